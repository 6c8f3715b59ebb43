"""Sum-of-squares online packing of token sequences.

Each task packs the documents it reads, one after the other. A level array counts the open windows by
fill; a document (or what is left of it after whole windows) goes to the fill level that makes the sum of
squared counts smallest, a new window included. At the end of a task, and whenever the open windows hold more
than MOST_OPEN tokens (so a task's memory is bounded), the emptiest open windows are cut up to fill the fullest
ones. The single window left over stays open, and at the end it is cut at powers of two, so nothing is padded.

Null text counts as empty; every document ends with ``end_id``, so none is without a piece. Repeated rows
are packed each for itself. Ties go to the fuller window. An empty table gives no row. Of other columns
nothing is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import buffers, rest
from .tokenizing import library_tokenizer

WINDOW = 4096
#: Tokens that a task's open windows may hold, 4 bytes each.
MOST_OPEN = 2 << 20
#: Rows and tokens after which a task hands on what it has packed.
ROWS_OUT, TOKENS_OUT = 2000, 1 << 20
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SumOfSquares:
    """Places items of 1 to window tokens. A piece is a tuple (document, start, ids, document's tokens)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)  # open windows by fill; level 0 and a full window count nothing
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.held = 0

    def best_fill(self, size: int) -> int:
        """The fill whose window is to take an item of this size; 0: a new window."""
        n, top = self.level, self.window - size
        cost = np.where(n[: top + 1] > 0, 1 - 2 * n[: top + 1], 1 << 40)
        cost[0] = 0
        cost += 1 + 2 * n[size : self.window + 1]
        cost[top] -= 1  # a window that gets full leaves the array
        return top - int(np.argmin(cost[::-1]))

    def add(self, piece: tuple) -> list | None:
        """Puts the piece in; returns its window's pieces if that is full now."""
        size = len(piece[2])
        fill = self.best_fill(size)
        if fill:
            pieces = self.open[fill].pop()
            self.level[fill] -= 1
        else:
            pieces = []
        pieces.append(piece)
        self.held += size
        if fill + size == self.window:
            self.held -= self.window
            return pieces
        self.open[fill + size].append(pieces)
        self.level[fill + size] += 1
        return None

    def settle(self) -> tuple[list[list], list[tuple]]:
        """Full windows made of the open ones, and the pieces that are too few for another; none stays open."""
        left = [(fill, pieces) for fill, group in enumerate(self.open) for pieces in group]
        out, low, high = [], 0, len(left) - 1
        spare: list[tuple] = []  # pieces of cut-up windows
        while low <= high:
            fill, pieces = left[high]
            high -= 1
            need = self.window - fill
            while need and (spare or low <= high):
                if not spare:
                    spare = list(left[low][1])
                    low += 1
                head, tail = cut(spare.pop(), need)
                pieces.append(head)
                need -= len(head[2])
                if tail:
                    spare.append(tail)
            if need:
                spare = pieces
            else:
                out.append(pieces)
        self.level[:], self.held = 0, 0
        self.open = [[] for _ in range(self.window)]
        return out, spare

    def shrink(self) -> list[list]:
        """Closes the open windows but one."""
        out, spare = self.settle()
        if size := sum(len(p[2]) for p in spare):
            self.open[size].append(spare)
            self.level[size], self.held = 1, size
        return out

    def finish(self) -> list[list]:
        """The rest as windows that are full or hold a power of two."""
        out, spare = self.settle()
        size = sum(len(p[2]) for p in spare)
        while size:
            part = 1 << (size.bit_length() - 1)
            size -= part
            pieces = []
            while part:
                head, tail = cut(spare.pop(), part)
                pieces.append(head)
                part -= len(head[2])
                if tail:
                    spare.append(tail)
            out.append(pieces)
        return out


def cut(piece: tuple, most: int) -> tuple[tuple, tuple | None]:
    doc, start, ids, tokens = piece
    return (doc, start, ids[:most], tokens), (doc, start + most, ids[most:], tokens) if len(ids) > most else None


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the document, the piece's first id and length there, its window and place in it, and its
    ids as little-endian unsigned 32-bit integers. A document whose id is null keeps a null ``doc_id``."""

    def pack(batches):
        model, packer = library_tokenizer(tokenizer), SumOfSquares(window)
        sequence = (TaskContext.get().partitionId() << 40) - 1
        rows: list[tuple] = []
        waiting = 0

        def emit(pieces):
            nonlocal sequence, waiting
            waiting += window
            sequence, offset = sequence + 1, 0
            for doc, start, ids, tokens in pieces:
                rows.append((doc, start, len(ids), tokens, sequence, offset, ids.astype("<u4").tobytes()))
                offset += len(ids)

        def flush():
            nonlocal waiting
            cols, waiting = list(zip(*rows)) or [[]] * 7, 0
            rows.clear()
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, offs in model.encode(*buffers(batch.column(1)), end_id=end_id):
                for k in range(len(offs) - 1):
                    own, doc = ids[offs[k] : offs[k + 1]], names[first + k]
                    whole = len(own) // window * window
                    for at in range(0, whole, window):
                        emit([(doc, at, own[at : at + window], len(own))])
                    if whole < len(own):
                        if full := packer.add((doc, whole, own[whole:].copy(), len(own))):
                            emit(full)
                    if packer.held > MOST_OPEN:
                        for pieces in packer.shrink():
                            emit(pieces)
                    if len(rows) >= ROWS_OUT or waiting >= TOKENS_OUT:
                        yield flush()
        for pieces in packer.finish():
            emit(pieces)
            if len(rows) >= ROWS_OUT:
                yield flush()
        yield flush()

    return rest(docs, [id_col], text_col).mapInArrow(pack, PIECE_SCHEMA)
