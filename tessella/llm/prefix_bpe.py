"""Byte-level BPE by prefix dynamic programming.

For every prefix of a pre-token there is one last token that a valid encoding of the prefix can end in.
Storing that token for each prefix gives the encoding by walking back from the end, makes appending bytes
exact (old entries never change), and lets an edit keep every entry before the edited byte.

Rows: null text counts as empty and has no ids; repeated rows are each encoded; an empty table gives an
empty table; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import buffers, rest, runs, spread
from .tokenizing import PIECE_BYTES, PieceCache, cuts, _loaded

#: Pairs whose validity, and pre-tokens whose ids, a worker remembers.
VALID_PAIRS = 400_000
WORDS = 200_000


class PrefixBpe:
    """Vocabulary of mergeable ranks with the split of each token into the pair that makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Merged token by left << 32 | right, and the parts of each token.
        self.pair: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.valid: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                left, right = self._parts(token)
                self.split[rank] = (left, right)
                self.pair[left << 32 | right] = rank

    def _parts(self, token: bytes) -> tuple[int, int]:
        """The two tokens that merges of lower rank leave of a token."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: self.pair.get(parts[i] << 32 | parts[i + 1], 1 << 60))
            parts[at : at + 2] = [self.pair[parts[at] << 32 | parts[at + 1]]]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and then right is the encoding of their bytes: no merge across the border comes before both are whole."""
        found = self._check(left, right)
        if len(self.valid) < VALID_PAIRS:
            self.valid[left << 32 | right] = found
        return found

    def _check(self, a: int, b: int) -> bool:
        # Take apart the younger of the two bordering tokens until a merge over the border would have come first.
        pair, split, limit = self.pair.get, self.split.get, 1 << 60
        while True:
            merged = pair(a << 32 | b)
            if merged is not None and merged < limit:
                return False
            if a > b:
                limit = a
                parts = split(a)
                if parts is None:
                    limit = b + 1
                    parts = split(b)
                    if parts is None:
                        return True
                    b = parts[0]
                else:
                    a = parts[1]
            else:
                limit = b + 1
                parts = split(b)
                if parts is None:
                    limit = a
                    parts = split(a)
                    if parts is None:
                        return True
                    a = parts[1]
                else:
                    b = parts[0]


def last_tokens(bpe: PrefixBpe, whole: bytes, last: list[int]) -> list[int]:
    """Extends ``last``, the last tokens of a bytes string's first prefixes, to all prefixes."""
    token_of, known, compatible, longest = bpe.ranks.get, bpe.valid.get, bpe.compatible, bpe.longest
    for end in range(len(last) + 1, len(whole) + 1):
        for begin in range(end - longest if end > longest else 0, end):
            token = token_of(whole[begin:end])
            if token is None:
                continue
            if begin:
                before = last[begin - 1]
                valid = known(before << 32 | token)
                if valid is None:
                    valid = compatible(before, token)
                if not valid:
                    continue
            last.append(token)
            break
        else:
            raise ValueError("a byte isn't in the vocabulary")
    return last


def walk_back(bpe: PrefixBpe, last: list[int]) -> list[int]:
    out, at, size = [], len(last), bpe.size
    while at:
        token = last[at - 1]
        out.append(token)
        at -= size[token]
    out.reverse()
    return out


class PrefixEncoder:
    """Encoding of one growing and editable byte string; ``last[i]`` is the last token of the prefix of i + 1 bytes."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        last_tokens(self.bpe, bytes(self.data), self.last)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces bytes start to end; prefixes before start keep their entries, and the rest is done again."""
        tail = bytes(self.data[end:])
        del self.data[start:], self.last[start:]
        self.append(new + tail)

    def ids(self) -> list[int]:
        return walk_back(self.bpe, self.last)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_tokenizer(path: str, pattern: str) -> tuple[PieceCache, PrefixBpe]:
    """A cache of pieces encoded by prefix dynamic programming; one a worker process."""
    if (key := ("ranks", path, pattern)) not in _loaded:
        bpe, find = PrefixBpe(load_ranks(path)), regex.compile(pattern).findall

        words: dict[str, list[int]] = {}

        def encode_pieces(pieces: list[bytes]):
            ids, lengths = [], []
            if len(words) > WORDS:
                words.clear()
            for piece in pieces:
                before = len(ids)
                for match in find(piece.decode()):
                    own = words.get(match)
                    if own is None:
                        raw = match.encode()
                        token = bpe.ranks.get(raw)
                        own = words[match] = [token] if token is not None else walk_back(bpe, last_tokens(bpe, raw, []))
                    ids += own
                lengths.append(len(ids) - before)
            return np.array(ids, np.uint32), np.array(lengths, np.int64), range(len(pieces))

        _loaded[key] = (PieceCache(encode_pieces), bpe)
    return _loaded[key]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text."""

    def encode(batches):
        cache, _ = rank_tokenizer(ranks, pattern)
        for batch in batches:
            for first, ids, offs in cache.encode(*buffers(batch.column(1))):
                raw = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), raw], ["doc_id", "ids"])

    return rest(docs, [id_col], text_col).withColumnsRenamed({id_col: "doc_id"}).mapInArrow(encode, "doc_id long, ids binary")


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in one buffer, with each token's start and length."""
    if (key := ("bytes", path)) not in _loaded:
        found = load_ranks(path)
        table = [b""] * (max(found.values()) + 1)
        for b, i in found.items():
            table[i] = b
        lengths = np.array([len(b) for b in table], np.int64)
        _loaded[key] = (np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return _loaded[key]


def decode_batch(batch: pa.RecordBatch, ranks: str):
    """(first row, ids, id offsets, bytes, byte offsets) of runs of rows; the second column holds the ids."""
    flat, starts, lengths = token_bytes(ranks)
    data, offs = buffers(batch.column(1))
    for i, j in runs(offs, PIECE_BYTES):
        ids = data[offs[i] : offs[j]].view("<u4")
        at = (offs[i : j + 1] - offs[i]) // 4
        sizes = lengths[ids]
        yield i, ids, at, flat[spread(starts[ids], sizes)], np.concatenate([[0], np.cumsum(sizes)])[at]


def decode_documents(encoded: DataFrame, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and the bytes that the ids stand for."""

    def decode(batches):
        for batch in batches:
            for i, _, at, raw, ends in decode_batch(batch, ranks):
                n = len(at) - 1
                text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(np.diff(at)), text], ["doc_id", "n_tokens", "bytes"])

    return encoded.select(id_col, "ids").mapInArrow(decode, "doc_id long, n_tokens long, bytes binary")
