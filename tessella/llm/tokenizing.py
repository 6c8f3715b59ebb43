"""Exact tokenisation of Arrow text batches that encodes each distinct stretch of text once per worker.

Text is cut before a space or line feed that follows a visible character. No pre-token of the public
pre-tokenisers used here crosses such a place, so the ids of a text are those of its pieces in order.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import runs, spread

PIECE_BYTES = 1 << 20
#: Memory of the pieces that a worker remembers, by generation: the recent ones, and as much again of older ones.
CACHE_BYTES = 40 << 20
#: Bytes of the longest piece that is remembered.
SHORT = 15
#: Pieces that the library encodes in one call.
GROUP = 4096
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_loaded: dict[tuple, "PieceCache"] = {}


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces: each row's start, and each ' ' or line feed after a visible character."""
    n = len(data)
    mask = (data == 32) | (data == 10)
    before = np.zeros(n, bool)
    prev = data[:-1]
    before[1:] = (prev > 32) & (prev != 127)
    wide = np.flatnonzero(mask[2:] & (data[1:-1] >= 128)) + 2 if n > 2 else np.empty(0, np.int64)
    if len(wide):  # Unicode white space before the place: leave it uncut
        b, a = data[wide - 2], data[np.maximum(wide - 3, 0)]
        odd = ((b == 0xC2) & ((data[wide - 1] == 0x85) | (data[wide - 1] == 0xA0))) | ((a >= 0xE1) & (a <= 0xE3) & ((b == 0x80) | (b == 0x81) | (b == 0x9A)))
        before[wide[odd]] = False
    mask &= before
    starts = offsets[:-1][np.diff(offsets) > 0]
    mask[starts] = True
    return np.flatnonzero(mask)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's first 15 bytes and its length as two 64-bit words: exact for pieces of SHORT bytes at most."""
    at = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), 0, (1,))
    low, high = at[starts], at[np.minimum(starts + 8, len(data))]
    return low & _KEEP[np.minimum(lengths, 8)], high & _KEEP[np.clip(lengths - 8, 0, 7)] | np.minimum(lengths, 255).astype(np.uint64) << np.uint64(56)


class PieceTable:
    """ids of short pieces by their two words, as arrays: ``hashes`` in order with the slot of each, the rest by slot."""

    def __init__(self):
        self.hashes, self.low, self.high, self.ids = (np.empty(0, t) for t in (np.uint64, np.uint64, np.uint64, np.uint32))
        self.slots, self.starts, self.counts = (np.empty(0, np.int32) for _ in range(3))

    def size(self) -> int:
        return sum(x.nbytes for x in vars(self).values())

    def find(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slots of the pieces, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        slots = self.slots[at]
        return np.where((self.hashes[at] == hashes) & (self.low[slots] == low) & (self.high[slots] == high), slots, np.int32(-1))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether pieces, these or others, have the hashes."""
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def get(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces in these slots, and their counts."""
        counts = self.counts[slots].astype(np.int64)
        return self.ids[spread(self.starts[slots], counts)], counts

    def add(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Takes pieces with ascending hashes that it doesn't hold, and their ids."""
        at = np.searchsorted(self.hashes, hashes)
        n = len(self.low)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.slots = np.insert(self.slots, at, np.arange(n, n + len(low), dtype=np.int32))
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.low, self.high, self.ids = (np.concatenate(x) for x in ((self.low, low), (self.high, high), (self.ids, ids.astype(np.uint32))))
        self.starts, self.counts = (np.concatenate([x, y.astype(np.int32)]) for x, y in ((self.starts, starts), (self.counts, counts)))


class PieceCache:
    """ids of pieces seen so far by this worker; ``encode_pieces`` maps byte pieces to flat ids, their counts and the pieces' order there.

    Pieces of SHORT bytes at most are remembered, in two generations of ``cache_bytes``; longer ones, and a piece whose
    hash belongs to another one, are encoded wherever they stand."""

    def __init__(self, encode_pieces, run_bytes: int = PIECE_BYTES, cache_bytes: int = CACHE_BYTES):
        self.encode_pieces, self.run_bytes, self.cache_bytes = encode_pieces, run_bytes, cache_bytes
        self.known, self.older = PieceTable(), PieceTable()

    def encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces in their order, and their counts."""
        flat, lengths, order = self.encode_pieces(pieces)
        starts, counts = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        starts[order], counts[order] = np.cumsum(lengths) - lengths, lengths
        return flat[spread(starts, counts)], counts

    def lookup(self, raw: bytes, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slots of different short pieces, by ascending hash, among the known ones; -1 where another piece has the hash."""
        if self.known.size() > self.cache_bytes:
            self.known, self.older = PieceTable(), self.known
        old = self.older.find(hashes, low, high)
        for recall in (True, False):
            new = ~self.known.holds(hashes)
            k = np.flatnonzero(new & (old >= 0) if recall else new)
            if len(k):
                found = self.older.get(old[k]) if recall else self.encoded([raw[a : a + n] for a, n in zip(starts[k].tolist(), lengths[k].tolist())])
                self.known.add(hashes[k], low[k], high[k], *found)
        return self.known.find(hashes, low, high)

    def pieces(self, part: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of different pieces, and where each piece's ids begin there, and how many they are."""
        lengths, raw = np.diff(starts, append=len(part)), part.tobytes()
        low, high = words(part, starts, lengths)
        hashes = mixed(low ^ mixed(high))
        own = lengths > SHORT
        short = np.flatnonzero(~own)
        some, first, inverse = np.unique(hashes[short], return_index=True, return_inverse=True)
        first = short[first]
        slots = self.lookup(raw, starts[first], lengths[first], some, low[first], high[first])
        flat, counts = self.known.get(slots[slots >= 0])
        at, many = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        at[slots >= 0], many[slots >= 0] = np.cumsum(counts) - counts, counts
        same = (low[first][inverse] == low[short]) & (high[first][inverse] == high[short]) & (slots >= 0)[inverse]
        own[short[~same]] = True
        begin, length = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begin[short], length[short] = at[inverse], many[inverse]
        if len(k := np.flatnonzero(own)):
            more, counts = self.encoded([raw[a : a + n] for a, n in zip(starts[k].tolist(), lengths[k].tolist())])
            begin[k], length[k] = len(flat) + np.cumsum(counts) - counts, counts
            flat = np.concatenate([flat, more.astype(np.uint32)])
        return flat, begin, length

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None):
        """Yields (first row, flat ids, id offsets) for runs of rows; end_id is put after each row."""
        for i, j in runs(offsets, self.run_bytes):
            part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(part):
                starts = cuts(part, offs)
                flat, begin, lengths = self.pieces(part, starts)
                ids = flat[spread(begin, lengths)]
                sums = np.concatenate([[0], np.cumsum(lengths)])
                id_offs = sums[np.searchsorted(starts, offs)]
            else:
                ids, id_offs = np.empty(0, np.uint32), np.zeros(j - i + 1, np.int64)
            if end_id is not None:
                out = np.full(len(ids) + j - i, end_id, np.uint32)
                where = np.repeat(np.arange(j - i), np.diff(id_offs)) + np.arange(len(ids))
                out[where] = ids
                ids, id_offs = out, id_offs + np.arange(j - i + 1)
            yield i, ids, id_offs


def public_file(name: str) -> str:
    """The place of a public vocabulary file, as installed on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Pieces with a known number of words for tokenizers that mark each word's last token: letters, then perhaps points.
_WORDS = re.compile(rb"[ \n][A-Za-z]+([.,;:!?]*)\Z")


def library_tokenizer(path: str, special_text: bool = True, run_bytes: int = PIECE_BYTES, cache_bytes: int = CACHE_BYTES) -> PieceCache:
    """A PieceCache over a file of the tokenizers library; one a worker process. As in the library, the strings of special
    tokens within a text give their ids, unless special_text is False: they are ordinary text then."""
    if (key := ("library", path, special_text, run_bytes, cache_bytes)) not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = not special_text
        _loaded[key] = PieceCache(LibraryPieces(model), run_bytes, cache_bytes)
    return _loaded[key]


class LibraryPieces:
    """Encodes many pieces in one text. Where a piece ends is read from the ids: byte-level models by a token with a space or
    line feed in front that follows a visible character, models with word ends by the number of words, others by a mark."""

    def __init__(self, model):
        self.model = model
        spec = json.loads(model.to_str())
        self.mark, self.mark_id = next((c, x[0]) for c in "†‡•§¶" if len(x := self.ids_of(f" {c}")) == 1)
        vocab = sorted(model.get_vocab().items(), key=lambda x: x[1])
        self.head, self.tail, self.last = (np.zeros(vocab[-1][1] + 1, bool) for _ in range(3))
        by_bytes = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        word_end = spec["model"].get("end_of_word_suffix")
        for token, i in vocab:
            self.head[i] = token[0] in "ĠĊ"  # a space or a line feed in byte-level vocabularies
            self.tail[i] = "!" <= token[-1] <= "~"
            self.last[i] = bool(word_end) and token.endswith(word_end)
        self.kind = "bytes" if by_bytes else "words" if word_end else "marks"

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def ends(self, pieces: list[bytes], counts: list[int]) -> tuple[np.ndarray, np.ndarray] | None:
        """ids of the pieces in one text, and each piece's end there; None if they can't be told."""
        ids = self.ids_of(b"".join(pieces).decode())
        if self.kind == "bytes":
            ends = np.append(np.flatnonzero(self.head[ids[1:]] & self.tail[ids[:-1]]) + 1, len(ids))
        else:
            words = np.flatnonzero(self.last[ids]) + 1
            upto = np.cumsum(counts)
            if len(words) != upto[-1]:
                return None
            ends = words[upto - 1]
        return (ids, ends) if len(ends) == len(pieces) else None

    def marked(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        mark = f" {self.mark}".encode()
        ids = self.ids_of((mark.join(pieces) + mark).decode())
        at = np.flatnonzero(ids == self.mark_id)
        return (np.delete(ids, at), at - np.arange(len(at))) if len(at) == len(pieces) else None

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        plain, marked, alone, counts = [], [], [], {}
        for k, p in enumerate(pieces):
            if not (p[0] in b" \n" and 32 < p[-1] < 127):
                alone.append(k)
            elif self.kind == "bytes":
                plain.append(k)
            elif self.kind == "words" and (m := _WORDS.match(p)):
                plain.append(k)
                counts[k] = 1 + (m.end(1) > m.start(1))
            elif self.mark.encode() not in p:
                marked.append(k)
            else:
                alone.append(k)
        flat, lengths, order = [], [], []
        for members, by_mark in ((plain, False), (marked, True)):
            for at in range(0, len(members), GROUP):
                group = members[at : at + GROUP]
                own = [pieces[k] for k in group]
                found = self.marked(own) if by_mark else self.ends(own, [counts.get(k, 1) for k in group])
                if found is None:
                    alone += group
                    continue
                flat.append(found[0])
                lengths.append(np.diff(found[1], prepend=0))
                order += group
        for at in range(0, len(alone), GROUP):
            found = [x.ids for x in self.model.encode_batch_fast([pieces[k].decode() for k in alone[at : at + GROUP]], add_special_tokens=False)]
            flat += [np.array(x, np.uint32) for x in found]
            lengths.append(np.array([len(x) for x in found]))
        return np.concatenate(flat).astype(np.uint32), np.concatenate(lengths).astype(np.int64), order + alone
