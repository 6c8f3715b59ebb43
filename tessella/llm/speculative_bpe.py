"""Byte-level BPE by speculation: greedy longest matches are proposed, every adjacent pair is verified, and words with a
pair that fails are merged exactly.

A sequence of tokens is the encoding of its bytes if each two neighbours are the encoding of theirs. So the longest
matches of all words of a batch are found at once by a walk of a trie, all neighbours are tested at once by taking the
later made token of each pair apart, and merges are played one by one only for the words that hold a wrong pair.

Rows: null text counts as empty and has no ids; repeated rows are each encoded; an empty table gives an empty table;
columns other than the id and the text are ignored. Strings of special tokens inside a text give their ids, as in the
library's default. Memory is that of the longest text, of one batch of stretches and of the remembered ones.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import buffers, rest, runs, spread
from .tokenizing import PIECE_BYTES, PieceCache, _loaded

#: Bytes of pieces that are proposed and verified at once (a longer piece stands alone).
BATCH_BYTES = 1 << 20
_NEVER = 1 << 40
_ASCII_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", regex.ASCII)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 letters stand for themselves, and
    the other bytes in order for the letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class SpeculativeBpe:
    """A vocabulary as arrays. Tokens are numbered in the order they are made: bytes, then the product of each merge."""

    def __init__(self, spec: dict):
        from tokenizers import pre_tokenizers

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = model["vocab"]
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]
        number = {b: k for k, b in enumerate(self.bytes)}
        self.left, self.right = (np.full(256 + len(model["merges"]), -1, np.int64) for _ in range(2))
        for k, merge in enumerate(model["merges"], 256):
            a, b = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            if a + b in number or a not in number or b not in number:
                raise ValueError("a merge repeats a token or comes before its parts")
            self.left[k], self.right[k] = number[a], number[b]
            number[a + b] = k
            self.bytes.append(a + b)
        by_letters = {b: c for c, b in letters.items()}
        self.ids = np.array([vocab["".join(by_letters[x] for x in b)] for b in self.bytes], np.uint32)
        keys = self.left[256:] << 32 | self.right[256:]
        self.pair = dict(zip(keys.tolist(), range(256, len(self.bytes))))
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], order + 256
        made = np.arange(256, len(self.bytes))
        whole = np.ones(len(self.bytes), bool)
        whole[256:] = self.compatible(self.left[256:], self.right[256:], made)
        for k in np.flatnonzero(~whole[self.left[256:]] | ~whole[self.right[256:]]).tolist():
            whole[k + 256] = whole[self.left[k + 256]] and whole[self.right[k + 256]] and whole[k + 256]
        self._trie([b if w else None for b, w in zip(self.bytes, whole.tolist())])
        self.special: dict[bytes, int] = {}
        for t in spec.get("added_tokens") or []:
            if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(c.isspace() for c in t["content"]):
                raise ValueError("an added token has rules of its own")
            self.special[t["content"].encode()] = t["id"]
        names = sorted(self.special, key=len, reverse=True)
        self.any_special = regex.compile(b"|".join(map(regex.escape, names))) if names else None
        self.pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def _trie(self, tokens: list[bytes | None]) -> None:
        """Nodes 1 to 256 stand for one byte; edges are (node, byte) in order."""
        edges, at_node = {}, list(range(-1, 256))
        for number, token in enumerate(tokens[256:], 256):
            if token is None:
                continue
            node = token[0] + 1
            for b in token[1:]:
                node = edges.setdefault(node << 8 | b, len(at_node))
                if node == len(at_node):
                    at_node.append(-1)
            at_node[node] = number
        keys = np.array(sorted(edges), np.int64)
        self.edges, self.child = keys, np.array([edges[k] for k in keys.tolist()], np.int64)
        self.number_at = np.array(at_node, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int = _NEVER) -> np.ndarray:
        """Whether a then b is the encoding of their bytes, for all pairs at once; merges from ``limit`` on don't count.

        The later made token of a pair is taken apart until a merge over the border would have come before it."""
        a, b = a.copy(), b.copy()
        limit = np.broadcast_to(np.asarray(limit, np.int64), a.shape).copy()
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_made[at] < limit)
            out[live[clash]] = False
            go = ~clash & (np.maximum(a, b) >= 256)
            live, a, b = live[go], a[go], b[go]
            later = a > b  # of equals the left one is made first
            limit = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def longest(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and length of the longest token that starts at each byte and ends within ``room`` bytes."""
        token, length, node = data.astype(np.int64), np.ones(len(data), np.int64), data.astype(np.int64) + 1
        live, depth = np.flatnonzero(room > 1), 1
        while len(live):
            key = node[live] << 8 | data[live + depth]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            live, at = live[hit], at[hit]
            node[live] = self.child[at]
            depth += 1
            made = self.number_at[node[live]]
            token[live[made >= 0]], length[live[made >= 0]] = made[made >= 0], depth
            live = live[room[live] > depth]
        return token, length

    def merged(self, word: bytes) -> list[int]:
        """The word's tokens by playing its merges: the earliest in the vocabulary first, of equals the leftmost."""
        token, n, pair = list(word), len(word), self.pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := pair(token[i] << 32 | token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= n or pair(token[i] << 32 | token[j]) != m:
                continue
            token[i], token[j] = m, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := pair(m << 32 | token[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := pair(token[p] << 32 | m)) is not None:
                heapq.heappush(heap, (x, p))
        return [t for t in token if t >= 0]

    def words(self, piece: bytes) -> list[int]:
        """Bytes of each word of a piece. Beyond ASCII the library's own classes of letters hold."""
        text = piece.decode()
        return [len(m) for m in _ASCII_WORDS.findall(text)] if piece.isascii() else [len(m) for m, _ in self.pre.pre_tokenize_str(text)]

    def encode_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of consecutive words, and how many each has."""
        ends = np.cumsum(sizes)
        token, length = self.longest(data, np.repeat(ends, sizes) - np.arange(len(data)))
        step, starts, at = length.tolist(), [], 0
        while at < len(step):  # no match crosses a word's end, so this visits the start of every word
            starts.append(at)
            at += step[at]
        starts = np.array(starts, np.int64)
        proposed, word = token[starts], np.searchsorted(ends, starts, "right")
        counts = np.bincount(word, minlength=len(sizes))
        inner = np.flatnonzero(word[1:] == word[:-1])
        if not len(inner):
            return proposed, counts
        pairs, inverse = np.unique(proposed[inner] << 32 | proposed[inner + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        wrong = np.unique(word[inner[~fine[inverse]]])
        if not len(wrong):
            return proposed, counts
        raw, known = data.tobytes(), {}
        exact = []
        for a, b in zip((ends[wrong] - sizes[wrong]).tolist(), ends[wrong].tolist()):
            found = known.get(raw[a:b])
            if found is None:
                found = known[raw[a:b]] = self.merged(raw[a:b])
            exact.append(found)
        lengths = np.array([len(x) for x in exact], np.int64)
        failed = np.zeros(len(sizes), bool)
        failed[wrong] = True
        flat = np.concatenate([proposed[~failed[word]], np.array([t for x in exact for t in x], np.int64)])
        begin, many = np.empty(len(sizes), np.int64), counts.copy()
        begin[~failed] = np.cumsum(counts[~failed]) - counts[~failed]
        begin[wrong] = (~failed[word]).sum() + np.cumsum(lengths) - lengths
        many[wrong] = lengths
        return flat[spread(begin, many)], many

    def encode_run(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces without special tokens, and how many each has."""
        sizes = [self.words(p) for p in pieces]
        numbers, counts = self.encode_words(np.frombuffer(b"".join(pieces), np.uint8), np.array([n for s in sizes for n in s], np.int64))
        upto = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, sizes)])]
        return self.ids[numbers], np.diff(upto)

    def encode_special(self, piece: bytes) -> np.ndarray:
        """ids of a piece that holds strings of special tokens: what lies between them is encoded on its own."""
        out, at = [], 0
        for m in [*self.any_special.finditer(piece), None]:
            if len(between := piece[at : m.start() if m else len(piece)]):
                out.append(self.encode_run([between])[0])
            if m:
                out.append(np.array([self.special[m[0]]], np.uint32))
                at = m.end()
        return np.concatenate(out)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Flat ids, counts and the pieces' order there."""
        odd = [k for k, p in enumerate(pieces) if self.any_special and self.any_special.search(p)]
        odd_set = set(odd)
        plain = [k for k in range(len(pieces)) if k not in odd_set] if odd else list(range(len(pieces)))
        flat, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        offsets = np.cumsum([0, *[len(pieces[k]) for k in plain]])
        for i, j in runs(offsets, BATCH_BYTES):
            ids, counts = self.encode_run([pieces[k] for k in plain[i:j]])
            flat.append(ids)
            lengths.append(counts)
        for k in odd:
            flat.append(self.encode_special(pieces[k]))
            lengths.append(np.array([len(flat[-1])]))
        return np.concatenate(flat), np.concatenate(lengths), plain + odd


def tokenizer(path: str) -> tuple[SpeculativeBpe, PieceCache]:
    """The vocabulary and a cache of pieces; one a worker process."""
    if (key := ("speculative", path)) not in _loaded:
        with open(path, encoding="utf-8") as f:
            bpe = SpeculativeBpe(json.load(f))
        _loaded[key] = (bpe, PieceCache(bpe.encode_pieces))
    return _loaded[key]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text."""

    def encode(batches):
        _, cache = tokenizer(path)
        for batch in batches:
            for first, ids, offs in cache.encode(*buffers(batch.column(1))):
                raw = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), raw], ["doc_id", "ids"])

    return rest(docs, [id_col], text_col).withColumnsRenamed({id_col: "doc_id"}).mapInArrow(encode, "doc_id long, ids binary")


def id_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids in one buffer, special ones included, with each id's start and length."""
    if (key := ("id bytes", path)) not in _loaded:
        bpe, _ = tokenizer(path)
        named = dict(zip(bpe.ids.tolist(), bpe.bytes)) | {i: b for b, i in bpe.special.items()}
        table = [named.get(i, b"") for i in range(max(named) + 1)]
        lengths = np.array([len(b) for b in table], np.int64)
        _loaded[key] = (np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return _loaded[key]


def decode_batch(batch: pa.RecordBatch, path: str):
    """(first row, ids, id offsets, texts in UTF-8) of runs of rows; the second column holds the ids. Bytes that are no
    UTF-8 become replacement characters."""
    flat, starts, lengths = id_bytes(path)
    data, offs = buffers(batch.column(1))
    for i, j in runs(offs, PIECE_BYTES):
        ids = data[offs[i] : offs[j]].view("<u4")
        at = (offs[i : j + 1] - offs[i]) // 4
        sizes = lengths[ids]
        raw = flat[spread(starts[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
        yield i, ids, at, [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:])]


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and the text that the ids stand for, special tokens included."""

    def decode(batches):
        for batch in batches:
            for i, _, at, texts in decode_batch(batch, path):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(np.diff(at)), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_tokens", "text"])

    return encoded.select(id_col, "ids").mapInArrow(decode, "doc_id long, n_tokens long, text string")
