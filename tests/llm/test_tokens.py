"""Token store, packing and prefix encoding against the libraries and brute force."""

import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessella.llm import packing, prefix_bpe, registry, wavelet
from tessella.llm.tokenizing import library_tokenizer, public_file

TEXTS = [
    (5, "The quick  brown\tfox\n\n jumps  over   † it's  "), (3, None), (4, ""), (1, " \n\t \n x"), (1, " \n\t \n x"), (9, "　 a\u0085 b\x1c c\x7f d"),
    (7, "Éa ñ <|endoftext|> İstanbul 😀 don't WE'LL 123456" * 40), (8, "x" * 9000), (None, "no id"), (2, "a\r\n b  c  d é f"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, start int")


@functools.cache
def library_model(name):
    return Tokenizer.from_file(public_file(name))


def reference(name, text):
    return library_model(name).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_ids(name):
    rng = random.Random(7)
    texts = [t or "" for _, t in TEXTS] + ["".join(rng.choice(" \n\t\r.,'s†aébB1   　́") for _ in range(60)) for _ in range(400)]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    got = {}
    for first, ids, at in library_tokenizer(public_file(name)).encode(np.frombuffer(b"".join(raw), np.uint8), offs, 2):
        got |= {first + k: ids[at[k] : at[k + 1]].tolist() for k in range(len(at) - 1)}
    assert [got[k] for k in range(len(texts))] == [reference(name, t) for t in texts]


def test_special_strings_can_be_ordinary_text():
    model = Tokenizer.from_file(public_file("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    raw = b"a <|endoftext|> b<|endoftext|>"
    (_, ids, _), *_ = library_tokenizer(public_file("byte_bpe_50k.json"), special_text=False).encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert ids.tolist() == model.encode(raw.decode(), add_special_tokens=False).ids and 50256 not in ids


def test_few_open_windows_are_kept():
    """Closing windows early keeps every id, and no window is padded."""
    rng, p, out = random.Random(9), packing.SumOfSquares(64), []
    sizes = [rng.randrange(1, 65) for _ in range(500)]
    for d, n in enumerate(sizes):
        if full := p.add((d, 0, np.full(n, d, np.uint32), n)):
            out.append(full)
        assert p.held == sum(f * int(c) for f, c in enumerate(p.level))
        if p.held > 300:
            out += p.shrink()
            assert p.held < 64
    rest = p.finish()
    assert all(sum(len(x[2]) for x in w) == 64 for w in out)
    found = {}
    for w in out + rest:
        for d, start, ids, _ in w:
            found.setdefault(d, []).append((start, len(ids)))
    for d, n in enumerate(sizes):
        at = 0
        for start, length in sorted(found[d]):
            assert start == at
            at += length
        assert at == n


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(3)
    ids = rng.choice([2, 7, 500, 50256, 33], 3000)
    m, docs, lengths = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes(np.array([4, 9]), np.array([1000, 2000])))
    assert (m.decode() == ids).all() and docs.tolist() == [4, 9] and lengths.tolist() == [1000, 2000]
    for i in (0, 1, 511, 512, 513, 2047, 2999):
        assert m.access(i) == ids[i]
    for v in (2, 7, 50256, 11):
        places = np.flatnonzero(ids == v)
        assert [m.rank(v, i) for i in (0, 1, 512, 1999, 3000)] == [int((ids[:i] == v).sum()) for i in (0, 1, 512, 1999, 3000)]
        for k in range(0, len(places), 97):
            assert m.select(v, k) == places[k]
    with pytest.raises(IndexError):
        m.select(11, 0)


def test_token_store_round_trip(spark, docs):
    shards = wavelet.token_store(docs, public_file("byte_bpe_50k.json"))
    rows = wavelet.read_documents(shards).collect()
    assert len(rows) == len(TEXTS)
    want = [(i, reference("byte_bpe_50k.json", t)) for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))]
    at = 0
    for row, (i, ids) in zip(sorted(rows, key=lambda r: r.start), want):
        assert (row.doc_id, row.start, row.n_tokens) == (i, at, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        at += len(ids)


def test_small_shards_hold_whole_documents(spark, docs):
    shards = wavelet.write_shards(docs.repartition(3), public_file("byte_bpe_50k.json"), shard_tokens=64)
    rows = sorted(wavelet.read_documents(shards).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    assert wavelet.read_documents(wavelet.write_shards(docs.limit(0), public_file("byte_bpe_50k.json"))).count() == 0


def test_packing_keeps_each_id_once(spark, docs):
    many = docs.union(spark.range(300).selectExpr("id + 100", "repeat('some words here ', cast(1 + id * 13 % 200 as int))", "1"))
    rows = packing.pack_documents(many, public_file("word_bpe_49k.json"), window=128).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for s in seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s]])[:-1].tolist()
        size = sum(r.length for r in s)
        assert size == 128 or size & (size - 1) == 0
    for i, t in TEXTS:
        if i not in (1, None):
            pieces = sorted(by[i], key=lambda r: r.start)
            assert b"".join(r.ids for r in pieces) == np.array(reference("word_bpe_49k.json", t), "<u4").tobytes()
            assert {r.doc_tokens for r in pieces} == {sum(r.length for r in pieces)}
    assert packing.pack_documents(docs.limit(0), public_file("word_bpe_49k.json")).count() == 0


def test_best_fill_is_the_least_sum_of_squares():
    rng = random.Random(5)
    for _ in range(200):
        p = packing.SumOfSquares(16)
        for _ in range(rng.randrange(40)):
            p.add((0, 0, np.zeros(rng.randrange(1, 17), np.uint32), 0))
        size = rng.randrange(1, 17)

        def cost(fill):
            n = p.level.copy()
            n[fill] -= fill > 0
            if fill + size < 16:
                n[fill + size] += 1
            return int((n**2).sum())

        fills = [f for f in range(17 - size) if f == 0 or p.level[f]]
        assert cost(p.best_fill(size)) == min(map(cost, fills))


@pytest.fixture(scope="module")
def bpe():
    return prefix_bpe.rank_tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)[1]


def library(bpe):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_prefix_encoder_appends_and_edits(bpe):
    rng, lib = random.Random(2), library(bpe)
    for _ in range(300):
        e = prefix_bpe.PrefixEncoder(bpe)
        for _ in range(4):
            e.append(bytes(rng.choice(b"abetnh ou\xc3\xa9\xff") for _ in range(rng.randrange(9))))
            if e.data:
                a = rng.randrange(len(e.data))
                e.edit(a, min(len(e.data), a + rng.randrange(4)), bytes(rng.choice(b"the ") for _ in range(rng.randrange(5))))
            assert e.ids() == (lib._encode_single_piece(bytes(e.data)) if e.data else [])


def test_encode_decode_documents(spark, docs, bpe):
    encoded = prefix_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = prefix_bpe.decode_documents(encoded, P.path("byte_bpe_50k.tiktoken")).collect()
    lib = library(bpe)
    want = sorted(((t or "").encode(), len(lib.encode_ordinary(t or ""))) for _, t in TEXTS)
    assert sorted((bytes(r.bytes), r.n_tokens) for r in rows) == want
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()]
    assert sorted(ids) == sorted(lib.encode_ordinary(t or "") for _, t in TEXTS)


def test_queries_on_a_table(spark, sf):
    for name in ("op8_wavelet_tokens", "op9_sum_of_squares_packing", "op10_prefix_bpe"):
        rows = registry.QUERIES[name](spark, sf).collect()
        assert len({r.doc_id for r in rows}) == spark.read.parquet(f"{sf}/documents.parquet").count()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.QUERIES["op8_wavelet_tokens"](spark, sf).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(reference("byte_bpe_50k.json", text[r.doc_id]), "<u4").tobytes())
    lib = library(prefix_bpe.rank_tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)[1])
    for r in registry.QUERIES["op10_prefix_bpe"](spark, sf).collect():
        ids = lib.encode_ordinary(text[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest())
