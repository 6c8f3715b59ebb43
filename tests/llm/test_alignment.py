"""Alignment of two tokenizers and speculative encoding against the libraries and brute force."""

import collections
import hashlib
import json
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import alignment, registry, speculative_bpe
from tessella.llm.tokenizing import public_file

A, B = public_file("byte_bpe_50k.json"), public_file("piece_bpe_32k.model")
rng = random.Random(11)
TEXTS = [
    (5, "The quick  brown\tfox\n\n jumps  over   † it's  "), (3, None), (4, ""), (1, " \n\t \n x"), (1, " \n\t \n x"), (9, "　 a\u0085 b\x1c c\x7f d"), (8, "x" * 9000), (7, " "), (10, "abc "),
    (None, "no id"), (2, "a\r\n b  c  d é f"), (6, "Éa ñ <|endoftext|> İstanbul 😀 don't </s> <unk> WE'LL 123456" * 40), (11, "a ▁ place"), (12, "\n"), (13, "  " * 700 + "y"), (14, "漢字かな交じり文" * 60),
    *[(k, "".join(rng.choice("abcehnotu  \n\r.,'é†漢0 1") for _ in range(rng.randrange(200)))) for k in range(100, 160)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, part int")


def expected(texts):
    """Everything by looking at every pair of tokens of every document."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    letters = speculative_bpe.byte_letters()
    tokens = []
    for t in texts:
        tokens.append(([], []))
        if not t:
            continue
        a = [(i, bytes(letters[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + t, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()) for i in b_model.encode(t) for p in [b_model.id_to_piece(i)]]
        if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode():
            tokens[-1] = (a, b)
    out, counts = [], collections.Counter()
    for a, b in tokens:
        spans = []
        for side in (a, b):
            at, found = 0, []
            for i, raw in side:
                found.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(found)
        links = []
        j = 0
        for s, e, i in spans[0]:
            while j < len(spans[1]) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        counts.update(links)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for cut in common:
            groups.append("|".join(",".join(str(i) for s, e, i in side if last < e <= cut) for side in spans) if len(a) < 400 else None)
            last = cut
        out.append([len(a), len(b), len(common), links, groups])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and None not in groups else "" if not groups else None)
        for na, nb, ng, links, groups in out
    ]


def as_rows(df):
    return [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()]


def same(got, ids, want):
    rows = sorted(((i, *w) for i, w in zip(ids, want)), key=str)
    got = sorted(got, key=str)
    assert len(got) == len(rows)
    for g, w in zip(sorted(got, key=lambda r: str(r[:7])), sorted(rows, key=lambda r: str(r[:7]))):
        assert g[:7] == w[:7]
        assert w[7] is None or g[7] == w[7]


def test_documents_against_all_pairs(docs):
    same(as_rows(alignment.align_documents(docs, A, B)), [i for i, _ in TEXTS], expected([t for _, t in TEXTS]))


def test_parts_and_empty_tables(spark, docs, monkeypatch):
    whole = sorted(as_rows(alignment.align_documents(docs, A, B)), key=str)
    monkeypatch.setattr(alignment, "PART_BYTES", 300)
    assert sorted(as_rows(alignment.align_documents(docs.repartition(5), A, B)), key=str) == whole
    assert as_rows(alignment.align_documents(docs.limit(0), A, B)) == []
    assert as_rows(alignment.align_documents(docs.where("text is null"), A, B)) == [(3, 0, 0, 0, 0, 0, 0, "")]


def test_links_of_given_tokens(spark):
    """Tokens of any kind; a group that never cuts stays linear; frequent pairs joined by shuffling give the same."""
    sides = [([3, 2, 4], [5, 1, 3]), ([1] + [4] * 500, [3] + [4] * 499 + [2]), ([2, 2], [2, 2])]
    given = [(k, 10 + k, [(i % 3, n) for i, n in enumerate(a)], [(i % 5, n) for i, n in enumerate(b)]) for k, (a, b) in enumerate(sides)]
    tokens = spark.createDataFrame(given, "key long, occ long, a array<struct<id:int,size:int>>, b array<struct<id:int,size:int>>")
    linked = alignment.links(tokens).cache()
    found = sorted(tuple(r) for r in linked.collect())
    want, counts = [], collections.Counter()
    for key, occ, a, b in given:
        ends = [np.cumsum([n for _, n in x]).tolist() for x in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        last = 0
        for e in sorted(set(ends[0]) | set(ends[1])):
            i, j = (next(k for k, x in enumerate(side) if x >= e) for side in ends)
            want.append((key, last, e, sum(c < e for c in cuts), e in ends[0], e in ends[1], a[i][0], b[j][0]))
            counts[a[i][0], b[j][0]] += occ
            last = e
    assert found == sorted(want) and len([w for w in want if w[0] == 1]) == 1001
    rows = alignment.grouped(linked).join(tokens.select("key", "occ"), "key").cache()
    pairs = alignment.pair_counts(rows).cache()
    best = {b: max(n for (_, y), n in counts.items() if y == b) for _, b in counts}
    assert {(r.a_id, r.b_id): (r["count"], r.is_best) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in counts.items()}
    sent, dealt = (sorted(map(tuple, alignment.link_scores(rows, pairs, "key", most).collect())) for most in (1000, 0))
    assert sent == dealt and [r[0] for r in sent] == [0, 1, 2]
    texts = {r.key: r.groups for r in rows.collect()}
    assert texts[0] == "0,1|0;2|1,2" and texts[2] == "0|0;1|1"


def test_alignment_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    same(as_rows(registry.QUERIES["op11_token_alignment"](spark, sf)), [r.doc_id for r in rows], expected([r.text for r in rows]))


@pytest.fixture(scope="module")
def bpe():
    return speculative_bpe.tokenizer(A)[0]


def test_speculation_gives_the_library_ids(spark, docs):
    lib = Tokenizer.from_file(A)
    encoded = speculative_bpe.encode_documents(docs, A)
    rows = speculative_bpe.decode_documents(encoded, A).collect()
    assert sorted((r.text, r.n_tokens) for r in rows) == sorted((t or "", len(lib.encode(t or "", add_special_tokens=False).ids)) for _, t in TEXTS)
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()]
    assert sorted(ids) == sorted(lib.encode(t or "", add_special_tokens=False).ids for _, t in TEXTS)
    assert speculative_bpe.encode_documents(docs.limit(0), A).count() == 0


def test_every_way_agrees(bpe):
    """Words that pass verification, words merged exactly, and pairs that are wrong by the library's count."""
    lib, failed = Tokenizer.from_file(A), 0
    for _ in range(2000):
        word = "".join(rng.choice("abcdehnorstu") for _ in range(rng.randrange(1, 14))).encode()
        want = lib.encode(word.decode(), add_special_tokens=False).ids
        assert bpe.ids[bpe.merged(word)].tolist() == want
        ids, counts = bpe.encode_run([word])
        assert ids.tolist() == want and counts.tolist() == [len(want)]
        proposed, length = bpe.longest(np.frombuffer(word, np.uint8), np.arange(len(word), 0, -1))
        at, greedy = 0, []
        while at < len(word):
            greedy.append(int(proposed[at]))
            at += int(length[at])
        fine = bpe.compatible(np.array(greedy[:-1], np.int64), np.array(greedy[1:], np.int64)).all()
        assert fine == (bpe.ids[greedy].tolist() == want)
        failed += not fine
    assert 50 < failed < 1950


def test_decoding_of_broken_utf8(spark, bpe):
    lib = Tokenizer.from_file(A)
    ids = [[int(bpe.ids[0xE6]), int(bpe.ids[0x41])], [50256, int(bpe.ids[0xFF]), int(bpe.ids[0xC3])], []]
    df = spark.createDataFrame([(k, np.array(x, "<u4").tobytes()) for k, x in enumerate(ids)], "doc_id long, ids binary")
    assert [r.text for r in speculative_bpe.decode_documents(df, A).orderBy("doc_id").collect()] == [lib.decode(x, skip_special_tokens=False) for x in ids]


def test_other_vocabularies():
    """Trained on nothing: a few merges given by hand, among them a product that its own merges never reach."""
    letters = {b: c for c, b in speculative_bpe.byte_letters().items()}
    merges = [("b", "c"), ("a", "b"), ("ab", "c"), ("a", "bc"), ("bc", "d")]
    vocab = {c: b for b, c in letters.items()}
    for k, m in enumerate(dict.fromkeys("".join(m) for m in merges), 256):
        vocab[m] = k
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": merges[:3] + merges[4:]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
    own = speculative_bpe.SpeculativeBpe(spec)
    lib = Tokenizer.from_str(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None} | spec | {"pre_tokenizer": spec["pre_tokenizer"] | {"trim_offsets": True}, "model": spec["model"] | {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}}))
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
        assert own.encode_run([word.encode()])[0].tolist() == lib.encode(word).ids
    with pytest.raises(ValueError):
        speculative_bpe.SpeculativeBpe(spec | {"model": spec["model"] | {"merges": merges}})
    with pytest.raises(ValueError):
        speculative_bpe.SpeculativeBpe(spec | {"normalizer": {"type": "NFC"}})


def test_speculation_query(spark, sf):
    lib = Tokenizer.from_file(A)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.QUERIES["op13_speculative_bpe"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
