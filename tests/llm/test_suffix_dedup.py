"""Repeated passages against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import registry, suffix_dedup


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if times[r[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(r) else 0
        kept = np.frombuffer(r, np.uint8)[~gone[:-1]].tobytes()
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def test_repeated_starts():
    rng = random.Random(1)
    for _ in range(150):
        contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 30))) for _ in range(rng.randrange(1, 8))]
        weights = np.array([rng.choice([1, 1, 2]) for _ in contexts])
        times = Counter()
        for c, w in zip(contexts, weights.tolist()):
            for i in range(len(c) - 7):
                times[c[i : i + 8]] += w
        want = [[i for i in range(len(c) - 7) if times[c[i : i + 8]] > 1] for c in contexts]
        assert [g.tolist() for g in suffix_dedup.repeated_starts(contexts, weights, 8)] == want


@pytest.mark.parametrize("hot", [8192, 3])
def test_against_all_windows(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    rng = random.Random(hot)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(30) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "short"), (None, passages[0]), (5, "ab" * 300), (6, "z" * 59), (7, "z" * 60), (8, "y" * 61)]
    for i in range(60):
        parts = [text(rng.randrange(0, 20)) for _ in range(3)] + rng.choices(passages, k=rng.randrange(3))
        rng.shuffle(parts)
        rows.append((100 + i, "".join(parts)))
    base = text(60)
    for i in range(25):
        k = rng.randrange(len(base))
        rows.append((200 + i, base[:k] + word() + base[k + 1 :]))
    rows += [(300, base), (301, base), (301, base), (5, "other text of the same id " + passages[1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as weight")
    assert result(suffix_dedup.repeated_passages(df, 60)) == brute(rows, 60)


def test_cleaned_rows_keep_their_columns(spark):
    line = "this passage stands in both documents é " * 3
    df = spark.createDataFrame([(1, "a " + line, "en", 5), (2, line + " b", None, None), (3, None, "x", 0)], "doc_id long, text string, lang string, n_chars long")
    rows = {r.doc_id: r for r in suffix_dedup.without_repeats(df, 60).collect()}
    assert rows[1].text == "a" and rows[1].lang == "en" and rows[1].n_chars == 1 and rows[2].text == " b" and rows[3].text == ""
    assert suffix_dedup.without_repeats(df, 60).columns == df.columns
    assert suffix_dedup.without_repeats(df.limit(0), 60).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in registry.QUERIES["op5_bwt_repeats"](spark, sf).collect()), key=str)
    assert got == brute(rows, 200)
