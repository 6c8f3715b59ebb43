"""License scans against alignment of every window."""

import random

from tessella.llm import licenses, registry


def brute(rows, templates, least):
    out = []
    for i, t in rows:
        words = licenses.words_of(t or "")
        for name, text in templates.items():
            template = licenses.words_of(text)
            best = 0.0
            for lo in range(len(words)):
                for hi in range(lo + 1, min(len(words), lo + 2 * len(template)) + 1):
                    best = max(best, len(licenses.align(words[lo:hi], template)) / len(template))
            if best >= least:
                out.append((i, name))
    return sorted(out, key=str)


def test_alignment_is_increasing_and_finds_anchors():
    rng = random.Random(1)
    for _ in range(500):
        a, b = [[rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2)]
        m = licenses.align(a, b)
        assert all(a[i] == b[k] for i, k in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
    assert licenses.align(list("xaybzc"), list("abc")) == [(1, 0), (3, 1), (5, 2)]
    assert [[3, 1, 2, 5, 4][i] for i in licenses.increasing([3, 1, 2, 5, 4])] == [1, 2, 4]
    assert licenses.increasing([]) == []


def test_no_window_is_lost():
    """Best coverage over all windows of random words, the same template words again and again among them."""
    rng = random.Random(3)
    for _ in range(2500):
        letters = "abcde"[: rng.randrange(2, 6)] + "z" * rng.randrange(2)
        words, template = ([rng.choice(letters) for _ in range(rng.randrange(1, n))] for n in (14, 7))
        best = max(len(licenses.align(words[lo:hi], template)) for lo in range(len(words)) for hi in range(lo + 1, min(len(words), lo + 2 * len(template)) + 1)) / len(template)
        least = rng.choice([0.3, 0.5, 0.8, 1.0])
        got = licenses.best_match(words, template, least)
        assert (got[0] if got else None) == (best if best >= least else None)
    assert licenses.best_match("e b e a b e z".split(), "a b e b e".split(), 0.8)[0] >= 0.8


def test_edited_licences():
    """Licence texts that the test tables don't hold, with words changed, within other text, twice, and long ones."""
    rng = random.Random(4)
    for name in ("BSD-2-Clause", "ISC", "Zlib", "AGPL header", "MPL-2.0 header", "MIT"):
        template = licenses.words_of(licenses.TEMPLATES[name])
        words = list(template)
        for _ in range(len(words) // 12):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        whole = ["pad"] * 300 + template + ["the", "of"] * 40 + template + ["end"]
        assert licenses.best_match(whole, template, 0.8)[0] == 1
        got = licenses.best_match(["before"] * 50 + words + ["the", "after"] * 50, template, 0.8)
        assert got and got[0] >= 0.9
        assert licenses.best_match(template[: len(template) // 2], template, 0.8) is None


def test_scan(spark):
    rng = random.Random(2)
    templates = {"a": "alpha beta gamma delta epsilon zeta eta theta", "none": "...", "b": "one two three four five"}
    rows = [(1, None), (2, ""), (3, "Alpha BETA, gamma delta; epsilon zeta eta theta!"), (4, "one two three"), (5, "one x two three y four five " * 3), (6, "word " * 30000 + "one two three four five"), (6, "word")]
    for i in range(30):
        words = licenses.words_of(templates["a"])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "noise"
        rows.append((10 + i, " ".join(["pad"] * rng.randrange(5) + words + ["alpha"] * rng.randrange(3))))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as template")
    got = licenses.scan(df, templates).collect()
    assert sorted(((r.doc_id, r.template) for r in got), key=str) == brute([r for r in rows if r[0] != 6], templates, 0.8) + [(6, "b")]
    assert all(r.coverage >= 0.8 and r.matched <= r.end_word - r.first_word for r in got)
    assert licenses.scan(df.limit(0), templates).count() == 0 and licenses.scan(df, {}).count() == 0


def test_query_finds_every_notice(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {(r.doc_id, r.template) for r in registry.QUERIES["op7_patience_licenses"](spark, sf).collect()}
    for name, text in licenses.TEMPLATES.items():
        assert {(r.doc_id, name) for r in rows if text in (r.text or "")} <= got
