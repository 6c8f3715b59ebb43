"""The n-gram Jaccard join against all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pytest

from tessella.llm import jaccard, registry
from tessella.llm.common import Scratch
from tessella.llm.graph import components


def brute(rows):
    sets = []
    for i, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]):
                inter = len(sets[a] & sets[b])
                if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                    parent[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        out.append((i, len(sets[k]), None if i is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(k))))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    label = {x: x for p in links for x in p}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: v for x, v in label.items() if any(x in p and p[0] != p[1] for p in links)}


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(5)
    sizes = rng.integers(20, 60, 700)
    points = np.stack([np.bincount(rng.integers(0, 6, s), minlength=jaccard.GROUPS) for s in sizes])
    q, p, bound = jaccard.PointTree(points, sizes).pairs(points[:50], sizes[:50])
    want = {(a, b) for a in range(50) for b in range(700) if np.minimum(points[a], points[b]).sum() >= jaccard.needed(sizes[a], sizes[b])}
    assert set(zip(q.tolist(), p.tolist())) == want and len(q) == len(want)


def test_points_never_bound_too_low():
    """Sets of sizes with different numbers of groups, and one with more in a group than a point can hold."""
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: s * 2], s)) for s in (1, 3, 90, 120, 130, 140, 700, 900, 5000)]
    sets += [np.unique(pool[:40_000]), np.unique(pool[3000:45_000]), pool[:30] & np.uint64(0xFFFFFFFFFFFF0000)]
    crowded = (np.arange(600, dtype=np.uint64) << np.uint64(20)) | rng.integers(0, 40, 600, dtype=np.uint64)
    sets += [crowded[:500], crowded, crowded[80:510]]  # many in a group, with different numbers of groups
    sizes = np.array([len(s) for s in sets])
    points = jaccard.Points(np.frombuffer(b"".join(map(jaccard.point, sets)), np.uint8), sizes)
    a, b = np.divmod(np.arange(len(sets) ** 2), len(sets))
    true = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)])
    fine, coarse = points.bound(a, b), np.minimum(points.asked(a), points.searched(b)).sum(1, dtype=np.int64)
    assert (true <= fine).all() and (fine <= coarse).all() and (fine[a == b] == sizes).all()


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("block", [256, 8])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(block)
    passage = [f"p{i}" for i in range(40)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, "a b c d e"), (8, "a b c d e f"), (9, "É x y z w"), (10, "é x y z w"), (None, "a b c d e"), (12, "q r s\x0bt u")]
    base = [f"b{i}" for i in range(100)]
    for i in range(60):  # a chain of near copies around the threshold
        rows.append((100 + i, " ".join(edited(rng, base, rng.randrange(5)))))
    for i in range(60):  # other texts with a common passage
        rows.append((300 + i, " ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 30))] + passage)))
    rows += [(500, "same text here " * 30), (501, "same text here " * 30), (501, "same text here " * 30), (7, "another text under the same id")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as component_id")
    assert result(jaccard.near_duplicates(df)) == brute(rows)


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(registry.QUERIES["op6_count_vector_jaccard"](spark, sf)) == brute(rows)


def test_rows_grow_with_a_group_of_near_copies(spark, monkeypatch):
    """Shingles whose sets are one component already aren't dealt again, so a group four times as large takes about four times
    the rows, not sixteen."""
    made = []
    plain = jaccard.candidates

    def counted(rows, seed):
        made.append(rows.count())
        return plain(rows, seed)

    monkeypatch.setattr(jaccard, "candidates", counted)
    sums = []
    for n in (300, 1200):
        rng, words = random.Random(3), [f"w{k}" for k in range(150)]
        texts = []
        for k in range(n):
            own = list(words)
            own[rng.randrange(150)] = f"x{k}"
            texts.append((k, " ".join(own)))
        made.clear()
        found = jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
        assert found.select("component_id").distinct().count() == 1
        sums.append(sum(made))
    assert sums[1] <= 5 * sums[0]


def test_points_of_large_sets_are_unpacked_in_parts():
    """Sets of 8000 and 4000 shingles have points of different lengths, which are folded to be compared."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in [8000] * 40 + [4000] * 40]
    points = jaccard.Points(np.frombuffer(b"".join(jaccard.point(s) for s in sets), np.uint8), np.array([len(s) for s in sets]))
    a, b = rng.integers(0, 40, 4000), rng.integers(40, 80, 4000)
    tracemalloc.start()
    try:
        found, peak = points.bound(a, b), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16_000_000
    k = [0, 17, 3999]
    assert found[k].tolist() == [points.bound(a[[i]], b[[i]])[0] for i in k]


def test_sets_of_unlike_sizes_are_not_dealt(spark, monkeypatch):
    """A passage in texts of which each is twice as long as the next makes no row with a point, and links stay."""
    made = []
    plain = jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda rows, seed: made.append(rows.count()) or plain(rows, seed))
    passage, rng = [f"p{k}" for k in range(60)], random.Random(4)
    texts = [(k, " ".join(passage + [f"u{rng.randrange(10**9)}" for _ in range(40 * 2**k)])) for k in range(6)]
    assert result(jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))) == brute(texts) and sum(made) == 0
    texts += [(100 + k, t + " more") for k, t in texts]
    assert result(jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))) == brute(texts) and sum(made) > 0


@pytest.mark.parametrize("block", [256, 4])
def test_the_first_shared_shingle_of_a_link_is_kept(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[k % 3 * 15 :], rng.integers(3, 30), replace=False)) for k in range(120)]
    prefixes = [jaccard.prefix(s, pool[:0]).view(np.int64).tolist() for s in sets]
    counts = {t: sum(t in p for p in prefixes) for p in prefixes for t in p}
    rows = [(k, len(s), pos, t, counts[t]) for k, (s, p) in enumerate(zip(sets, prefixes)) for pos, t in enumerate(p) if counts[t] > 1]
    found = jaccard.promising(spark.createDataFrame(rows, "id long, n long, pos int, token long, count long"))
    kept = [(r.id, r.token) for r in found.collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= {(r[0], r[3]) for r in rows}
    for a in range(120):
        for b in range(a):
            both = np.intersect1d(sets[a], sets[b]).size
            if 7 * both >= 3 * (len(sets[a]) + len(sets[b])):
                first = next(t for t in prefixes[a] if t in prefixes[b])
                assert (a, first) in kept and (b, first) in kept
