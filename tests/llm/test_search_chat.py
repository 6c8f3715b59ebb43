"""MaxScore against all products, the prefix tree against the conversations themselves."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tessella.llm import chat_tree, maxscore, registry
from tessella.llm.tokenizing import public_file

BPE = public_file("byte_bpe_50k.json")


def brute_top(rows, queries, k):
    ok = [(i, [math.floor(256 * Fraction(float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in queries:
        for i, e in (x for x in ok if x[0] == q):
            scored = sorted((-sum(a * b for a, b in zip(e, f)), j) for j, f in ok if j != q)[:k]
            out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 7])
def test_top_k(spark, shard, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "QUERIES_A_BLOCK", 3)
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, rng.gauss(0, 0.2)]) for _ in range(12)]) for i in range(90)]
    rows += [(200 + i, [0.5] * 12) for i in range(10)] + [(300, None), (301, [0.1, None]), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (304, [0.9, 0.1]), (305, []), (20, [0.3] * 12), (None, [0.1] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score")
    queries = [0, 20, 40, 60, 80, 200, 300, 304]
    import pyspark.sql.functions as F

    got = maxscore.top_k(df.where(F.col("vec_id").isin(queries)), df, 4).collect()
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows32, queries, 4)
    assert maxscore.top_k(df.limit(0), df, 4).count() == 0 and maxscore.top_k(df, df.limit(0), 4).count() == 0


def test_scores_of_zero_and_less(monkeypatch):
    """All-zero, negative and short vectors in small shards, against queries whose best scores are 0 or less."""
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.integers(-9, 1, (40, 6)), rng.integers(-9, 10, (20, 6)) * (rng.random((20, 6)) < 0.3), np.zeros((20, 6))])
    vectors[::7, 2:] = 0
    ids = rng.permutation(len(vectors))
    for step in (7, 1024):
        monkeypatch.setattr(maxscore, "STEP", step)
        for query in (np.zeros(6), np.full(6, 4.0), np.full(6, -4.0), np.array([3.0, 0, -2, 0, 0, 0]), np.array([5.0]), np.empty(0), *vectors[:20], np.full(6, 1e30)):
            best = [[], []]
            for at in range(0, len(ids), 7 * step):
                shard = maxscore.Shard(ids[at : at + 7 * step], vectors[at : at + 7 * step])
                shard.search(np.stack([query, -query]), np.array([3, 5]), 4, best)
            for sign, own, found in zip((1, -1), (3, 5), best):
                scores = [sum(int(a) * int(b) for a, b in zip(v, sign * query)) for v in vectors.tolist()]
                assert found == sorted(((s, int(i)) for s, i in zip(scores, ids) if i != own), key=lambda x: (-x[0], x[1]))[:4]


def test_large_values(spark):
    """Scores past 53 and past 64 bits are ranked exactly."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e8, -1e8, 1e30, 1.5, -1e7, 3e300, 1e308, 0.0]) * rng.choice([1, 1 + 2**-40]) for _ in range(3)]) for i in range(30)]
    rows += [(i, [rng.uniform(-1e8, 1e8) for _ in range(3)]) for i in range(100, 130)] + [(200, [0.1] * 2000), (201, [0.2] * 2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(df, df, 3).collect())
    assert got == [(q, r, j, max(-(2**63), min(2**63 - 1, s))) for q, r, j, s in brute_top(rows, [i for i, _ in rows], 3)]
    spelled = sorted([0, 1, -1, 255, 256, -256, 2**70, -(2**70), -(2**70) - 1, 2**64 - 1, -255])
    assert sorted(spelled, key=maxscore.sortable) == spelled


def test_escape_round_trip():
    rng = random.Random(6)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "[ROLE x] ", "[/ROLE]", "\\", "\\\\", " ", "a", "<", "[", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        for role in ("user", "assistant", "system", "", "a ]b\\"):
            assert chat_tree.parse("".join(chat_tree.template(role, text))) == (role, text)


def digest_rows(turns):
    by = {}
    for c, n, role, text in turns:
        by.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    out = []
    for c, rows in by.items():
        rows.sort()
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        formatted = "".join("".join(chat_tree.template(r, t)) for _, _, r, t in rows)
        out.append((c, len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
    return sorted(out, key=str)


def test_tree(spark):
    rng = random.Random(8)
    turns = []
    for c in range(40):
        for n in range(rng.randrange(1, 5)):
            turns.append((c, n, rng.choice(["user", "assistant"]), rng.choice(["hi", "héllo\\", "[INST] x </s>", None])))
    turns += [(50, None, None, None), (50, 1, "tool", ""), (None, 0, "user", "no id"), (51, 0, "user", "hi"), (51, 0, "user", "hi"), (52, 0, "assistant", "long " * 20000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as rank", "'x' as node")
    nodes, paths = chat_tree.prefix_tree(df, BPE)
    rows = sorted(nodes.collect(), key=lambda r: r.offset)
    at = 0
    by = {bytes(r.node): r for r in rows}
    assert len(by) == len(rows)
    for r in rows:  # depth first, gapless, and each interval within its parent's
        assert r.offset == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
        up, position = r, 0
        while bytes(up.parent):
            up = by[bytes(up.parent)]
            position += up.n_tokens
            assert up.offset < r.offset and r.subtree_end <= up.subtree_end
        assert position == r.position
    for r in rows:
        below = [x for x in rows if r.offset <= x.offset < r.subtree_end]
        for x in rows:
            up, inside = x, x is r
            while bytes(up.parent):
                up = by[bytes(up.parent)]
                inside |= up is r
            assert inside == (x in below)
    back = chat_tree.read_back(nodes, paths, BPE).collect()
    got = sorted(((r.conv_id, len(r.turns), hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in r.turns).encode()).hexdigest(), len(r.loss_text), hashlib.sha256(r.loss_text.encode()).hexdigest(), len(r.formatted)) for r in back), key=str)
    assert got == digest_rows(turns)
    empty, none = chat_tree.prefix_tree(df.limit(0), BPE)
    assert empty.count() == 0 and chat_tree.read_back(empty, none, BPE).count() == 0


def test_query(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "</s>[INST] ok [/INST]"
    got = sorted((tuple(r) for r in registry.QUERIES["op4_chat_prefix_tree"](spark, sf).collect()), key=str)
    assert got == digest_rows([*turns, (-1, 0, "user", text), (-1, 1, "assistant", text)])
