"""Exact top-k inner-product search by MaxScore over signed integer vectors.

Each component is a query term with two posting lists, vectors with a positive and with a negative value. In a
shard a term's score bound is its query weight times the largest value on the side that adds to the score.
Sorted by bound, the terms whose bounds together stay under the k-th best score so far are non-essential: a
vector found in none of the other, essential lists can't enter the result. Only essential lists are traversed,
for all queries of a block at once: lists of dense vectors are columns, so a traversal is a matrix product over
them. The values that take away from the score, and then the non-essential terms from the greatest bound down, are
looked up for candidates that can still compete. The k-th best score is raised after every STEP vectors and carried
from shard to shard, and the tasks' results are merged by rank.

A shard is built once, with its bounds. Shards of candidates meet blocks of queries by key, so neither side is
broadcast. Vectors that are null or hold null or non-finite values take no part; components that a shorter vector
lacks count as 0. Sums are exact for finite values of any size: past 53 bits Python's integers take over. Ranks go by
the exact score; one that a long can't hold is returned as the nearest long. A candidate with the query's own id is
left out. Ties go to the smaller id, then repeated rows each count. An empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, rest

SHARD = 4096
STEP = 1024
QUERIES_A_BLOCK = 2048
SHARDS_A_CELL = 4
PROBE = 8
#: Whole numbers up to here are exact in a double.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """The vector as doubles, null if it takes no part."""
    bad = vector.isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, vector.cast("array<double>"))


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: as doubles where those are exact, else as Python integers."""
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if out.size and not np.abs(out).max() < EXACT:
        out = np.array([int(x) * scale if abs(x) >= EXACT else math.floor(x * scale) for x in values.ravel().tolist()], object).reshape(values.shape)
    return out


def largest(values: np.ndarray) -> int:
    return int(abs(values).max()) if values.size else 0


class Shard:
    """Candidates by rows, and the greatest value of each term's positive and negative list."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, top: np.ndarray | None = None):
        self.ids, self.values = ids, values
        self.top = top if top is not None else np.stack([values.max(0, initial=0), (-values).max(0, initial=0)])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> None:
        """Puts the best k of (score, id) of each query's list in ``best`` and this shard there, best first."""
        width = self.values.shape[1]
        q = np.zeros((len(queries), width), queries.dtype)
        m = min(width, queries.shape[1])
        q[:, :m] = queries[:, :m]
        if q.dtype == object or self.values.dtype == object or largest(q) * largest(self.values) * max(1, width) >= EXACT:
            self._by_integers(q, own, k, best)
            return
        for at in range(0, len(self.ids), STEP):
            self._step(q, own, k, best, self.ids[at : at + STEP], self.values[at : at + STEP])

    def _by_integers(self, q, own, k, best) -> None:
        exact = lambda a: np.array([int(x) for x in a.ravel().tolist()], object).reshape(a.shape)
        values = exact(self.values)
        for i, row in enumerate(exact(q)):
            scores = [int(x) for x in values @ row] if len(row) else [0] * len(values)
            found = [(s, j) for s, j in zip(scores, self.ids.tolist()) if j != own[i]]
            best[i] = sorted([*best[i], *found], key=lambda x: (-x[0], x[1]))[:k]

    def _step(self, q, own, k, best, ids, values) -> None:
        # Queries with fewer than k results so far take every candidate.
        least = np.array([max(-EXACT, min(EXACT, b[-1][0])) if len(b) == k else -np.inf for b in best], float)
        bound = np.abs(q) * np.where(q > 0, self.top[0], self.top[1])
        order = np.argsort(bound, axis=1, kind="stable")
        below = np.cumsum(np.take_along_axis(bound, order, 1), 1)
        # Terms up to this place in the order can't lift a vector to the k-th score even together.
        spare = (below < least[:, None]).sum(1)
        essential = np.empty(q.shape, bool)
        np.put_along_axis(essential, order, np.arange(q.shape[1]) >= spare[:, None], 1)
        held = np.where(essential, q, 0)
        # What the essential lists add: positive values for positive weights, negative values for negative ones.
        gain = np.maximum(held, 0) @ np.maximum(values, 0).T + np.minimum(held, 0) @ np.minimum(values, 0).T
        # Bounds of the first so many terms in the order together.
        upto = np.concatenate([np.zeros((len(q), 1)), below], 1)
        rest_ = np.take_along_axis(upto, spare[:, None], 1)
        i, j = np.nonzero(gain + rest_ >= least[:, None])
        keep = own[i] != ids[j]
        i, j = i[keep], j[keep]
        score = np.zeros(len(i))
        for at in range(0, len(i), 1 << 15):  # with what those terms take away, the essential part is whole
            a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            score[at : at + (1 << 15)] = np.einsum("ij,ij->i", held[a], values[b])
        left = spare[i]
        while len(i):
            keep = score + upto[i, left] >= least[i]
            i, j, score, left = i[keep], j[keep], score[keep], left[keep]
            more = left > 0
            if not more.any():
                break
            for _ in range(PROBE):
                now = np.flatnonzero(left > 0)
                left[now] -= 1
                d = order[i[now], left[now]]
                score[now] += q[i[now], d] * values[j[now], d]
        chosen = np.lexsort((ids[j], -score, i))
        i, j, score = i[chosen], j[chosen], score[chosen]
        heads = np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(i)).tolist()):
            b = min(b, a + k)
            found = zip(map(int, score[a:b].tolist()), ids[j[a:b]].tolist())
            best[i[a]] = sorted([*best[i[a]], *found], key=lambda x: (-x[0], x[1]))[:k]


def sortable(x: int) -> bytes:
    """Bytes that stand in the order of whole numbers of any size."""
    size = (abs(x).bit_length() + 7) // 8
    digits = abs(x).to_bytes(size, "big")
    return b"\1" + size.to_bytes(2, "big") + digits if x >= 0 else b"\0" + (0xFFFF - size).to_bytes(2, "big") + bytes(255 - d for d in digits)


def packed(rows: DataFrame, size: int, scale: int, tops: bool) -> DataFrame:
    """Rows (block, row, id, vector) as blobs of up to size consecutive rows of the same block and width: quantised vectors as
    doubles, or the doubles themselves where those aren't exact. With tops, each term's greatest values."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            block, vectors = batch.column(0).to_numpy(), batch.column(3)
            widths = np.diff(vectors.offsets.to_numpy())
            order = np.lexsort((widths, block))
            cuts = np.flatnonzero((np.diff(block[order]) != 0) | (np.diff(widths[order]) != 0)) + 1
            for part in np.split(order, cuts):
                for i in range(0, len(part), size):
                    at = part[i : i + size]
                    own = batch.take(pa.array(at))
                    plain = own.column(3).flatten().to_numpy().reshape(len(at), -1)
                    values = quantised(plain, scale)
                    top = b""
                    if tops and values.dtype != object:
                        top = Shard(at, values).top.astype("<f8").tobytes()
                    blobs = [own.column(c).to_numpy().astype("<i8").tobytes() for c in (1, 2)] + [(plain if values.dtype == object else values).astype("<f8").tobytes(), top]
                    columns = [pa.array([int(block[at[0]])]), pa.array([len(at)]), pa.array([values.dtype != object])]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([b], pa.binary()) for b in blobs], ["block", "n", "whole", "rows", "ids", "vectors", "top"])

    return rows.select("block", "row", "id", "vector").mapInArrow(pack, "block long, n long, whole boolean, rows binary, ids binary, vectors binary, top binary")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query row's k best candidates. A query row is told by its
    place, so that repeated rows each get a result."""
    scratch = Scratch(vectors.sparkSession)

    def valid(df):
        return rest(df, [id_col], vector_col).select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("vector")).where("id is not null and vector is not null")

    asked = scratch.write(valid(queries).withColumn("row", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // QUERIES_A_BLOCK))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long")).repartition("block").sortWithinPartitions("block")
    query_blocks = scratch.write(packed(dealt, QUERIES_A_BLOCK, scale, False), "none")
    plain = valid(vectors).select(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"), "id", "vector")
    shards = scratch.write(packed(plain, SHARD, scale, True).drop("block", "rows").withColumn("cell", F.floor(F.monotonically_increasing_id() / SHARDS_A_CELL)), "none")
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    # Each cell of shards meets each block of queries once.
    pairs = scratch.write(shards.select("cell").distinct().withColumn("block", numbers))
    asks = [F.col(c).alias(f"q_{c}") for c in ("n", "whole", "rows", "ids", "vectors")]
    # Dealt by cell: few queries against many shards are spread as well as many against few.
    joined = query_blocks.select("block", *asks).join(pairs, "block").join(shards, "cell").sortWithinPartitions("block")

    def matrix(n, whole, blob):
        values = np.frombuffer(blob, "<f8").reshape(n, -1)
        return values if whole else quantised(values, scale)

    def search(batches):
        held: tuple | None = None  # the block at hand: its blobs, rows, ids, queries and results

        def result():
            _, rows, own, _, best = held
            found = [(r, o, max(-(1 << 63), min((1 << 63) - 1, s)), i, sortable(s)) for r, o, b in zip(rows.tolist(), own.tolist(), best) for s, i in b]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate(kinds)], ["row", "query_id", "score", "vec_id", "place"])

        for batch in batches:
            for at in range(batch.num_rows):
                n, whole, ids, values, top, q_n, q_whole, q_rows, q_ids, q_vectors = (batch.column(c)[at].as_py() for c in ("n", "whole", "ids", "vectors", "top", "q_n", "q_whole", "q_rows", "q_ids", "q_vectors"))
                if held is None or held[0] != q_rows:
                    if held:
                        yield result()
                    held = (q_rows, np.frombuffer(q_rows, "<i8"), np.frombuffer(q_ids, "<i8"), matrix(q_n, q_whole, q_vectors), [[] for _ in range(q_n)])
                values = matrix(n, whole, values)
                shard = Shard(np.frombuffer(ids, "<i8"), values, np.frombuffer(top, "<f8").reshape(2, -1) if whole else values[:0].sum(0))
                shard.search(held[3], held[2], k, held[4])
        if held:
            yield result()

    found = joined.mapInArrow(search, "row long, query_id long, score long, vec_id long, place binary")
    order = Window.partitionBy("row").orderBy(F.desc("place"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
