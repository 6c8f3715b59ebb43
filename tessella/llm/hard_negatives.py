"""Hard-negative mining by a pivot table: exact inner-product search in brackets that stored distances give.

Every vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, and an anchor a gets a 0 there. Then
|a' - x'|^2 = |a|^2 + M^2 - 2 a.x, so a greater inner product is a smaller distance. The distances of all rows to a few
pivots are stored once. For an anchor and a row the triangle inequality over a pivot p gives
|d(a,p) - d(x,p)| <= d(a,x) <= d(a,p) + d(x,p): the score lies in a bracket, and only rows whose bracket can still compete
have it checked exactly. Rows are stored in order of label and nearest pivot, so that whole steps of a shard fall out
by the extremes of their distances.

The first search finds an anchor's positives, the best rows of its label; the second one, for each positive, the best rows of
other labels in the window ``low * positive <= 100 * score <= high * positive``. Blocks of anchors meet shards by key and
results are merged by rank; neither side is broadcast. Pivots are chosen, farthest first, from the SAMPLE rows of least
hash; the choice changes cost, never results.

Rows whose id, label or vector is null, or whose vector holds null or non-finite components, take no part; components that
a shorter vector lacks count as 0. A row with an anchor's own id is left out; other repeated rows each count, repeated anchors
each get results, and ties go to the smaller id. Vectors with a squared norm beyond 2^52, or infinite, are outside the table:
they are compared exactly as Python integers, one by one, and a score that a long can't hold is returned as the nearest
long. An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, rest
from .maxscore import quantised, sortable, usable

PIVOTS = 16
SAMPLE = 512
SHARD = 8192
STEP = 2048
ANCHORS_A_BLOCK = 1024
#: Greatest squared norm inside the table: products of two such vectors and their sums are exact in a double.
TAME = float(1 << 52)
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """A matrix of Python integers."""
    return np.array([int(x) for x in values.ravel().tolist()], object).reshape(values.shape)


class Pivots:
    """Pivots among stored vectors: their components, and the one more that each has."""

    def __init__(self, sample: np.ndarray, top2: float, most: int = PIVOTS):
        self.top2 = top2
        norm2 = (sample**2).sum(1)
        more = np.sqrt(np.maximum(top2 - norm2, 0))
        chosen: list[int] = []
        apart = np.full(len(sample), np.inf)
        while len(chosen) < min(most, len(sample)):
            at = int(apart.argmax()) if chosen else 0
            if chosen and apart[at] <= 0:
                break
            chosen.append(at)
            apart = np.minimum(apart, ((sample - sample[at]) ** 2).sum(1) + (more - more[at]) ** 2)
        self.values, self.more, self.norm2 = sample[chosen], more[chosen], norm2[chosen]

    def products(self, values: np.ndarray) -> np.ndarray:
        width = min(values.shape[1], self.values.shape[1])
        return values[:, :width] @ self.values[:, :width].T

    def of_rows(self, values: np.ndarray) -> np.ndarray:
        """Distances of stored vectors to the pivots."""
        norm2 = (values**2).sum(1)
        more = np.sqrt(np.maximum(self.top2 - norm2, 0))
        return np.sqrt(np.maximum(norm2[:, None] + self.norm2 - 2 * self.products(values) + (more[:, None] - self.more) ** 2, 0))

    def of_anchors(self, values: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((values**2).sum(1)[:, None] + self.top2 - 2 * self.products(values), 0))


class Anchors:
    """A block of anchors of one width, tame or not, and for the second search the scores of their positives."""

    def __init__(self, rows, ids, labels, values, tame, pivots: Pivots, positives: list[list[int]] | None, k: int, low: int, high: int):
        self.rows, self.ids, self.labels, self.tame, self.k = rows, ids, labels, tame, k
        self.values, self.positives, self.low, self.high, self.pivots = values, positives, low, high, pivots
        most = max([1, *map(len, positives)]) if positives is not None else 1
        #: Best (score, id) by anchor and, in the second search, positive.
        self.best: list[list[list[tuple[int, int]]]] = [[[] for _ in range(most)] for _ in ids]
        if tame:
            self.norm2 = (values**2).sum(1)
            self.apart = pivots.of_anchors(values)
            #: Bounds of the scores that count: 50 p <= 100 s <= 95 p say, none where there is no positive.
            self.least, self.most = np.full((len(ids), most), -np.inf), np.full((len(ids), most), np.inf)
            if positives is not None:
                self.least, self.most = np.full((len(ids), most), np.inf), np.full((len(ids), most), -np.inf)
                for i, own in enumerate(positives):
                    for c, p in enumerate(own):
                        self.least[i, c], self.most[i, c] = max(-2.0**60, min(2.0**60, -(-low * p // 100))), max(-2.0**60, min(2.0**60, high * p // 100))

    def take(self, i: int, c: int, found: list[tuple[int, int]]) -> None:
        own = sorted([*self.best[i][c], *found], key=lambda x: (-x[0], x[1]))[: self.k]
        self.best[i][c] = own
        if self.tame and len(own) == self.k:
            self.least[i, c] = max(self.least[i, c], own[-1][0])

    def wants(self, labels: np.ndarray) -> np.ndarray:
        same = self.labels[:, None] == labels
        return same if self.positives is None else ~same

    def search(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, tame: bool, apart: np.ndarray) -> None:
        if not (self.tame and tame):
            self._plainly(ids, labels, values)
            return
        for at in range(0, len(ids), STEP):
            self._step(ids[at : at + STEP], labels[at : at + STEP], values[at : at + STEP], apart[at : at + STEP])

    def _plainly(self, ids, labels, values) -> None:
        rows, anchors = whole_numbers(values), whole_numbers(self.values)
        width = min(rows.shape[1], anchors.shape[1])
        wants = self.wants(labels) & (self.ids[:, None] != ids)
        for i in range(len(anchors)):
            found = np.flatnonzero(wants[i])
            scores = [int(x) for x in rows[found, :width] @ anchors[i, :width]] if width else [0] * len(found)
            some = list(zip(scores, ids[found].tolist()))
            if self.positives is None:
                self.take(i, 0, some)
            else:
                for c, p in enumerate(self.positives[i]):
                    self.take(i, c, [x for x in some if self.low * p <= 100 * x[0] <= self.high * p])

    def _step(self, ids, labels, values, apart) -> None:
        slack, total = 1e-6 * (1 + math.sqrt(self.pivots.top2)), self.norm2 + self.pivots.top2
        floor_, ceiling = self.least.min(1), self.most.max(1)
        # By the step's extremes first: the greatest score that any of its rows can have with an anchor.
        if apart.shape[1]:
            near = np.maximum(np.maximum(self.apart - apart.max(0), apart.min(0) - self.apart).max(1) - slack, 0)
            far = (self.apart + apart.max(0)).min(1) + slack
        else:
            near, far = np.zeros(len(total)), np.full(len(total), np.inf)
        bound = (total - near**2) / 2 * (1 + 1e-9) + 1
        act = np.flatnonzero((bound >= floor_) & ((total - far**2) / 2 - 1 - 1e-9 * total <= ceiling))
        if not len(act):
            return
        live = self.wants(labels)[act] & (self.ids[act, None] != ids)
        lo, hi = np.zeros(live.shape), np.full(live.shape, np.inf)
        for j in range(apart.shape[1]):
            np.maximum(lo, np.abs(self.apart[act, j, None] - apart[:, j]), out=lo)
            np.minimum(hi, self.apart[act, j, None] + apart[:, j], out=hi)
        margin = (1 + 1e-9 * total[act])[:, None]
        upper = (total[act, None] - np.maximum(lo - slack, 0) ** 2) / 2 + margin
        lower = (total[act, None] - (hi + slack) ** 2) / 2 - margin
        fits = np.zeros(live.shape, bool)
        for c in range(self.least.shape[1]):
            fits |= (upper >= self.least[act, c, None]) & (lower <= self.most[act, c, None])
        i, j = np.nonzero(live & fits)
        if not len(i):
            return
        width = min(values.shape[1], self.values.shape[1])
        own, rows = self.values[:, :width], values[:, :width]
        if len(i) * 16 > live.size:
            scores = (own[act] @ rows.T)[i, j]
        else:
            scores = np.concatenate([np.einsum("ij,ij->i", own[act[i[s : s + 65536]]], rows[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
        scores, i = scores.astype(np.int64), act[i]
        for c in range(self.least.shape[1]):
            some = np.flatnonzero((scores >= self.least[i, c]) & (scores <= self.most[i, c]))
            if not len(some):
                continue
            some = some[np.lexsort((ids[j[some]], -scores[some], i[some]))]
            heads = np.flatnonzero(np.diff(i[some], prepend=-1))
            for a, b in zip(heads.tolist(), np.append(heads[1:], len(some)).tolist()):
                own_rows = some[a : min(b, a + self.k)]
                self.take(int(i[some[a]]), c, list(zip(scores[own_rows].tolist(), ids[j[own_rows]].tolist())))

    def result(self) -> pa.RecordBatch:
        """(row, slot, score, id, place) of all found; place orders scores of any size."""
        found = [(r, c, max(_LONG[0], min(_LONG[1], s)), k, sortable(s), str(s)) for r, own in zip(self.rows.tolist(), self.best) for c, best in enumerate(own) for s, k in best]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate(kinds)], ["row", "slot", "score", "id", "place", "exact"])


_FOUND = "row long, slot int, score long, id long, place binary, exact string"


def with_distances(rows: DataFrame, pivots: Pivots, scale: int) -> DataFrame:
    """Adds the quantised components, the distances to the pivots (both as doubles) and the nearest pivot to rows
    (id, label, tame, vector); rows outside the table keep their plain components."""

    def place(batches):
        for batch in batches:
            vectors = batch.column(3)
            offs, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            values, apart, near = [b""] * batch.num_rows, [b""] * batch.num_rows, np.full(batch.num_rows, -1, np.int32)
            tame, widths = batch.column(2).to_numpy(zero_copy_only=False), np.diff(offs)
            for width in np.unique(widths).tolist():
                for inside in (True, False):
                    k = np.flatnonzero((widths == width) & (tame == inside))
                    own = flat[offs[:-1][k][:, None] + np.arange(width)]
                    if inside:
                        own = quantised(own, scale).astype(float)
                        distances = pivots.of_rows(own)
                        for r, d in zip(k.tolist(), distances):
                            apart[r] = d.astype("<f8").tobytes()
                        if distances.shape[1]:
                            near[k] = distances.argmin(1)
                    for r, v in zip(k.tolist(), own):
                        values[r] = v.astype("<f8").tobytes()
            columns = [*batch.columns[:3], pa.array(widths.astype(np.int32)), pa.array(near), pa.array(values, pa.binary()), pa.array(apart, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "tame", "width", "near", "vector", "apart"])

    return rows.select("id", "label", "tame", "vector").mapInArrow(place, "id long, label long, tame boolean, width int, near int, vector binary, apart binary")


_PACKED = "n int, tame boolean, ids binary, labels binary, vectors binary, apart binary"


def shards_of(placed: DataFrame, size: int) -> DataFrame:
    """Blobs of up to ``size`` rows in order of width, label and nearest pivot."""

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(3).to_numpy() * 2 + batch.column(2).to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(kind)) + 1):
                for i in range(int(part[0]), int(part[-1]) + 1, size):
                    own = batch.slice(i, min(size, int(part[-1]) + 1 - i))
                    blobs = [own.column(c).to_numpy().astype("<i8").tobytes() for c in (0, 1)] + [b"".join(own.column(c).to_pylist()) for c in (5, 6)]
                    yield pa.RecordBatch.from_arrays([pa.array([own.num_rows], pa.int32()), own.column(2).slice(0, 1), *[pa.array([b], pa.binary()) for b in blobs]], ["n", "tame", "ids", "labels", "vectors", "apart"])

    order = ["tame", "width", "label", "near", "id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _PACKED)


def searched(asked: DataFrame, shards: DataFrame, blocks: int, pivots: Pivots, scale: int, k: int, window: tuple[int, int] | None) -> DataFrame:
    """Each block of anchors (row, id, label, tame, width, vector and, with a window, exact scores of positives) against all
    shards: the best k of each anchor and positive in every shard of a task."""

    def pack(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.append_column("kind", pa.array(batch.column(batch.schema.get_field_index("width")).to_numpy() * 2 + batch.column(batch.schema.get_field_index("tame")).to_numpy(zero_copy_only=False)))
            keys = np.stack([table.column(c).to_numpy() for c in ("block", "kind")])
            order = np.lexsort(keys[::-1])
            for part in np.split(order, np.flatnonzero(np.diff(keys[:, order]).any(0)) + 1) if len(order) else []:
                own = table.take(pa.array(part))
                blobs = [own.column(c).to_numpy().astype("<i8").tobytes() for c in ("row", "id", "label")] + [b"".join(own.column("vector").to_pylist())]
                said = ";".join(",".join(p) for p in own.column("positives").to_pylist()) if window else ""
                yield pa.RecordBatch.from_arrays([own.column("block").combine_chunks().slice(0, 1), pa.array([len(part)], pa.int32()), own.column("tame").combine_chunks().slice(0, 1), *[pa.array([b], pa.binary()) for b in blobs], pa.array([said])], ["block", "q_n", "q_tame", "q_rows", "q_ids", "q_labels", "q_vectors", "q_positives"])

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).repartition("block").sortWithinPartitions("block")
    packed = dealt.mapInArrow(pack, "block int, q_n int, q_tame boolean, q_rows binary, q_ids binary, q_labels binary, q_vectors binary, q_positives string")
    # Each shard meets each block of the stated anchors once.
    cells = shards.select("cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    joined = packed.join(cells, "block").join(shards, "cell").sortWithinPartitions("block", "q_tame")

    def matrix(n, tame, blob):
        values = np.frombuffer(blob, "<f8").reshape(n, -1) if n and len(blob) else np.zeros((n, 0))
        return values if tame else quantised(values, scale)

    def search(batches):
        held = key = None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(batch.schema.get_field_index(c))[r].as_py()  # noqa: E731, B023
                if held is None or get("q_rows") != key:
                    if held:
                        yield held.result()
                    key, n = get("q_rows"), get("q_n")
                    positives = [[int(x) for x in p.split(",") if x] for p in get("q_positives").split(";")] if window else None
                    low, high = window or (0, 0)
                    held = Anchors(np.frombuffer(key, "<i8"), np.frombuffer(get("q_ids"), "<i8"), np.frombuffer(get("q_labels"), "<i8"), matrix(n, get("q_tame"), get("q_vectors")), get("q_tame"), pivots, positives, k, low, high)
                n, tame = get("n"), get("tame")
                apart = np.frombuffer(get("apart"), "<f8").reshape(n, -1) if tame and len(pivots.values) else np.zeros((n, 0))
                held.search(np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("labels"), "<i8"), matrix(n, tame, get("vectors")), tame, apart)
        if held:
            yield held.result()

    return joined.mapInArrow(search, _FOUND)


def best_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("place"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchors`` is a condition over ``id``."""
    scratch = Scratch(rows.sparkSession)
    valid = rest(rows, [id_col], vector_col, label_col).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), usable(F.col(vector_col)).alias("vector"))
    norm2 = F.aggregate("vector", F.lit(0.0), lambda n, x: n + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
    # floor() gives a long: values that it can't hold are outside the table anyway.
    wide = F.exists("vector", lambda x: F.abs(x) * scale >= 2.0**26)
    valid = valid.where("id is not null and label is not null and vector is not null").withColumn("norm2", F.when(~wide, norm2)).withColumn("tame", F.coalesce(F.col("norm2") <= TAME, F.lit(False)))
    valid = scratch.write(valid)
    tame = valid.where("tame")
    top2 = tame.agg(F.max("norm2")).first()[0] or 0.0
    sample = [quantised(np.array(r.vector, float), scale).astype(float) for r in tame.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    padded = np.zeros((len(sample), max(map(len, sample), default=0)))
    for k, v in enumerate(sample):
        padded[k, : len(v)] = v
    pivots = Pivots(padded, top2)
    placed = scratch.write(with_distances(valid, pivots, scale))
    shards = scratch.write(shards_of(placed, SHARD).withColumn("cell", F.monotonically_increasing_id()), "none")
    asked = scratch.write(placed.where(anchors).select(F.monotonically_increasing_id().alias("row"), "id", "label", "tame", "width", "vector"))
    blocks = max(1, -(-asked.count() // ANCHORS_A_BLOCK))
    first = scratch.write(best_of(searched(asked, shards, blocks, pivots, scale, positives, None), ["row"], positives).select("row", F.col("rank").alias("slot"), "id", "score", "exact"))
    own = first.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "exact"))), lambda p: p.exact).alias("positives"))
    found = searched(asked.join(own, "row"), shards, blocks, pivots, scale, negatives, (low, high))
    best = best_of(found, ["row", "slot"], negatives).withColumn("slot", F.col("slot") + 1)
    named = first.select("row", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    return best.join(named, ["row", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
