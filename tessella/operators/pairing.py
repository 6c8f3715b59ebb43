"""Greedy pairing by distance inside keys, without a limit on candidates.

All edges between a key's target and source rows stand in one order: rounded distance, number of differing attributes, target
row, source row. Pairing takes the first edge whose rows are both free, again and again. The result is the one in which every
pair is the best edge of both its rows among those free at the time, so it can be found from any place:

* Keys of up to SMALL rows go to tasks by buckets of about BUCKET rows. Keys of few edges are paired together: the edges of many of
  them in one order, taken greedily. In other keys a task follows chains of best partners until two rows are each other's best.
  That takes time with the square of a key's rows and memory with the rows.
* A larger key is dealt to blocks of space of about BLOCK rows with a margin around them. A block takes its edges up to a reach in
  order and keeps those that nothing outside its margin can change: an edge longer than the way to the margin's end makes both
  rows doubtful, and so does an edge to a doubtful row. Blocks are shifted and the reach grows with the distance of the rows
  that are left, round by round, until a key is small. Only rows of one place, which no shift takes apart, stay together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.overlay import ranges
from .staging import settled, spread, written

SMALL = 1 << 13
BLOCK = 4096
#: Distances are compared in whole multiples of this.
QUANTUM = 1e-4
#: Edges of a block that are looked at together; beyond, the block's reach is halved.
EDGES = 1 << 21
#: Rows of small keys that a task looks at together, and edges of a key up to which all are listed.
BUCKET = 1 << 15
FEW = 1 << 12
_ROW = "key string, side int, rec long, x double, y double, attributes array<string>, line array<double>"


class Points:
    """Rows of one side by rec: places, attribute codes, and samples of lines (NaN for other shapes)."""

    def __init__(self, rec, xy, codes, lines):
        self.rec, self.xy, self.codes, self.lines = rec, xy, codes, lines

    def take(self, k) -> "Points":
        return Points(self.rec[k], self.xy[k], self.codes[k], self.lines[k])

    def __len__(self) -> int:
        return len(self.rec)


def sides(table: pa.Table) -> tuple[Points, Points, np.ndarray]:
    """Target and source points of a table's rows, and the rows' order."""
    n = table.num_rows
    side, rec = table.column("side").to_numpy(), table.column("rec").to_numpy()
    xy = np.stack([table.column(c).to_numpy() for c in "xy"], 1)
    values = table.column("attributes").to_pylist()
    width = max((len(v) for v in values if v), default=0)
    codes = np.zeros((n, width), np.int64)
    for c in range(width):
        seen: dict = {}
        codes[:, c] = [seen.setdefault(v[c] if v and c < len(v) else None, len(seen)) for v in values]
    lines = np.full((n, 16, 2), np.nan, np.float64)
    drawn = table.column("line").to_pylist() if table.column("line").null_count < n else []
    for k, line in enumerate(drawn):
        if line:
            p = np.array(line, float).reshape(-1, 2)
            lines[k] = p[np.minimum(np.arange(16), len(p) - 1)]  # short samples repeat their last point
    order = np.lexsort((rec, side))
    whole = Points(rec, xy, codes, lines).take(order)
    n_target = int((side == 0).sum())
    return whole.take(slice(0, n_target)), whole.take(slice(n_target, None)), order


def distances(a: Points, i, b: Points, j) -> np.ndarray:
    """Distance of rows: between their places; of two lines no less than the Hausdorff distance of their samples."""
    d = np.hypot(*(a.xy[i] - b.xy[j]).T)
    both = np.flatnonzero(~np.isnan(a.lines[:, 0, 0])[i] & ~np.isnan(b.lines[:, 0, 0])[j] & np.ones(len(d), bool))
    for at in range(0, len(both), 4096):
        k = both[at : at + 4096]
        p, q = (v.lines[np.broadcast_to(x, len(d))[k]] for v, x in ((a, i), (b, j)))
        apart = np.hypot(*np.moveaxis(p[:, :, None] - q[:, None], -1, 0))
        d[k] = np.maximum(d[k], np.maximum(apart.min(2).max(1), apart.min(1).max(1)))
    return d


def quantised(d: np.ndarray) -> np.ndarray:
    return np.floor(d / QUANTUM + 0.5)


def best(own: Points, k: int, other: Points) -> tuple[int, float]:
    """The other side's best row for row k, by distance, differences and rec, and its distance."""
    d = distances(own, np.array([k]), other, np.arange(len(other)))
    q = quantised(d)
    some = np.flatnonzero(q == q.min())
    if len(some) > 1:
        apart = (other.codes[some] != own.codes[k]).sum(1)
        some = some[apart == apart.min()]
    return int(some[0]), float(d[some[0]])


def chained(t: Points, s: Points) -> list[tuple[int, int, float]]:
    """All greedy pairs (target rec, source rec, distance): best partners are followed until two rows are each other's."""
    out, free, chain = [], [np.ones(len(t), bool), np.ones(len(s), bool)], []
    now, place = [t, s], [np.arange(len(t)), np.arange(len(s))]
    for _ in range(min(len(t), len(s))):
        for side in (0, 1):  # rows that are gone are left out when they are half of what is looked at
            if 2 * free[side][place[side]].sum() < len(place[side]):
                place[side] = place[side][free[side][place[side]]]
                now[side] = (t, s)[side].take(place[side])
        if not chain:
            chain = [int(np.flatnonzero(free[0])[0])]
        while True:
            side = (len(chain) - 1) % 2
            k, other = chain[-1], place[1 - side]
            live = free[1 - side][other]
            found = now[1 - side] if live.all() else now[1 - side].take(live)
            j, d = best((t, s)[side], k, found)
            j = int((other if live.all() else other[live])[j])
            if len(chain) > 1 and chain[-2] == j:
                break
            chain.append(j)
        a, b = (chain[-2], chain[-1]) if len(chain) % 2 == 0 else (chain[-1], chain[-2])
        out.append((int(t.rec[a]), int(s.rec[b]), d))
        free[0][a] = free[1][b] = False
        del chain[-2:]
    return out


def edges_within(t: Points, s: Points, reach: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs whose places are at most ``reach`` apart, by a grid of that size; None if they are too many."""
    if not len(t) or not len(s):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.minimum(t.xy.min(0), s.xy.min(0))
    size = max(reach, 1e-9)
    a, b = (np.floor((p.xy - low) / size).astype(np.int64) for p in (t, s))
    code = lambda c: c[:, 0] * (1 << 31) + c[:, 1]
    order = np.argsort(code(b), kind="stable")
    cells = code(b)[order]
    starts, stops = [], []
    for dx in (-1, 0, 1):  # three cells above each other stand in a row
        starts.append(np.searchsorted(cells, code(a + [dx, -1]), "left"))
        stops.append(np.searchsorted(cells, code(a + [dx, 1]), "right"))
    starts, stops = np.concatenate(starts), np.concatenate(stops)
    if (stops - starts).sum() > 16 * EDGES:
        return None
    found, n = [], 0
    for i, j in ranges(starts, stops):
        i, j = i % len(t), order[j]
        near = ((t.xy[i] - s.xy[j]) ** 2).sum(1) <= reach * reach
        found.append((i[near], j[near]))
        n += int(near.sum())
        if n > EDGES:
            return None
    return tuple(np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in (0, 1))


def certain(t: Points, s: Points, reach: float, room_t: np.ndarray, room_s: np.ndarray) -> list[tuple[int, int, float]]:
    """Greedy pairs (target, source, distance) that rows beyond ``room`` of each row can't change."""
    while (found := edges_within(t, s, reach)) is None:
        reach /= 2
        if reach < QUANTUM / 4:  # many rows of one place: no edge list, but chains if nothing is outside
            return chained_places(t, s) if min(room_t.min(), room_s.min()) == np.inf else []
    i, j = found
    d = distances(t, i, s, j)
    q, apart = quantised(d), (t.codes[i] != s.codes[j]).sum(1)
    order = np.lexsort((s.rec[j], t.rec[i], apart, q))
    known = d + 2 * QUANTUM < np.minimum(np.minimum(room_t[i], room_s[j]), reach if np.isfinite(reach) else np.inf)
    taken, doubt = (bytearray(len(t)), bytearray(len(s))), (bytearray(len(t)), bytearray(len(s)))
    out = []
    for a, b, sure, length in zip(i[order].tolist(), j[order].tolist(), known[order].tolist(), d[order].tolist()):
        if taken[0][a] or taken[1][b]:
            continue
        if sure and not doubt[0][a] and not doubt[1][b]:
            taken[0][a] = taken[1][b] = 1
            out.append((a, b, length))
        else:
            doubt[0][a] = doubt[1][b] = 1
    return out


def chained_places(t: Points, s: Points) -> list[tuple[int, int, float]]:
    at, bt = {int(r): k for k, r in enumerate(t.rec)}, {int(r): k for k, r in enumerate(s.rec)}
    return [(at[a], bt[b], d) for a, b, d in chained(t, s)]


_FOUND = "key string, db_rec long, file_rec long, distance double"


def _pairs(key: str, rows) -> pa.Table:
    columns = [[key] * len(rows), *([r[c] for r in rows] for c in range(3))]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["key", "db_rec", "file_rec", "distance"])


def listed(t: Points, s: Points, of_t: np.ndarray, of_s: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, float]]:
    """All greedy pairs (target, source, distance) of several keys, from the list of all their edges. ``of_t`` and ``of_s`` say the
    rows' keys, numbers in order."""
    first, last = np.searchsorted(of_s, of_t, "left"), np.searchsorted(of_s, of_t, "right")
    out, at = [], 0
    free_t, free_s = bytearray(b"\1" * len(t)), bytearray(b"\1" * len(s))
    upto = np.concatenate([[0], np.cumsum(last - first)])
    ends = np.searchsorted(of_t, keys, "right")  # blocks end where a key does
    while at < len(t):
        fit = ends[(upto[ends] <= upto[at] + EDGES) & (ends > at)]
        end = int(fit[-1] if len(fit) else ends[ends > at][0])
        n = (last - first)[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:end], n)
        d = distances(t, i, s, j)
        order = np.lexsort((s.rec[j], t.rec[i], (t.codes[i] != s.codes[j]).sum(1), quantised(d)))
        for a, b, length in zip(i[order].tolist(), j[order].tolist(), d[order].tolist()):
            if free_t[a] and free_s[b]:
                free_t[a] = free_s[b] = 0
                out.append((a, b, length))
        at = end
    return out


def _whole_keys(table: pa.Table) -> pa.Table:
    """The pairs of all keys of a bucket."""
    coded = table.column("key").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    names, key = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    t, s, order = sides(table)
    key = key[order]
    of_t, of_s = key[: len(t)], key[len(t) :]
    by_t, by_s = np.argsort(of_t, kind="stable"), np.argsort(of_s, kind="stable")
    t, s, of_t, of_s = t.take(by_t), s.take(by_s), of_t[by_t], of_s[by_s]
    n_t, n_s = np.bincount(of_t, minlength=len(names)), np.bincount(of_s, minlength=len(names))
    few = n_t * n_s <= FEW
    small_t, small_s = few[of_t], few[of_s]
    p, q = t.take(small_t), s.take(small_s)
    pairs = listed(p, q, of_t[small_t], of_s[small_s], np.flatnonzero(few & (n_t > 0)))
    said, a, b, d = ([names[k] for k in of_t[small_t][[x[0] for x in pairs]]] if pairs else []), [int(p.rec[x[0]]) for x in pairs], [int(q.rec[x[1]]) for x in pairs], [x[2] for x in pairs]
    for k in np.flatnonzero(~few):
        more = chained(t.take(of_t == k), s.take(of_s == k))
        said, a, b, d = said + [names[k]] * len(more), a + [x[0] for x in more], b + [x[1] for x in more], d + [x[2] for x in more]
    columns = zip((said, a, b, d), (pa.string(), pa.int64(), pa.int64(), pa.float64()))
    return pa.table([pa.array(c, kind) for c, kind in columns], ["key", "db_rec", "file_rec", "distance"])


def _block(table: pa.Table) -> pa.Table:
    """The certain pairs whose target row's home is this block."""
    t, s, order = sides(table)
    first = {c: table.column(c)[0].as_py() for c in ("x1", "y1", "x2", "y2", "reach", "key")}
    low, high = np.array([first["x1"], first["y1"]]), np.array([first["x2"], first["y2"]])
    room = lambda p: np.minimum(p.xy - low, high - p.xy).min(1)
    home = table.column("home").to_numpy()[order][: len(t)]
    found = certain(t, s, first["reach"], room(t), room(s)) if len(t) and len(s) else []
    return _pairs(first["key"], [(int(t.rec[a]), int(s.rec[b]), d) for a, b, d in found if home[a]])


def by_distance(rows: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(key, db_rec, file_rec, distance) of rows (key, side 0 for the target and 1 for the source, rec, x, y, attributes, line)."""
    left, found, widen, shift = rows.select(*[c.split()[0] for c in _ROW.split(", ")]), None, 1.0, 0.0
    while True:
        stats = left.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("n_t"), F.count_if(F.col("side") == 1).alias("n_s"), *[f(c).alias(f"{m}{c}") for c in "xy" for m, f in (("least", F.min), ("most", F.max))])
        stats = stats.where("n_t > 0 and n_s > 0").withColumn("n", F.col("n_t") + F.col("n_s"))
        wide = F.greatest(F.col("mostx") - F.col("leastx"), F.col("mosty") - F.col("leasty"), F.lit(QUANTUM))
        # About eight rows in reach at first; a key whose reach spans it goes to one task, as a small one does.
        reach = F.lit(widen * 1.5) * wide / F.sqrt(F.least(F.col("n_t"), F.col("n_s")))
        side = F.greatest(wide * F.sqrt(block / F.col("n")), 8 * reach)
        sized = stats.withColumn("wide", wide).withColumn("reach", reach).withColumn("size", side).withColumn("alone", (F.col("n") <= small) | (side >= wide))
        sized = written(sized)
        keyed = left.join(sized, "key")
        buckets = F.ceil(F.lit(sized.where("alone").agg(F.sum("n")).first()[0] or 0) / F.lit(BUCKET))
        own = keyed.where("alone").select(*left.columns, F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), buckets)).alias("bucket"))
        own = written(spread(own, "bucket").groupBy("bucket").applyInArrow(lambda g: _whole_keys(g), _FOUND))
        found = own if found is None else found.unionByName(own)
        big = sized.where("not alone").agg(F.sum("n")).first()[0]
        if not big:
            return found
        reached = lambda c: F.sequence(*[F.floor((F.col(c) - F.col(f"least{c}") + sign * 2 * F.col("reach")) / F.col("size") + shift).cast("int") for sign in (-1, 1)])  # noqa: E731, B023
        at = lambda c: F.floor((F.col(c) - F.col(f"least{c}")) / F.col("size") + shift).cast("int")  # noqa: E731, B023
        dealt = keyed.where("not alone").withColumn("bx", F.explode(reached("x"))).withColumn("by", F.explode(reached("y"))).withColumn("home", (F.col("bx") == at("x")) & (F.col("by") == at("y")))
        inf = F.lit(float("inf"))
        for c in "xy":  # what a block knows: its own space and a margin of twice the reach; nothing lies beyond a key's extent
            begin = F.col(f"least{c}") + (F.col(f"b{c}") - shift) * F.col("size") - 2 * F.col("reach")
            end = begin + F.col("size") + 4 * F.col("reach")
            dealt = dealt.withColumn(f"{c}1", F.when(begin <= F.col(f"least{c}"), -inf).otherwise(begin)).withColumn(f"{c}2", F.when(end >= F.col(f"most{c}"), inf).otherwise(end))
        sure = written(dealt.select(*left.columns, "home", "x1", "y1", "x2", "y2", "reach", "bx", "by").groupBy("key", "bx", "by").applyInArrow(lambda g: _block(g), _FOUND))
        found = found.unionByName(sure)
        gone = sure.select("key", F.lit(0).alias("side"), F.col("db_rec").alias("rec")).union(sure.select("key", F.lit(1), "file_rec"))
        left = settled(keyed.where("not alone").select(*left.columns).join(gone, ["key", "side", "rec"], "left_anti"))
        widen, shift = widen * (2 if sure.count() * 20 < big else 1), 0.5 - shift


def nearest_pairs(t: DataFrame, s: DataFrame) -> DataFrame:
    """(key, method, db_rec, file_rec, distance) of rows (key, rec, x, y, attributes and, if they have it, line: up to 16 points of
    a line as x, y, x, y ...). GEOMETRY: paired by distance. ELIMINATION: one row is left on each side. UNPAIRED: the other side
    has none left. AMBIGUOUS: rows without a place (x or y is null or no number) face several others. Every row of both sides comes
    back once; rows without a key take no part."""
    side = lambda df, k: df.select("key", F.lit(k).alias("side"), F.col("rec").cast("long").alias("rec"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "attributes", (F.col("line") if "line" in df.columns else F.lit(None)).cast("array<double>").alias("line"))
    rows = written(side(t, 0).unionByName(side(s, 1)).where("key is not null"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    found = written(by_distance(rows.where(finite("x") & finite("y"))))
    gone = found.select("key", F.lit(0).alias("side"), F.col("db_rec").alias("rec")).union(found.select("key", F.lit(1), "file_rec"))
    left = rows.select("key", "side", "rec").join(gone, ["key", "side", "rec"], "left_anti")
    counts = left.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("n_t"), F.count_if(F.col("side") == 1).alias("n_s"), F.min("rec").alias("any"), *[F.max(F.when(F.col("side") == k, F.col("rec"))).alias(c) for k, c in ((0, "db_rec"), (1, "file_rec"))])
    none, single = F.lit(None).cast("double").alias("distance"), (F.col("n_t") == 1) & (F.col("n_s") == 1)
    one = counts.where(single).select("key", F.lit("ELIMINATION").alias("method"), "db_rec", "file_rec", none)
    method = F.when((F.col("n_t") == 0) | (F.col("n_s") == 0), "UNPAIRED").otherwise("AMBIGUOUS")
    rest = left.join(counts.where(~single).select("key", "n_t", "n_s"), "key")
    rest = rest.select("key", method.alias("method"), *[F.when(F.col("side") == k, F.col("rec")).alias(c) for k, c in ((0, "db_rec"), (1, "file_rec"))], none)
    return found.select("key", F.lit("GEOMETRY").alias("method"), "db_rec", "file_rec", "distance").unionByName(one).unionByName(rest)
