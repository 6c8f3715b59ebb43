"""Exact near-duplicate join on word shingles, through R-trees over count vectors.

Documents link when the Jaccard similarity of their shingle sets is at least 0.75.

1. Documents with equal sets become one representative.
2. The shingles of a set are put in one order, the same for all sets: by hash, the very common ones last.
   Two sets that link share one of their first ``n / 4 + 1`` shingles, so only sets that share such a
   shingle are compared. Which shingles count as common touches the cost alone, never the result. At the first shingle
   that two sets share, all of their overlap is yet to come: a set whose rest after a shingle allows a link with none of
   the sets there is not compared at that shingle (``promising``).
3. Each set's shingles are hashed into groups, at least as many as shingles; the counts are a point. Among the
   sets that share a shingle, an R-tree over the points, folded to GROUPS coordinates, yields the pairs whose
   summed coordinate minima reach the overlap that the threshold needs. The unfolded points bound them again
   before a pair leaves the task.
4. What is left is verified on the whole sets.

First each point takes two partners only: the one of highest random priority, which makes stars, and the one with the
most room over the threshold. The first round looks at each set's first STAR shared shingles. Verified pairs are contracted to components,
and that goes on while it at least halves what is open. Then all pairs that still lie in different components are
taken, by all shingles, so no link between components is lost, while a large group of copies costs a few pairs per
member. A shingle with many sets is dealt out as pairs of blocks of BLOCK sets.

Documents without words link with nothing and are their own component. Null ids take no part: their
component is null. Repeated rows, and ids with several texts, all come back; equal texts have equal
components. An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, buffers, rest, runs
from .graph import components
from .shingles import mix, shingle_sets

GROUPS = 32
#: Groups of a point: a power of two of at least the set's size, within these bounds.
LEAST_GROUPS, MOST_GROUPS = 64, 8192
#: Counts are held in two bits. What goes beyond them may overlap anywhere once points are folded, so both sets' excess
#: counts then; between unfolded points it can overlap no more than the lesser excess.
MOST_COUNT = 3
_ANY = 1 << 30
LEAF = 16
BLOCK = 256
STAR = 8
#: Counts of points that are unpacked together.
COUNTS = 1 << 20
#: A shingle in more than this share of all texts goes last in the order, as far as runs of texts show it.
COMMON = 0.0005
#: So many of those at most, the most frequent: 8 MB.
MOST_COMMON = 1 << 20
RUN_BYTES = 1 << 20
#: Bytes of text whose sets are made together: a word takes many times its bytes on the way.
SET_BYTES = 1 << 18
#: Names of sets (16 bytes each) are sent to every executor up to this number; more of them meet the texts in a shuffle.
SENT_NAMES = 500_000


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles in more than COMMON of all texts, counted in the runs of texts that hold them twice; MOST_COMMON at most."""

    def local(batches):
        for batch in batches:
            data, offs = buffers(batch.column(0))
            for i, j in runs(offs, RUN_BYTES):
                sets = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                often = times > max(1, COMMON * (j - i))
                yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often])], ["token", "n"])

    total = docs.count()
    rows = docs.select("text").mapInArrow(local, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON * total).orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def prefix(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n // 4 + 1 of a set in the global order."""
    most = len(tokens) // 4 + 1
    if len(common):
        last = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens
        tokens = np.concatenate([tokens[~last], tokens[last]])
    return tokens[:most]


def groups_for(n):
    """Groups of the points of sets of these sizes."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_GROUPS, MOST_GROUPS)


def point(tokens: np.ndarray) -> bytes:
    """Counts by group: all low bits, then all high bits."""
    groups = int(groups_for(len(tokens)))
    counts = np.minimum(np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups), MOST_COUNT)
    return np.packbits([counts & 1, counts >> 1], axis=1).tobytes()


class Points:
    """The points of many sets. A point of more groups folds to a shorter one, since groups are the low bits of a hash."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray):
        groups = groups_for(sizes)
        starts = np.cumsum(groups // 4) - groups // 4
        self.groups, self.place, self.words = groups, np.zeros(len(sizes), np.int64), {}
        self.coarse = np.zeros((len(sizes), GROUPS), np.int32)
        for g in np.unique(groups).tolist():
            at = np.flatnonzero(groups == g)
            self.place[at] = np.arange(len(at))
            packed = raw[starts[at][:, None] + np.arange(g // 4)]
            low, high = packed[:, : g // 8].view(np.uint64), packed[:, g // 8 :].view(np.uint64)
            self.words[g] = np.stack([low | high, high, low & high])  # which groups hold one, two, three or more
            step = max(1, COUNTS // g)
            for i in range(0, len(at), step):
                self.coarse[at[i : i + step]] = self._counts(g, np.arange(i, min(i + step, len(at)))).reshape(-1, g // GROUPS, GROUPS).sum(1, dtype=np.int32)
        self.excess = (sizes - self.coarse.sum(1)).astype(np.int32)

    def _counts(self, g: int, place: np.ndarray) -> np.ndarray:
        return np.unpackbits(self.words[g][:, place].view(np.uint8), axis=2).sum(0, dtype=np.uint8)

    def searched(self, at: np.ndarray) -> np.ndarray:
        """Coordinates for a tree. With those of asked() the last two minima are the two sets' excess."""
        return np.column_stack([self.coarse[at], self.excess[at], np.full(len(at), _ANY, np.int32)])

    def asked(self, at: np.ndarray) -> np.ndarray:
        return np.column_stack([self.coarse[at], np.full(len(at), _ANY, np.int32), self.excess[at]])

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most overlap that the unfolded points of the sets a and b allow."""
        same = self.groups[a] == self.groups[b]
        out = np.where(same, np.minimum(self.excess[a], self.excess[b]), self.excess[a] + self.excess[b]).astype(np.int64)
        for g in np.unique(self.groups[a]).tolist():
            for h in np.unique(self.groups[b]).tolist():
                both = np.flatnonzero((self.groups[a] == g) & (self.groups[b] == h))
                step = max(1, COUNTS // max(g, h))
                for i in range(0, len(both), step):
                    at = both[i : i + step]
                    x, y = self.place[a[at]], self.place[b[at]]
                    if g == h:
                        w = self.words[g]
                        out[at] += sum(np.bitwise_count(w[k, x] & w[k, y]).sum(1, dtype=np.int64) for k in range(3))
                    else:
                        low = min(g, h)
                        x, y = (self._counts(k, v).reshape(len(at), -1, low).sum(1, dtype=np.int32) for k, v in ((g, x), (h, y)))
                        out[at] += np.minimum(x, y).sum(1)
        return out


def set_id(tokens: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def summaries(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, set size n, id of the set (null when empty), prefix and point."""
    schema = "doc_id long, n long, id long, prefix array<long>, point binary, text_hash long"

    def summed(batches):
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for i, j in runs(offs, SET_BYTES):
                sets = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = np.array([len(s) for s in sets])
                prefixes = [prefix(s, common).view(np.int64) if len(s) else s.view(np.int64) for s in sets]
                points = pa.array([point(s) if len(s) else b"" for s in sets], pa.binary())
                ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), ids, lists(prefixes), points, batch.column(2).slice(i, j - i)], ["doc_id", "n", "id", "prefix", "point", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(summed, schema)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(np.int64)))


def needed(a, b):
    """Least overlap of linked sets of sizes a and b: 100 overlap >= 75 (a + b - overlap)."""
    return -(-3 * (a + b) // 7)


class PointTree:
    """Packed R-tree: points sorted by size in leaves of LEAF, nodes hold coordinate maxima and the least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(1), sizes))
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            top, size = self.levels[-1]
            cuts = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(size, cuts)))

    def pairs(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, bound) wherever the summed minima reach the needed overlap."""
        top, size = self.levels[-1]
        q, node = np.repeat(np.arange(len(points)), len(top)), np.tile(np.arange(len(top)), len(points))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, size = self.levels[depth]
            keep, bounds = [], []
            for i in range(0, len(q), 1 << 16):
                a, b = q[i : i + (1 << 16)], node[i : i + (1 << 16)]
                bound = np.minimum(points[a], top[b]).sum(1, dtype=np.int64)
                # A node's least size gives the least need of any set below it.
                ok = bound >= needed(sizes[a], size[b])
                keep.append(np.flatnonzero(ok) + i)
                bounds.append(bound[ok])
            keep = np.concatenate(keep) if keep else np.empty(0, np.int64)
            q, node, bound = q[keep], node[keep], np.concatenate(bounds) if bounds else np.empty(0, np.int64)
            if depth:
                below = len(self.levels[depth - 1][0])
                child = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                q, child = np.repeat(q, LEAF)[child < below], child[child < below]
                node = child
        return q, self.order[node], bound


def candidates(rows: DataFrame, seed: int | None) -> DataFrame:
    """Pairs of different components from rows (key, side, id, component, n, point), each key's rows in one task.
    side 0 and 1 are compared with each other, side 2 within itself.

    Without a seed: all pairs (a, b) with a < b. With one: rows (a, b, room, priority) with at most two partners b of
    each row a and key, of most room over the threshold and of highest priority."""

    def best(a, b, room, ids, n):
        """Of each a the two partners."""
        priority = mix(ids[b].view(np.uint64) ^ np.uint64(seed)).view(np.int64)
        worth = room / n[a]
        keep = []
        for by in (worth, priority):
            order = np.lexsort((ids[b], by, a))
            keep.append(order[np.append(a[order][1:] != a[order][:-1], True)] if len(a) else order)
        k = np.unique(np.concatenate(keep))
        return ids[a[k]], ids[b[k]], worth[k], priority[k]

    def fitting(a, b, comp, n, points):
        """Of the pairs of places (a, b) those of different components that the unfolded points allow, and their room."""
        apart = comp[a] != comp[b]
        a, b = a[apart], b[apart]
        room = points.bound(a, b) - needed(n[a], n[b])
        ok = room >= 0
        return a[ok], b[ok], room[ok]

    def in_group(at, side, comp, n, points):
        """Pairs of one key's rows at these places."""
        out = []
        for left, right in ((side[at] == 2, side[at] == 2), (side[at] == 0, side[at] == 1)):
            left, right = at[left], at[right]
            if not len(left) or not len(right):
                continue
            tree = PointTree(points.searched(right), n[right])
            for i in range(0, len(left), 64):
                q, p, _ = tree.pairs(points.asked(left[i : i + 64]), n[left[i : i + 64]])
                out.append(fitting(left[q + i], right[p], comp, n, points))
        return out

    def in_leaves(rows, comp, n, points, size):
        """All groups of at most LEAF rows at once; each is a tree's single leaf."""
        start = np.cumsum(size) - size
        left = np.repeat(start + size, size) - np.arange(len(rows))
        out = []
        for d in range(1, LEAF):
            x = np.flatnonzero(left > d)
            if not len(x):
                break
            a, b = rows[x], rows[x + d]
            apart = comp[a] != comp[b]
            a, b = a[apart], b[apart]
            ok = np.minimum(points.coarse[a], points.coarse[b]).sum(1, dtype=np.int64) + points.excess[a] + points.excess[b] >= needed(n[a], n[b])
            out.append(fitting(a[ok], b[ok], comp, n, points))
        return out

    def emit(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key, side, ids, comp, n = (table.column(c).to_numpy() for c in ("key", "side", "id", "component", "n"))
        points = Points(buffers(table.column("point"))[0], n)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(start, append=len(key))
        closed = np.minimum.reduceat(comp, start) == np.maximum.reduceat(comp, start)
        small = ~closed & (np.minimum.reduceat(side, start) == 2) & (size <= LEAF)
        found = in_leaves(np.flatnonzero(np.repeat(small, size)), comp, n, points, size[small])
        for k in np.flatnonzero(~closed & ~small):
            found += in_group(np.arange(start[k], start[k] + size[k]), side, comp, n, points)
        a, b, room = (np.concatenate([f[c] for f in found] or [np.empty(0, np.int64)]) for c in range(3))
        if seed is None:
            pairs = np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1).astype(np.int64)
            pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        columns = best(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([room, room]), ids, n)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.float64, np.int64))], ["a", "b", "room", "priority"])

    def by_key(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield emit(pa.Table.from_batches(held))
                held = []
            change = np.flatnonzero(key[1:] != key[:-1])
            if len(change):  # the last key may go on in the next batch
                at = int(change[-1]) + 1
                yield emit(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held, batch = [], batch.slice(at)
            held.append(batch)
        if held:
            yield emit(pa.Table.from_batches(held))

    ordered = rows.select("key", "side", "id", "component", "n", "point").repartition("key").sortWithinPartitions("key")
    if seed is None:
        return ordered.mapInArrow(by_key, "a long, b long").distinct()
    chosen = ordered.mapInArrow(by_key, "a long, b long, room double, priority long").groupBy("a").agg(F.max(F.struct("room", "b")).b.alias("x"), F.max(F.struct("priority", "b")).b.alias("y"))
    pairs = chosen.select("a", F.explode(F.array("x", "y")).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough, by their true overlap."""
    a = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    overlap = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").where(7 * overlap >= 3 * (F.size("ta") + F.size("tb"))).select("a", "b").distinct()


def full_sets(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(id, tokens) of the sets in names (id, doc_id), each read from the document named there."""

    def made(batches):
        for batch in batches:
            data, offs = buffers(batch.column(1))
            wanted = batch.column(0).to_numpy()
            for i, j in runs(offs, SET_BYTES):
                sets = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                # Another text under the same id isn't the one that is meant.
                sets = [s for k, s in enumerate(sets, i) if len(s) and set_id(s) == wanted[k]]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), lists([s.view(np.int64) for s in sets])], ["id", "tokens"])

    return docs.join(names, "doc_id").select("id", "text").mapInArrow(made, "id long, tokens array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) for every row; also text_hash, Spark's xxhash64 of
    the text, and component, which tells components apart where ids repeat (null without words)."""
    scratch = Scratch(docs.sparkSession)
    docs = rest(docs, [id_col], text_col).toDF("doc_id", "text")
    base = scratch.write(summaries(docs, common_shingles(docs)))

    # One representative per distinct set, with the least document id that has it.
    first = [F.first(c).alias(c) for c in ("n", "prefix", "point")]
    reps = scratch.write(base.where("doc_id is not null and id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), *first))
    small = scratch.write(base.select("doc_id", "n", "id", "text_hash"))
    scratch.drop(base)
    # The shingles that each set shares with others, in its order, with the number of sets that have them.
    tokens = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = scratch.write(tokens.groupBy("token").count().where("count > 1"))
    met = scratch.write(tokens.join(shared, "token"))
    rows = promising(met).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "count"))).alias("shared"))
    sets = scratch.write(rows.join(reps.select("id", "n", "point"), "id"))
    names = scratch.write(reps.select("id", "doc_id"))
    scratch.drop(reps, shared, met)

    labels, step, opened = None, 0, 0
    while True:
        placed = sets.withColumn("component", F.col("id")) if labels is None else sets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        by_token = tokens_of(placed, F.slice("shared", 1, STAR) if not step else F.col("shared"), "n", "point")
        before, last = opened, False
        if step:
            thin = tokens_of(placed, F.col("shared"))
            opens = scratch.write(open_tokens(thin))
            opened = opens.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            if not opened:
                break
            last = step > 1 and opened * 2 > before
            # Only shingles whose sets lie in several components go on; their rows get their points after that.
            by_token = thin.join(opens.select("token"), "token", "left_semi").join(sets.select("id", "n", "point"), "id")
        blocks = F.ceil(F.col("count") / BLOCK)
        own = F.pmod(F.xxhash64("id", "token", F.lit(step)), blocks)
        if last:
            dealt = by_token.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            dealt = dealt.withColumn("key", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
            dealt = dealt.withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
        else:
            dealt = by_token.withColumn("key", F.xxhash64("token", own)).withColumn("side", F.lit(2))
        pairs = scratch.write(candidates(dealt, None if last else step))
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = scratch.write(names.join(ends, "id", "left_semi").select("id", "doc_id"))
        whole = scratch.write(full_sets(docs, F.broadcast(wanted) if wanted.count() <= SENT_NAMES else wanted))
        good = scratch.write(verified(pairs, whole))
        scratch.drop(pairs, wanted, whole)
        links = good if labels is None else good.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        labels = scratch.write(components(links, scratch))
        if last:
            break
        step += 1

    least = names.join(labels, "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = scratch.write(labels.join(least, "component").select("id", "component_id", "component"))
    joined = small.join(found, "id", "left").join(names.select("id", F.col("doc_id").alias("first_id")), "id", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "first_id", "doc_id")).alias("component_id"), "text_hash", F.coalesce("component", "id").alias("component"))


def promising(rows: DataFrame) -> DataFrame:
    """The rows (id, n, pos, token, count) that may be where a set first shares a shingle with one that it links with: both have
    n - pos shingles left, at least the overlap that they need. Of shingles with more than BLOCK sets all rows stay."""
    few = rows.where(F.col("count") <= BLOCK)
    a, b = few.alias("a"), few.alias("b")
    left = lambda s: F.col(f"{s}.n") - F.col(f"{s}.pos")
    enough = 7 * F.least(left("a"), left("b")) >= 3 * (F.col("a.n") + F.col("b.n"))
    kept = a.join(b.hint("merge"), (F.col("a.token") == F.col("b.token")) & (F.col("a.id") != F.col("b.id")) & enough, "left_semi")
    return kept.unionByName(rows.where(F.col("count") > BLOCK))


def tokens_of(placed: DataFrame, shared, *more: str) -> DataFrame:
    """(id, component, token, count) of the shingles of each set, with further columns."""
    return placed.select("id", "component", *more, F.explode(shared).alias("s")).select("id", "component", *more, "s.token", "s.count")


def open_tokens(rows: DataFrame) -> DataFrame:
    """(token, rows) of the shingles whose sets lie in more than one component."""
    per_token = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows"))
    return per_token.where("x <> y").select("token", "rows")
