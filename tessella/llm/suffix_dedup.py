"""Removal of repeated passages: bytes covered by a string of ``length`` bytes that also starts anywhere else.

The repeats come from the longest common prefixes of suffixes, by threshold-bounded interval expansion on a
Burrows-Wheeler transform: from the intervals of single symbols, backward extension finds, breadth first,
every place where neighbouring suffixes part after 0, 1, 2, ... symbols, and stops at ``length``. Suffixes that
have not parted then share a string of that length.

One transform of all texts would not fit one task, so the strings are dealt out by content. Of every window of
``length`` bytes the least-hashed GRAM bytes are its anchor: equal windows have equal anchors, wherever they
stand, and neighbouring windows mostly share one. An anchor's windows make up its context. Equal texts count
once with a weight, then equal contexts do. Anchors that stand in one place only are dropped; an anchor with one
context that occurs several times repeats throughout; the different contexts of an anchor go together into
a block, and each block of about BLOCK_BYTES is transformed for itself. An anchor with over HOT contexts is not
gathered: its windows are counted by their 128-bit hashes, which needs no group in one place.

Strings are judged on the input, as UTF-8 bytes; matches never cross rows. Null text is empty. Each row counts,
repeated ones too: an exact copy of ``length`` bytes or more goes entirely. Shorter texts stay. Null ids are
kept as they are. An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, buffers, rest, runs
from .shingles import mix

LENGTH = 200
GRAM = 40
BLOCK_BYTES = 1 << 20
HOT = 8192
RUN_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_PLACE = np.uint64((1 << 31) - 1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * RUN_BYTES)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_P, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i, from running minima within blocks of that width, forward and backward."""
    n = len(x)
    whole = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[:n] = x
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Of all rows: (row, place of the anchor in the row, first and last window relative to it, anchor hash, context hash)."""
    n = len(data)
    sizes = np.diff(offsets)
    room = np.maximum(sizes - length + 1, 0)
    if n < length or not room.any():
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int16, np.int16, np.int64, np.int64))
    up, down = powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    grams = mix((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
    # The place breaks ties between equal hashes: the first in the window.
    least = sliding_least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    row = np.repeat(np.arange(len(sizes)), room)
    ends = np.cumsum(room)
    window = np.arange(int(ends[-1])) - np.repeat(ends - room, room) + offsets[row]
    at = (least[window] & _PLACE).astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    lo, hi, a, row = window[first], window[last], at[first], row[first]
    raw = data.tobytes()
    digest = xxhash.xxh3_64_intdigest
    context = np.fromiter((digest(raw[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist())), np.uint64, len(lo))
    return row, (a - offsets[row]).astype(np.int32), (lo - a).astype(np.int16), (hi - a).astype(np.int16), grams[a].view(np.int64), context.view(np.int64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by prefix doubling."""
    n = len(text)
    key, h = np.zeros(n, np.int64), 7
    for k in range(h):
        key[: n - k] |= text[k:].astype(np.int64) << (9 * (h - 1 - k))
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if h >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        h *= 2


def parted(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix in the order parts from the one before it within ``depth`` symbols.

    Breadth first over the Burrows-Wheeler transform: the suffixes that start with c w are, in order, those that
    start with w and have c before them. So two neighbours with the same first symbol part after l + 1 symbols
    where the suffixes that follow them lie in different intervals of length l."""
    transform = text[order - 1]
    follow = np.argsort(transform, kind="stable")  # rank of the suffix one symbol shorter
    symbol = transform[follow]
    border = np.ones(len(text), bool)
    border[1:] = symbol[1:] != symbol[:-1]
    open_ = np.flatnonzero(~border)
    x, y = follow[open_ - 1], follow[open_]
    for _ in range(depth - 1):
        interval = np.cumsum(border, dtype=np.int32)
        new = interval[x] != interval[y]
        if not new.any():
            break  # nothing parts at this length, so nothing does at a greater one
        border[open_[new]] = True
        stay = ~new
        open_, x, y = open_[stay], x[stay], y[stay]
    return border


def repeated_starts(contexts: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context: at which of its window starts a string of ``length`` bytes stands that occurs twice or more,
    each context counting as often as its weight says."""
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    text = np.zeros(int(ends[-1]), np.uint16)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    order = suffix_order(text, length)
    border = parted(text, order, length)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # A window must lie within its context; shorter suffixes aren't windows.
    window = (ends[owner] - 1 - np.arange(len(text))) >= length
    weight = np.where(window, weights[owner], 0)[order]
    group = np.cumsum(border) - 1
    total = np.bincount(group, weight)
    again = np.zeros(len(text), bool)
    again[order] = total[group] >= 2
    again &= window
    return [np.flatnonzero(again[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())]


def as_runs(starts: np.ndarray, shift: int) -> list[int]:
    """[first, last, first, last, ...] of runs of consecutive numbers, shifted."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)
    first, last = np.concatenate([[starts[0]], starts[gap + 1]]), np.concatenate([starts[gap], [starts[-1]]])
    return (np.stack([first, last], 1).ravel() + shift).tolist()


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (array of start, end: maximal removed runs) and kept (the other bytes).
    With ``carry`` also ``row``, a struct of all other columns of ``docs``."""
    gram = min(GRAM, length)
    scratch = Scratch(docs.sparkSession)
    whole_rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")) if carry else None
    docs = rest(docs, [id_col], text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("key", F.unhex(F.md5("text")))

    def find(batches):
        for batch in batches:
            data, offs = buffers(batch.column(1))
            for i, j in runs(offs, RUN_BYTES):
                row, at, lo, hi, anchor, context = anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length, gram)
                has = np.unique(row)
                cuts = np.searchsorted(row, np.append(has, j - i)).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(c)) for c in (at, lo, hi, anchor, context)]
                keys = batch.column(0).slice(i, j - i).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([keys, *columns], ["key", "at", "lo", "hi", "anchor", "context"])

    kinds = "at array<int>, lo array<short>, hi array<short>, anchor array<long>, context array<long>"
    names = ["at", "lo", "hi", "anchor", "context"]
    long = docs.where(F.octet_length("text") >= length)
    # One row per different text, with its copies as weight.
    texts = long.select("key", "text").mapInArrow(find, f"key binary, {kinds}").groupBy("key").agg(F.count("*").alias("weight"), *[F.first(c).alias(c) for c in names])
    texts = scratch.write(texts.withColumn("rid", F.monotonically_increasing_id()))
    places = texts.select("rid", "weight", F.explode(F.arrays_zip(*names)).alias("p")).select("rid", "weight", "p.*")
    often = scratch.write(places.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor"))
    places = scratch.write(places.join(often, "anchor"))
    scratch.drop(often)
    keys = scratch.write(texts.select("rid", "key", "weight"))
    scratch.drop(texts)

    contexts = scratch.write(places.groupBy("anchor", "context").agg(F.sum("weight").alias("weight"), F.min(F.struct("rid", "at", "lo", "hi")).alias("p")).select("anchor", "context", "weight", "p.*"))
    groups = scratch.write(contexts.groupBy("anchor").agg(F.count("*").alias("n")))
    contexts = scratch.write(contexts.join(groups, "anchor"))
    alone = contexts.where("n = 1").select("anchor", "context", F.array(F.col("lo").cast("int"), F.col("hi").cast("int")).alias("runs"))

    def read(batches):
        for batch in batches:
            raw = batch.column(0)
            for k, wanted in enumerate(batch.column(1)):
                text = raw[k].as_buffer()
                rows = wanted.values.flatten()  # anchor, context, weight, at, lo, hi
                anchor, context, weight, at, lo, hi = (c.to_numpy() for c in rows)
                bytes_ = [text[int(a + x) : int(a + y + length)].to_pybytes() for a, x, y in zip(at, lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), pa.array(weight), pa.array(lo), pa.array(bytes_, pa.binary())], ["anchor", "context", "weight", "lo", "bytes"])

    def fetch(wanted: DataFrame) -> DataFrame:
        """The bytes of contexts, read from one row of the text that each was first seen in."""
        per_text = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "context", "weight", "at", "lo", "hi")).alias("wanted")).join(keys, "rid").select("key", "wanted")
        one = docs.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id")).doc_id.alias("doc_id"))
        per_row = scratch.write(per_text.join(one, "key"))
        found = docs.join(per_row.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & docs.doc_id.eqNullSafe(per_row.doc_id)).select("text", "wanted")
        return found.mapInArrow(read, "anchor long, context long, weight long, lo short, bytes binary").dropDuplicates(["anchor", "context"])

    def blocks(batches):
        held: dict[str, list] = {c: [] for c in ("anchor", "context", "weight", "lo", "bytes")}
        size = 0

        def emit():
            starts = repeated_starts(held["bytes"], np.array(held["weight"]), length)
            out = [as_runs(s, lo) for s, lo in zip(starts, held["lo"])]
            row = pa.RecordBatch.from_arrays([pa.array(held["anchor"], pa.int64()), pa.array(held["context"], pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["anchor", "context", "runs"])
            for c in held.values():
                c.clear()
            return row

        for batch in batches:
            for anchor, context, weight, lo, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK_BYTES and anchor != held["anchor"][-1]:  # an anchor's contexts stay together
                    yield emit()
                    size = 0
                for c, v in zip(held.values(), (anchor, context, weight, lo, raw)):
                    c.append(v)
                size += len(raw)
        if held["anchor"]:
            yield emit()

    fetched = scratch.write(fetch(contexts.where("n > 1")).join(groups, "anchor"))
    together = fetched.where(F.col("n") <= HOT).drop("n").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(blocks, "anchor long, context long, runs array<int>")
    found = scratch.write(together.union(alone).union(counted_windows(fetched.where(F.col("n") > HOT), length)))
    spans = places.join(found.where(F.size("runs") > 0), ["anchor", "context"]).select("rid", F.transform("runs", lambda r: r + F.col("at")).alias("runs"))
    spans = spans.groupBy("rid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    spans = scratch.write(keys.join(spans, "rid", "left").where("weight > 1 or runs is not null").select("key", "weight", "runs"))
    scratch.drop(contexts, groups, fetched, found, places)

    def cut(batches):
        for batch in batches:
            ids, data, runs_, *others = batch.columns
            sizes, spans_, kept = [], [], []
            for k in range(batch.num_rows):
                raw = data[k].as_py()
                sizes.append(len(raw))
                if not runs_[k].is_valid:
                    spans_.append([])
                    kept.append(raw)
                    continue
                pairs = runs_[k].values.to_numpy().reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1] + length)
                new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
                start, end = pairs[new, 0].tolist(), reach[np.append(np.flatnonzero(new)[1:], len(new)) - 1].tolist()
                spans_.append([{"start": a, "end": b} for a, b in zip(start, end)])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *end], [*start, len(raw)])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(spans_, kind), pa.array(kept, pa.binary()), *others]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept", "row"][: len(columns)])

    whole = F.array(F.lit(0), (F.octet_length("text") - length).cast("int"))
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    source = docs
    if carry:
        source = whole_rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.unhex(F.md5("text")))
        schema += f", row {source.schema['row'].dataType.simpleString()}"
    joined = source.join(spans, "key", "left").select("doc_id", F.col("text").cast("binary").alias("raw"), F.when(F.col("weight") > 1, whole).otherwise(F.col("runs")).alias("runs"), *["row"] * carry)
    return joined.mapInArrow(cut, schema)


def counted_windows(fetched: DataFrame, length: int) -> DataFrame:
    """The runs of repeated windows of contexts whose anchors have too many of them to meet in one task."""

    def windows(batches):
        for batch in batches:
            for anchor, context, weight, lo, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "weight", "lo", "bytes"))):
                n = len(raw) - length + 1
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(n)), np.int64).reshape(-1, 2)
                full = lambda v: pa.array(np.full(n, v, np.int64))
                yield pa.RecordBatch.from_arrays([full(anchor), full(context), full(weight), pa.array(np.arange(lo, lo + n, dtype=np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["anchor", "context", "weight", "place", "h1", "h2"])

    rows = fetched.mapInArrow(windows, "anchor long, context long, weight long, place int, h1 long, h2 long")
    rows = Scratch(fetched.sparkSession).write(rows)
    again = Scratch(fetched.sparkSession).write(rows.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).where("n > 1").select("h1", "h2"))
    return rows.join(again, ["h1", "h2"]).groupBy("anchor", "context").agg(F.flatten(F.collect_list(F.array("place", "place"))).alias("runs"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without repeated passages, n_chars set anew. What a cut leaves of a split character goes too."""

    def as_text(batches):
        for batch in batches:
            texts = [x.as_py().decode("utf-8", "ignore") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], ["text", "row"])

    found = repeated_passages(docs, length, carry=True).select("kept", "row")
    texts = found.mapInArrow(as_text, f"text string, row {found.schema['row'].dataType.simpleString()}")
    values = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return texts.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
