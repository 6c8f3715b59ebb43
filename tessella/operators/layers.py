"""Processing of staged polygon layers: repair, union by key, overlaps, subdivision, and the report about them.

Geometries are WKT or EWKB hex texts. A union by key is a tree: rows of a key are dealt to chunks of about FAN neighbours, a
chunk's rows become one, and rounds go on until each key has one row, so a key with a third of all rows is spread over
many tasks. What a task holds is one chunk; a key's final geometry is one row, as its table wants it.

A text that is no geometry counts as an invalid one without a region; points and lines have none either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions import overlay as O
from ..functions.geometry import measures, parse_any
from ..sources.shape_ranges import record_bytes
from . import spatial
from .grouping import group_key
from .staging import settled, spread

#: Rows of a key that one task makes into one.
FAN = 64
#: Pieces that leave a task together.
PIECES = 4096
#: Characters of the geometry texts that are worked on together.
TEXTS = 1 << 19
SHAPE = T.StructType([T.StructField("geom", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in (*spatial.BOX, "area")] + [T.StructField(c, T.IntegerType()) for c in ("n_vertices", "n_parts")])
_SHAPE_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SHAPE)


def described(geoms: list[dict | None], texts: list[str | None]) -> list[tuple]:
    """The rows of geometries, in SHAPE; all null without one. A text that is given isn't written again."""
    rows = iter(measures([g for g in geoms if g is not None]))
    return [(None,) * 8 if g is None else (text or O.to_wkt(g), *next(rows), O.vertices(g), len(g["parts"])) for g, text in zip(geoms, texts)]


def runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about TEXTS characters together."""
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > TEXTS:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def by_runs(work, *columns: pd.Series) -> list:
    """The results of ``work``, a function of equally long lists, over rows of a bounded number of characters at a time."""
    size = lambda x: len(x) if isinstance(x, str) else 0 if x is None or np.isscalar(x) else sum(map(len, x))
    lists = [list(c) for c in columns]
    out: list = []
    for start, end in runs([sum(map(size, row)) for row in zip(*lists)]):
        out += work(*[x[start:end] for x in lists])
    return out


def _examine(texts: list, repair: list) -> list[tuple]:
    geoms = [parse_any(text) for text in texts]
    reasons: list = [None if text is None else "unreadable" for text in texts]
    known = [k for k, g in enumerate(geoms) if g is not None]
    for k, reason in zip(known, O.invalid_reasons([geoms[k] for k in known])):
        reasons[k] = reason
    bad = [k for k in known if reasons[k] is not None and repair[k] and reasons[k] != "a coordinate isn't finite"]
    mended = dict(zip(bad, O.make_valid_all([geoms[k] for k in bad])))
    shapes = described([mended.get(k, g) for k, g in enumerate(geoms)], [None if k in mended else text for k, text in enumerate(texts)])
    return [(reason is not None, reason, *shape) for reason, shape in zip(reasons, shapes)]


@pandas_udf(T.StructType([T.StructField("invalid", T.BooleanType()), T.StructField("reason", T.StringType()), *SHAPE]))
def _examined(texts: pd.Series, repair: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(by_runs(_examine, texts, repair), columns=["invalid", "reason", *SHAPE.names])


#: Filters on its results stay behind it: pushed before it, each would examine all geometries once more.
_examined = _examined.asNondeterministic()


def examined(df: DataFrame, geom: str, repair: bool = True) -> DataFrame:
    """Adds whether a geometry is invalid and why, and, repaired if wanted, its text, box, area, vertices and parts; a geometry
    that is empty after repair is null."""
    return spread(df).withColumn("_x", _examined(F.col(geom), F.lit(repair))).select(*[c for c in df.columns if c != geom], "_x.*")


def combined(groups: list[list[dict]], how: str) -> list[tuple[dict | None, bool]]:
    """One geometry of each group, and whether their plain collection is invalid. ``how``: union, or parity: what an odd number of
    them holds, the even-odd repair of the collection."""
    groups = [[g for g in geoms if "Polygon" in g["type"]] for geoms in groups]
    if how == "union":
        return [(g, False) for g in O.unions(groups)]
    wholes = [{"type": "MultiPolygon", "parts": [p for g in geoms for p in g["parts"]]} for geoms in groups]
    found: list = [(whole if geoms else None, False) for whole, geoms in zip(wholes, groups)]
    bad = [k for k, reason in enumerate(O.invalid_reasons(wholes)) if reason is not None and groups[k]]
    for k, g in zip(bad, O.make_valid_all([wholes[k] for k in bad])):
        found[k] = (g, True)
    return found


def merged(df: DataFrame, key: str, rec: str, how: str, fan: int = FAN) -> DataFrame:
    """(key, geom, box, area, n_vertices, n_parts, collided): one row for each key of rows (key, rec, geom, box ...) whose geometries
    are valid; collided says whether their plain collection isn't. Keys aren't null."""
    schema = "k " + df.schema[key].dataType.simpleString()
    shape = SHAPE.names
    names = ["k", "rec", *shape, "collided"]
    rows = df.select(F.col(key).alias("k"), F.col(rec).cast("long").alias("rec"), *shape, F.lit(False).alias("collided"))

    def combine(batches):
        """Rows come group by group, the first of each marked as ``head``; groups of many texts are worked on together."""
        held: list[list] = []  # key, least rec, texts, collided

        def together(schema: pa.Schema) -> pa.RecordBatch:
            found = combined([[parse_any(x) for x in texts] for _, _, texts, _ in held], how)
            shapes = described([g for g, _ in found], [None] * len(held))
            values = [(k, rec, *shape, odd or was) for (k, rec, _, was), (_, odd), shape in zip(held, found, shapes)]
            fields = [schema.field(n) if n in ("k", "geom", "collided") else pa.field(n, pa.int64() if n == "rec" else pa.int32() if n.startswith("n_") else pa.float64()) for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values), fields)], schema=pa.schema(fields))

        size, schema = 0, None
        for batch in batches:
            schema = batch.schema
            columns = [batch.column(c).to_pylist() for c in ("rec", "geom", "collided", "head")]
            keys = iter(batch.column("k").filter(batch.column("head")).to_pylist())
            for rec, text, was, head in zip(*columns):
                if head:
                    if size > TEXTS:
                        yield together(schema)
                        held, size = [], 0
                    held.append([next(keys), rec, [], False])
                last = held[-1]
                last[1], last[3] = min(last[1], rec), last[3] or was
                if text is not None:
                    last[2].append(text)
                    size += len(text)
        if held:
            yield together(schema)

    while True:
        middle = [((F.col(f"min{c}") + F.col(f"max{c}")) / 2).alias(f"c{c}") for c in "xy"]
        placed = rows.select("*", *middle)
        stats = placed.groupBy("k").agg(F.count("*").alias("n"), *[f(f"c{c}").alias(f"{m}{c}") for c in "xy" for m, f in (("least", F.min), ("most", F.max))])
        sides = F.ceil(F.sqrt(F.col("n") / fan))
        # A lattice over each key's extent with about one cell for each chunk, and cells with too many rows by hash.
        cell = lambda c: F.coalesce(F.least(sides - 1, F.floor((F.col(f"c{c}") - F.col(f"least{c}")) / F.greatest(F.col(f"most{c}") - F.col(f"least{c}"), F.lit(1e-300)) * sides)), F.lit(0))
        dealt = placed.join(stats, "k").withColumn("gx", cell("x")).withColumn("gy", cell("y"))
        many = dealt.where("n > 1")
        sizes = many.groupBy("k", "gx", "gy").agg(F.count("*").alias("m"))
        chunked = many.join(sizes, ["k", "gx", "gy"]).withColumn("chunk", F.pmod(F.xxhash64("rec"), F.ceil(F.col("m") / fan)))
        group = ["k", "gx", "gy", "chunk"]
        told = spread(chunked.select("rec", "geom", "collided", *group), *group).withColumn("head", F.row_number().over(Window.partitionBy(*group).orderBy("rec")) == 1)
        one = told.select("k", "rec", "geom", "collided", "head").mapInArrow(combine, f"{schema}, rec long, {_SHAPE_DDL}, collided boolean")
        most = stats.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        rows = settled(dealt.where("n = 1").select(*names).unionByName(one))
        if most <= fan:
            break
    return rows.select(F.col("k").alias(key), *shape, "collided")


@dataclass(frozen=True)
class LayerConfig:
    """What to do with a staged layer: repair, unify by keys, look for overlaps beyond an area; whether the target takes one part only."""

    keys: tuple[str, ...] = ()
    compared: tuple[str, ...] = ()
    repair: bool = True
    single_part: bool = False
    overlaps: bool = True
    least_area: float = 1.0
    block: bool = True
    cell: float = 64.0


def unified(base: DataFrame, keys: list[str], values: list[str], rec: str = "rec") -> DataFrame:
    """One row per key with the first values by rec, the number of rows, and the geometry that its rows' geometries make, repaired
    where their collection is invalid (``collided``). A null in a key keeps a row apart."""
    own = base.select(*base.columns, F.struct(*group_key(keys, rec)).alias("_key"))
    firsts = own.groupBy("_key").agg(F.min(rec).alias(rec), *[F.min_by(v, rec).alias(v) for v in values], F.count("*").alias("n_rows"))
    shapes = merged(own.where("geom is not null"), "_key", rec, "parity")
    out = firsts.join(shapes, "_key", "left").withColumn("collided", F.coalesce("collided", F.lit(False)))
    return out.select(*[F.col(f"_key.{k}").alias(k) for k in keys], rec, *values, "n_rows", *[c for c in shapes.columns if c != "_key"])


def process(staged: DataFrame, geom: str, cfg: LayerConfig, rec: str = "rec") -> tuple[DataFrame, DataFrame]:
    """The processed layer and its report (measure, value): repair, unification by key, repair of what the unification made,
    validity, overlaps, and whether these block the load."""
    base = settled(examined(staged, geom, cfg.repair).withColumnRenamed("reason", "_reason"))
    layer = settled(unified(base, list(cfg.keys), list(cfg.compared), rec)) if cfg.keys and cfg.repair else base
    count = lambda df, name, when: df.agg(F.count_if(when).alias("value")).select(F.lit(name).alias("measure"), F.col("value").cast("long"))
    invalid, gone, true = F.col("invalid"), F.col("geom").isNull(), F.lit(True)
    unified_ = bool(cfg.keys) and cfg.repair
    facts = [
        count(base, "invalid_before", invalid),
        count(base, "repaired", invalid & F.lit(cfg.repair)).union(count(layer, "repaired", F.col("collided"))) if unified_ else count(base, "repaired", invalid & F.lit(cfg.repair)),
        count(base, "empty_after_repair", invalid & gone & F.lit(cfg.repair)),
        count(layer, "incompatible", (F.col("n_parts") > 1) & F.lit(cfg.single_part)),
        count(layer, "inserted_invalid", F.lit(False) if cfg.repair else invalid),
        count(layer, "inserted_rows", true),
    ]
    if unified_:
        null = F.lit(False)
        for k in cfg.keys:
            null = null | F.col(k).isNull()
        merged_rows = layer.agg(F.count_if(F.col("n_rows") > 1).alias("groups"), F.coalesce(F.sum("n_rows") - F.count("*"), F.lit(0)).alias("rows_merged"))
        facts += [merged_rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("value")) for c in ("groups", "rows_merged")])).alias("x")).select("x.*"), count(base, "null_key_rows", null)]
    if cfg.overlaps:
        found = count(overlaps(layer.where("geom is not null" + ("" if cfg.repair else " and not invalid")), rec, cfg.least_area, cfg.cell), "overlaps", true)
        blocked = F.struct(F.lit("would_block").alias("measure"), ((F.col("value") > 0) & F.lit(cfg.block)).cast("long").alias("value"))
        facts.append(found.select(F.inline(F.array(F.struct("measure", "value"), blocked))))
    report = facts[0]
    for f in facts[1:]:
        report = report.unionByName(f)
    return layer, report.groupBy("measure").agg(F.sum("value").alias("value"))


def parsed(*columns: list) -> list[list[dict | None]]:
    """Geometries of texts, each text read once."""
    known = {text: parse_any(text) for c in columns for text in c if text is not None}
    return [[known.get(text) for text in c] for c in columns]


@pandas_udf(T.DoubleType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(by_runs(lambda x, y: O.shared_areas(list(zip(*parsed(x, y)))), a, b), dtype=float)


_shared = _shared.asNondeterministic()


def shared_area(a: Column, b: Column) -> Column:
    """Area of the intersection of two repaired polygon texts."""
    return _shared(a, b)


def pairs_with_area(left: DataFrame, right: DataFrame, a: str, b: str, cell: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(a_id, b_id, area) of all pairs of polygons whose boxes meet in an area and that agree in ``on``; rows hold an id, geom and box."""
    boxes = lambda df, i: df.select(F.col(i).alias("id"), *on, *spatial.BOX)
    met = spatial.box_join(boxes(left, a), boxes(right, b), cell, on).where("shared > 0").select("a_id", "b_id")
    met = met.join(left.select(F.col(a).alias("a_id"), F.col("geom").alias("a_geom")), "a_id").join(right.select(F.col(b).alias("b_id"), F.col("geom").alias("b_geom")), "b_id")
    return spread(met).select("a_id", "b_id", shared_area(F.col("a_geom"), F.col("b_geom")).alias("area"))


def overlaps(layer: DataFrame, rec: str, least: float, cell: float) -> DataFrame:
    """(a_id, b_id, area): pairs of one layer, a before b, that share more than ``least`` area."""
    boxes = layer.select(F.col(rec).alias("id"), *spatial.BOX)
    met = spatial.box_join(boxes, boxes, cell).where("a_id < b_id and shared > 0").select("a_id", "b_id")
    for side in ("a", "b"):
        met = met.join(layer.select(F.col(rec).alias(f"{side}_id"), F.col("geom").alias(f"{side}_geom")), f"{side}_id")
    return spread(met).select("a_id", "b_id", shared_area(F.col("a_geom"), F.col("b_geom")).alias("area")).where(F.col("area") > least)


def union_by_key(rows: DataFrame, geom: str, keys: list[str], carried: list[str], rec: str = "rec", repair: bool = True) -> DataFrame:
    """Parcels by key: the union of a key's geometries, the first carried values by rec, and the number of rows. Rows without a
    key or a region take no part. Without ``repair`` only geometries of keys with several rows are mended for their union."""
    held = examined(rows.dropna(subset=keys).where(F.col(geom).isNotNull()), geom, True).where("geom is not null")
    if not repair:
        raw = rows.select(*keys, rec, F.col(geom).alias("_raw"))
    held = settled(held.withColumn("_key", F.struct(*keys)))
    firsts = held.groupBy("_key").agg(F.min(rec).alias(rec), *[F.min_by(v, rec).alias(v) for v in carried], F.count("*").alias("n_rows"))
    out = firsts.join(merged(held, "_key", rec, "union"), "_key").drop("collided")
    out = out.select(*[F.col(f"_key.{k}").alias(k) for k in keys], rec, *carried, "n_rows", *SHAPE.names)
    if repair:
        return out
    return out.join(raw, [*keys, rec], "left").withColumn("geom", F.when(F.col("n_rows") > 1, F.col("geom")).otherwise(F.col("_raw"))).drop("_raw")


def union_report(rows: DataFrame, geom: str, keys: list[str], rec: str = "rec") -> DataFrame:
    """One row about a union by key: rows read, without key, without geometry, empty, invalid ones in keys of one row and of
    several, keys."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    seen = examined(rows, geom, True).withColumn("_null", null).withColumn("_usable", ~null & F.col("geom").isNotNull())
    each = seen.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("_null").alias("no_key"), F.count_if(F.col("geom").isNull() & ~F.col("invalid")).alias("no_geom"),
        F.count_if(F.col("geom").isNull() & F.col("invalid")).alias("empty"), F.count_if("_usable").alias("usable"), F.count_if(F.col("_usable") & F.col("invalid")).alias("bad"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(
        total("n").alias("n_rows"), total("no_key").alias("n_without_key"), total("no_geom").alias("n_without_geometry"), total("empty").alias("n_empty"), F.count_if(F.col("usable") > 0).alias("n_keys"),
        total("bad").alias("n_repaired"), total(F.when(F.col("usable") == 1, F.col("bad"))).alias("n_invalid_alone"), total(F.when(F.col("usable") > 1, F.col("bad"))).alias("n_invalid_in_union"),
    )


@pandas_udf(T.DoubleType())
def _border(a: pd.Series) -> pd.Series:
    length = lambda g: float(sum(math.dist(p, q) for part in g["parts"] for r in part for p, q in zip(r, r[1:])))
    return pd.Series([length(parse_any(x)) if x else None for x in a], dtype=float)


def border(a: Column) -> Column:
    """Length of all closed rings of a geometry text."""
    return _border(a)


@pandas_udf(T.BinaryType())
def _record(a: pd.Series) -> pd.Series:
    return pd.Series([record_bytes(parse_any(x)) if x else None for x in a])


def shape_record(a: Column) -> Column:
    """Polygon texts as the contents of shape records."""
    return _record(a)


def subdivided(df: DataFrame, ids: list[str], most: int = 256) -> DataFrame:
    """Pieces (ids, piece, geom, area, n_vertices) with at most ``most`` vertices of repaired geometries."""

    names = [*ids, "piece", "geom", "area", "n_vertices"]

    def cut(frames):
        for frame in frames:
            rows = []
            for start, end in runs([len(x or "") for x in frame["geom"]]):
                for values in zip(frame[start:end].itertuples(index=False), O.subdivided_all([parse_any(x) if x else {"type": "", "parts": []} for x in frame["geom"][start:end]], most)):
                    (*own, _), found = values
                    rows += [(*own, k, O.to_wkt(g), m[-1], O.vertices(g)) for k, (g, m) in enumerate(zip(found, measures(found)))]
                    if len(rows) >= PIECES:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids)
    return df.select(*ids, "geom").mapInPandas(cut, f"{kinds}, piece int, geom string, area double, n_vertices int")
