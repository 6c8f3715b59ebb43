"""What changed between two states of a street network: sections that are new, unchanged, changed, renumbered, split, merged or removed.

Sections of one street meet on a grid of boxes, so a street id with a third of all sections is spread over space. Lengths near
other lines come from linear referencing: stretches of a section are united along its segments, which keeps them exact where
lines overlap. A section's partners are few, as only those within a metre count.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions import lines as L
from ..functions.geometry import measures, parse_any
from . import layers, spatial
from .staging import settled, spread


@dataclass(frozen=True)
class AxesConfig:
    """Tolerances in the units of the coordinates."""

    same: float = 0.001
    renumbered: float = 0.5
    cover: float = 1.0
    share: float = 0.95
    cell: float = 256.0


_TRAITS = T.StructType([T.StructField("len", T.DoubleType()), T.StructField("said", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in spatial.BOX])


@pandas_udf(_TRAITS)
def _traits(texts: pd.Series) -> pd.DataFrame:
    geoms = [parse_any(x) for x in texts]
    boxes = iter(measures([g for g in geoms if g is not None]))
    return pd.DataFrame([(None,) * 6 if g is None else (L.length(g), L.comparable(g), *next(boxes)[:4]) for g in geoms], columns=_TRAITS.names)


def _hausdorffs(a: list, b: list) -> list[float | None]:
    out: list[float | None] = [None] * len(a)
    some = [k for k, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
    for k, far in zip(some, L.hausdorffs([parse_any(a[k]) for k in some], [parse_any(b[k]) for k in some])):
        out[k] = far
    return out


@pandas_udf(T.DoubleType())
def _hausdorff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(layers.by_runs(_hausdorffs, a, b), dtype=float)


@pandas_udf(T.DoubleType())
def _covered(a: pd.Series, others: pd.Series, reach: pd.Series) -> pd.Series:
    within = float(reach.iloc[0]) if len(reach) else 0.0
    return pd.Series(layers.by_runs(lambda x, o: L.covers([parse_any(t) for t in x], [[parse_any(t) for t in several] for several in o], within), a, others), dtype=float)


#: Filters on their results stay behind them, so no line is looked at twice.
_traits, _hausdorff, _covered = _traits.asNondeterministic(), _hausdorff.asNondeterministic(), _covered.asNondeterministic()


def apart(a: Column, b: Column) -> Column:
    """The greatest distance of a vertex of either geometry to the other one; null where one is missing."""
    return _hausdorff(a, b)


def covered(a: Column, others: Column, reach: float) -> Column:
    """Length of a line within reach of any line of an array."""
    return _covered(a, others, F.lit(reach))


def prepared(df: DataFrame) -> DataFrame:
    """Rows (ref, street, geom, ...) with length, comparable text and box; a reference's first row by its values; none without a
    geometry or a whole-number reference."""
    trimmed = df.withColumn("ref", F.nullif(F.trim("ref"), F.lit(""))).where(F.col("ref").rlike(r"^[0-9]+\z") & F.col("geom").isNotNull())
    first = trimmed.groupBy("ref").agg(F.min(F.struct(*[c for c in df.columns if c != "ref"])).alias("r")).select("ref", "r.*")
    return spread(first).withColumn("_t", _traits("geom")).select("ref", *[c for c in df.columns if c != "ref"], "_t.*").where("len is not null")


def classified(staged: DataFrame, current: DataFrame, attributes: list[str], cfg: AxesConfig) -> DataFrame:
    """Every staged section: new, or whether its attributes and its geometry differ from the current one of its reference.
    Shapes that only run the other way, or differ by less than the tolerance, are the same."""
    old = current.select("ref", F.struct("geom", "said", *attributes).alias("old"))
    both = staged.join(old, "ref", "left")
    differs = F.lit(False)
    for c in attributes:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old.{c}"))
    known = F.col("old").isNotNull()
    both = both.withColumn("far", _hausdorff(F.col("geom"), F.when(F.col("said") != F.col("old.said"), F.col("old.geom"))))
    return both.withColumn("is_new", ~known).withColumn("attr_changed", known & differs).withColumn("geom_changed", known & (F.col("said") != F.col("old.said")) & (F.col("far") >= cfg.same)).drop("old", "far")


def candidates(removed: DataFrame, new: DataFrame, cfg: AxesConfig) -> DataFrame:
    """(old_ref, new_ref, both geometries and lengths) of a removed and a new section of one street that come within the tolerance."""
    wide = lambda df: df.select("ref", "street", "geom", "len", *[(F.col(c) + (-1 if c.startswith("min") else 1) * cfg.cover / 2).alias(c) for c in spatial.BOX])
    pairs = spatial.box_join(wide(removed), wide(new), cfg.cell, on=("street",))
    pairs = pairs.select(F.col("a_ref").alias("old_ref"), F.col("b_ref").alias("new_ref"), F.col("a_street").alias("street"), F.col("a_geom").alias("old_geom"), F.col("b_geom").alias("new_geom"), F.col("a_len").alias("old_len"), F.col("b_len").alias("new_len"))
    pairs = spread(pairs).withColumn("covered", covered(F.col("old_geom"), F.array("new_geom"), cfg.cover)).withColumn("back", covered(F.col("new_geom"), F.array("old_geom"), cfg.cover))
    return pairs.where("old_len > 0 and (covered > 0 or back > 0)")


def renumbered(pairs: DataFrame, cfg: AxesConfig) -> DataFrame:
    """Pairs of one shape in which each side has that one candidate only."""
    near = settled(spread(pairs).withColumn("hausdorff", _hausdorff("old_geom", "new_geom")).where(F.col("hausdorff") < cfg.renumbered))
    single = lambda c: near.groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(c)
    return near.join(single("old_ref"), "old_ref").join(single("new_ref"), "new_ref").select("old_ref", "new_ref", "street", "old_len", "new_len", "hausdorff")


def analysed(staged: DataFrame, current: DataFrame, attributes: list[str], cfg: AxesConfig = AxesConfig()) -> dict[str, DataFrame]:
    """``sections`` (classified staged ones), ``renumbered``, ``splits`` (old_ref, new_refs, covered share), ``merges`` (new_ref,
    old_refs, covered share) and ``removed`` (references that are simply gone), from rows (ref, street, geom, attributes)."""
    staged, current = settled(prepared(staged)), settled(prepared(current))
    sections = settled(classified(staged, current, attributes, cfg))
    gone = current.join(staged.select("ref"), "ref", "left_anti")
    pairs = settled(candidates(gone, sections.where("is_new"), cfg))
    same = settled(renumbered(pairs, cfg))
    rest = pairs.join(same.select("old_ref"), "old_ref", "left_anti").join(same.select("new_ref"), "new_ref", "left_anti")
    enough = lambda part, whole: part >= cfg.share * whole
    # A section's partners are those that touch its metre: what they cover together is united, not added.
    cover = rest.groupBy("old_ref", "street").agg(F.first("old_geom").alias("geom"), F.first("old_len").alias("len"), F.array_sort(F.collect_list(F.struct("new_ref", "new_geom"))).alias("parts"))
    cover = spread(cover.where("size(parts) >= 2")).withColumn("covered", covered(F.col("geom"), F.transform("parts", lambda p: p.new_geom), cfg.cover))
    splits = settled(cover.where(enough(F.col("covered"), F.col("len"))).select("old_ref", "street", F.transform("parts", lambda p: p.new_ref).alias("new_refs"), (F.col("covered") / F.col("len")).alias("coverage")))
    left = rest.join(splits.select("old_ref"), "old_ref", "left_anti").where("covered > 0")
    joined = left.groupBy("new_ref", "street").agg(F.sort_array(F.collect_list("old_ref")).alias("old_refs"), F.sum("covered").alias("covered"), F.sum("old_len").alias("len"))
    merges = settled(joined.where((F.size("old_refs") >= 2) & enough(F.col("covered"), F.col("len"))).select("new_ref", "street", "old_refs", (F.col("covered") / F.col("len")).alias("coverage")))
    taken = same.select("old_ref").union(splits.select("old_ref")).union(left.join(merges.select("new_ref"), "new_ref").select("old_ref")).distinct()
    removed = gone.select(F.col("ref").alias("old_ref"), "street").join(taken, "old_ref", "left_anti")
    return {"sections": sections, "renumbered": same, "splits": splits, "merges": merges, "removed": removed}


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """(measure, value) of an analysis."""
    s = found["sections"]
    flags = {"new": "is_new", "unchanged": "not is_new and not attr_changed and not geom_changed", "attr": "attr_changed", "geom": "geom_changed", "both": "attr_changed and geom_changed"}
    counts = s.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in flags.items()])
    out = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in flags])).alias("x")).select("x.*")
    for name in ("renumbered", "splits", "merges", "removed"):
        out = out.unionByName(found[name].agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value"))
    return out
