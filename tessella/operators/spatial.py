"""Spatial joins over boxes on a grid of many levels, with exact predicates after.

A box goes to the level whose cells are as large as itself, so it touches four cells at most, and a country-sized one makes no
more rows than a parcel. Boxes of different sizes meet on the level of the larger one: each side is dealt to its own level and to
those larger levels that the other side has, which are a few numbers. A pair counts in the cell that holds the lower corner of
its intersection, so no distinct is needed. Many small boxes in one place go to small cells of their own; what is left of a
skew is boxes that really meet, and those cells are split by the adaptive join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BOX = ("minx", "miny", "maxx", "maxy")
#: Levels reach from cells of size / 2^30 to size * 2^30.
DEEPEST = 30


def level(size: float) -> Column:
    """The least level whose cells are as long as the box's longer side."""
    side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    return F.when(side > 0, F.greatest(F.lit(-DEEPEST), F.least(F.lit(DEEPEST), F.ceil(F.log2(side / size))))).otherwise(-DEEPEST).cast("int")


def levels(df: DataFrame, size: float) -> list[int]:
    """The levels that a layer's boxes have: at most 61 numbers."""
    return sorted(r[0] for r in df.select(level(size)).distinct().collect() if r[0] is not None)


def cells(df: DataFrame, size: float, others: list[int]) -> DataFrame:
    """One row per touched cell (at, cx, cy) on the box's own level and on the larger ones of ``others``."""
    df = df.withColumn("own", level(size))
    larger = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > F.col("own"))
    df = df.withColumn("at", F.explode(F.concat(F.array("own"), larger))).withColumn("_s", F.lit(size) * F.pow(F.lit(2.0), F.col("at")))
    low = lambda c: F.floor(F.col(c) / F.col("_s"))
    return df.withColumn("cx", F.explode(F.sequence(low("minx"), low("maxx")))).withColumn("cy", F.explode(F.sequence(low("miny"), low("maxy")))).drop("_s")


def box_join(a: DataFrame, b: DataFrame, size: float, on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of boxes that touch, and agree in the columns ``on``, columns prefixed a_ and b_, with the intersection's area
    ``shared``. ``size`` is the length that level 0 has."""
    of_a = levels(a, size)
    of_b = of_a if a is b else levels(b, size)
    side = lambda df, p, others: cells(df, size, others).select(*[F.col(c).alias(f"{p}_{c}") for c in (*df.columns, "own")], *[F.col(c).alias(f"_{c}") for c in on], "at", "cx", "cy")
    left, right = side(a, "a", of_b), side(b, "b", of_a)
    if a is b:
        right = right.hint("merge")  # as large as the other side: a small file says little of what its cells take in each task
    x, y = F.greatest("a_minx", "b_minx"), F.greatest("a_miny", "b_miny")
    u, v = F.least("a_maxx", "b_maxx"), F.least("a_maxy", "b_maxy")
    cell = F.lit(size) * F.pow(F.lit(2.0), F.col("at"))
    joined = left.join(right, ["at", "cx", "cy", *[f"_{c}" for c in on]]).where((F.col("at") == F.greatest("a_own", "b_own")) & (x <= u) & (y <= v) & (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy")))
    return joined.withColumn("shared", (u - x) * (v - y)).drop("at", "cx", "cy", "a_own", "b_own", *[f"_{c}" for c in on])


def area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}maxx") - F.col(f"{prefix}minx")) * (F.col(f"{prefix}maxy") - F.col(f"{prefix}miny"))


def overlaps(df: DataFrame, rec: str, size: float, least: float) -> DataFrame:
    """Pairs a < b of one layer that share more than ``least`` area."""
    return box_join(df, df, size).where((F.col(f"a_{rec}") < F.col(f"b_{rec}")) & (F.col("shared") > least))


def cover_share(df: DataFrame, rec: str, covers: DataFrame, size: float) -> DataFrame:
    """Share of each box covered by disjoint covers; 0 for none."""
    shared = box_join(df, covers, size).groupBy(F.col(f"a_{rec}").alias(rec)).agg(F.sum("shared").alias("shared"))
    return df.join(shared, rec, "left").withColumn("share", F.coalesce("shared", F.lit(0.0)) / area()).drop("shared")


def replacement_classes(df: DataFrame, rec: str, parts: DataFrame, size: float) -> DataFrame:
    """Missing parcels by what covers them: parts count from 5 %; best 90 % or more: REPLACED_ONE; two or more parts with
    90 % together: SUBDIVIDED; 50 % together: PARTIAL; else ORPHAN. Parts must be disjoint."""
    pairs = box_join(df, parts, size).withColumn("share", F.col("shared") / area("a_"))
    stats = pairs.groupBy(F.col(f"a_{rec}").alias(rec)).agg(F.count_if(F.col("share") >= 0.05).alias("n_parts"), F.max("share").alias("best"), F.sum(F.when(F.col("share") >= 0.05, F.col("share"))).alias("together"))
    joined = df.select(rec).join(stats, rec, "left").na.fill(0, ["n_parts"]).na.fill(0.0, ["best", "together"])
    kind = F.when(F.col("best") >= 0.9, "REPLACED_ONE").when((F.col("n_parts") >= 2) & (F.col("together") >= 0.9), "SUBDIVIDED").when(F.col("together") >= 0.5, "PARTIAL").otherwise("ORPHAN")
    return joined.select(rec, kind.alias("class"), "n_parts")


def around(points: DataFrame, within: float = 0.0) -> DataFrame:
    """Boxes about points (x, y)."""
    return points.select("*", *[(F.col(c) + sign * within).alias(f"{m}{c}") for m, sign in (("min", -1), ("max", 1)) for c in "xy"])


def containment(points: DataFrame, pid: str, boxes: DataFrame, bid: str, size: float) -> DataFrame:
    """Per point how many boxes hold it, and the least of their ids."""
    inside = box_join(around(points.select(pid, "x", "y")), boxes.select(bid, *BOX), size)
    counts = inside.groupBy(F.col(f"a_{pid}").alias(pid)).agg(F.count("*").alias("n_receivers"), F.min(f"b_{bid}").alias("receiver"))
    return points.select(pid).join(counts, pid, "left").withColumn("n_receivers", F.coalesce("n_receivers", F.lit(0)))


def nearest(points: DataFrame, pid: str, boxes: DataFrame, bid: str, within: float) -> DataFrame:
    """The nearest box within a distance (ties: larger area, then smaller id), with the squared distance."""
    d = lambda c: F.greatest(F.lit(0.0), F.col(f"b_min{c}") - F.col(f"a_{c}"), F.col(f"a_{c}") - F.col(f"b_max{c}"))
    met = box_join(around(points.select(pid, "x", "y"), within), boxes.select(bid, *BOX), within)
    pairs = met.withColumn("d2", d("x") * d("x") + d("y") * d("y")).where(F.col("d2") <= within * within)
    best = pairs.groupBy(F.col(f"a_{pid}").alias(pid)).agg(F.min(F.struct("d2", (-area("b_")).alias("a"), F.col(f"b_{bid}").alias("receiver"))).alias("m"))
    return best.select(pid, F.col("m.receiver").alias("receiver"), F.col("m.d2").alias("d2"))


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def in_view(df: DataFrame, view: tuple[float, float, float, float]) -> DataFrame:
    """Boxes that touch the view: a range filter that reaches the scan."""
    return df.where((F.col("minx") <= view[2]) & (F.col("maxx") >= view[0]) & (F.col("miny") <= view[3]) & (F.col("maxy") >= view[1]))


def top_parts(pairs: DataFrame, by: str, order: list, most: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)
