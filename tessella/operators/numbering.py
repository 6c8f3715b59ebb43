"""Running totals and numbers over orders of any length, without a window that holds a whole key.

Rows are dealt to ranges of the order, so a key with a third of all rows lies in many of them. Each range adds up its own rows, the
sums of the ranges before are carried in, and a range needs its own rows only. The order must tell rows apart; rows that
tie in it count in any order, but once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .staging import settled


def running_total(df: DataFrame, by: list[str], order: list[str], weight: str, name: str = "total", ranges: int | None = None) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the same ``by`` up to each row in ascending ``order``."""
    held = [*df.columns, name]
    keys = [*by, *order]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    placed = settled(dealt.sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A key has one sum a range that it reaches; only keys that reach several need any carried in, at most two rows a range.
    carried = sums.withColumn("_carry", F.sum("_sum").over(before)).where("_carry is not null").drop("_sum")
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p, c = placed.withColumn(name, F.sum(weight).over(own)).alias("p"), F.broadcast(carried).alias("c")
    same = F.col("p._range") == F.col("c._range")
    for k in by:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    out = p.join(c, same, "left").withColumn("_total", F.col(f"p.{name}") + F.coalesce("c._carry", F.lit(0)))
    return out.select(*[F.col(f"p.{x}") for x in df.columns], F.col("_total").alias(held[-1]))


def numbered(df: DataFrame, order: list[str], name: str = "n", ranges: int | None = None) -> DataFrame:
    """Rows numbered from 1 without gaps in ascending order."""
    one = running_total(df.withColumn("_one", F.lit(1).cast("long")), [], order, "_one", name, ranges)
    return one.drop("_one")


def dense_ids(df: DataFrame, keys: list[str], name: str = "group_id") -> DataFrame:
    """Adds the place of each row's key among all distinct keys in order, from 1."""
    return df.join(numbered(df.select(*keys).distinct(), keys, name), keys)
