"""Row validation, reference counting, plan guards and capped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, null if none. A rule that is null isn't broken."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def reference_counts(targets: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per target the number of rows of each table that refer to it: one grouped scan a table, then one pivot."""
    counts = None
    for name, (df, column) in tables.items():
        part = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.count("*").alias("n")).withColumn("t", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    wide = counts.groupBy(key).agg(*[F.sum(F.when(F.col("t") == n, F.col("n"))).alias(f"n_{n}") for n in tables])
    return targets.select(key).join(wide, key, "left").na.fill(0, [f"n_{n}" for n in tables])


def prune_choices(choices: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that a user's choice doesn't rule out: a chosen end keeps its chosen pair only."""
    free = pairs.join(choices.select(a).distinct(), a, "left_anti").join(choices.select(b).distinct(), b, "left_anti")
    return free.unionByName(pairs.join(choices, [a, b], "left_semi"))


def capped_by_group(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """Rows of as many whole groups in order as fit ``most`` rows; a group is never split. Sizes are one row a group,
    of which only the first ``most`` can matter."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(*order).limit(most)
    total = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.join(sizes.withColumn("t", total).where(F.col("t") <= most).select(group), group, "left_semi")


def rejected(df: DataFrame, reason: str, text: str, order: list[str], most: int, width: int = 80) -> DataFrame:
    """The first rejected rows with their text cut short, and the true total on each."""
    bad = df.where(F.col(reason).isNotNull())
    return bad.orderBy(*order).limit(most).select(*order, reason, F.substring(text, 1, width).alias("excerpt")).join(F.broadcast(bad.agg(F.count("*").alias("n_total"))))  # one row


def plan_digest(plans: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """A digest per kind of write, equal for a dry and a real run: summed row hashes and the count."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, 12), 16, 10).cast("decimal(38,0)")
    return plans.groupBy(kind).agg(F.sum(h).cast("string").alias("digest"), F.count("*").alias("n"))
