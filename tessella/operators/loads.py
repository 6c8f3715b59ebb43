"""Load guards and report sinks: validated swaps, history, deltas, batches, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .numbering import running_total


def validated_swap(staged: DataFrame, current: DataFrame, least: float = 0.97) -> DataFrame:
    """One row: counts, their ratio and whether the staged table may replace the current one."""
    s, c = staged.agg(F.count("*").alias("n_staged")), current.agg(F.count("*").alias("n_current"))
    ratio = F.when(F.col("n_current") > 0, F.col("n_staged") / F.col("n_current"))
    return s.join(F.broadcast(c)).withColumn("ratio", F.round(ratio, 6)).withColumn("accepted", F.coalesce(ratio >= least, F.lit(True)))  # one row each


def replace_cuts(history: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """History with the staged cuts in place of its own of the same key."""
    return history.join(staged.select(key).distinct(), key, "left_anti").unionByName(staged)


def append_unless_loaded(history: DataFrame, current: DataFrame, key: str) -> DataFrame:
    return history.unionByName(current.join(history.select(key).distinct(), key, "left_anti"))


def next_value(df: DataFrame, column: str, last: int) -> DataFrame:
    """Where a sequence goes on: past the largest value and past what it gave last."""
    return df.agg(F.greatest(F.coalesce(F.max(column), F.lit(0)) + 1, F.lit(last)).alias("next_value"))


def resource_state(remote_hash: Column, local_hash: Column, remote_time: Column, local_time: Column, remote_size: Column, local_size: Column, downloaded: Column) -> Column:
    """Rule chain: hashes decide if both are there, then the newer time, then the size where neither tells."""
    hashes, times = remote_hash.isNotNull() & local_hash.isNotNull(), remote_time.isNotNull() & local_time.isNotNull()
    return (
        F.when(~downloaded, "NOT_DOWNLOADED").when(hashes & (remote_hash != local_hash), "UPDATE_AVAILABLE").when(hashes, "UP_TO_DATE")
        .when(times & (remote_time > local_time), "UPDATE_AVAILABLE").when(~times & (remote_size != local_size), "UPDATE_AVAILABLE").otherwise("UP_TO_DATE")
    )


def badge(state: Column) -> Column:
    """The worst state of a group: updates above missing downloads."""
    worst = F.max(F.when(state == "UPDATE_AVAILABLE", 2).when(state == "NOT_DOWNLOADED", 1).otherwise(0))
    return F.when(worst == 2, "UPDATE_AVAILABLE").when(worst == 1, "NOT_DOWNLOADED").otherwise("UP_TO_DATE")


def batches(df: DataFrame, by: list[str], order: list[str], weight: str, most: int) -> DataFrame:
    """Batch numbers by cumulative weight within each group, a group of any size."""
    total = running_total(df, by, order, weight, "_total")
    return total.withColumn("batch", F.floor((F.col("_total") - 1) / most)).drop("_total")


def csv_field(c: Column, guard: bool = False) -> Column:
    """A field for RFC 4180 CSV: quoted when needed or with spaces at its ends; with ``guard`` a leading sign that a
    spreadsheet would run gets an apostrophe before it."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    if guard:
        c = F.when(c.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(c.rlike('[",\r\n]|^ | $'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)


def csv_line(columns: list[str], guard: bool = False) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(c), guard) for c in columns])


def copy_field(c: Column) -> Column:
    """A field of the database's text copy format."""
    c = F.regexp_replace(c.cast("string"), "\x00", "")
    for plain, escaped in (("\\\\", "\\\\\\\\"), ("\t", "\\\\t"), ("\n", "\\\\n"), ("\r", "\\\\r")):
        c = F.regexp_replace(c, plain, escaped)
    return F.coalesce(c, F.lit("\\N"))


def merge_overrides(defaults: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Defaults with stored rows over them by id; stored rows that only claim to be defaults are dropped."""
    o = overrides.select(key, "is_default", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = defaults.select(key, *columns, F.lit(True).alias("_known")).join(o, key, "full")
    keep = joined.where(F.col("_known").isNotNull() | ~F.col("is_default"))
    return keep.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])
