"""Join operators with the null and multiplicity rules of SQL's set tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def not_in(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Rows of left whose key isn't IN right, nulls as SQL has them: an empty right keeps all; a null on the right keeps
    none; a null key is kept only by an empty right. Two facts of one row each guard a plain anti join."""
    facts = right.agg((F.count("*") > 0).alias("_some"), (F.count_if(F.col(right_key).isNull()) > 0).alias("_null"))
    guarded = left.join(F.broadcast(facts))  # one row
    keep = guarded.where("not _some").drop("_some", "_null")
    anti = guarded.where(F.col("_some") & ~F.col("_null") & F.col(key).isNotNull()).drop("_some", "_null")
    keys = right.select(F.col(right_key).alias("_k")).distinct()
    return keep.unionByName(anti.join(keys, F.col(key) == F.col("_k"), "left_anti"))


def lookup(df: DataFrame, name: str, dimension: DataFrame, dim_name: str, dim_id: str) -> DataFrame:
    """Case-insensitive lookup: n_matches (0, 1, many) and the id if there is just one."""
    dim = dimension.groupBy(F.upper(F.trim(dim_name)).alias("_n")).agg(F.count("*").alias("n_matches"), F.min(dim_id).alias("_id"))
    joined = df.join(dim, F.upper(F.trim(F.col(name))) == F.col("_n"), "left")
    return joined.withColumn("n_matches", F.coalesce("n_matches", F.lit(0))).withColumn("match_id", F.when(F.col("n_matches") == 1, F.col("_id"))).drop("_n", "_id")


def mutual_unique(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose two ends each occur in one pair only."""
    single = lambda c: pairs.groupBy(c).agg(F.count("*").alias("_n")).where("_n = 1").select(c)
    return pairs.join(single(a), a, "left_semi").join(single(b), b, "left_semi").select(pairs.columns)


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def capped_samples(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group with their rank and the group's true size."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n_group"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(sizes, by)
