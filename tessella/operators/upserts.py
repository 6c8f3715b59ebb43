"""Plans of changes to a stored table: upserts with their inverse, cascaded deletes, gates, audits, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert_plan(stored: DataFrame, wanted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key that changes: action (INSERT, UPDATE, DELETE), the new and the old values. Keys are joined null-safe,
    so a null is a key value like any other."""
    a, b = stored.select(*keys, F.struct(*values).alias("old")), wanted.select(*keys, F.struct(*values).alias("new"))
    s, w = a.alias("s"), b.alias("w")
    joined = s.join(w, null_safe([F.col(f"s.{k}") for k in keys], [F.col(f"w.{k}") for k in keys]), "full")
    action = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    return joined.select(*[F.when(F.col("old").isNull(), F.col(f"w.{k}")).otherwise(F.col(f"s.{k}")).alias(k) for k in keys], action.alias("action"), "new", "old").where("action is not null")


def revert_plan(plan: DataFrame) -> DataFrame:
    """The plan that undoes a plan: inserts become deletes, and values change places."""
    back = F.when(F.col("action") == "INSERT", "DELETE").when(F.col("action") == "DELETE", "INSERT").otherwise(F.col("action"))
    return plan.select(*[c for c in plan.columns if c not in ("action", "new", "old")], back.alias("action"), F.col("old").alias("new"), F.col("new").alias("old"))


def apply_plan(stored: DataFrame, plan: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The table after a plan."""
    s, p = stored.select(*keys, *values).alias("s"), plan.alias("p")
    same = null_safe([F.col(f"s.{k}") for k in keys], [F.col(f"p.{k}") for k in keys])
    kept = s.join(p, same, "left_anti")
    return kept.unionByName(plan.where("action <> 'DELETE'").select(*keys, *[F.col(f"new.{v}").alias(v) for v in values]))


def null_safe(left: list[Column], right: list[Column]) -> Column:
    """Equality of composite keys in which a null equals a null."""
    out = left[0].eqNullSafe(right[0])
    for a, b in zip(left[1:], right[1:]):
        out = out & a.eqNullSafe(b)
    return out


def cascade(roots: DataFrame, key: str, children: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows that a delete of the roots takes from each table, in the order of deletion: table, position and number of rows.
    ``children`` are (name, rows, column that names the root), the deepest first."""
    out = None
    for i, (name, rows, column) in enumerate(children):
        n = rows.join(roots.select(F.col(key).alias(column)).distinct(), column, "left_semi").agg(F.count("*").alias("n_rows"))
        n = n.select(F.lit(name).alias("table"), F.lit(i + 1).alias("position"), "n_rows")
        out = n if out is None else out.union(n)
    return out.union(roots.agg(F.countDistinct(key).alias("n_rows")).select(F.lit("roots"), F.lit(len(children) + 1), "n_rows"))


def gates(old: DataFrame, new: DataFrame, area: str, vertices: str, most_vertices: int = 1024, drift: float = 1e-6) -> DataFrame:
    """One row: whether a processed layer may replace the current one, and the figures behind that."""
    a = old.agg(F.count("*").alias("n_old"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area_old"))
    b = new.agg(F.count("*").alias("n_new"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area_new"), F.coalesce(F.max(vertices), F.lit(0)).cast("long").alias("most_vertices"), F.count_if(F.col(area).isNull()).alias("n_invalid"))
    moved = F.abs(F.col("area_new") - F.col("area_old")) / F.greatest(F.col("area_old"), F.lit(1e-12))
    out = a.crossJoin(b)  # one row each
    return out.withColumn("drift", moved).withColumn("passes", (F.col("n_new") >= F.col("n_old")) & (F.col("most_vertices") <= most_vertices) & (F.col("n_invalid") == 0) & (F.col("drift") <= drift))


def preview(rows: DataFrame, kind: str, order: list, most: int = 25) -> DataFrame:
    """The first rows of each kind, each with the true number of its kind."""
    # The rank ends at ``most``, so each task keeps that many rows of a kind before they are dealt.
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
    total = rows.groupBy(F.col(kind).alias("_kind")).agg(F.count("*").alias("n_total"))
    return first.join(total, F.col(kind).eqNullSafe(F.col("_kind"))).drop("_kind")


def audit(rows: DataFrame, step: str, started: Column, rejected: Column) -> DataFrame:
    """One row about a load: step, rows taken and rejected, start, and the state that follows."""
    out = rows.agg(F.count_if(~rejected).alias("n_loaded"), F.count_if(rejected).alias("n_rejected"), F.min(started).alias("started_at"))
    return out.select(F.lit(step).alias("step"), "n_loaded", "n_rejected", "started_at", F.when(F.col("n_rejected") > 0, "PARTIAL").otherwise("DONE").alias("state"))
