"""Duplicate decisions inside match groups, and the removal plan that follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.values import urn_tail
from .numbering import dense_ids, numbered


def decide(rows: DataFrame, key: str, urn: str, protected: str, evidence: str) -> DataFrame:
    """Per row: group size, decision (KEEP, REMOVE, REVIEW) and reason.

    In a group of one key the protected rows stay. Of the others the one of least URN number stays if nothing in the
    group is protected; the rest go, unless there is evidence that they are in use, which calls for review. Rows
    without a key are left out. Counts per group come from partial aggregation; only removable rows are ranked."""
    groups = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_group"), F.bool_or(F.col(protected)).alias("has_protected"), F.min(F.when(~F.col(protected) & ~F.col(evidence), F.col(urn))).alias("least"))
    joined = rows.join(groups, key)
    removable = ~F.col(protected) & ~F.col(evidence)
    reason = (
        F.when(F.col("n_group") == 1, "SINGLE").when(F.col(protected), "PROTECTED").when(F.col(evidence), "IN_USE")
        .when(F.col("has_protected"), "REDUNDANT_TO_PROTECTED").when(F.col(urn) == F.col("least"), "FIRST_OF_GROUP").otherwise("REDUNDANT")
    )
    decision = F.when(removable & reason.isin("REDUNDANT_TO_PROTECTED", "REDUNDANT"), "REMOVE").when(reason == "IN_USE", "REVIEW").otherwise("KEEP")
    return joined.withColumn("reason", reason).withColumn("decision", decision).drop("least", "has_protected")


def with_group_ids(decided: DataFrame, key: str) -> DataFrame:
    """Groups numbered densely in key order, from one row per group."""
    return dense_ids(decided, [key]).withColumn("group_id", F.col("group_id").cast("int"))


def removal_targets(decided: DataFrame, urn: str) -> DataFrame:
    """URNs all of whose rows are to be removed, with their reasons."""
    verdicts = decided.groupBy(urn).agg(F.bool_and(F.col("decision") == "REMOVE").alias("all_out"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.count("*").alias("n_rows"))
    return verdicts.where("all_out").drop("all_out")


def summary(decided: DataFrame, source: str) -> DataFrame:
    return decided.groupBy("decision", source).agg(F.count("*").alias("n_rows"), F.count_if(F.col("n_group") > 1).alias("n_grouped"))


#: Reasons whose rows go, and reasons that call for a look.
REMOVED = ("REDUNDANT_WITH_MATCHED", "REDUNDANT_NOT_LOWEST_URN", "REDUNDANT_WITH_PROTECTED")
REVIEWED = ("KEPT_ALONGSIDE_PROTECTED", "HAS_INTERNAL_UNITS")


def decide_by_source(rows: DataFrame, removable: list[str], protected: list[str], beside_protected: bool = False) -> DataFrame:
    """Decisions of rows (match_key, urn, source, matched, has_units): n_group, n_matched, reason and decision.

    The first of these holds: a protected source stays; what infrastructure refers to stays; so does a group of one. With
    ``beside_protected`` a removable row beside a protected one goes. Where no removable row of the group is matched, its one of
    least URN number stays (alongside a protected one, for review, if there is one). The rest goes: as redundant with a matched
    row, or as not the lowest. A removable row that would go but has units inside stays, for review. Rows without a key take no
    part. A group's facts are partial aggregates, and only its least URN is looked for, so no group is ordered."""
    is_removable, is_protected = F.col("source").isin(*removable), F.col("source").isin(*protected)
    rows = rows.where("match_key is not null").withColumn("_urn", F.struct(urn_tail(F.col("urn")).isNull().alias("none"), urn_tail(F.col("urn")).alias("tail"), "urn"))
    groups = rows.groupBy("match_key").agg(
        F.count("*").alias("n_group"), F.count_if(is_removable & F.col("matched")).alias("n_matched"), F.coalesce(F.bool_or(is_protected), F.lit(False)).alias("_protected"), F.min(F.when(is_removable, F.col("_urn"))).alias("_least")
    )
    lowest = is_removable & (F.col("n_matched") == 0) & (F.col("_urn") == F.col("_least"))
    reason = (
        F.when(is_protected, "PROTECTED_SOURCE").when(F.col("matched"), "INFRA_MATCHED").when(F.col("n_group") == 1, "NO_DUPLICATE")
        .when(F.lit(beside_protected) & is_removable & F.col("_protected"), "REDUNDANT_WITH_PROTECTED")
        .when(lowest, F.when(F.col("_protected"), "KEPT_ALONGSIDE_PROTECTED").otherwise("LOWEST_URN_KEPT"))
        .when(F.col("n_matched") > 0, "REDUNDANT_WITH_MATCHED").otherwise("REDUNDANT_NOT_LOWEST_URN")
    )
    out = rows.join(groups, "match_key").withColumn("reason", reason)
    out = out.withColumn("reason", F.when(is_removable & F.col("has_units") & F.col("reason").isin(*REMOVED), "HAS_INTERNAL_UNITS").otherwise(F.col("reason")))
    return out.withColumn("decision", F.when(F.col("reason").isin(*REMOVED), "REMOVE").otherwise("KEEP")).drop("_urn", "_protected", "_least")


def reported(decided: DataFrame, all_groups: bool = False) -> DataFrame:
    """The rows of all groups in which one goes or calls for a look, or of all groups of several, with group_id, numbered densely in
    the order of their keys without a window over the table."""
    shown = F.col("decision").eqNullSafe("REMOVE") | F.col("reason").isin(*REVIEWED) | (F.lit(all_groups) & (F.col("n_group") > 1))
    keys = decided.where(shown).select("match_key").distinct()
    return decided.join(numbered(keys, ["match_key"], "group_id"), "match_key")
