"""Update of a stored parcel layer from a staged one: what each row on both sides comes to, as one plan.

Staged rows are accepted or skipped, matched by key, compared by shape, and new ones are paired with stored ones that lost their
key but lie in the same place. Stored parcels that are still missing are told by what covers them now, and go unless a pair is open
or something refers to them; the references of a subdivided parcel move to the part nearest to each. Keys are joined null-safe,
places meet on a grid of boxes, and only pairs that meet have their polygons overlaid.

``target`` rows are (id, type, province, locality, number, geom), ``staged`` rows (rec, type, province, locality, number, geom),
``references`` (ref_id, parcel_id, x, y, movable); x and y may be null.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions import lines, overlay as O
from ..functions.geometry import parse_any, traits
from . import grouping, layers, spatial
from .axes import apart
from .staging import settled, spread

KEY = ("type", "province", "locality", "number")


@dataclass(frozen=True)
class UpdateConfig:
    """Shares and bands of the rules. A pair's old parcel must lie in the new one by ``overlap``, and the areas differ by ``area`` at most."""

    update_geometries: bool = True
    tolerance: float = 0.001
    changed: float = 0.05
    strict: tuple[float, float] = (0.98, 0.02)
    loose: tuple[float, float] = (0.85, 0.10)
    part: float = 0.05
    whole: float = 0.90
    partial: float = 0.50
    cell: float = 64.0


def _shares(a: list, b: list) -> list[float | None]:
    out: list[float | None] = [None] * len(a)
    some = [k for k, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
    pairs = list(zip(*layers.parsed([a[k] for k in some], [b[k] for k in some])))
    for k, odd, both in zip(some, O.odd_areas(pairs), O.union_areas(pairs)):
        out[k] = odd / both if both else None
    return out


@pandas_udf(T.DoubleType())
def _moved_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Area in one of two polygons only, as a share of what they cover together."""
    return pd.Series(layers.by_runs(_shares, a, b), dtype=float)


#: What the covered polygon weighs beside its parts.
_OLD = 1 << 30


def _covers(old: list, parts: list) -> list[float]:
    geoms = layers.parsed(old)[0]
    shared = O.areas([[(p, _OLD), *[(parse_any(y), 1) for y in several]] for p, several in zip(geoms, parts)], lambda n: n > _OLD)
    return [v / O.polygon_area(p) for v, p in zip(shared, geoms)]


@pandas_udf(T.DoubleType())
def _together(old: pd.Series, parts: pd.Series) -> pd.Series:
    """Share of a polygon that several cover together."""
    return pd.Series(layers.by_runs(_covers, old, parts), dtype=float)


def same_key(a: str, b: str):
    out = F.lit(True)
    for k in KEY:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def accepted(staged: DataFrame) -> DataFrame:
    """Staged rows with their repaired geometry and why they are skipped, if so: without a key, without a region, or with a key
    that another such row has."""
    seen = layers.examined(staged, "geom").withColumn("number", F.nullif(F.trim(F.col("number").cast("string")), F.lit("")))
    keyless = F.col("type").isNull() | F.col("province").isNull() | F.col("number").isNull()
    reason = F.when(keyless, "NULL_KEY").when(F.col("geom").isNull(), "NO_GEOMETRY")
    seen = settled(seen.withColumn("skipped", reason))
    counts = seen.where("skipped is null").groupBy(*KEY).agg(F.count("*").alias("_n"))
    both = seen.alias("s").join(counts.alias("c"), same_key("s", "c"), "left")
    return both.select(*[F.col(f"s.{c}") for c in seen.columns if c != "skipped"], F.when(F.col("s.skipped").isNull() & (F.col("c._n") > 1), "DUPLICATE_KEY").otherwise(F.col("s.skipped")).alias("skipped"))


def matched(target: DataFrame, candidates: DataFrame, cfg: UpdateConfig, accepts: DataFrame | None) -> DataFrame:
    """Accepted rows with their class: NEW, AMBIGUOUS (several stored rows have the key), UNCHANGED, TOLERATED or CHANGED; and for
    changed ones whether the new shape is applied."""
    counts = target.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    found = candidates.alias("c").join(counts.alias("t"), same_key("c", "t"), "left").select("c.*", "t.n", "t.id")
    old = target.select(F.col("id").alias("old_id"), F.col("geom").alias("old_geom"))
    found = found.join(old, (F.col("id") == F.col("old_id")) & (F.col("n") == 1), "left")
    # Only texts that differ are looked at: equal ones have one shape, and a new row has nothing to be compared with.
    unlike = F.col("old_id").isNotNull() & ~F.col("geom").eqNullSafe(F.col("old_geom"))
    found = spread(found).withColumn("shape", traits(F.when(unlike, F.col("geom"))).shape).withColumn("old_shape", traits(F.when(unlike, F.col("old_geom"))).shape)
    differs = unlike & ~F.col("shape").eqNullSafe(F.col("old_shape"))
    found = found.withColumn("far", apart(F.when(differs, F.col("geom")), F.col("old_geom")))
    kind = F.when(F.col("n").isNull(), "NEW").when(F.col("n") > 1, "AMBIGUOUS").when(~differs, "UNCHANGED").when(F.col("far") <= cfg.tolerance, "TOLERATED").otherwise("CHANGED")
    found = settled(found.withColumn("class", kind))
    share = _moved_share(F.when(F.col("class") == "CHANGED", F.col("geom")), F.col("old_geom"))
    found = found.withColumn("moved", share)
    if accepts is None:
        found = found.withColumn("chosen", F.lit(False))
    else:
        found = found.alias("f").join(accepts.select(*KEY, F.lit(True).alias("_a")).alias("a"), same_key("f", "a"), "left").select("f.*", F.coalesce("a._a", F.lit(False)).alias("chosen"))
    applied = (F.col("class") == "CHANGED") & F.lit(cfg.update_geometries) & (F.col("old_geom").isNull() | F.coalesce(F.col("moved") < cfg.changed, F.lit(False)) | F.col("chosen"))
    return found.withColumn("applied", applied)


def paired(new: DataFrame, pairable: DataFrame, cfg: UpdateConfig, choices: DataFrame | None) -> DataFrame:
    """(rec, id, tier, status) of new rows and stored rows without a key of the same province that lie in one place. A key with a
    choice keeps the chosen row only, and a chosen row is no candidate of another key."""
    ids = layers.pairs_with_area(new, pairable.withColumnRenamed("id", "_id"), "rec", "_id", cfg.cell, on=("province",))
    pairs = ids.join(new.select(F.col("rec").alias("a_id"), *KEY, F.col("area").alias("new_area")), "a_id").join(pairable.select(F.col("id").alias("b_id"), F.col("area").alias("old_area")), "b_id")
    fits = lambda band: (F.col("area") >= band[0] * F.col("old_area")) & F.col("new_area").between((1 - band[1]) * F.col("old_area"), (1 + band[1]) * F.col("old_area"))
    pairs = pairs.withColumn("tier", F.when(fits(cfg.strict), "STRICT").when(fits(cfg.loose), "LOOSE")).where("tier is not null")
    if choices is None:
        pairs = pairs.withColumn("chosen", F.lit(False))
    else:
        by_key, by_id = choices.select(*KEY, F.col("old_id").alias("_own"), F.lit(True).alias("_k")), choices.where("old_id is not null").select(*KEY, F.col("old_id").alias("_id"))
        pairs = pairs.alias("p").join(by_key.alias("k"), same_key("p", "k"), "left").select("p.*", "k._own", "k._k").where("_k is null or _own <=> b_id")
        taken = pairs.alias("p").join(by_id.alias("o"), (F.col("o._id") == F.col("p.b_id")) & ~same_key("p", "o"), "left_anti")
        pairs = taken.withColumn("chosen", F.col("_k").isNotNull()).drop("_own", "_k")
    pairs = settled(pairs)
    of = lambda c: pairs.groupBy(c).agg(F.count("*").alias(f"n_{c}"))
    counted = pairs.join(of("a_id"), "a_id").join(of("b_id"), "b_id")
    status = F.when((F.col("n_a_id") > 1) | (F.col("n_b_id") > 1), "AMBIGUOUS").when((F.col("tier") == "LOOSE") & ~F.col("chosen"), "PENDING").otherwise("APPLIED")
    return counted.select(F.col("a_id").alias("rec"), F.col("b_id").alias("id"), "tier", status.alias("status"))


def covered_by(missing: DataFrame, parts: DataFrame, cfg: UpdateConfig) -> tuple[DataFrame, DataFrame]:
    """(id, cover) of missing parcels, and (id, rec, share) of the new parcels that cover a twentieth of one at least."""
    met = layers.pairs_with_area(missing, parts, "id", "rec", cfg.cell).select(F.col("a_id").alias("id"), F.col("b_id").alias("rec"), "area")
    met = met.join(missing.select("id", F.col("area").alias("_whole"), F.col("geom").alias("_old")), "id").withColumn("share", F.col("area") / F.col("_whole")).where(F.col("share") >= cfg.part)
    met = settled(met.join(parts.select("rec", F.col("geom").alias("_part")), "rec"))
    each = met.groupBy("id").agg(F.count("*").alias("n"), F.max("share").alias("best"), F.first("_old").alias("_old"), F.collect_list("_part").alias("_parts"))
    each = spread(each)
    each = each.withColumn("together", F.when((F.col("n") > 1) & (F.col("best") < cfg.whole), _together("_old", "_parts")).otherwise(F.col("best")))
    kind = F.when(F.col("best") >= cfg.whole, "REPLACED_ONE").when((F.col("n") >= 2) & (F.col("together") >= cfg.whole), "SUBDIVIDED").when(F.col("together") >= cfg.partial, "PARTIAL").otherwise("ORPHAN")
    out = missing.select("id").join(each.select("id", kind.alias("cover")), "id", "left").withColumn("cover", F.coalesce("cover", F.lit("ORPHAN")))
    return out, met.select("id", "rec", "share", F.col("_part").alias("geom"))


@pandas_udf(T.DoubleType())
def _point_distance(x: pd.Series, y: pd.Series, geom: pd.Series) -> pd.Series:
    out = []
    for a, b, text in zip(x, y, geom):
        if a is None or b is None or a != a or b != b:
            out.append(0.0)
            continue
        g = parse_any(text)
        inside = sum(O.holds_point(r, a, b) for part in g["parts"] for r in part) % 2
        out.append(0.0 if inside else float(lines.vertex_distances({"parts": [[[(a, b)]]]}, g)[0]))
    return pd.Series(out, dtype=float)


def reassigned(references: DataFrame, parts: DataFrame) -> DataFrame:
    """(ref_id, parcel_id, rec): the receiving part of each reference to a subdivided parcel: the nearest one, then the one that
    covers most, then the least; a reference without a place goes by cover alone."""
    met = references.join(parts.withColumnRenamed("id", "parcel_id"), "parcel_id").withColumn("far", _point_distance("x", "y", "geom"))
    best = met.groupBy("ref_id", "parcel_id").agg(F.min(F.struct("far", (-F.col("share")).alias("c"), "rec")).alias("m"))
    return best.select("ref_id", "parcel_id", F.col("m.rec").alias("rec"))


def matching(target: DataFrame, staged: DataFrame, cfg: UpdateConfig = UpdateConfig(), accepts: DataFrame | None = None, choices: DataFrame | None = None) -> dict[str, DataFrame]:
    """What both sides have to do with each other: ``seen`` staged rows, ``found``, the accepted ones with their class, ``new`` ones,
    ``unmatched`` stored rows, and ``pairs`` of those."""
    seen = settled(accepted(staged))
    target = target.withColumn("number", F.nullif(F.trim(F.col("number").cast("string")), F.lit("")))
    found = settled(matched(target, seen.where("skipped is null").drop("skipped"), cfg, accepts))
    unmatched = target.alias("t").join(found.alias("f"), same_key("t", "f"), "left_anti")
    unmatched = settled(layers.examined(unmatched, "geom").drop("invalid", "reason"))
    pairable = unmatched.alias("t").join(seen.where("skipped is null or skipped <> 'NULL_KEY'").alias("s"), same_key("t", "s"), "left_anti").where("geom is not null")
    new = settled(found.where("class = 'NEW'").select("rec", *KEY, "geom", "area", *spatial.BOX))
    return {"seen": seen, "found": found, "new": new, "unmatched": unmatched, "pairs": settled(paired(new, pairable, cfg, choices))}


def staged_outcomes(match: dict[str, DataFrame]) -> DataFrame:
    """(rec, outcome): what each staged row comes to. What becomes of stored rows has no part in it."""
    by_rec = match["pairs"].groupBy("rec").agg(F.max_by("status", F.when(F.col("status") == "APPLIED", 2).when(F.col("status") == "AMBIGUOUS", 1).otherwise(0)).alias("pair"))
    out = match["seen"].select("rec", "skipped").join(match["found"].select("rec", "class", "applied"), "rec", "left").join(by_rec, "rec", "left")
    return out.select("rec", F.when(F.col("skipped").isNotNull(), F.concat(F.lit("SKIPPED_"), "skipped")).when(F.col("class") == "CHANGED", F.when(F.col("applied"), "CHANGED_APPLIED").otherwise("CHANGED_PENDING"))
                      .when(F.col("class") != "NEW", F.col("class")).when(F.col("pair") == "APPLIED", "PAIRED").when(F.col("pair").isNotNull(), F.concat(F.lit("INSERTED_PAIR_"), "pair")).otherwise("INSERTED").alias("outcome"))


def verdicts(match: dict[str, DataFrame], references: DataFrame, cfg: UpdateConfig = UpdateConfig()) -> tuple[DataFrame, DataFrame]:
    """(id, outcome, cover) of the stored rows that are missing from the staged ones, and (id, rec, share, geom) of what covers them."""
    applied, open_ = match["pairs"].where("status = 'APPLIED'"), match["pairs"].where("status <> 'APPLIED'").select("id").distinct()
    missing = settled(match["unmatched"].join(applied.select("id"), "id", "left_anti"))
    cover, parts = covered_by(missing.where("geom is not null"), match["new"].join(applied.select("rec"), "rec", "left_anti"), cfg)
    held = references.groupBy(F.col("parcel_id").alias("id")).agg(F.count("*").alias("n_refs"), F.count_if(~F.col("movable")).alias("n_fixed"))
    verdict = missing.select("id").join(cover, "id", "left").join(open_.withColumn("_open", F.lit(True)), "id", "left").join(held, "id", "left")
    used, divided = F.coalesce(F.col("n_refs"), F.lit(0)) > 0, F.coalesce(F.col("cover") == "SUBDIVIDED", F.lit(False))
    outcome = (
        F.when(F.col("_open"), "KEPT_STILL_PAIRABLE").when(used & divided & (F.col("n_fixed") == 0), "DELETED_AFTER_MOVES").when(used & divided, "KEPT_NOT_REASSIGNABLE")
        .when(used, "KEPT_REFERENCED").otherwise("DELETED")
    )
    return settled(verdict.select("id", outcome.alias("outcome"), F.coalesce("cover", F.lit("ORPHAN")).alias("cover"))), parts


def moves_of(verdict: DataFrame, parts: DataFrame, references: DataFrame) -> DataFrame:
    """``reassigned`` references of the parcels that go once these have moved."""
    going = verdict.where("outcome = 'DELETED_AFTER_MOVES'").select(F.col("id"))
    return reassigned(references.join(going.withColumnRenamed("id", "parcel_id"), "parcel_id", "left_semi"), parts.join(going, "id", "left_semi"))


def stored_outcomes(match: dict[str, DataFrame], verdict: DataFrame) -> DataFrame:
    """(id, outcome, cover): what the stored rows come to that the staged ones don't name."""
    return verdict.unionByName(match["pairs"].where("status = 'APPLIED'").select("id", F.lit("PAIRED").alias("outcome"), F.lit(None).cast("string").alias("cover")))


def plan(target: DataFrame, staged: DataFrame, references: DataFrame, cfg: UpdateConfig = UpdateConfig(), accepts: DataFrame | None = None, choices: DataFrame | None = None) -> dict[str, DataFrame]:
    """``staged`` (rec, outcome), ``stored`` (id, outcome, cover), ``moves`` (ref_id, parcel_id, rec) and ``digest``, a mergeable
    fingerprint of all writes, by which a run can tell that the plan it was given is still the one the data make."""
    match = matching(target, staged, cfg, accepts, choices)
    verdict, parts = verdicts(match, references, cfg)
    moves = settled(moves_of(verdict, parts, references))
    staged_out = settled(staged_outcomes(match))
    text = lambda *c: F.concat_ws("|", *c)
    writes = staged_out.where("outcome like 'INSERTED%' or outcome = 'CHANGED_APPLIED'").join(match["seen"].select("rec", "geom"), "rec").select(text(F.lit("W"), "rec", "outcome", F.md5("geom")).alias("entry"))
    writes = writes.unionByName(match["pairs"].where("status = 'APPLIED'").select(text(F.lit("P"), "rec", "id").alias("entry"))).unionByName(verdict.where("outcome like 'DELETED%'").select(text(F.lit("D"), "id").alias("entry")))
    writes = writes.unionByName(moves.select(text(F.lit("S"), "ref_id", "rec").alias("entry")))
    return {"staged": staged_out, "stored": stored_outcomes(match, verdict), "moves": moves, "digest": grouping.fingerprint_text(grouping.multiset_state(writes, ["entry"]))}
