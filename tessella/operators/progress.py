"""Progress of building zones: the rebuild from two sheets and a layer of zones, and five reports about what doesn't fit.

Sheets have rows (building, cable, zone, hub, label ...), zones (id, building, code, status, geom). A concatenated key is null if one
of its parts is, and the two NOT IN reports keep what SQL says about nulls: a null key on the left is listed only if nothing
matched, and a null on the right empties the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import joins, layers
from .staging import settled

#: Names of zones that aren't zones, and states in the order that work goes.
NO_ZONES = ("DO", "Primario", "PRIMARIO")
DONE, DONE_OPEN, AT_WORK, PLANNED = "EJECUTADA", "EJECUTADA SIN PLANOSALCOM", "EN TRABAJO", "PLAN 2017"


def sheet_key() -> Column:
    """Building, cable and zone as the layer of zones spells them."""
    return F.concat(F.trim("building"), F.lit("|C0"), F.trim("cable"), F.lit("|Z"), F.trim("zone"))


def layer_key() -> Column:
    return F.concat("building", F.lit("|"), F.replace(F.col("code"), F.lit("Z"), F.lit("|Z")))


def cut_key() -> Column:
    """The same by places: four letters of cable, three of zone."""
    return F.concat("building", F.lit("|"), F.substring("code", 1, 4), F.lit("|"), F.substring("code", 5, 3))


def open_zones(zones: DataFrame, closed: tuple[str, ...]) -> DataFrame:
    return zones.where(F.col("status").isNotNull() & ~F.col("status").isin(*closed)) if closed else zones


def rebuilt(sheets: list[DataFrame], zones: DataFrame, columns: list[str], closed: tuple[str, ...] = ()) -> DataFrame:
    """Distinct rows of both sheets that have a zone, with its id and geometry; cables get their leading 0."""
    keyed = open_zones(zones, closed).select(layer_key().alias("_key"), F.col("id").alias("zone_id"), "geom")
    out = None
    for sheet in sheets:
        part = sheet.withColumn("_key", sheet_key()).join(keyed, "_key").withColumn("cable", F.concat(F.lit("0"), F.trim("cable"))).select(*columns, "zone_id", "geom")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def duplicates(sheets: list[DataFrame], names: tuple[str, ...] = NO_ZONES) -> DataFrame:
    """Rows whose building, cable and zone stand several times in their own sheet; rows in no zone don't count."""
    out = None
    for n, sheet in enumerate(sheets):
        keys = sheet.where(F.col("zone").isNotNull() & ~F.col("zone").isin(*names)).groupBy("building", "cable", "zone").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        part = sheet.join(keys, ["building", "cable", "zone"]).withColumn("sheet", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def state_errors(progress: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of the latest load whose state now is another one, and one that lies behind: (building, cable, zone, state) against
    (building, cable, zone, state, loaded). A row that isn't there now is only missed if it was done."""
    latest = history.agg(F.max("loaded").alias("loaded"))
    then = history.join(F.broadcast(latest), "loaded").select("building", "cable", "zone", F.col("state").alias("was"), "loaded")  # one row
    both = then.join(progress.select("building", "cable", "zone", F.col("state").alias("is_now"), F.lit(True).alias("_now")), ["building", "cable", "zone"], "left")
    was, now, said = F.upper("was"), F.upper("is_now"), F.col("is_now")
    behind = (was == DONE) | ((was == DONE_OPEN) & ~said.isin(DONE, DONE_OPEN)) | ((was == AT_WORK) & ~now.isin(DONE, DONE_OPEN, AT_WORK)) | ((was == PLANNED) & ~now.isin(PLANNED, DONE, DONE_OPEN, AT_WORK))
    return both.where(~F.coalesce(was == now, F.lit(False)) & behind).drop("_now")


def zones_of(sheets: list[DataFrame], names: tuple[str, ...]) -> DataFrame:
    """Distinct rows in a zone of each sheet, one sheet after the other."""
    out = None
    for sheet in sheets:
        part = sheet.where(F.col("zone").isNotNull() & ~F.col("zone").isin(*names)).select("building", "cable", "zone", "hub", "label").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def in_sheets_only(sheets: list[DataFrame], zones: DataFrame, closed: tuple[str, ...] = (), names: tuple[str, ...] = NO_ZONES) -> DataFrame:
    """Rows of the sheets whose key, as it is written there, no row with a zone has."""
    rows = zones_of(sheets, names).withColumn("_own", F.concat_ws("|", "building", "cable", "zone"))
    rows = rows.withColumn("_own", F.when(F.col("building").isNotNull() & F.col("cable").isNotNull(), F.col("_own")))
    matched = rows.withColumn("_key", sheet_key()).join(open_zones(zones, closed).select(layer_key().alias("_key")), "_key").select(F.col("_own").alias("_match"))
    return joins.not_in(rows, matched, "_own", "_match").drop("_own")


def in_zones_only(sheets: list[DataFrame], zones: DataFrame, closed: tuple[str, ...] = (), names: tuple[str, ...] = NO_ZONES) -> DataFrame:
    """Zones whose key, cut by places, no row of the sheets has."""
    rows = open_zones(zones, closed).withColumn("_own", cut_key())
    matched = rows.select(F.col("_own").alias("_match")).join(zones_of(sheets, names).select(sheet_key().alias("_match")).distinct(), "_match")
    return joins.not_in(rows, matched, "_own", "_match").drop("_own")


def outside(progress: DataFrame, limits: DataFrame, cell: float, least: float = 0.9) -> DataFrame:
    """Rows (id, geom) of which less than ``least`` lies within the limits' polygons, with the share; 0 where none is near."""
    held, bounds = (settled(layers.examined(df, "geom").where("geom is not null")) for df in (progress, limits))
    met = layers.pairs_with_area(held, bounds.select(F.col("id").alias("_id"), *[c for c in bounds.columns if c != "id"]), "id", "_id", cell)
    inside = met.groupBy(F.col("a_id").alias("id")).agg(F.sum("area").alias("_inside"))
    return held.join(inside, "id", "left").withColumn("share", F.coalesce("_inside", F.lit(0.0)) / F.col("area")).where(F.col("share") < least).select("id", "share")
