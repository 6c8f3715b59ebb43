"""Text rules of loads and reports: derived codes, casts of staged text, formats, ordered shortening, resolved names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def replace_first(c: Column, old: str, new: str) -> Column:
    """Only the first occurrence of a plain string."""
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c)))).otherwise(c)


def is_integer(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9]+\z"), F.lit(False))


def staged_cast(c: Column, kind: str) -> Column:
    """A staged text as a value of the column it goes to: empty is null except for text; what doesn't fit fails the load."""
    return c if kind == "string" else F.nullif(c, F.lit("")).cast(kind)


def any_contains(df: DataFrame, needle: str, columns: list[str] | None = None) -> Column:
    """Whether any attribute holds the text, whatever the case."""
    out = F.lit(False)
    for c in columns or df.columns:
        out = out | F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(needle.lower()), F.lit(False))
    return out


def resolve(columns: list[str], name: str) -> str | None:
    """The column that is meant: of that very name, or else the first of that name in another case."""
    if name in columns:
        return name
    return next((c for c in columns if c.lower() == name.lower()), None)


def latin1_line(columns: list[str], delimiter: str = ";") -> Column:
    """A report line in ISO-8859-1: what the encoding lacks becomes a question mark, one for each character."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.regexp_replace(F.concat_ws(delimiter, *parts), r"[^\x{0}-\x{ff}]", "?")


def shorten(name: Column, rules: list[tuple[str, str, str]], most: int) -> Column:
    """Applies rules (LIKE pattern of the original name, text, replacement) in their order, each only while the name at
    hand is longer than ``most``."""
    out = name
    for pattern, old, new in rules:
        out = F.when(name.like(pattern) & (F.length(out) > most), F.replace(out, F.lit(old), F.lit(new))).otherwise(out)
    return F.trim(out)


def point_geojson(lng: Column, lat: Column, properties: list[str]) -> Column:
    """A feature with a point; null if a coordinate is missing."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return F.when(lng.isNotNull() & lat.isNotNull(), F.to_json(feature))


def group_links(df: DataFrame, group: str, order: str, lng: str, lat: str) -> DataFrame:
    """(group, line, geometry): one line through the located members of each group that has two at least, in order, whole, so its
    number in the group is 0. The line is one value, so a group's places, and nothing else of its rows, come together."""
    located = df.where(F.col(lng).isNotNull() & F.col(lat).isNotNull())
    lines = located.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("nth"), F.array(lng, lat).alias("xy")))).alias("m")).where(F.size("m") > 1)
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("m", lambda x: x.xy).alias("coordinates"))
    return lines.select(group, F.lit(0).cast("long").alias("line"), F.to_json(shape).alias("geometry"))
