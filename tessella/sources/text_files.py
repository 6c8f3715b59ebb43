"""Delimited text: dialects, encodings, validation, spatial headers.

Files are read by Spark as whole binary files, decoded and cut into records on the executors; one row per record,
with the file, the 1-based record number and the line it starts on."""

from __future__ import annotations

import datetime
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions.geometry import parse_any, to_degrees

DELIMITERS = ",;\t"


def decode(raw: bytes) -> str:
    """Strict UTF-8, else Windows-1252; a byte order mark goes."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def detect_delimiter(line: str) -> str:
    """The commonest of comma, semicolon and tab outside quotes; the comma in doubt."""
    bare = re.sub(r'"[^"]*"', "", line)
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))


def records(text: str, delimiter: str, multiline: bool = True):
    """(line, fields) of each record; doubled quotes stand for one. With ``multiline`` a quoted field may hold line
    breaks, and one left open is an error; without, a quote never reaches past its line."""
    field, fields, quoted, line, start, i, n = [], [], False, 1, 1, 0, len(text)
    seen = False
    while i < n:
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            elif c == '"':
                quoted = False
            elif c in "\r\n" and not multiline:
                quoted = False
                continue
            else:
                line += c == "\n"
                field.append(c)
        elif c == '"' and not field:
            quoted = seen = True
        elif c == delimiter:
            fields.append("".join(field))
            field, seen = [], True
        elif c in "\r\n":
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            if seen or field or fields:
                yield start, [*fields, "".join(field)]
            field, fields, seen = [], [], False
            line += 1
            start = line
        else:
            field.append(c)
        i += 1
    if quoted and multiline:
        raise ValueError(f"the quote opened on line {start} isn't closed")
    if seen or field or fields:
        yield start, [*fields, "".join(field)]


def spatial_columns(headers: list[str]) -> dict[str, str]:
    """Columns that hold a geometry, or a latitude and a longitude, by their names."""
    out: dict[str, str] = {}
    for h in headers:
        name = h.strip().lower()
        for role, pattern in (("geometry", r"(the_)?geom(etry)?|geometria|wkt|wkb"), ("lat", r"lat(itud|itude)?"), ("lng", r"lo?ng?(itud|itude)?")):
            if re.fullmatch(pattern, name):
                out.setdefault(role, h)
    return out


def point_text(lat: str, lng: str) -> str | None:
    """WKT of a pair; a decimal comma passes, half a pair is an error."""
    lat, lng = (v.strip().replace(",", ".") for v in (lat or "", lng or ""))
    if not lat and not lng:
        return None
    if not lat or not lng:
        raise ValueError("latitude and longitude go together")
    return f"POINT({float(lng)} {float(lat)})"


_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


def leading_number(text: str | None) -> float | None:
    """The number that a text begins with, whatever follows it."""
    m = _NUMBER.match(text or "")
    return float(m[1]) if m else None


@pandas_udf(T.StringType())
def _row_geometry(geom: pd.Series, lat: pd.Series, lng: pd.Series) -> pd.Series:
    out = []
    for g, a, b in zip(geom, lat, lng):
        x, y = leading_number(b), leading_number(a)
        if g and parse_any(g):
            out.append(g)
        elif x is None or y is None:
            out.append(None)
        else:
            x, y = to_degrees(x, y)
            out.append(f"POINT({x!r} {y!r})")
    return pd.Series(out, dtype=object)


def row_geometry(values: Column, columns: dict[str, str]) -> Column:
    """A record's geometry text from its values and ``spatial_columns``: the geometry column if that can be read, else latitude and
    longitude by the numbers they begin with (metres are taken as the fallback zone's), else null."""
    of = lambda role: values[columns[role]] if role in columns else F.lit(None).cast("string")
    return _row_geometry(of("geometry"), of("lat"), of("lng"))


def file_date(name: str, pattern: str) -> datetime.date | None:
    """The date in a file name by a pattern with groups d, m and y; null if it isn't in the calendar."""
    m = re.search(pattern, name)
    try:
        return datetime.date(int(m["y"]), int(m["m"]), int(m["d"])) if m else None
    except ValueError:
        return None


SCHEMA = "file string, rec long, line long, values map<string,string>, error string"


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool = True, trim: bool = True) -> DataFrame:
    """(file, rec, line, values, error) of each record; a record with the wrong number of fields keeps null values
    and says so, and a bad file gives one row with its error."""

    def parse(frames):
        for frame in frames:
            for file, raw in zip(frame.path, frame.content):
                rows = []
                try:
                    text = decode(raw)
                    own = delimiter or detect_delimiter(text.split("\n", 1)[0])
                    header = None
                    for line, fields in records(text, own, multiline):
                        fields = [f.strip() for f in fields] if trim else fields
                        if header is None:
                            header = fields
                            if len(set(header)) < len(header):
                                raise ValueError("a column name repeats")
                            continue
                        error = None if len(fields) == len(header) else f"{len(fields)} fields, {len(header)} expected"
                        rows.append((file, len(rows) + 1, line, None if error else dict(zip(header, fields)), error))
                    if not rows:
                        raise ValueError("no records")
                except ValueError as e:
                    rows = [(file, 0, 0, None, str(e))]
                yield pd.DataFrame(rows, columns=["file", "rec", "line", "values", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMA)
