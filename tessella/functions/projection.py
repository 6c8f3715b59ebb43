"""Reference systems by EPSG code: transverse Mercator zones, Web Mercator and geographic systems, with the datums behind them.

Coordinates go through geographic WGS84. A datum of another ellipsoid is shifted by three geocentric parameters; the modern
datums are taken to be equal to WGS84. Unknown codes raise an error; nothing is guessed from the size of coordinates.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from .geometry import UnsupportedGeometry, parse_any

#: Ellipsoids (semi-major axis, inverse flattening).
WGS84, GRS80, INTL, SA69 = (6378137.0, 298.257223563), (6378137.0, 298.257222101), (6378388.0, 297.0), (6378160.0, 298.25)
#: Datums (ellipsoid, shift to WGS84 in metres).
DATUMS = {"WGS84": (WGS84, (0, 0, 0)), "SIRGAS2000": (GRS80, (0, 0, 0)), "ROU98": (WGS84, (0, 0, 0)), "ETRS89": (GRS80, (0, 0, 0)), "NAD83": (GRS80, (0, 0, 0)), "SAD69": (SA69, (-57, 1, -41)), "ED50": (INTL, (-87, -98, -121))}
#: Geographic systems, and the first code, first zone, last zone and hemisphere of each row of UTM zones.
GEOGRAPHIC = {4326: "WGS84", 4674: "SIRGAS2000", 5381: "ROU98", 4258: "ETRS89", 4269: "NAD83", 4618: "SAD69", 4230: "ED50"}
ZONES = [
    (32601, 1, 60, "N", "WGS84"), (32701, 1, 60, "S", "WGS84"), (31965, 11, 22, "N", "SIRGAS2000"), (31977, 17, 25, "S", "SIRGAS2000"), (5382, 21, 22, "S", "ROU98"),
    (25828, 28, 38, "N", "ETRS89"), (26901, 1, 23, "N", "NAD83"), (29168, 18, 22, "N", "SAD69"), (29187, 17, 25, "S", "SAD69"), (23028, 28, 38, "N", "ED50"),
]
#: How names of datums are written in projection texts, by pattern.
NAMES = {"WGS84": r"WGS_?(19)?84", "ROU98": r"SIRGAS_?ROU_?(19)?98", "SIRGAS2000": r"SIRGAS_?2000", "ETRS89": r"ETRS_?(19)?89", "NAD83": r"(NAD_?(19)?83|NORTH_AMERICAN_1983)", "SAD69": r"(SAD_?(19)?69|SOUTH_AMERICAN_(DATUM_)?1969)", "ED50": r"(ED_?(19)?50|EUROPEAN_(DATUM_)?1950)"}


class UnknownSystem(ValueError):
    """No parameters are known for a code or a projection text."""


@dataclass(frozen=True)
class System:
    """A geographic system, or a transverse Mercator zone about a meridian."""

    datum: str
    meridian: float | None = None
    north: float = 0.0
    web: bool = False


def system(code: int) -> System:
    if code in GEOGRAPHIC:
        return System(GEOGRAPHIC[code])
    if code in (3857, 900913, 102100):
        return System("WGS84", web=True)
    for first, low, high, side, datum in ZONES:
        if first <= code <= first + high - low:
            return System(datum, 6.0 * (low + code - first) - 183, 0.0 if side == "N" else 10_000_000.0)
    raise UnknownSystem(f"EPSG:{code}")


class TransverseMercator:
    """Krüger's series in the third flattening up to the fourth power, for arrays; scale 0.9996 and 500 km to the east."""

    K0, EAST = 0.9996, 500_000.0

    def __init__(self, ellipsoid: tuple[float, float]):
        a, f = ellipsoid[0], 1 / ellipsoid[1]
        n = f / (2 - f)
        self.e = math.sqrt(f * (2 - f))
        self.radius = self.K0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.out = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        self.back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)

    def conformal(self, tau: np.ndarray) -> np.ndarray:
        """Tangent of the conformal latitude from the tangent of the latitude."""
        sigma = np.sinh(self.e * np.arctanh(self.e * tau / np.hypot(1, tau)))
        return tau * np.hypot(1, sigma) - sigma * np.hypot(1, tau)

    def forward(self, lon: np.ndarray, lat: np.ndarray, meridian: float, north: float) -> tuple[np.ndarray, np.ndarray]:
        lam = np.radians((lon - meridian + 180) % 360 - 180)
        t = self.conformal(np.tan(np.radians(lat)))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
        x, y = eta.copy(), xi.copy()
        for j, a in enumerate(self.out, 1):
            x += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
            y += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        return self.EAST + self.radius * x, north + self.radius * y

    def inverse(self, x: np.ndarray, y: np.ndarray, meridian: float, north: float) -> tuple[np.ndarray, np.ndarray]:
        xi, eta = (y - north) / self.radius, (x - self.EAST) / self.radius
        u, v = xi.copy(), eta.copy()
        for j, b in enumerate(self.back, 1):
            u -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            v -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        t = np.sin(u) / np.hypot(np.sinh(v), np.cos(u))
        tau = t / (1 - self.e**2)
        for _ in range(5):  # Newton's steps from the conformal latitude to the geodetic one
            now = self.conformal(tau)
            tau += (t - now) / np.hypot(1, now) * (1 + (1 - self.e**2) * tau**2) / ((1 - self.e**2) * np.hypot(1, tau))
        return (meridian + np.degrees(np.arctan2(np.sinh(v), np.cos(u))) + 180) % 360 - 180, np.degrees(np.arctan(tau))


def shifted(lon: np.ndarray, lat: np.ndarray, source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """Geographic coordinates in another datum, by geocentric coordinates at height zero. From a modern datum to an older one
    the way back is inverted, so that a round trip ends where it began."""
    (a, rf), by = DATUMS[source]
    (b, rg), to = DATUMS[target]
    if by == to == (0, 0, 0):
        return lon, lat
    if by == (0, 0, 0):
        x, y = lon, lat
        for _ in range(4):
            u, v = shifted(x, y, target, source)
            x, y = x + (lon - u), y + (lat - v)
        return x, y
    e2, g2 = (2 - 1 / rf) / rf, (2 - 1 / rg) / rg
    p, q = np.radians(lat), np.radians(lon)
    v = a / np.sqrt(1 - e2 * np.sin(p) ** 2)
    x, y, z = (v * np.cos(p) * np.cos(q) + by[0] - to[0], v * np.cos(p) * np.sin(q) + by[1] - to[1], v * (1 - e2) * np.sin(p) + by[2] - to[2])
    flat = np.hypot(x, y)
    lat = np.arctan2(z, flat * (1 - g2))
    for _ in range(6):
        v = b / np.sqrt(1 - g2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + g2 * v * np.sin(lat), flat)
    return np.degrees(np.arctan2(y, x)), np.degrees(lat)


def transformed(xy: np.ndarray, source: int, target: int) -> np.ndarray:
    """Points (n, 2) of one system in another."""
    if source == target or not len(xy):
        return xy
    a, b = system(source), system(target)
    x, y = xy[:, 0].astype(float), xy[:, 1].astype(float)
    if a.web:
        x, y = np.degrees(x / WGS84[0]), np.degrees(2 * np.arctan(np.exp(y / WGS84[0])) - math.pi / 2)
    elif a.meridian is not None:
        x, y = TransverseMercator(DATUMS[a.datum][0]).inverse(x, y, a.meridian, a.north)
    x, y = shifted(x, y, a.datum, b.datum)
    if b.web:
        x, y = np.radians(x) * WGS84[0], np.log(np.tan(math.pi / 4 + np.radians(y) / 2)) * WGS84[0]
    elif b.meridian is not None:
        x, y = TransverseMercator(DATUMS[b.datum][0]).forward(x, y, b.meridian, b.north)
    return np.stack([x, y], 1)


def epsg_of(prj: str) -> int:
    """The EPSG code of a projection text: its own authority at the end, else the datum and UTM zone that its name says."""
    if found := re.findall(r'AUTHORITY\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]\s*\]\s*$', prj.strip(), re.I):
        return int(found[-1])
    m = re.match(r'\s*(PROJCS|GEOGCS|PROJCRS|GEOGCRS)\s*\[\s*"([^"]*)"', prj, re.I)
    name = re.sub(r"[^A-Z0-9]+", "_", m[2].upper()) if m else ""
    datum = next((d for d, p in NAMES.items() if re.search(p, name)), None)
    zone = re.search(r"UTM_ZONE_(\d{1,2})_?([NS])", name)
    if datum and zone:
        for first, low, high, side, own in ZONES:
            if own == datum and side == zone[2] and low <= int(zone[1]) <= high:
                return first + int(zone[1]) - low
    if datum and m[1].upper().startswith("GEOG"):
        return next(c for c, d in GEOGRAPHIC.items() if d == datum)
    if m and re.search(r"WEB_MERCATOR|PSEUDO_MERCATOR", name):
        return 3857
    raise UnknownSystem(m[2] if m else prj[:40])


def srid_of(text: str | None) -> int | None:
    """The SRID that a geometry text carries: EWKB with the flag, or a SRID=...; in front of WKT; None without one."""
    if not text:
        return None
    if m := re.match(r"\s*SRID=(\d+);", text, re.I):
        return int(m[1])
    bare = re.sub(r"^(\\x|0x)", "", text)
    if re.fullmatch(r"[0-9A-Fa-f]{18,}", bare):
        order = "little" if bare[:2] == "01" else "big"
        if int.from_bytes(bytes.fromhex(bare[2:10]), order) & 0x20000000:
            return int.from_bytes(bytes.fromhex(bare[10:18]), order)
    return None


def parse_raw(text: str | None) -> dict | None:
    """A geometry from EWKB hex, WKT, or a GeoJSON geometry or feature."""
    if not text or not text.lstrip().startswith("{"):
        return parse_any(text)
    try:
        g = json.loads(text)
        g = g.get("geometry") if g.get("type") == "Feature" else g
        kind, c = g["type"], g["coordinates"]
        point = lambda p: (float(p[0]), float(p[1]))
        line = lambda r: [point(p) for p in r]
        parts = {
            "Point": lambda: [[[point(c)]]], "MultiPoint": lambda: [[[point(p)]] for p in c], "LineString": lambda: [[line(c)]], "MultiLineString": lambda: [[line(r)] for r in c],
            "Polygon": lambda: [[line(r) for r in c]], "MultiPolygon": lambda: [[line(r) for r in p] for p in c],
        }[kind]()
        return {"type": kind, "parts": parts} if parts and all(p and all(p) for p in parts) else None
    except (ValueError, KeyError, TypeError, IndexError, AttributeError):
        return None


def to_geojson(geom: dict, digits: int = 7) -> str:
    """A GeoJSON geometry with rounded coordinates."""
    line = lambda r: [[round(x, digits) + 0.0, round(y, digits) + 0.0] for x, y in r]
    parts = [[line(r) for r in p] for p in geom["parts"]]
    kind = geom["type"]
    c = {"Point": lambda: parts[0][0][0], "MultiPoint": lambda: [p[0][0] for p in parts], "LineString": lambda: parts[0][0], "MultiLineString": lambda: [p[0] for p in parts], "Polygon": lambda: parts[0], "MultiPolygon": lambda: parts}[kind]()
    return json.dumps({"type": kind, "coordinates": c}, separators=(",", ":"))


def moved(geoms: list[dict | None], sources: list[int | None], target: int) -> list[dict | None]:
    """Geometries in the target system; all points of one system go through at once."""
    out: list[dict | None] = [None] * len(geoms)
    by: dict[int, list[int]] = {}
    for k, (g, s) in enumerate(zip(geoms, sources)):
        if g is not None:
            if s is None:
                raise UnknownSystem("a geometry without SRID")
            by.setdefault(int(s), []).append(k)
    for code, members in by.items():
        rings = [r for k in members for part in geoms[k]["parts"] for r in part]
        points = iter(np.split(transformed(np.concatenate([np.asarray(r, float).reshape(-1, 2) for r in rings]), code, target), np.cumsum([len(r) for r in rings])[:-1]))
        for k in members:
            out[k] = {"type": geoms[k]["type"], "parts": [[list(map(tuple, next(points).tolist())) for _ in part] for part in geoms[k]["parts"]]}
    return out


@pandas_udf(T.StringType())
def _geojson(texts: pd.Series, declared: pd.Series, target: pd.Series) -> pd.Series:
    geoms = [parse_raw(x) for x in texts]
    if any(g is None and isinstance(x, str) for g, x in zip(geoms, texts)):
        raise UnsupportedGeometry("a text that is no geometry")
    sources = [srid_of(x) or (None if d is None or d != d or not d else int(d)) for x, d in zip(texts, declared)]
    return pd.Series([None if g is None else to_geojson(g) for g in moved(geoms, sources, int(target.iloc[0]) if len(target) else 4326)])


def to_geojson_in(geom: Column, declared: Column, target: int = 4326) -> Column:
    """GeoJSON in the target system of geometries in any form. A text's own SRID goes before the declared one of its row; a
    geometry with neither, an unknown code and an unreadable text fail."""
    return _geojson(geom, declared.cast("double"), F.lit(target))


@pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def _points(x: pd.Series, y: pd.Series, source: pd.Series, target: pd.Series) -> pd.DataFrame:
    out = np.full((len(x), 2), np.nan)
    codes = np.stack([source.to_numpy(float), target.to_numpy(float)], 1)
    for pair in np.unique(codes[~np.isnan(codes).any(1)], axis=0):
        k = np.flatnonzero((codes == pair).all(1))
        out[k] = transformed(np.stack([x.to_numpy(float), y.to_numpy(float)], 1)[k], int(pair[0]), int(pair[1]))
    found = pd.DataFrame(out, columns=["x", "y"])
    return found.astype(object).where(found.notna(), None)


def points_in(x: Column, y: Column, source: Column, target: Column) -> Column:
    """Struct of x and y in another system, both systems by row; null where a coordinate or a code is."""
    return _points(x, y, source, target)


@pandas_udf(T.IntegerType())
def _srid(texts: pd.Series) -> pd.Series:
    return pd.Series([srid_of(x) for x in texts], dtype="Int32")


@pandas_udf(T.IntegerType())
def _epsg(texts: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else epsg_of(x) for x in texts], dtype="Int32")


def epsg_code(prj: Column) -> Column:
    """Codes of projection texts; one that names no known system fails."""
    return _epsg(prj)


def detected_srid(df: DataFrame, geom: str, rec: str, declared: int | None = None, column_type: str | None = None) -> int:
    """The SRID of a layer: the declared one, else that of the first row by ``rec`` with a geometry, else that of the column's type
    text, such as geometry(Point,32721)."""
    if declared:
        return declared
    row = df.where(F.col(geom).isNotNull()).orderBy(rec).limit(1).select(_srid(F.col(geom)).alias("s")).first()
    if row and row.s:
        return row.s
    if m := re.search(r",\s*(\d+)\s*\)", column_type or ""):
        return int(m[1])
    raise UnknownSystem("a layer without SRID")
