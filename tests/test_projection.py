"""Reference systems: the projection's own laws, round trips, projection texts, texts of geometry."""

import json
import math

import numpy as np
import pytest

from tessella.functions import geometry as G, projection as P

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("code", [32721, 32630, 31981, 5382, 25830, 26915, 29191, 23031, 3857, 4674, 4618])
def test_round_trips_stay_below_a_millimetre(code):
    s = P.system(code)
    lon = (s.meridian if s.meridian is not None else -57) + RNG.uniform(-3.5, 3.5, 500)
    lat = RNG.uniform(-79, -1, 500) if s.north else RNG.uniform(1, 79, 500)
    there = P.transformed(np.stack([lon, lat], 1), 4326, code)
    back = P.transformed(there, code, 4326)
    apart = np.hypot((back[:, 0] - lon) * np.cos(np.radians(lat)), back[:, 1] - lat) * 111_320
    assert apart.max() < 1e-3
    again = P.transformed(back, 4326, code)
    assert code in P.GEOGRAPHIC or np.abs(again - there).max() < 1e-3


@pytest.mark.parametrize("datum", ["WGS84", "SAD69", "ED50"])
def test_transverse_mercator_by_its_laws(datum):
    """On the meridian northings are 0.9996 of the meridian's arc, found here by quadrature; elsewhere the map is conformal."""
    a, rf = P.DATUMS[datum][0]
    tm, e2 = P.TransverseMercator((a, rf)), (2 - 1 / rf) / rf
    for lat in (10.0, 34.5, 60.0, 80.0):
        p = np.linspace(0, math.radians(lat), 20_001)
        arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(p) ** 2) ** 1.5, p)
        x, y = tm.forward(np.array([-57.0]), np.array([lat]), -57.0, 0.0)
        assert x[0] == 500_000 and y[0] == pytest.approx(0.9996 * arc, abs=1e-3)
    h = 1e-6
    for lon, lat in RNG.uniform([-60, -70], [-54, 70], (50, 2)):
        at = lambda dx, dy: np.array(tm.forward(np.array([lon + dx]), np.array([lat + dy]), -57.0, 0.0))[:, 0]  # noqa: B023, E731
        p = math.radians(lat)
        nu, rho = a / math.sqrt(1 - e2 * math.sin(p) ** 2), a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
        east, north = (at(h, 0) - at(-h, 0)) / (nu * math.cos(p)), (at(0, h) - at(0, -h)) / rho
        assert np.dot(east, north) == pytest.approx(0, abs=2e-9) and np.hypot(*east) == pytest.approx(np.hypot(*north), rel=1e-6)


def test_older_kernel_agrees():
    lon, lat = RNG.uniform(-59, -55, 50), RNG.uniform(-35, -30, 50)
    new = P.transformed(np.stack([lon, lat], 1), 4326, 32721)
    assert np.abs(new - np.array([G.utm_forward(x, y) for x, y in zip(lon, lat)])).max() < 1e-3


def test_datums_shift_by_their_parameters():
    here = P.transformed(np.array([[-56.0, -34.5]]), 4618, 4326)[0]
    assert 20 < math.hypot((here[0] + 56) * 92_000, (here[1] + 34.5) * 111_000) < 120
    assert (P.transformed(np.array([[-56.0, -34.5]]), 4674, 4326) == [[-56.0, -34.5]]).all()


def test_projection_texts():
    own = 'PROJCS["any",GEOGCS["x",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32721"]]'
    texts = {
        own: 32721, 'PROJCS["WGS_1984_UTM_Zone_21S",GEOGCS["GCS_WGS_1984",AUTHORITY["EPSG","4326"]],UNIT["Meter",1.0]]': 32721, 'PROJCS["WGS 84 / UTM zone 30N"]': 32630, 'PROJCS["SIRGAS_2000_UTM_Zone_21S"]': 31981,
        'PROJCS["SIRGAS 2000 / UTM zone 11N"]': 31965, 'PROJCS["SIRGAS-ROU98_UTM_zone_21S"]': 5382, 'PROJCS["ETRS_1989_UTM_Zone_31N"]': 25831, 'PROJCS["NAD_1983_UTM_Zone_15N"]': 26915, 'PROJCS["South_American_1969_UTM_Zone_21S"]': 29191,
        'PROJCS["ED_1950_UTM_Zone_30N"]': 23030, 'GEOGCS["GCS_WGS_1984"]': 4326, 'GEOGCS["SIRGAS 2000"]': 4674, 'GEOGCS["SIRGAS-ROU98"]': 5381, 'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere"]': 3857,
    }
    assert {t: P.epsg_of(t) for t in texts} == texts
    for bad in ('PROJCS["Yacare_UTM_Zone_21S"]', 'PROJCS["SIRGAS_2000_UTM_Zone_40S"]', "", "nothing"):
        with pytest.raises(P.UnknownSystem):
            P.epsg_of(bad)
    with pytest.raises(P.UnknownSystem):
        P.system(2154)


def test_texts_of_any_form(spark):
    ring = [(600000.0, 6140000.0), (600100.0, 6140000.0), (600100.0, 6140100.0), (600000.0, 6140000.0)]
    hex_ = G.write_ewkb({"type": "Polygon", "parts": [[ring]]}, 32721)
    flat = "POLYGON((" + ",".join(f"{x} {y}" for x, y in ring) + "))"
    rows = [(1, hex_, None), (2, flat, 32721), (3, f"SRID=32721;{flat}", 4326), (4, json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}), 32721), (5, None, None), (6, "POINT(1 2)", 4326)]
    df = spark.createDataFrame(rows, "rec int, g string, s int")
    got = {r.rec: json.loads(r.j) if r.j else None for r in df.select("rec", P.to_geojson_in(df.g, df.s).alias("j")).collect()}
    want = P.transformed(np.array(ring), 32721, 4326).round(7).tolist()
    assert got[1] == {"type": "MultiPolygon", "coordinates": [[want]]} and got[2] == got[3] == got[4] == {"type": "Polygon", "coordinates": [want]} and got[5] is None and got[6]["coordinates"] == [1.0, 2.0]
    for bad in (("POINT(1 2)", None), ("POINT(1 2)", 9999), ("junk", 4326)):
        odd = spark.createDataFrame([bad], "g string, s int")
        with pytest.raises(Exception):  # noqa: B017
            odd.select(P.to_geojson_in(odd.g, odd.s)).collect()
    assert P.detected_srid(df, "g", "rec") == 32721 and P.detected_srid(df, "g", "rec", 5382) == 5382 and P.detected_srid(df.where("rec = 6"), "g", "rec", column_type="geometry(Point,31981)") == 31981
    with pytest.raises(P.UnknownSystem):
        P.detected_srid(df.where("rec = 5"), "g", "rec")


def test_geojson_forms():
    for g in ({"type": "MultiPoint", "parts": [[[(1, 2)]], [[(3, 4)]]]}, {"type": "LineString", "parts": [[[(1, 2), (3, 4)]]]}, {"type": "MultiLineString", "parts": [[[(1, 2), (3, 4)]], [[(5, 6), (7, 8)]]]}, {"type": "MultiPolygon", "parts": [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]}):
        assert P.parse_raw(P.to_geojson(g)) == {"type": g["type"], "parts": [[[tuple(map(float, p)) for p in r] for r in part] for part in g["parts"]]}
    assert P.parse_raw('{"type":"Polygon"}') is None and P.parse_raw("{") is None and P.parse_raw('{"type":"Polygon","coordinates":[]}') is None
