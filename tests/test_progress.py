"""Building progress: null keys, empty sides and the order of states."""

from tessella.operators import progress as P

SHEET = "building string, cable string, zone string, hub string, label string"
ZONES = "id int, building string, code string, status string, geom string"


def test_not_in_has_its_nulls(spark):
    sheet = spark.createDataFrame([("b", "12", "01", "h", "l"), ("b", "12", "02", "h", "l"), ("b", None, "01", "h", "l"), ("b", "12", None, "h", "l"), ("b", "12", "DO", "h", "l")], SHEET)
    zones = spark.createDataFrame([(1, "b", "C012Z01", "BUILT", None), (2, "b", "C099Z09", "BUILT", None), (3, None, "C012Z02", "BUILT", None), (4, "b", "C012Z02", "CLOSED", None)], ZONES)
    of = lambda df, c: sorted(r[c] for r in df.collect())
    none = sheet.limit(0)
    assert of(P.in_sheets_only([sheet, none], zones, ("CLOSED",)), "zone") == ["02"]
    # Nothing matches: a null key on the left is listed too.
    assert of(P.in_sheets_only([sheet, none], zones.limit(0)), "zone") == ["01", "01", "02"]
    assert of(P.in_zones_only([sheet, none], zones, ("CLOSED",)), "id") == [2]
    assert of(P.in_zones_only([none, none], zones), "id") == [1, 2, 3, 4]
    built = P.rebuilt([sheet, sheet], zones, ["building", "cable", "zone"], ("CLOSED",)).collect()
    assert [(r.cable, r.zone, r.zone_id) for r in built] == [("012", "01", 1)]
    twice = P.duplicates([sheet.union(sheet.where("zone = '02' or zone = 'DO'")), sheet])
    assert [(r.sheet, r.zone) for r in twice.collect()] == [(0, "02")] * 2


def test_states_fall_behind(spark):
    states = ["EJECUTADA", "EJECUTADA SIN PLANOSALCOM", "EN TRABAJO", "PLAN 2017", None]
    pairs = [(w, n) for w in states[:4] for n in states]
    then = spark.createDataFrame([("b", str(k), "z", w, 2) for k, (w, _) in enumerate(pairs)] + [("b", "gone", "z", "Ejecutada", 2), ("b", "old", "z", "EJECUTADA", 1), ("b", "plan", "z", "PLAN 2017", 2)], "building string, cable string, zone string, state string, loaded int")
    now = spark.createDataFrame([("b", str(k), "z", n) for k, (_, n) in enumerate(pairs)], "building string, cable string, zone string, state string")
    got = sorted((r.was, r.is_now or "") for r in P.state_errors(now, then).collect())
    rank = {s: k for k, s in enumerate(states[:4])}
    assert got == sorted([(w, n or "") for w, n in pairs if w == "EJECUTADA" and n != w or w != "EJECUTADA" and n and rank[n] > rank[w]] + [("Ejecutada", "")])


def test_outside_without_limits(spark):
    box = "POLYGON(({0} 0,{1} 0,{1} 10,{0} 10,{0} 0))"
    rows = spark.createDataFrame([(1, box.format(0, 10)), (2, box.format(5, 15)), (3, box.format(50, 60)), (4, None)], "id int, geom string")
    limits = spark.createDataFrame([(9, box.format(-5, 12))], "id int, geom string")
    assert sorted(tuple(r) for r in P.outside(rows, limits, 8.0).collect()) == [(2, 0.7), (3, 0.0)]
    assert P.outside(rows, limits.limit(0), 8.0).count() == 3
