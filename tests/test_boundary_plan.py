"""Finished boundaries of cell catchments beside official ones."""

import pytest
from pyspark.sql import functions as F

from catchwise.operators import geometry as ge
from catchwise.plans import boundary as pb

GRID = {"x0": 0.0, "y0": 3000.0, "cell": 30.0}


def block(point, r0, c0, n):
    return [(point, r, c) for r in range(r0, r0 + n) for c in range(c0, c0 + n)]


def rectangle(code, x1, y1, x2, y2):
    at = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    return [(code, 0, 0, i, *at[i], *at[(i + 1) % 4]) for i in range(4)]


@pytest.fixture(scope="module")
def finished(spark):
    # a: 40 x 40 cells at x 300..1500, y 900..2100, its basin 40 m further west and south and much wider east and north
    # b: all of its basin but a rim of 10 m; c: no basin; d: a basin far away; each of c and d with a small hole
    members = block("a", 30, 10, 40) + block("b", 10, 110, 30) + [m for m in block("c", 10, 160, 30) if m[1:] != (20, 170)] + block("d", 60, 110, 30)
    edges = rectangle(1, 260.0, 860.0, 2600.0, 2990.0) + rectangle(2, 3290.0, 1790.0, 4210.0, 2710.0) + rectangle(4, 9000.0, 0.0, 9900.0, 900.0)
    cells = [(r, c, 1) for r in range(1, 71) for c in range(9, 86)] + [(r, c, 2) for r in range(10, 40) for c in range(110, 140)] + [(r, c, 4) for r in range(70, 100) for c in range(300, 330)]
    return pb.finish_boundaries(
        spark.createDataFrame(members, "point_id string, row int, col int"), grid=GRID,
        basin_of=spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "point_id string, basin_code long"),
        basin_edges=spark.createDataFrame(edges, "poly_id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double"),
        basin_cells=spark.createDataFrame(cells, "row int, col int, basin_code long"))


def test_modes_and_areas(finished):
    got = {r.point_id: r for r in finished["summary"].collect()}
    assert {k: r.boundary_mode for k, r in got.items()} == {"a": "hybrid", "b": "full_reference", "c": "no_reference", "d": "no_match"}
    assert got["a"].raw_km2 == pytest.approx(1.44) and got["a"].contact_percent == pytest.approx(50, abs=4) and got["a"].contact_runs == 1
    assert got["b"].final_km2 == pytest.approx(0.92 * 0.92) and got["b"].boundary_adjustment_km2 == pytest.approx(0.92 * 0.92 - 0.81)
    assert got["a"].jaccard > 0.9 and got["c"].jaccard is None
    # smoothing rounds corners; the hole of one cell is below the threshold and filled
    assert 0.76 < got["c"].final_km2 < 0.82 and got["c"].final_km2 == pytest.approx(got["d"].final_km2, rel=0.01)
    for r in got.values():
        assert r.boundary_adjustment_km2 == pytest.approx(r.final_km2 - r.raw_km2)


def test_contact_follows_the_official_line(finished):
    a = finished["final"].filter("poly_id = 'a'").collect()
    west = [e for e in a if e.x1 < 290 and 1000 < e.y1 < 1950]
    assert all(e.x1 == pytest.approx(260) for e in west) and any(e.x1 == pytest.approx(260) and e.y1 == pytest.approx(860) for e in a)
    assert any(e.y1 < 1200 and e.y2 > 1800 and e.x1 == pytest.approx(1500, abs=4) and e.x2 == pytest.approx(1500, abs=4) for e in a)
    # west and south lie 40 m outside the cells
    assert sum(e.x1 * e.y2 - e.x2 * e.y1 for e in a) / 2e6 == pytest.approx(1.24 * 1.24, abs=0.03)


def test_rings_are_closed(finished):
    ends = finished["final"].select("poly_id", F.round("x1", 6).alias("x"), F.round("y1", 6).alias("y"), F.lit(1).alias("n")).unionByName(
        finished["final"].select("poly_id", F.round("x2", 6).alias("x"), F.round("y2", 6).alias("y"), F.lit(-1).alias("n")))
    assert ends.groupBy("poly_id", "x", "y").agg(F.sum("n").alias("n")).filter("n <> 0").isEmpty()
    assert ge.polygon_measures(finished["raw"]).filter("poly_id = 'c'").first().area == pytest.approx(810_000)
