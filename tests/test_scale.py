"""Plans that must not change their shape when tables grow."""

from pyspark.sql import functions as F

from catchwise import catalog
from catchwise.operators import climate as cl
from catchwise.operators import spatial as sp
from catchwise.runtime import MEASURED, STATIC, fits_broadcast, measured_broadcasts
from catchwise.sources import testbed as tb


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_prove_no_size(spark):
    few = spark.range(10)
    assert fits_broadcast(few)
    assert not fits_broadcast(few.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1_000_000)))))


def test_no_broadcast_before_sizes_are_measured(spark, sf):
    # only the areas of the soil queries (read twice for the parameters) are hinted; their weights and cells, and all copies of vertices, are not
    for name, hinted in (("z31_soil_layers", 1), ("z31_soil_parameters", 2), ("r9_parameter_preview", 2), ("t2_smooth", 0)):
        assert plan(catalog.queries()[name](spark, sf)).count("BroadcastHashJoin") <= hinted, name


def test_session_gets_its_broadcast_settings_back(spark, sf):
    measured_broadcasts(spark, on=False)
    before = spark.conf.get(STATIC), spark.conf.get(MEASURED, None)
    catalog.queries()["z31_soil_layers"](spark, sf)
    assert spark.conf.get(STATIC) == "-1" and spark.conf.get(MEASURED) == before[0]
    measured_broadcasts(spark, on=False)
    assert (spark.conf.get(STATIC), spark.conf.get(MEASURED, None)) == before


def test_long_segments_are_listed_where_points_are(spark):
    points = spark.createDataFrame([("a", 0.5, 10.0), ("b", 5.0, 12.0), ("c", -0.5, 2.0)], "point_id string, x double, y double")
    segs = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 3e9), (2, 1e6, 0.0, 1e6, 3e9), (3, -1e9, 11.0, 1e9, 11.0)], "linkno long, x1 double, y1 double, x2 double, y2 double")
    near = {(r.point_id, r.linkno): r.d for r in sp.near_segments(points, segs, 1.0).collect()}
    assert near == {("a", 1): 0.5, ("a", 3): 1.0, ("b", 3): 1.0, ("c", 1): 0.5}
    assert sp.near_segments(points.limit(0), segs, 1.0).count() == 0


def test_areal_rain_spreads_catchments(spark):
    # two days of two cells are one small partition; the weighted rows must not all be made in it
    rain = spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0), (2, 0, None), (2, 1, 6.0)], "date int, cell int, mm double").coalesce(1)
    weights = spark.range(400).select(F.concat(F.lit("P"), "id").alias("point_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("cell")).withColumn("w", F.lit(1.0)).coalesce(1)
    areas = weights.select("point_id", F.lit(2.0).alias("area")).distinct()
    out = cl.areal_rain(rain, weights, areas, ["date"])
    assert out.filter("date = 1").select("mm", "coverage").distinct().collect() == [(3.0, 1.0)]
    assert out.filter("date = 2").select("mm", "coverage").distinct().collect() == [(6.0, 0.5)]
    assert out.count() == 800
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_names_are_met_once_for_each_query_they_hold(spark):
    # every name shares its digits in pairs with most queries; only names that hold a query may be met
    names = spark.range(400).select("id", F.format_string("name %06d", F.col("id") * 7919 % 100000).alias("name_norm")).withColumns({"name": F.col("name_norm"), "category": F.lit("Desa"), "priority": F.lit(1)})
    texts = [f"{k:03d}" for k in range(0, 1000, 37)] + ["name 00", "name 0079", "name 007919", "00", "me 0", "none of them", "e"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    held = {r.id: r.name_norm for r in names.collect()}
    hits = {(i, k) for i, t in enumerate(texts) if len(t) > 1 for k, n in held.items() if t in n}
    short = {i for i, t in enumerate(texts) if len(t) <= sp.PIECE}
    met = sorted((r.query_id, r.id) for r in sp.name_candidates(queries, names).collect())
    assert [p for p in met if p[0] in short] == sorted(h for h in hits if h[0] in short) and hits <= {*met} and len({*met}) == len(met)
    top = sorted((r.query_id, r.id, r.position) for r in sp.search_names(queries, names).collect())
    rank = lambda i, k: (0 if held[k] == texts[i] else 1 if held[k].startswith(texts[i]) else 2, len(held[k]), held[k], k)
    assert top == sorted((i, k, n) for i in range(len(texts)) for n, k in enumerate(sorted((k for j, k in hits if j == i), key=lambda k: rank(i, k))[:10], 1))


def test_feed_of_observed_catchments_is_made_of_their_weights(spark, sf):
    obs = spark.createDataFrame([("P1",), ("P3",)], "point_id string")
    feed = tb.climate(spark, sf, obs)
    assert sorted(r.point_id for r in feed.select("point_id").distinct().collect()) == ["P1", "P3"]
    assert feed.exceptAll(tb.climate(spark, sf)).count() == 0 and feed.count() == tb.climate(spark, sf).filter("point_id in ('P1', 'P3')").count()
    # below the sums of the feed, not above them
    tree = plan(feed)
    assert tree.index("LeftSemi") > tree.index("HashAggregate")


def test_balance_asks_the_state_once_a_batch():
    from pyspark.sql import Row

    from catchwise.streaming.flows import BalanceState

    calls = []

    class Store:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return Store()

        def getMapState(self, *_):
            raise AssertionError("one call a half-month")

    state = BalanceState()
    state.init(Handle())
    row = lambda y, p: Row(year=y, period=p, days=15, p_mm=90.0, et0_mm=40.0, wet_days=5, smc_mm=120.0, exposed_fraction=0.3, smc_multiplier=1.0, infiltration=0.4, k30=0.9, first_year=2020, first_period=0)
    send = lambda *at: [(r.year, r.period, r.status) for r in state.handleInputRows(("a",), iter([row(*a) for a in at]), None)]
    assert send(*[(2021, p) for p in range(24)]) == [] and calls == ["get", "update"]
    assert send((2021, 3), (2021, 3)) == [(2021, 3, "repeated")] * 2 and calls == ["get", "update", "get"]
    assert send(*[(2020, p) for p in range(24)]) == [(2020 + n // 24, n % 24, "done") for n in range(48)] and calls[3:] == ["get", "update"]
    assert send((2020, 0)) == [(2020, 0, "older")]


def test_validation_needs_the_feed_of_gauged_catchments_only(spark, sf):
    from catchwise.catalog import streamflow as ss
    from catchwise.plans import models as pm
    from catchwise.runtime import cut

    obs = cut(ss._observed(spark, sf))
    gauged = cut(tb.climate(spark, sf, obs))
    unread = gauged.withColumn("p_mm", F.raise_error(F.lit("the whole feed was made")).cast("double"))
    out = pm.learning_model(unread, ss._static(spark, sf), obs, trees=2, gauged=gauged)
    assert out["validation"].count() == obs.select("point_id").distinct().count()
    assert out["flow"].columns == ["point_id", "year", "period", "depth_pred_mm", "predicted"]


def test_topology_is_refreshed_by_zones(spark, sf):
    # a catchment lists zones; repair and increments by zones are those of the cells one by one
    from catchwise.operators import d8
    from catchwise.plans import network as pn
    from catchwise.runtime import cut

    pts, cells, links = tb.cell_outlets(spark, sf), tb.cells(spark, sf), tb.links(spark, sf)
    zones, parts = (cut(df) for df in d8.hybrid_zones(cells, pts, links))
    each = cut(d8.hybrid_cells(cells, pts, links))
    listed = parts.join(zones, "zone").select("point_id", "row", "col")
    assert listed.exceptAll(each).count() == each.exceptAll(listed).count() == 0
    assert parts.count() * 10 < each.count() and zones.select("row", "col").distinct().count() == zones.count()
    points = pts.select("point_id", "linkno").join(each.groupBy("point_id").agg((F.count("*") * 0.0009).alias("area_km2")), "point_id")
    by_cell, by_zone = (pn.refresh_topology(m, points, links) for m in (each, parts))
    assert sorted(by_cell["qa"].collect()) == sorted(by_zone["qa"].collect())
    n = lambda df, total: sorted(df.groupBy("point_id").agg(total.alias("n")).collect())
    for part in ("members", "increments"):
        assert n(by_cell[part], F.count("*")) == n(by_zone[part], F.sum("cells")), part


def test_clipped_pieces_are_dealt_twice(spark, monkeypatch):
    # rows follow the answer: they are dealt for the cuts and for the parity, and neither written nor joined again
    monkeypatch.setattr(sp, "cut", None)
    square = spark.createDataFrame([(7, 0, 0, 0, 0.0, 0.0, 10.0, 0.0), (7, 0, 0, 1, 10.0, 0.0, 10.0, 10.0), (7, 0, 0, 2, 10.0, 10.0, 0.0, 10.0), (7, 0, 0, 3, 0.0, 10.0, 0.0, 0.0)],
                                   "poly_id long, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    segs = spark.createDataFrame([(1, 0, 0, -5.0, 5.0, 15.0, 5.0), (2, 0, 0, 2.0, 2.0, 2.0, 6.0), (3, 0, 0, 11.0, 1.0, 12.0, 9.0), (4, 0, 0, 8.0, 8.0, 12.0, 8.0)],
                                  "linkno long, part int, seq int, x1 double, y1 double, x2 double, y2 double")
    out = sp.clip_lines(segs, square, size=4.0)
    assert plan(out).count("Exchange hashpartitioning(linkno") == 2
    assert sorted((r.linkno, r.poly_id, round(r.t0, 9), round(r.t1, 9), round(r.length_m, 9)) for r in out.collect()) == [(1, 7, 0.25, 0.75, 10.0), (2, 7, 0.0, 1.0, 4.0), (4, 7, 0.0, 0.5, 2.0)]
