"""Network operators against plain-Python walks on small random networks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from catchwise.operators import channel as ch
from catchwise.operators import doubling
from catchwise.operators import network as net

SCHEMA = "linkno long, downstream_id long, length_m double, slope double, strm_order int, area_km2 double"


def forest(seed, n=60, chain=False):
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        parent = None if i == 1 or (not chain and rng.random() < 0.05) else (i - 1 if chain else rng.randint(max(1, i - 6), i - 1))
        rows.append((i, parent, float(rng.randint(1, 50)), rng.random(), rng.randint(1, 3), float(rng.randint(1, 9))))
    return rows


def closure(rows):
    up = defaultdict(list)
    for r in rows:
        if r[1]:
            up[r[1]].append(r[0])
    out = {}
    for r in rows:
        seen, stack = set(), [r[0]]
        while stack:
            v = stack.pop()
            seen.add(v)
            stack += up[v]
        out[r[0]] = seen
    return out, up


@pytest.mark.parametrize("seed,chain", [(1, False), (2, False), (3, True)])
def test_closure_accumulation_and_longest_path(spark, seed, chain):
    rows = forest(seed, chain=chain)
    links = spark.createDataFrame(rows, SCHEMA)
    want, up = closure(rows)
    outlets = spark.createDataFrame([(i,) for i in (1, 5, 6, 20, 41)], "linkno long")
    got = {(r.outlet, r.linkno) for r in net.upstream(links, outlets).collect()}
    assert got == {(o, v) for o in (1, 5, 6, 20, 41) for v in want[o]}
    area = {r[0]: r[5] for r in rows}
    acc = {r.linkno: (r.area_km2, r.upstream_count) for r in net.accumulate(links, ["area_km2"]).collect()}
    assert acc == {v: (sum(area[u] for u in s), len(s)) for v, s in want.items()}
    length = {r[0]: r[2] for r in rows}

    def longest(v):
        return length[v] + max((longest(c) for c in up[v]), default=0.0)

    paths = defaultdict(list)
    for r in net.longest_path(links, outlets).orderBy("outlet", "step").collect():
        paths[r.outlet].append((r.step, r.linkno, r.main_length_m))
    parent = {r[0]: r[1] for r in rows}
    for o in (1, 5, 6, 20, 41):
        steps = [v for _, v, _ in paths[o]]
        assert [s for s, _, _ in paths[o]] == list(range(1, len(steps) + 1))
        assert steps[0] == o and all(parent[b] == a for a, b in zip(steps, steps[1:]))
        assert sum(length[v] for v in steps) == pytest.approx(longest(o)) == pytest.approx(paths[o][0][2])


def test_three_link_network(spark):
    links = spark.createDataFrame([(1, None, 1000.0, 0.01, 2, 1.0), (2, 1, 1000.0, 0.03, 1, 0.5), (3, 1, 1000.0, 0.02, 1, 0.5)], SCHEMA)
    m = net.drainage_metrics(links, spark.createDataFrame([(1,)], "linkno long")).first()
    assert (m.total_stream_length_km, m.drainage_density, m.stream_count, m.junction_count, m.stream_order_max) == (3.0, 1.5, 3, 1, 2)
    assert m.bifurcation_ratio == 2.0 and m.network_mean_slope_pct == pytest.approx(2.0)
    assert net.longest_path(links, links.filter("linkno = 1")).first().main_length_m == 2000.0


def test_drainage_metrics_match_strahler_counts(spark):
    links = spark.createDataFrame(forest(7), SCHEMA)
    outlets = links.select("linkno")
    a = {r.outlet: (r.stream_count, r.bifurcation_ratio) for r in net.drainage_metrics(links, outlets).collect()}
    b = {r.outlet: (r.n, r.b) for r in net.strahler_counts(links, outlets).groupBy("outlet").agg(F.sum("streams").alias("n"), F.avg("bifurcation_ratio").alias("b")).collect()}
    assert a == b


def test_one_link_with_most_of_the_network(spark):
    star = [(1, None, 1.0, 0.0, 2, 1.0)] + [(i, 1, 1.0, 0.0, 1, 1.0) for i in range(2, 2002)]
    acc = net.accumulate(spark.createDataFrame(star, SCHEMA), ["area_km2"]).filter("linkno = 1").first()
    assert (acc.area_km2, acc.upstream_count) == (2001.0, 2001)


@pytest.mark.parametrize("shape", ["star", "chain"])
def test_terminals_of_large_networks(spark, shape, monkeypatch):
    n = 100_000
    parent = F.when(F.col("node") > 0, F.lit(0) if shape == "star" else F.col("node") - 1)
    nodes = spark.range(n).select(F.col("id").alias("node")).withColumn("parent", parent.cast("long")).withColumn("m", F.lit(2.0))
    rounds = []
    kept = doubling.Cut
    monkeypatch.setattr(doubling, "Cut", lambda df, **more: rounds.append(kept(df, **more)) or rounds[-1])
    got = doubling.to_terminal(nodes, {"below": "m"}).agg(F.count("*"), F.max("terminal"), F.sum("hops"), F.sum("below")).first()
    hops = n - 1 if shape == "star" else n * (n - 1) // 2
    assert tuple(got) == (n, 0, hops, 2.0 * hops)
    # a round writes the rows that were unfinished before it: one round over a star, the further half in the last of a chain
    left = [r.count for r in rounds]
    assert left[0] == n - 1 and left[-1] == 0 and all(a > b for a, b in zip(left, left[1:])) and (len(left) == 2 if shape == "star" else left[-2] <= n // 2 and len(left) <= 18)
    assert rounds[-1].df.count() == left[-2]
    marks = spark.createDataFrame([(0,), (n // 2,)], "node long")
    first = {r.mark: r.n for r in doubling.first_marked(nodes, marks).groupBy("mark").agg(F.count("*").alias("n")).collect()}
    assert first == ({0: n - 1, n // 2: 1} if shape == "star" else {0: n // 2, n // 2: n // 2})


def test_cycles_and_connectors(spark):
    links = spark.createDataFrame([(1, -1, 5.0), (2, 1, 5.0), (3, 2, 0.0), (4, 3, 5.0), (5, 4, 5.0), (6, 99, 5.0)], "linkno long, downstream_id long, length_m double")
    subs = spark.createDataFrame([(i,) for i in (1, 2, 4, 6)], "polygon_id long")
    got = {r.linkno: (r.downstream_id, r.broken) for r in net.resolve_downstream(links, subs).collect()}
    assert got == {1: (None, False), 2: (1, False), 4: (2, False), 6: (None, True)}
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, None)], "linkno long, downstream_id long")
    assert {(r.linkno, r.kind) for r in net.find_cycles(loop).collect()} == {(1, "loop"), (2, "loop"), (3, "loop"), (5, "self")}
    with pytest.raises(doubling.CyclicNetwork):
        net.basin_level(loop)


def test_pair_relations(spark):
    links = spark.createDataFrame(forest(4, n=30), SCHEMA)
    want, _ = closure(forest(4, n=30))
    pts = spark.createDataFrame([(f"p{i}", i, float(i), i % 3) for i in range(1, 31)], "point_id string, linkno long, area_km2 double, basin_code int")
    got = {(r.upstream_point, r.downstream_point) for r in net.flow_path_pairs(links, pts).collect()}
    assert got == {(f"p{u}", f"p{d}") for d, s in want.items() for u in s if u != d}
    counts = net.relation_counts(links, pts).collect()
    assert all(r.same_outlet + r.same_flow_path + r.same_basin_different_branch + r.different_basin == 29 for r in counts)


def test_branch_follows_the_reference_line(spark):
    links = spark.createDataFrame([(1, None, 1000.0), (2, 1, 1500.0), (3, 1, 3000.0), (4, 2, 1000.0)], "linkno long, downstream_id long, length_m double")
    segs = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 1000.0, 0.0), (2, 0, 0, 1000.0, 0.0, 2500.0, 0.0), (4, 0, 0, 2500.0, 0.0, 3500.0, 0.0), (3, 0, 0, 1000.0, 0.0, 1000.0, 3000.0)],
                                 "linkno long, part int, seq int, x1 double, y1 double, x2 double, y2 double")
    ref = spark.createDataFrame([(1, 0.0, 0.0, 3800.0, 0.0, 0.0)], "seg_id long, x1 double, y1 double, x2 double, y2 double, station double")
    path = ch.aligned_path(links, ch.link_fit(segs, ref, 3800.0), spark.createDataFrame([(1,)], "linkno long"), 3800.0)
    assert [r.linkno for r in path.orderBy("step").collect()] == [1, 2, 4]
    line = ch.assemble_channel(path, segs).orderBy("step").collect()
    assert [r.station_m for r in line] == [0.0, 1000.0, 2500.0] and not any(r.flipped for r in line)


def test_reconcile_siblings_chains_and_ties(spark):
    from catchwise.operators import d8

    # D holds branches A1 and A2, A2 holds B; E is unrelated; F and G tie
    nested = [("A1", "D"), ("A2", "D"), ("B", "D"), ("B", "A2")]
    raw = {"D": 90, "A1": 30, "A2": 20, "B": 10, "E": 60, "F": 5, "G": 5}
    cells = {0: "D A1 A2 B", 1: "D A2 B", 2: "D E A1", 3: "E F", 4: "F G", 5: "D A1", 6: "D A2 B E"}
    members = spark.createDataFrame([(p, 0, c) for c, ps in cells.items() for p in ps.split()] + [("A1", 0, 9)], "point_id string, row int, col int")
    kept, qa = d8.reconcile(members, spark.createDataFrame(nested, "upstream_point string, downstream_point string"), spark.createDataFrame(list(raw.items()), "point_id string, raw_cells long"))
    got = {}
    for r in kept.collect():
        got.setdefault(int(r.node) % 100, set()).add(r.point_id)
    by_cell = [got[k] for k in sorted(got)]
    assert by_cell == [{"D", "A1"}, {"D", "A2", "B"}, {"D", "A1"}, {"E"}, {"F"}, {"D", "A1"}, {"D", "A2", "B"}]
    counts = {r.point_id: (r.outside_cells, r.overlap_cells) for r in qa.collect()}
    assert counts["A1"] == (1, 0) and counts["A2"] == (0, 1) and counts["E"] == (0, 2) and counts["G"] == (0, 1)


def test_intervals_of_a_forest(spark):
    from catchwise.operators import intervals as iv

    rows = forest(11, n=80)
    want, _ = closure(rows)
    tree = spark.createDataFrame([(r[0], r[1]) for r in rows], "node long, parent long")
    got = {r.node: r for r in iv.tree_intervals(tree).collect()}
    assert sorted(r.enter for r in got.values()) == list(range(80))
    for v, below in want.items():
        assert got[v].leave - got[v].enter == len(below)
        assert {u for u, r in got.items() if got[v].enter <= r.enter < got[v].leave} == below
        assert got[v].depth == sum(v in want[u] for u in want) - 1
    places = spark.createDataFrame([(f"p{v}", r.enter, r.leave, v % 3) for v, r in got.items()] + [("twin", got[5].enter, got[5].leave, 2)], "point_id string, enter long, leave long, code int")
    at = {f"p{v}": v for v in want} | {"twin": 5}
    nested = {(a, b) for a, u in at.items() for b, v in at.items() if u != v and u in want[v]}
    assert {(r.inner.point_id, r.outer.point_id) for r in iv.nested_pairs(places, ["point_id"]).collect()} == nested
    assert iv.nested_pairs(places, ["point_id"]).count() == len(nested)
    code = {f"p{v}": v % 3 for v in want} | {"twin": 2}
    for keys, same in (([], lambda a, b: True), (["code"], lambda a, b: code[a] == code[b])):
        counts = {r.point_id: (r.above, r.below) for r in iv.counts_along(places, keys, ["point_id"]).collect()}
        assert counts == {p: (sum(a == p and same(a, b) for a, b in nested), sum(b == p and same(a, b) for a, b in nested)) for p in at}
    pairs = spark.createDataFrame(sorted(nested), "upstream_point string, downstream_point string")
    again = iv.places_of_pairs(pairs.filter("upstream_point <> 'twin' and downstream_point <> 'twin'"), places.filter("point_id <> 'twin'"))
    made = {(r.inner.point_id, r.outer.point_id) for r in iv.nested_pairs(again, ["point_id"]).collect()}
    assert made == {(a, b) for a, b in nested if "twin" not in (a, b)}


def test_rejected_climate_points(spark):
    import datetime as dt

    from catchwise.plans.catchment import halfmonth_climate

    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(31)]
    rain = [(d, 1, 2.0) for d in days] + [(d, 2, None if d.day == 7 else 1.0) for d in days]
    rain = spark.createDataFrame(rain, "date date, cell int, mm double")
    weights = spark.createDataFrame([("ok", 1, 1.0), ("gap", 2, 1.0)], "point_id string, cell int, w double")
    areas = spark.createDataFrame([("ok", 1.0), ("gap", 1.0), ("away", 1.0)], "point_id string, area double")
    et0 = spark.createDataFrame([(p, d, 3.0) for p in ("ok", "gap") for d in days], "point_id string, date date, et0_mm double")
    accepted, rejected = halfmonth_climate(rain, weights, areas, et0)
    assert {r.point_id for r in accepted.collect()} == {"ok"} and accepted.count() == 2
    assert {r.point_id for r in rejected.collect()} == {"gap", "away"} and rejected.filter("reason is null").isEmpty()


def test_equal_paths_summed_in_another_order_are_ties(spark):
    # 0.3 + 0.2 + 0.1 and 0.1 + 0.2 + 0.3 differ in the last bit; the smaller headwater keeps the main path
    rows = [(1, None, 0.0), (2, 1, 0.1), (3, 2, 0.2), (4, 3, 0.3), (5, 1, 0.3), (6, 5, 0.2), (7, 6, 0.1)]
    for flip in (False, True):
        lengths = [rows[0], *[(i, p, round(0.4 - m, 1) if flip else m) for i, p, m in rows[1:]]]
        links = spark.createDataFrame(lengths, "linkno long, downstream_id long, length_m double")
        assert net.main_stems(links).filter("linkno = 1").first().headwater == 4
