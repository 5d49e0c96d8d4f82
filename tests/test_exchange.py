"""Ingest, sinks, streams and the registered queries."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from catchwise.runtime import fits_broadcast, scratch_root
from catchwise.sinks import publish as pb
from catchwise.sinks import vector as vc
from catchwise.sources.layers import load_layers, resolve_dataset
from catchwise.sources.outlets import ingest_outlets
from catchwise.streaming import flows as fl


def test_outlet_rules(spark):
    raw = spark.createDataFrame([("f", "A" * 40, "Kali X", "-7,5", "110,25"), ("f", "b", "", "", ""), ("f", "c", "", "91", "110"), ("f", "d", "", "x", "1")], ["file", "NAMA Titik", "Nama Sungai", "lintang", "Bujur"])
    ok, bad = ingest_outlets(raw)
    r = ok.first()
    assert ok.count() == 1 and (r.lat, r.lon, len(r.label)) == (-7.5, 110.25, 25)
    assert {x.reason for x in bad.collect()} == {"out_of_range", "not_a_number"}
    assert ingest_outlets(raw, max_points=0)[1].count() == 3
    with pytest.raises(ValueError):
        ingest_outlets(raw.drop("Bujur"))


def test_layers(spark, sf):
    with pytest.raises(FileNotFoundError, match="absent"):
        load_layers(spark, sf, {"part": ["p_partkey"], "absent": []})
    with pytest.raises(ValueError):
        load_layers(spark, sf, {"part": ["nope"]})
    v = spark.createDataFrame([("current", 1), ("1km2", 2)], "dataset_id string, n int")
    assert [resolve_dataset(v, *a).first().n for a in ((), ("1km2",), (None, "1km2"))] == [1, 2, 2]


def test_publish_and_signature(spark):
    path = f"{scratch_root(spark)}/pub/t"
    a, b = spark.range(10), spark.range(20)
    pb.publish(a, path)
    pb.publish(b, path)
    assert spark.read.parquet(path).count() == 20
    assert pb.content_signature(b).first() == pb.content_signature(b.orderBy(F.desc("id"))).first() != pb.content_signature(a).first()
    pb.assert_same(a, a)
    with pytest.raises(AssertionError):
        pb.assert_same(a, b)
    assert fits_broadcast(a) and not fits_broadcast(spark.range(10**9))


def test_drop_empty(spark):
    df = spark.createDataFrame([(1, None, "s", " "), (2, None, "s", "")], "id int, a string, SUMBER string, b string")
    assert vc.drop_empty(df.select("SUMBER", "id", "a", "b")).columns == ["id", "SUMBER"]


def test_halfmonth_stream_with_late_rows(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(70)]
    rows = [(0, d, 1.0) for d in days]
    schema = "cell int, ts timestamp, mm double"
    # the fourth day comes with the second file, the fifteenth one day after the next period has begun
    files = (rows[:3] + rows[4:14] + rows[15:16], rows[3:4] + rows[14:15] + rows[16:31], rows[31:])

    def feed(root, sink, mode):
        for part in files:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
            src = spark.readStream.schema(schema).parquet(f"{root}/in")
            q = sink(fl.halfmonth_totals(src).writeStream.outputMode(mode)).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
        return spark.read.parquet(f"{root}/out")

    root = tempfile.mkdtemp(prefix="spark-")
    closed = feed(root, lambda w: w.format("parquet").option("path", f"{root}/out"), "append")
    assert {(r.year, r.period): (r.mm, r.complete) for r in closed.collect()} == {(2024, 0): (15.0, True), (2024, 1): (16.0, True), (2024, 2): (15.0, True)}
    root = tempfile.mkdtemp(prefix="spark-")
    every = feed(root, lambda w: w.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{root}/out")), "update")
    newest = {(r.year, r.period): (r.mm, r.complete) for r in every.orderBy("batch").collect()}
    assert newest == {(2024, 0): (15.0, True), (2024, 1): (16.0, True), (2024, 2): (15.0, True), (2024, 3): (14.0, True), (2024, 4): (10.0, False)}


def test_balance_of_half_months_in_any_order(spark, tmp_path):
    import random

    from catchwise.operators import water_balance as wb

    rnd = random.Random(2)
    rows = [(p, 2020 + i // 24, i % 24, 15, rnd.uniform(0, 150), 50.0, rnd.randint(0, 9)) for p in ("a", "b") for i in range(40)]
    schema = "point_id string, year int, period int, days int, p_mm double, et0_mm double, wet_days int"
    params = spark.createDataFrame([(p, 120.0, 0.3, 1.0, 0.4, 0.9, 2020, 0) for p in ("a", "b")], "point_id string, smc_mm double, exposed_fraction double, smc_multiplier double, infiltration double, k30 double, first_year int, first_period int")
    want = {(r.point_id, r.year, r.period): (r.soil_mm, r.groundwater_mm, r.runoff_mm) for r in wb.mock(spark.createDataFrame(rows, schema), params).collect()}
    held = [r for r in rows if r[:3] == ("b", 2020, 7)]
    mixed = [r for r in rows if r not in held]
    rnd.shuffle(mixed)
    late = rnd.sample(mixed, 5)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = None
    for part in (mixed[:30], mixed[30:50], mixed[50:], late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = src or spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = fl.water_balance_stream(src, params).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        out.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    done = {(r.point_id, r.year, r.period): (r.soil_mm, r.groundwater_mm, r.runoff_mm) for r in got if r.status == "done"}
    # b waits at the half-month that never came
    assert done.keys() == {k for k in want if k[0] == "a" or k[1:] < (2020, 7)}
    assert all(done[k] == pytest.approx(want[k]) for k in done)
    assert len([r for r in got if r.status != "done"]) == 5 and {r.status for r in got if r.point_id == "a"} <= {"done", "older"}


def test_a_day_sent_twice_counts_once(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(15)]
    rows = [(0, d, 1.0) for d in days[:14]] + [(0, days[3], 1.0), (0, days[3] + dt.timedelta(hours=6), 0.5), (1, days[0], None)]
    batch = spark.createDataFrame(rows, "cell int, ts timestamp, mm double")
    got = {r.cell: (r.mm, r.days_seen, r.complete) for r in fl.halfmonth_totals(batch).collect()}
    assert got == {0: (14.0, 14, False), 1: (0.0, 0, False)}
    whole = fl.halfmonth_totals(batch.unionByName(spark.createDataFrame([(0, days[14], 2.0)] * 3, batch.schema))).filter("cell = 0").first()
    assert (whole.mm, whole.days_seen, whole.complete) == (16.0, 15, True)


def test_years_accepted_before_are_rejected(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    guard = fl.guard_batches(lambda b: (b.filter("q >= 0"), b.filter("q < 0").select("gauge", "year", F.lit("negative").alias("reason"))), f"{root}/ok", f"{root}/bad", ["gauge", "year"])
    for i, rows in enumerate(([("a", 2020, 1.0), ("b", 2020, -1.0)], [("a", 2020, 2.0), ("b", 2020, 3.0)])):
        guard(spark.createDataFrame(rows, "gauge string, year int, q double"), i)
    assert {(r.gauge, r.year, r.q) for r in spark.read.parquet(f"{root}/ok").collect()} == {("a", 2020, 1.0), ("b", 2020, 3.0)}
    assert {(r.gauge, r.reason) for r in spark.read.parquet(f"{root}/bad").collect()} == {("b", "negative"), ("a", "accepted_before")}


def test_newest_request_wins(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", 3, 2)], "client_id string, request_id int, ts int")
    assert {r.client_id: r.request_id for r in fl.newest_request(df).collect()} == {"a": 2, "b": 3}


def test_entry_and_registry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 10 and "drainage_density" in df.columns
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 180


def test_kml_lines_write_the_exact_value(spark):
    xs = [67110547.328, -67110547.328, 120000000.123, 99999999.999999999, 0.001, -0.0004, 12345.678, 1e15 + 0.5]
    v = spark.createDataFrame([(1, i, x, -x) for i, x in enumerate(xs)], "ID long, seq int, x double, y double")
    text = vc.lines_to_kml(v.select("ID").distinct().withColumn("NAMA", F.lit("a")), v, []).first().placemark
    assert text.split("<coordinates>")[1].split("</coordinates>")[0] == " ".join(f"{x:.8f},{-x:.8f},0" for x in xs)
