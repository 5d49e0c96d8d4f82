"""Structured Streaming forms of batch operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catchwise.functions.calendar import halfmonth_days, period, period_start
from catchwise.operators.water_balance import PARAMETERS, walk


def halfmonth_totals(daily: DataFrame, *, lateness: str = "10 days") -> DataFrame:
    """Half-month rain of an arriving daily feed ``cell, ts, mm``.

    ``lateness`` is how far a row may lag behind the newest one.  The event time of a period is
    its last day, up to sixteen days ahead of its rows, so the watermark waits that much
    longer and no row within the allowance is dropped.  In append mode a period is emitted
    once closed; in update mode each batch also reports what is still open.  ``complete``
    tells whether every day arrived; gaps are never filled with zeros.  A day of a cell counts
    once: a repeated row changes nothing, and of different values the largest stands.
    """
    day = F.to_date("ts")
    year, p = F.year(day), period(day)
    last = F.date_add(period_start(year, p), halfmonth_days(year, p) - 1).cast("timestamp")
    keyed = daily.withColumn("period_end", last).withWatermark("period_end", f"{int(lateness.split()[0]) + 16} days")
    # at most sixteen dates belong to a period, so one value a date is a tiny state and needs no second stateful step
    each = [F.max(F.when(F.datediff(F.to_date("period_end"), F.to_date("ts")) == k, F.col("mm"))).alias(f"d{k}") for k in range(16)]
    agg = keyed.groupBy("period_end", "cell").agg(*each)
    days = F.array_compact(F.array(*[f"d{k}" for k in range(16)]))
    agg = agg.select("period_end", "cell", F.aggregate(days, F.lit(0.0), lambda a, v: a + v).alias("mm"), F.size(days).alias("days_seen"))
    end = F.to_date("period_end")
    y, q = F.year(end), period(end)
    return agg.select("cell", y.alias("year"), q.alias("period"), "mm", "days_seen", (F.col("days_seen") == halfmonth_days(y, q)).alias("complete"))


BALANCE = "point_id string, year int, period int, soil_mm double, groundwater_mm double, runoff_mm double, status string"


class BalanceState(StatefulProcessor):
    """Storages of one catchment, carried across half-months in their order, whatever order they arrive in.

    A catchment asks the state store once and writes it once a batch, however many rows arrive: the half-months that
    wait lie beside the storages, five numbers each.  They are bounded by the calendar, 24 a year.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("storage", "next long, soil double, ground double, waiting array<double>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = list(rows)
        r = rows[0]
        known = self.store.get()
        following, soil, ground, flat = known if known else (r.first_year * 24 + r.first_period, None, 0.0, [])
        waiting = {int(flat[i]): tuple(flat[i + 1:i + 5]) for i in range(0, len(flat), 5)}
        begin, arrived = following, 0
        for row in rows:
            n = row.year * 24 + row.period
            if n < begin or n in waiting:
                yield Row(point_id=key[0], year=row.year, period=row.period, soil_mm=None, groundwater_mm=None, runoff_mm=None, status="older" if n < begin else "repeated")
            else:
                waiting[n] = (row.p_mm, row.et0_mm, float(row.days), float(row.wet_days))
                arrived += 1
        steps = []
        while following in waiting:
            steps.append((following, waiting.pop(following)))
            following += 1
        if steps:
            p, et0, days, wet = zip(*[v for _, v in steps], strict=True)
            walked = walk(p, et0, days, wet, r.smc_mm * r.smc_multiplier, r.infiltration, r.k30, r.exposed_fraction, soil, ground)
            for (n, _), (_, soil, ground, _, _, _, runoff, _) in zip(steps, walked, strict=True):
                yield Row(point_id=key[0], year=n // 24, period=n % 24, soil_mm=float(soil), groundwater_mm=float(ground), runoff_mm=float(runoff), status="done")
        if arrived or known is None:
            self.store.update((following, None if soil is None else float(soil), float(ground), [x for n, held in waiting.items() for x in (float(n), *held)]))

    def close(self) -> None:
        pass


def water_balance_stream(climate: DataFrame, params: DataFrame) -> DataFrame:
    """Water balance of arriving half-months; the storages live in the state store.

    ``params`` also name each catchment's ``first_year, first_period``.  A half-month is walked once all before it
    are: rows ahead of a gap wait in the state, so their order of arrival does not matter and no gap is skipped.  Rows of
    half-months already walked come out with status ``older``, second rows of waiting ones as ``repeated``; neither
    changes the storages.
    """
    joined = climate.join(params.select("point_id", "smc_mm", "exposed_fraction", "first_year", "first_period", *PARAMETERS), "point_id")
    return joined.groupBy("point_id").transformWithState(statefulProcessor=BalanceState(), outputStructType=BALANCE, outputMode="append", timeMode="None")


def newest_request(requests: DataFrame) -> DataFrame:
    """Latest request per client: ``client_id, request_id, ts`` (update mode on a stream)."""
    return requests.groupBy("client_id").agg(F.max(F.struct("ts", "request_id")).alias("_b")).select("client_id", F.col("_b.request_id").alias("request_id"), F.col("_b.ts").alias("ts"))


def guard_batches(guard, accepted_path: str, rejected_path: str, keys: list[str] | None = None):
    """``foreachBatch`` body: split each micro-batch into accepted and rejected rows.

    ``guard`` maps a frame to ``(accepted, rejected)``.  Rows whose ``keys`` an earlier batch
    has accepted are rejected as ``accepted_before``.  Batch folders are replaced, so a
    repeated batch after a failure writes the same rows once.
    """
    def earlier(batch: DataFrame, batch_id: int) -> DataFrame | None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(accepted_path)
        if batch_id == 0 or not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return None
        return spark.read.parquet(accepted_path).filter(F.col("batch") < batch_id).select(*keys)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        ok, bad = guard(batch)
        seen = earlier(batch, batch_id) if keys else None
        if seen is not None:
            again = ok.join(seen, keys, "left_semi").select(*[F.col(k).cast(bad.schema[k].dataType) for k in keys], F.lit("accepted_before").alias("reason"))
            ok, bad = ok.join(seen, keys, "left_anti"), bad.unionByName(again, allowMissingColumns=True)
        ok.write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        batch.unpersist()

    return run
