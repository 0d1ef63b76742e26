"""Structured Streaming jobs over probe readings and vehicle samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cityweave.operators.speeds import validated

LEDGER = "run long, road long, mass double, seconds double, settled boolean, late long"


def running_audit(raw: DataFrame, cap: float) -> DataFrame:
    """Readings by outcome of the ordered checks so far; run in complete mode, the result depends on no chunking."""
    return validated(raw, cap).groupBy(F.coalesce("rejected", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


def hourly_speeds(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Exact median and count of every closed hour of every road; rows behind the watermark are dropped."""
    return (
        readings.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour"), "road")
        .agg(F.count("*").alias("n"), F.percentile("speed", 0.5).alias("median"))
        .select("road", F.col("window.start").alias("hour"), "n", "median")
    )


def sliding_speeds(readings: DataFrame, length: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return (
        readings.withWatermark("ts", late)
        .groupBy(F.window("ts", length, step), "road")
        .agg(F.avg("speed").alias("mean"), F.count("*").alias("n"))
        .select("road", F.col("window.start").alias("start"), "mean", "n")
    )


def request_budget(log: DataFrame, per_minute: int, late: str = "1 minute") -> DataFrame:
    """Callers over their budget in a window of a minute that slides by ten seconds."""
    n = log.withWatermark("ts", late).groupBy(F.window("ts", "1 minute", "10 seconds"), "caller").agg(F.count("*").alias("n"))
    return n.where(F.col("n") > per_minute).select("caller", F.col("window.start").alias("start"), "n")


def trips(readings: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Session windows of each vehicle."""
    return (
        readings.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "vehicle")
        .agg(F.count("*").alias("n"))
        .select("vehicle", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def paired_arrivals(a: DataFrame, b: DataFrame, late: str = "1 hour") -> DataFrame:
    """Arrivals (vehicle, ts) of run a with those of run b within the hour after; without one they are overdue."""
    left = a.select(F.col("vehicle").alias("va"), F.col("ts").alias("ta")).withWatermark("ta", late)
    right = b.select(F.col("vehicle").alias("vb"), F.col("ts").alias("tb")).withWatermark("tb", late)
    on = F.expr("va = vb and tb >= ta and tb <= ta + interval 1 hour")
    return left.join(right, on, "left_outer").select(F.col("va").alias("vehicle"), "ta", "tb", F.col("tb").isNull().alias("overdue"))


class Ledger(StatefulProcessor):
    """Totals per run: rate times time since the run's previous time. The first time starts the clock and adds nothing;
    samples that do not advance it are counted as late."""

    def __init__(self, window_s: float):
        self.window_s = window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        clock = StructType([StructField("first", DoubleType()), StructField("last", DoubleType()), StructField("late", LongType())])
        sums = StructType([StructField("mass", DoubleType()), StructField("seconds", DoubleType())])
        self.clock = handle.getValueState("clock", clock)
        self.sums = handle.getMapState("sums", StructType([StructField("road", LongType())]), sums)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seconds", kind="stable")
        first, last, late = self.clock.get() if self.clock.exists() else (None, None, 0)
        totals = {}
        for t, some in frame.groupby("seconds", sort=True):
            if last is None:
                first = last = float(t)
            elif t <= last:
                late += len(some)
            else:
                for road, rate in zip(some["road"], some["rate"]):
                    m = totals.get(road) or (self.sums.getValue((int(road),)) if self.sums.containsKey((int(road),)) else (0.0, 0.0))
                    totals[road] = (m[0] + float(rate) * (t - last) / 1000, m[1] + t - last)
                last = float(t)
        self.clock.update((first, last, int(late)))
        for road, m in totals.items():
            self.sums.updateValue((int(road),), (float(m[0]), float(m[1])))
        settled = last - first >= self.window_s
        yield pd.DataFrame(
            [(key[0], int(r), float(m[0]), float(m[1]), settled, int(late)) for r, m in totals.items()],
            columns=["run", "road", "mass", "seconds", "settled", "late"],
        )

    def close(self) -> None:
        pass


def ledger(samples: DataFrame, window_s: float = 60.0) -> DataFrame:
    """Running totals of (run, road) from samples (run, road, ts, rate); a row whenever a batch changes them."""
    s = samples.select("run", "road", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), "rate")
    return s.groupBy("run").transformWithStateInPandas(
        Ledger(window_s), outputStructType=LEDGER, outputMode="Update", timeMode="None"
    )
