"""Emission and noise ledgers over vehicle samples (run, ts, road, rate) and fleet counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityweave.operators.windows import with_previous

#: Frames that are ordered in one task.
FRAMES = 4096


def timed(samples: DataFrame) -> DataFrame:
    """Adds dt, seconds since the run's previous distinct time; none for the first time, which adds nothing."""
    times = with_previous(samples.select("run", "ts").distinct(), ["run"], "ts", F.date_trunc("HOUR", "ts"), "_before")
    gap = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col("ts")) / 1e6
    return samples.join(times.select("run", "ts", gap.alias("dt")), ["run", "ts"]).where("dt > 0")


def exhaust(samples: DataFrame, by: list[str]) -> DataFrame:
    """Rate times elapsed time, in thousandths, and seconds observed."""
    return timed(samples).groupBy(*by).agg(F.sum(F.col("rate") * F.col("dt") / 1000).alias("mass"), F.sum("dt").alias("seconds"))


def saved(totals: DataFrame, key: list[str], base: int = 0, plan: int = 1) -> DataFrame:
    """Baseline less plan, and its percentage, from totals (run, key, mass)."""
    w = totals.groupBy(*key).pivot("run", [base, plan]).agg(F.first("mass"))
    b, p = F.coalesce(F.col(str(base)), F.lit(0.0)), F.coalesce(F.col(str(plan)), F.lit(0.0))
    return w.select(*key, b.alias("baseline"), p.alias("plan"), (b - p).alias("saved"), F.when(b > 0, 100 * (b - p) / b).alias("percent"))


def equivalent_level(samples: DataFrame, by: list[str], level: str, background: float = 40.0) -> DataFrame:
    """Energy-mean sound level in dB over the window observed, with a background."""
    t = timed(samples)
    mean = F.sum(F.pow(F.lit(10.0), F.col(level) / 10) * F.col("dt")) / F.sum("dt") + 10 ** (background / 10)
    return t.groupBy(*by).agg((10 * F.log10(mean)).alias("leq"))


def paired_delay(arrivals: DataFrame) -> DataFrame:
    """One row from arrivals (run 0 or 1, vehicle, seconds): vehicles in both runs, overdue in run 1, mean delay."""
    v = arrivals.groupBy("vehicle").agg(F.min(F.when(F.col("run") == 0, F.col("seconds"))).alias("a"), F.min(F.when(F.col("run") == 1, F.col("seconds"))).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return v.agg(F.count_if(both).alias("paired"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("overdue"), F.avg(F.col("b") - F.col("a")).alias("mean_delay"))


def trajectory_steps(samples: DataFrame) -> DataFrame:
    """One row from (frame, vehicle, x): samples, vehicles, pairs in consecutive frames, those that moved, largest step."""
    frames = with_previous(samples.select("frame", F.lit(0).alias("_all")).distinct(), ["_all"], "frame", F.floor(F.col("frame") / FRAMES), "_before").drop("_all")
    w = Window.partitionBy("vehicle").orderBy("frame")
    s = samples.join(frames, "frame").withColumns({"_f": F.lag("frame").over(w), "_x": F.lag("x").over(w)})
    next_to = F.coalesce(F.col("_f") == F.col("_before"), F.lit(False))
    step = F.when(next_to, F.abs(F.col("x") - F.col("_x")))
    return s.agg(F.count("*").alias("samples"), F.countDistinct("vehicle").alias("vehicles"), F.count_if(next_to).alias("pairs"), F.count_if(step > 0).alias("moving"), F.max(step).alias("largest"))
