"""Hourly speed profiles and time-forward hold-out scores of probe readings.

Readings have road, cls, speed and ts. Quantiles are exact with linear interpolation. Values are counted per key first,
so a group holds its distinct values, not its readings; rows without a key or speed are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.1, 0.5, 0.9)
#: Keys of the five baselines, from the finest to the widest.
BASELINES = {
    "road_day_hour": ("road", "weekend", "hour"),
    "road_hour": ("road", "hour"),
    "road_overall": ("road",),
    "class_hour": ("cls", "hour"),
    "global_hour": ("hour",),
}
#: Ordered checks of a raw reading; the first that fails names the rejection.
REJECTIONS = (
    ("bad_date", "try_to_date(date) is null"),
    ("bad_time", "time is null or not rlike(time, '^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$')"),
    ("bad_velocity", "try_cast(velocity as double) is null or isnan(try_cast(velocity as double))"),
    ("negative_velocity", "try_cast(velocity as double) < 0"),
    ("over_cap", "try_cast(velocity as double) > {cap}"),
    ("bad_way", "way is null or not rlike(way, '^way/[0-9]{{1,12}}$')"),
)


def calendar(readings: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds hour, weekend and day; Saturday and Sunday are the weekend."""
    return readings.withColumns(
        {"hour": F.hour(ts), "weekend": (F.weekday(ts) >= 5).cast("int"), "day": F.to_date(ts)}
    )


def validated(raw: DataFrame, cap: float) -> DataFrame:
    """Adds rejected: the first failing check of each raw text row, null where all hold."""
    checks = [F.when(F.expr(test.format(cap=cap)), name) for name, test in REJECTIONS]
    return raw.withColumn("rejected", F.coalesce(*checks))


def split_by_day(readings: DataFrame, calibration: tuple[int, int], holdout: tuple[int, int]) -> DataFrame:
    """Adds split by day of the month; the hold-out must lie wholly after the calibration."""
    if not calibration[0] <= calibration[1] < holdout[0] <= holdout[1]:
        raise ValueError("the hold-out must follow the calibration")
    d = F.dayofmonth("ts")
    return readings.withColumn(
        "split", F.when(d.between(*calibration), "calibration").when(d.between(*holdout), "holdout").otherwise("other")
    )


def quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...], names: list[str]) -> DataFrame:
    """Exact quantiles per key from (key, value) counts, and n."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    picks = [F.percentile(value, p, F.col("_n")).alias(name) for p, name in zip(at, names)]
    return counts.groupBy(*keys).agg(F.sum("_n").alias("n"), *picks)


def fit(readings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """n, p10, median and p90 of the readings of each key."""
    present = readings.where(" and ".join(f"{k} is not null" for k in keys))
    return quantiles(present, list(keys), "speed", QUANTILES, ["p10", "median", "p90"])


def hourly_profile(readings: DataFrame, least: int = 10, low: float = 3, high: float = 160) -> DataFrame:
    """(road, hour, kmh) for all 24 hours: the road's own median with enough readings, else its class's hour scaled by
    road over class median, else the class's; clipped."""
    roads = quantiles(readings, ["road", "cls"], "speed", (0.5,), ["overall"]).select("road", "cls", "overall")
    own = quantiles(readings, ["road", "hour"], "speed", (0.5,), ["own"]).where(F.col("n") >= least).select("road", "hour", "own")
    class_hour = quantiles(readings, ["cls", "hour"], "speed", (0.5,), ["ch"]).select("cls", "hour", "ch")
    classes = quantiles(readings, ["cls"], "speed", (0.5,), ["c"]).select("cls", "c")
    grid = roads.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    joined = grid.join(own, ["road", "hour"], "left").join(class_hour, ["cls", "hour"], "left").join(classes, "cls", "left")
    kmh = F.coalesce("own", F.col("ch") * F.col("overall") / F.col("c"), "c")
    return joined.select("road", "hour", F.least(F.greatest(kmh, F.lit(low)), F.lit(high)).alias("kmh"))


def holdout_cells(readings: DataFrame, min_count: int) -> DataFrame:
    """Observed median of each held-out (road, weekend, hour) cell with enough readings."""
    cells = quantiles(readings.where("split = 'holdout'"), ["road", "cls", "weekend", "hour"], "speed", (0.5,), ["observed"])
    return cells.withColumn("eligible", F.col("n") >= min_count)


def predictions(readings: DataFrame, min_count: int) -> DataFrame:
    """Eligible cells against every baseline in long form: pred is null where the baseline has too few readings."""
    cells = holdout_cells(readings, min_count).where("eligible").drop("eligible")
    past = readings.where("split = 'calibration'")
    parts = []
    for name, keys in BASELINES.items():
        fitted = fit(past, keys).where(F.col("n") >= min_count).select(*keys, "p10", F.col("median").alias("pred"), "p90")
        parts.append(cells.join(fitted, list(keys), "left").select("road", "weekend", "hour", "n", "observed", F.lit(name).alias("baseline"), "pred", "p10", "p90"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def error_metrics(scored: DataFrame, by: list[str], tolerance: float = 0.25) -> DataFrame:
    """MAE, median absolute error, bias, reading-weighted MAE, band and tolerance shares over supported cells."""
    e = F.col("pred") - F.col("observed")
    ok: Column = F.col("pred").isNotNull()
    return scored.groupBy(*by).agg(
        F.count("*").alias("cells"),
        F.count_if(ok).alias("supported"),
        F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(F.percentile(F.abs(e), 0.5), 6).alias("median_abs"),
        F.round(F.avg(e), 6).alias("bias"),
        F.round(F.sum(F.abs(e) * F.col("n")) / F.sum(F.when(ok, F.col("n"))), 6).alias("weighted_mae"),
        F.round(F.avg(F.when(ok, F.col("observed").between(F.col("p10"), F.col("p90")).cast("int"))), 6).alias("band_share"),
        F.round(F.avg(F.when(ok, (F.abs(e) <= tolerance * F.col("observed")).cast("int"))), 6).alias("tolerance_share"),
    )


def readings_in_band(readings: DataFrame, scored: DataFrame) -> DataFrame:
    """(baseline, readings, inside, share): held-out readings of the cells that a baseline scores, and those between its p10
    and p90. Readings are counted by cell and speed first, so each goes to the baselines once however often it occurs."""
    cell = ["road", "weekend", "hour"]
    seen = readings.where("split = 'holdout'").groupBy(*cell, "speed").agg(F.count("*").alias("m"))
    j = seen.join(scored.where("pred is not null").select(*cell, "baseline", "p10", "p90"), cell)
    inside = F.when(F.col("speed").between(F.col("p10"), F.col("p90")), F.col("m")).otherwise(0)
    return j.groupBy("baseline").agg(F.sum("m").alias("readings"), F.sum(inside).alias("inside")).withColumn("share", F.col("inside") / F.col("readings"))


def common_cells(scored: DataFrame) -> DataFrame:
    """Cells that every baseline scores."""
    whole = scored.groupBy("road", "weekend", "hour").agg(F.min(F.col("pred").isNotNull()).alias("all")).where("all")
    return scored.join(whole.drop("all"), ["road", "weekend", "hour"], "left_semi")
