"""Road attributes and volumes: counted stations, lanes and widths, capacity, flow over the day, tiles, endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lanes each way by class, vehicles an hour a lane by class, lane width in metres, share of an uncounted
#: class's capacity at the peak hour, that hour.
LANES = {"motorway": 3, "trunk": 2, "primary": 2, "secondary": 2}
CAPACITY = {"motorway": 1900, "trunk": 1600, "primary": 1200, "secondary": 1000, "tertiary": 800, "unclassified": 600, "residential": 500, "living_street": 300}
LANE_WIDTH, UNCOUNTED_SHARE, PEAK_HOUR = 3.2, 0.6, 9


def by_class(values: dict, cls: Column, default) -> Column:
    """The value of a class from a fixed map, else the default."""
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(cls == name, F.lit(v)).otherwise(out)
    return out


def lanes(tagged: Column, cls: Column, defaults: dict = LANES) -> Column:
    return F.when(tagged > 0, tagged.cast("double")).otherwise(by_class(defaults, cls, 1).cast("double"))


def with_lanes(roads: DataFrame, defaults: dict = LANES, capacity: dict = CAPACITY) -> DataFrame:
    """roads (cls, lanes, oneway) with lanes_each (tag or class default), lane_count, width and capacity an hour each way;
    links carry four fifths of their class."""
    each, base = lanes(F.col("lanes"), F.col("cls"), defaults), F.regexp_replace("cls", "_link$", "")
    per_lane = by_class(capacity, base, 500) * F.when(F.col("cls").endswith("_link"), 0.8).otherwise(1.0)
    count = F.greatest(F.lit(1.0), F.bround(each)).cast("int")
    width = count * F.when(F.col("oneway"), 1).otherwise(2) * LANE_WIDTH
    return roads.withColumns({"lanes_each": each, "lane_count": count, "width": width, "capacity": each * per_lane})


def station_roads(roads: DataFrame, stations: list[tuple[str, str, float, float]]) -> DataFrame:
    """(label, am, pm, road, cls, lanes_each) of the roads (road, name, cls, length, lanes_each) whose name matches a station's
    pattern and whose class is the longest in total among them; the stations (label, pattern, am, pm) are a parameter."""
    found = None
    for label, pattern, am, pm in stations:
        own = roads.where(F.col("name").rlike(f"(?i){pattern}")).select(F.lit(label).alias("label"), F.lit(float(am)).alias("am"), F.lit(float(pm)).alias("pm"), "road", "cls", "length", "lanes_each")
        found = own if found is None else found.unionAll(own)
    total = found.groupBy("label", "cls").agg(F.sum("length").alias("length"))
    main = total.groupBy("label").agg(F.min(F.struct(-F.col("length"), F.col("cls").alias("cls"))).alias("m")).select("label", "m.cls")
    return found.join(main, ["label", "cls"]).select("label", "am", "pm", "road", "cls", "lanes_each")


def peak_volumes(matched: DataFrame, fill: tuple[str, str, str] | None = None) -> DataFrame:
    """(cls, vph, pm_vph, ref_lanes, stations, interpolated): medians over the stations of each class. A class `fill[0]` that
    was not counted takes the geometric means of the two others."""
    one = matched.groupBy("cls", "label").agg(F.first("am").alias("am"), F.first("pm").alias("pm"))
    vol = one.groupBy("cls").agg(F.median("am").alias("vph"), F.median("pm").alias("pm_vph"), F.count("*").alias("stations"))
    out = vol.join(matched.groupBy("cls").agg(F.median("lanes_each").alias("ref_lanes")), "cls")
    out = out.select("cls", "vph", "pm_vph", "ref_lanes", "stations", F.lit(False).alias("interpolated"))
    if fill is None:
        return out
    gap, a, b = fill
    pick = lambda c, n: F.max(F.when(F.col("cls") == n, F.col(c)))
    made = out.agg(
        F.sqrt(pick("vph", a) * pick("vph", b)).alias("vph"), F.sqrt(pick("pm_vph", a) * pick("pm_vph", b)).alias("pm_vph"),
        F.count(F.when(F.col("cls") == gap, 1)).alias("have"),
    ).where("have = 0 and vph is not null")
    made = made.select(F.lit(gap).alias("cls"), "vph", "pm_vph", F.lit(float(LANES.get(gap, 1))).alias("ref_lanes"), F.lit(0).cast("long").alias("stations"), F.lit(True).alias("interpolated"))
    return out.unionAll(made)


def flow_curve(readings: DataFrame, volumes: DataFrame, peak: int = PEAK_HOUR) -> DataFrame:
    """(cls, hour, flow): the class's morning count over the day by its readings (cls, hour, n) relative to the peak hour,
    corrected towards the afternoon count: not at all up to the peak, wholly from 16 on, linearly between."""
    at = lambda h: F.max(F.when(F.col("hour") == h, F.col("n")))
    anchor = readings.groupBy("cls").agg(at(peak).alias("top"), ((F.coalesce(at(15), F.lit(0)) + F.coalesce(at(16), F.lit(0))) / 2).alias("late"))
    ref = volumes.join(anchor.where("top > 0"), "cls")
    hours = ref.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    shape = F.coalesce(F.col("n"), F.lit(0)) / F.col("top")
    factor = F.when(F.col("late") > 0, F.col("pm_vph") / F.col("vph") / (F.col("late") / F.col("top"))).otherwise(1.0)
    blend = F.when(F.col("hour") <= peak, 1.0).when(F.col("hour") >= 16, factor).otherwise(1 + (factor - 1) * (F.col("hour") - peak) / (16 - peak))
    return hours.join(readings, ["cls", "hour"], "left").select("cls", "hour", (F.col("vph") * shape * blend).alias("flow"))


def lane_factor(each: Column, ref: Column) -> Column:
    """A road's lanes over its class's counted lanes, within 0.5 and 2; 1 for classes without a count."""
    return F.when(ref > 0, F.least(F.greatest(each / ref, F.lit(0.5)), F.lit(2.0))).otherwise(1.0)


def identities(roads: DataFrame) -> DataFrame:
    """roads (way, x1, y1, x2, y2) with road_id from the way and the rounded end points in order, and how many share it."""
    point = lambda x, y: F.struct(F.bround(x, 3).alias("x"), F.bround(y, 3).alias("y"))
    ends = F.array_sort(F.array(point("x1", "y1"), point("x2", "y2")))
    text = F.concat_ws(",", *(F.format_string("%.3f", ends[i][k]) for i in (0, 1) for k in ("x", "y")))
    out = roads.withColumn("road_id", F.concat(F.lit("osm-way/"), F.col("way").cast("string"), F.lit("/segment/"), F.substring(F.sha2(text, 256), 1, 16)))
    return out.join(out.groupBy("road_id").agg(F.count("*").alias("uses")), "road_id")


def tile_cover(roads: DataFrame, size: float) -> DataFrame:
    """(road, tx, ty, owner) for segments (road, x1, y1, x2, y2): all tiles that the segment crosses, by clipping it to each
    tile of its box; the owner holds its midpoint."""
    cell = lambda c: F.floor(c / size)
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b))))
    t = roads.select("*", span("x1", "x2").alias("tx")).select("*", span("y1", "y2").alias("ty"))
    enter, leave = F.lit(0.0), F.lit(1.0)
    for a, b, k in (("x1", "x2", "tx"), ("y1", "y2", "ty")):
        d, lo = F.col(b) - F.col(a), F.col(k) * size - F.col(a)
        enter = F.greatest(enter, F.when(d > 0, lo / d).when(d < 0, (lo + size) / d).otherwise(0.0))
        leave = F.least(leave, F.when(d > 0, (lo + size) / d).when(d < 0, lo / d).otherwise(1.0))
    mid = (cell((F.col("x1") + F.col("x2")) / 2) == F.col("tx")) & (cell((F.col("y1") + F.col("y2")) / 2) == F.col("ty"))
    return t.where(enter <= leave).select("road", "tx", "ty", mid.alias("owner"))


def unsettled_nodes(ends: DataFrame) -> DataFrame:
    """(node, positions) of nodes that the edges' ends (node, x, y) put at more than one place."""
    return ends.groupBy("node").agg(F.count_distinct("x", "y").alias("positions")).where("positions > 1")


def overrides(model: DataFrame, plan: DataFrame) -> DataFrame:
    """Roads (road, lanes_each) with a plan's cap and removed lanes (road, cap, removed): lanes left, and closed where none is."""
    p = plan.groupBy("road").agg(F.min("cap").alias("cap"), F.sum("removed").alias("removed"))
    left = F.greatest(F.lit(0.0), F.col("lanes_each") - F.coalesce("removed", F.lit(0)))
    return model.join(p, "road", "left").select("road", "cap", left.alias("lanes_left"), (left <= 0).alias("closed"))


def fleet_counts(snapshot: DataFrame) -> DataFrame:
    """(ts, vehicle_type, n, stopped, detoured) of a fleet snapshot (ts, vehicle_type, speed, detoured)."""
    return snapshot.groupBy("ts", "vehicle_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("speed") < 0.1).alias("stopped"), F.count_if("detoured").alias("detoured")
    )


def speed_check(samples: DataFrame, profile: DataFrame, least: int) -> DataFrame:
    """One row: roads with `least` samples (road, speed) or more against their profile (road, kmh): how many, both medians
    and the median difference."""
    own = samples.groupBy("road").agg(F.avg("speed").alias("sim"), F.count("*").alias("n")).where(F.col("n") >= least)
    j = own.join(profile, "road")
    return j.agg(F.count("*").alias("roads"), F.median("sim").alias("sim"), F.median("kmh").alias("observed"), F.median(F.col("sim") - F.col("kmh")).alias("diff"))


def seed_ranges(runs: DataFrame, figures: list[str], by: str) -> DataFrame:
    """One row from runs (seed, figures): the run of median `by` (the lower of two; the smaller seed on ties) and each figure's range."""
    n = runs.agg(F.count("*").alias("_n"))
    ordered = runs.withColumn("_r", F.row_number().over(Window.orderBy(by, "seed")))  # one row a seed
    mid = ordered.join(F.broadcast(n), F.col("_r") == F.floor((F.col("_n") + 1) / 2)).select("seed", *figures)
    spread = runs.agg(*(f(c).alias(f"{c}_{k}") for c in figures for k, f in (("min", F.min), ("max", F.max))))
    return mid.crossJoin(F.broadcast(spread))
