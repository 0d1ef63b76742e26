"""Road queries: `part` as roads (name, class, lanes, length), `events` as readings, vehicles and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.operators import roads as op
from cityweave.operators import scenarios
from cityweave.plans.more import P
from cityweave.plans.spatial import points

#: Lanes and capacity of the tables' classes, and counted stations: label, name pattern, morning and afternoon count.
LANES, CAPACITY = {"economy": 3, "promo": 2}, {"economy": 1900, "standard": 1200, "promo": 900}
STATIONS = [("north", "^small", 900, 700), ("south", "ring$", 600, 800), ("east", "bolt|nut", 400, 300), ("west", "^large", 1000, 1100)]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.lower("p_type")
    cls = F.when(F.col("p_partkey") % 5 == 0, F.concat(cls, F.lit("_link"))).otherwise(cls)
    p = _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("road"), F.col("p_name").alias("name"), cls.alias("cls"), (F.col("p_size") % 4).alias("lanes"),
        (F.col("p_partkey") % 3 == 0).alias("oneway"), F.col("p_retailprice").alias("length"),
    )
    return op.with_lanes(p, LANES, CAPACITY)


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads(spark, sf_dir).select("road", "lanes_each", "lane_count", F.round("width", 3).alias("width"), F.round("capacity", 3).alias("capacity"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.peak_volumes(op.station_roads(roads(spark, sf_dir), STATIONS), ("promo_gap", "economy", "standard"))
    return out.select("cls", *(F.round(c, 5).alias(c) for c in ("vph", "pm_vph", "ref_lanes")), "stations", "interpolated")


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    n = e.groupBy(F.col("event_type").alias("cls"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    ref = e.groupBy(F.col("event_type").alias("cls")).agg(F.sum("value").alias("vph"), (F.sum("value") * 0.8).alias("pm_vph"))
    return op.flow_curve(n, ref).withColumn("flow", F.round("flow", 3))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return p.select(F.col("id").alias("road"), (F.col("id") % 40).alias("way"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.round(F.col("x") + F.col("z"), 6).alias("x2"), F.round(F.col("y") - F.col("z") / 2, 6).alias("y2"))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road ends on whole thousands, so that the text of a number is the same everywhere."""
    p = _t(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 50).alias("way"), *((F.col("p_size") % k).cast("double").alias(n) for n, k in (("x1", 3), ("y1", 5), ("x2", 4), ("y2", 7)))
    )
    return op.identities(p).select("way", "road_id", "uses").distinct()


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tile_cover(segments(spark, sf_dir), 0.7)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return op.unsettled_nodes(li.select(F.col("l_orderkey").alias("node"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y")))


def plan_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("road"), F.col("l_quantity").alias("cap"), F.col("l_linenumber").alias("removed"))
    return op.overrides(roads(spark, sf_dir), s.where("removed = 1 and cap < 20"))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return op.fleet_counts(e.select(F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("vehicle_type"), F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")).alias("speed"), (F.col("user_id") % 3 == 0).alias("detoured")))


def check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    prof = e.groupBy(F.col("user_id").alias("road")).agg(F.max("value").alias("kmh"))
    out = op.speed_check(e.select(F.col("user_id").alias("road"), F.col("value").alias("speed")), prof, 5)
    return out.select("roads", *(F.round(c, 5).alias(c) for c in ("sim", "observed", "diff")))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the events as runs."""
    runs = _t(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("seed")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("worst"))
    return op.seed_ranges(runs, ["n", "worst"], "n")


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in miles an hour that move, in kilometres."""
    e = _t(spark, sf_dir, "events").withColumn("kmh", F.col("value") * 1.609344)
    return e.where(F.col("kmh").between(3, 160)).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("kmh"), 2).alias("kmh"))


def share_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    out = scenarios.inside_share(p.where("id % 2 = 0"), p.where("z > 1"), 0.1)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


CLS = "case when p_partkey % 5 = 0 then lower(p_type) || '_link' else lower(p_type) end"
EACH = f"(case when p_size % 4 > 0 then cast(p_size % 4 as double) else cast(case {CLS} when 'economy' then 3 when 'promo' then 2 else 1 end as double) end)"
R = f"r as (select p_partkey as road, p_name as name, {CLS} as cls, p_retailprice as length, {EACH} as each, p_partkey % 3 = 0 as oneway, case lower(p_type) when 'economy' then 1900 when 'standard' then 1200 when 'promo' then 900 else 500 end * case when p_partkey % 5 = 0 then 0.8 else 1.0 end as per from part)"
S = f"s(label, pat, am, pm) as (values {', '.join(f'({a!r}, {b!r}, {c}.0::double, {d}.0::double)' for a, b, c, d in STATIONS)})"
QUERIES = {
    "roads_lanes": lanes, "roads_peak_volumes": volumes, "roads_flow_curve": curve, "roads_identity": identity, "roads_tile_cover": tiles, "roads_unsettled_nodes": nodes,
    "roads_overrides": plan_overrides, "fleet_counts": fleet, "fleet_speed_check": check, "runs_seed_ranges": seeds, "speeds_moving": moving, "network_share_inside": share_inside,
}
ORACLES = {
    "roads_lanes": f"with {R} select road, each as lanes_each, cast(greatest(1, round_even(each, 0)) as int) as lane_count, round(greatest(1, round_even(each, 0)) * case when oneway then 1 else 2 end * 3.2, 3) as width, round(each * per, 3) as capacity from r",
    "roads_peak_volumes": f"""with {R}, {S}, m as (select label, am, pm, road, cls, each, length from r, s where regexp_matches(name, pat, 'i')), t as (select label, cls, sum(length) as len from m group by 1, 2),
 mc as (select label, cls from (select *, row_number() over (partition by label order by len desc, cls) as k from t) where k = 1), o as (select m.* from m join mc using (label, cls)),
 v as (select cls, median(am) as vph, median(pm) as pm_vph, count(*) as stations from (select distinct cls, label, am, pm from o) group by 1), l as (select cls, median(each) as ref_lanes from o group by 1),
 c as (select cls, vph, pm_vph, ref_lanes, stations, false as interpolated from v join l using (cls)),
 g as (select sqrt(max(case when cls = 'economy' then vph end) * max(case when cls = 'standard' then vph end)) as vph, sqrt(max(case when cls = 'economy' then pm_vph end) * max(case when cls = 'standard' then pm_vph end)) as pm_vph from c)
 select cls, round(vph, 5) as vph, round(pm_vph, 5) as pm_vph, round(ref_lanes, 5) as ref_lanes, stations, interpolated from c union all select 'promo_gap', round(vph, 5), round(pm_vph, 5), 1.0, 0, true from g where vph is not null""",
    "roads_flow_curve": """with n as (select event_type as cls, hour(ts) as hour, count(*) as n from events group by 1, 2), ref as (select event_type as cls, sum(value) as vph, sum(value) * 0.8 as pm from events group by 1),
 a as (select cls, max(case when hour = 9 then n end) as top, (coalesce(max(case when hour = 15 then n end), 0) + coalesce(max(case when hour = 16 then n end), 0)) / 2.0 as late from n group by 1),
 j as (select ref.cls, cast(h.range as int) as hour, vph, coalesce(n.n, 0) / top as shape, case when late > 0 then pm / vph / (late / top) else 1.0 end as f from ref join a using (cls) cross join range(24) h left join n on n.cls = ref.cls and n.hour = h.range where top > 0)
 select cls, hour, round(vph * shape * case when hour <= 9 then 1 when hour >= 16 then f else 1 + (f - 1) * (hour - 9) / 7.0 end, 3) as flow from j""",
    "roads_identity": """with p as (select p_partkey % 50 as way, p_size % 3 as x1, p_size % 5 as y1, p_size % 4 as x2, p_size % 7 as y2 from part),
 q as (select way, case when (x1, y1) <= (x2, y2) then [x1, y1, x2, y2] else [x2, y2, x1, y1] end as e from p), i as (select way, 'osm-way/' || way || '/segment/' || sha256(array_to_string(list_transform(e, lambda v: v || '.000'), ','))[1:16] as road_id from q)
 select way, road_id, count(*) as uses from i group by 1, 2""",
    "roads_tile_cover": f"""with {P}, s as (select id as road, x as x1, y as y1, round(x + z, 6) as x2, round(y - z / 2, 6) as y2 from p),
 t as (select s.*, cast(a.i as bigint) as tx, cast(b.i as bigint) as ty from s, unnest(range(cast(floor(least(x1, x2) / 0.7) as bigint), cast(floor(greatest(x1, x2) / 0.7) as bigint) + 1)) a(i), unnest(range(cast(floor(least(y1, y2) / 0.7) as bigint), cast(floor(greatest(y1, y2) / 0.7) as bigint) + 1)) b(i)),
 c as (select *, x2 - x1 as dx, tx * 0.7 - x1 as lx, y2 - y1 as dy, ty * 0.7 - y1 as ly from t)
 select road, tx, ty, floor((x1 + x2) / 2 / 0.7) = tx and floor((y1 + y2) / 2 / 0.7) = ty as owner from c
 where greatest(0.0, case when dx > 0 then lx / dx when dx < 0 then (lx + 0.7) / dx else 0 end, case when dy > 0 then ly / dy when dy < 0 then (ly + 0.7) / dy else 0 end) <= least(1.0, case when dx > 0 then (lx + 0.7) / dx when dx < 0 then lx / dx else 1 end, case when dy > 0 then (ly + 0.7) / dy when dy < 0 then ly / dy else 1 end)""",
    "roads_unsettled_nodes": "select l_orderkey as node, count(distinct (l_discount, l_tax)) as positions from lineitem group by 1 having count(distinct (l_discount, l_tax)) > 1",
    "roads_overrides": f"with {R}, p as (select l_partkey as road, min(l_quantity) as cap, sum(l_linenumber) as removed from lineitem where l_linenumber = 1 and l_quantity < 20 group by 1) select road, cap, greatest(0.0, each - coalesce(removed, 0)) as lanes_left, each - coalesce(removed, 0) <= 0 as closed from r left join p using (road)",
    "fleet_counts": "select date_trunc('hour', ts) as ts, event_type as vehicle_type, count(*) as n, count(*) filter (where value < 20) as stopped, count(*) filter (where user_id % 3 = 0) as detoured from events group by 1, 2",
    "fleet_speed_check": "with o as (select user_id, avg(value) as sim, max(value) as kmh, count(*) as n from events group by 1 having count(*) >= 5) select count(*) as roads, round(median(sim), 5) as sim, round(median(kmh), 5) as observed, round(median(sim - kmh), 5) as diff from o",
    "runs_seed_ranges": "with r as (select day(ts) as seed, count(*) as n, round(max(value), 4) as worst from events group by 1), k as (select *, row_number() over (order by n, seed) as k from r) select seed, n, worst, (select min(n) from r) as n_min, (select max(n) from r) as n_max, (select min(worst) from r) as worst_min, (select max(worst) from r) as worst_max from k where k = (select (count(*) + 1) // 2 from r)",
    "speeds_moving": "select event_type, count(*) as n, round(sum(value * 1.609344), 2) as kmh from events where value * 1.609344 between 3 and 160 group by 1",
    "network_share_inside": f"with {P}, b as (select min(x) - 0.1 as x1, max(x) + 0.1 as x2, min(y) - 0.1 as y1, max(y) + 0.1 as y2 from p where z > 1) select round(x1, 6) as x1, round(x2, 6) as x2, round(y1, 6) as y1, round(y2, 6) as y2, round(avg(case when x between x1 and x2 and y between y1 and y2 then 1 else 0 end), 6) as share from p, b where id % 2 = 0 group by x1, x2, y1, y2",
}
