"""Queries of the learned forecaster, cross-validation, table functions and saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.functions import tables
from cityweave.operators import boosting
from cityweave.operators import learned as op
from cityweave.operators import panel as panels
from cityweave.operators.iterate import new_path
from cityweave.plans import panel
from cityweave.plans.more import P
from cityweave.plans.spatial import points
from cityweave.sources import store

WEIGHTS = {"l_quantity": 0.05, "l_discount": -4.0, "l_tax": 3.0}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Panel rows with the events and the mean value that an object had up to the start of the interval."""
    ev = _t(spark, sf_dir, "events")
    wave = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int")
    seen = ev.groupBy(F.col("user_id").alias("object_id"), wave.alias("start_year")).agg(F.count("*").alias("events"), F.avg(F.when(F.col("value") < 60, F.col("value"))).alias("mean_value"))
    rows = panel.panel(spark, sf_dir).join(seen, ["object_id", "start_year"], "left")
    return panels.select_interval(rows, 0, 1), panels.select_interval(rows, 1, 2)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    past, future = _intervals(spark, sf_dir)
    rows, chosen = op.benchmark(past, future, panel.LABELS, op.Forest(["events", "mean_value"], ["current_state"]))
    return rows.withColumn("chosen", F.col("model") == chosen)


def refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transition matrix refitted on both intervals."""
    past, future = _intervals(spark, sf_dir)
    return op.refitted(past, future, panel.LABELS, "markov", None).withColumn("p", F.round("p", 9))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    out = op.scored_by(li, WEIGHTS, -1.0, "line").groupBy(F.floor(F.col("score") * 20).alias("bin"))
    return out.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of two models of z over blocks of half a unit."""
    fold = F.pmod(F.floor(F.col("x") * 2) + 3 * F.floor(F.col("y") * 2), F.lit(4)).cast("int")
    out = op.cross_validated(points(spark, sf_dir).select("x", F.col("z").alias("value"), fold.alias("fold")), 4, {"constant": [], "slope": ["x"]})
    return out.select("model", "fold", "n", F.round("mae", 5).alias("mae"), F.round("bias", 5).alias("bias"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    at = lambda i: F.struct((F.col("x") + i).alias("x"), (F.col("y") + i / 2).alias("y"))
    lines = points(spark, sf_dir).select("id", F.array(at(0), at(1), at(2)).alias("line"))
    out = spark.sql("select id, u.k, u.x1, u.y1, u.x2, u.y2 from {lines}, lateral line_units(line, 5) u", lines=lines)
    return out.select("id", "k", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    boxes = points(spark, sf_dir).select("id", "x", "y", F.abs("z").alias("w"))
    out = spark.sql("select t.col, t.row from {boxes}, lateral box_tiles(x, y, x + w, y + 0.3D, 0.25D) t", boxes=boxes)
    return out.groupBy("col", "row").agg(F.count("*").alias("n"))


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(tables.trimmed_mean("l_quantity"), 6).alias("mean"))


def simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a line over its positions."""
    line = F.transform("embedding", lambda v, i: F.struct(i.cast("double").alias("x"), (v.cast("double") * 10).alias("y")))
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), line.alias("line"))
    out = e.withColumn("kept", tables.simplified(1.5)("line"))
    return out.select("id", F.size("line").alias("points"), F.size("kept").alias("kept"), F.array_join(F.transform("kept", lambda p: p["x"].cast("int").cast("string")), ",").alias("at"))


def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written as CSV, read again under its schema, and counted."""
    p = panel.panel(spark, sf_dir).select("object_id", "start_year", "target_year", "current_state", "target_state")
    path = new_path(spark, "panel-csv")
    store.write_csv(p, path)
    back = store.read_csv(spark, path, "object_id long, start_year int, target_year int, current_state string, target_state string")
    return panels.transition_counts(back).select("current_state", "target_state", "n")


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their sales saved as one tagged model, loaded and joined."""
    path = new_path(spark, "model")
    sales = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    store.save_model({"roads": _t(spark, sf_dir, "part").select("p_partkey", "p_type"), "profile": sales}, path, "roads/1")
    m = store.load_model(spark, path, "roads/1")
    return m["roads"].join(m["profile"], F.col("p_partkey") == F.col("l_partkey")).groupBy("p_type").agg(F.round(F.sum("quantity"), 3).alias("quantity"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a tenth of a unit saved by tiles, and those of a box loaded."""
    p = points(spark, sf_dir)
    cells = p.groupBy(F.floor(F.col("x") * 10).alias("col"), F.floor(F.col("y") * -10).alias("row")).agg(F.round(F.max("z"), 3).alias("z"))
    path = new_path(spark, "grid")
    store.save_grid(cells, path, "EPSG:32636", 0.0, 0.0, 0.1, "points")
    back, _ = store.load_grid(spark, path, "EPSG:32636", (-0.55, -0.75, 0.95, 1.05))
    return back.select("row", "col", F.round("z", 3).alias("z"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "snapshot")
    store.save_snapshot(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), F.col("p_brand").alias("sector"), "p_size"), path, "2024")
    return store.load_snapshot(spark, path, "2024").groupBy("sector").agg(F.count("*").alias("objects"), F.sum("p_size").cast("long").alias("floors"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval of a panel stored by interval."""
    path = new_path(spark, "panel")
    store.write_panel(panel.panel(spark, sf_dir), path)
    back = spark.read.parquet(path).where("start_year = 1 and target_year = 2")
    return back.groupBy("target_state").agg(F.count("*").alias("n"))


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth record by class, as the operator is meant to."""
    e = _t(spark, sf_dir, "events")
    return store.class_sample(e.select(F.col("event_id").alias("record_index"), F.col("event_type").alias("class")), 10)


def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines exported as GeoJSON and read again."""
    at = lambda i: F.struct((F.col("x") + i).alias("x"), F.col("y").alias("y"))
    text = store.geojson_lines(points(spark, sf_dir).select("id", F.array(at(0), at(1)).alias("line")), "line", ["id"])
    got = F.from_json("value", "type string, geometry struct<type: string, coordinates: array<array<double>>>, properties struct<id: long>")
    return text.select(got.alias("f")).select("f.properties.id", "f.geometry.type", F.col("f.geometry.coordinates")[1][0].alias("x2"), F.col("f.geometry.coordinates")[1][1].alias("y2"))


WAVES = """s as (select user_id as object_id, cast(least(floor((day(ts) - 1) / 10.0), 2) as int) as wave, arg_max(event_type, (ts, event_id)) as raw from events group by 1, 2),
 w as (select object_id, wave, case raw when 'view' then 'planned' when 'click' then 'active' when 'purchase' then 'complete' when 'error' then 'stalled' else 'unknown' end as state from s),
 pan as (select a.state as c, b.state as t, a.wave as s, b.wave as e, b.wave - a.wave as years from w a join w b on a.object_id = b.object_id and b.wave > a.wave)"""
def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees fitted on the first interval of the panel tell the states after the second: by state, how many objects, how many
    told rightly, and the mean chance given to it."""
    past, future = _intervals(spark, sf_dir)
    place = lambda c: F.array_position(F.array(*map(F.lit, panel.LABELS)), F.col(c)) - 1
    shaped = lambda df: df.select(F.col("object_id").alias("id"), F.array(place("current_state").cast("double"), F.col("events").cast("double"), "mean_value").alias("x"), place("target_state").cast("int").alias("y"), "target_state")
    model = boosting.fit(shaped(past), 3, len(panel.LABELS), rounds=3, depth=2, rate=0.3, least=5)
    out = boosting.predicted(shaped(future), model)
    told = F.array_position("p", F.array_max("p")) - 1
    out = out.groupBy("target_state").agg(F.count("*").alias("n"), F.count_if(told == F.col("y")).alias("right"), F.avg(F.get("p", F.col("y"))).alias("chance"))
    return out.withColumn("chance", F.round("chance", 6))


QUERIES = {
    "forecast_learned_benchmark": benchmark, "forecast_boosted_states": boosted, "forecast_refitted": refit, "scored_by_model": scores, "cross_validated_models": folds, "line_units": units, "box_tiles_udtf": tiles,
    "trimmed_means": trimmed, "lines_simplified": simplified, "store_csv": csv, "store_model": model, "store_grid": grid, "store_snapshot": snapshot, "store_intervals": intervals, "store_class_sample": sample, "export_geojson": geojson,
}
ORACLES = {
    "forecast_refitted": f"""with {WAVES}, l(k) as (values {', '.join(f"('{x}')" for x in panel.LABELS)}), n as (select c, t, count(*) as n from pan where years = 1 group by 1, 2)
 select 1 as interval_years, a.k as current_state, b.k as target_state, round((coalesce(n.n, 0) + {panels.SMOOTHING}) / sum(coalesce(n.n, 0) + {panels.SMOOTHING}) over (partition by a.k), 9) as p
 from l a cross join l b left join n on n.c = a.k and n.t = b.k""",
    "scored_by_model": """with s as (select 1 / (1 + exp(-(l_quantity * 0.05::double - 4.0::double * l_discount + 3.0::double * l_tax - 1))) as score from lineitem)
 select cast(floor(score * 20) as bigint) as bin, count(*) as n, round(avg(score), 6) as mean from s group by 1""",
    "cross_validated_models": f"""with {P}, f as (select x, z, cast(((floor(x * 2) + 3 * floor(y * 2)) % 4 + 4) % 4 as int) as fold from p),
 m as (select a.fold, avg(b.z) as c, regr_slope(b.z, b.x) as s, regr_intercept(b.z, b.x) as i from (select distinct fold from f) a join f b on a.fold <> b.fold group by 1),
 e as (select 'constant' as model, fold, c - z as e from f join m using (fold) union all select 'slope', fold, i + s * x - z from f join m using (fold))
 select model, fold, count(*) as n, round(avg(abs(e)), 5) as mae, round(avg(e), 5) as bias from e group by 1, 2""",
    "line_units": f"""with {P} select id, cast(k.range as int) as k, round(x + 2 * k.range / 5::double, 6) as x1, round(y + k.range / 5::double, 6) as y1, round(x + 2 * (k.range + 1) / 5::double, 6) as x2,
 round(y + (k.range + 1) / 5::double, 6) as y2 from p, range(5) k""",
    "box_tiles_udtf": f"""with {P}, c as (select id, unnest(generate_series(cast(floor(x / 0.25) as bigint), cast(floor((x + abs(z)) / 0.25) as bigint))) as col, y from p),
 r as (select col, unnest(generate_series(cast(floor(y / 0.25) as bigint), cast(floor((y + 0.3::double) / 0.25) as bigint))) as row from c) select col, row, count(*) as n from r group by 1, 2""",
    "trimmed_means": """with r as (select l_partkey, l_quantity as v, row_number() over (partition by l_partkey order by l_quantity) as i, count(*) over (partition by l_partkey) as n from lineitem)
 select l_partkey, round(avg(v), 6) as mean from r where i > n // 10 and i <= n - n // 10 group by 1""",
    "store_csv": f"with {WAVES} select c as current_state, t as target_state, count(*) as n from pan group by 1, 2",
    "store_grid": f"with {P} select cast(floor(y * -10) as int) as row, cast(floor(x * 10) as int) as col, round(max(z), 3) as z from p group by 1, 2 having row between -11 and 7 and col between -6 and 9",
    "store_snapshot": "select p_brand as sector, count(*) as objects, cast(sum(p_size) as bigint) as floors from part group by 1",
    "store_model": "select p_type, round(sum(l_quantity), 3) as quantity from lineitem join part on p_partkey = l_partkey group by 1",
    "store_intervals": f"with {WAVES} select t as target_state, count(*) as n from pan where s = 1 and e = 2 group by 1",
    "store_class_sample": "select event_type as class, count(*) as n from events where event_id % 10 = 0 group by 1",
    "export_geojson": f"with {P} select id, 'LineString' as type, round(x + 1, 6) as x2, round(y, 6) as y2 from p",
}
