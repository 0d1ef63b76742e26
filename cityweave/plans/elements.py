"""Queries of tag classes, places, reviews and screened pixels; tags come from the columns of `part` and `events`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.functions import columns as fn
from cityweave.operators import elements as op
from cityweave.operators import panel as panels
from cityweave.operators import rings
from cityweave.plans import panel
from cityweave.plans.spatial import points

#: Values of the tags, taken in turn by a number of the row; '' stands for no tag.
TURNS = {
    "natural": ["tree", "", "bush", "", "", "rock", "fell", "", "", "", ""],
    "landuse": ["", "forest", "", "grass", "retail", "", ""],
    "barrier": ["", "", "", "hedge", ""],
    "leisure": ["", "park", "", "nature_reserve", "", "pitch", "", ""],
    "landcover": ["", "", "", "", "", "", "", "", "flowers", "", "", "", ""],
    "surface": ["asphalt", "grass", ""],
    "highway": ["", "residential", "motorway", "", "bus_stop", ""],
    "genus": ["", "", "", "", "pinus", "", "", "", ""],
    "height": ["", "7.5", "4 m", "tall", "0", "", "250"],
    "amenity": ["", "cafe", "school", "", "place_of_worship", "", "", "bench"],
    "shop": ["", "", "", "bakery", "", "", ""],
    "office": ["", "", "", "", "", "", "government", "", "", "lawyer", ""],
    "foot": ["", "", "", "no"],
    "crossing": ["zebra", "", "informal", "marked", ""],
    "crossing:markings": ["", "no", "yes"],
    "power": ["", "", "", "", "", "", "", "line", "", ""],
    "man_made": ["", "", "pier", "", "mast", "", "", "", ""],
    "seamark:type": ["", "", "", "", "", "", "", "", "", "", "", "", "buoy"],
}
RULES = [("pier", "man_made", ("pier", "quay")), ("power", "power", None), ("mast", "man_made", ("mast", "tower"))]
LICENSES = ["odbl", "cdla"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, tags) of all parts."""
    turn = lambda vs: F.get(F.array(*map(F.lit, vs)), F.pmod("p_partkey", F.lit(len(vs))).cast("int"))
    entries = F.array(*(F.struct(F.lit(k).alias("k"), turn(vs).alias("v")) for k, vs in TURNS.items()))
    tags = F.map_from_entries(F.filter(entries, lambda e: e.v != ""))
    kind = F.when(F.col("p_size") % 2 == 0, "way").otherwise("node")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("type"), tags.alias("tags"))


def greenery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.greenery(tagged(spark, sf_dir)).select("id", "kind")


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.with_heights(tagged(spark, sf_dir).withColumn("kind", op.vegetation_kind()).where("kind is not null"))
    return out.select("id", "kind", "height_m", "height_source")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.walk_layers(tagged(spark, sf_dir)).drop("type", "tags")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.inventory(tagged(spark, sf_dir), op.tag_category(RULES, {"seamark:": "harbour"}))


def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("id") % 3 > 0, "crossing").otherwise("stop")
    return tagged(spark, sf_dir).withColumn("kind", kind).select("id", op.is_painted().alias("painted"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places: points but for every fifth, categories in two places, two sources each."""
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = lambda test, value: F.when(test, value)
    one = lambda name: F.struct(name.alias("primary"))
    source = lambda n, d: F.struct(F.concat(F.lit(d), (n % 3).cast("string")).alias("dataset"), F.get(F.array(*map(F.lit, LICENSES)), (n % 2).cast("int")).alias("license"))
    return c.select(
        k.cast("string").alias("id"),
        F.struct(F.when(k % 5 == 0, "Polygon").otherwise("Point").alias("type"), F.array((k % 360) / 7, F.col("c_acctbal") / 1000).alias("coordinates")).alias("geometry"),
        F.struct(
            text(k % 2 == 0, F.col("c_name")).alias("id"), F.when(k % 11 > 0, (k % 100) / 99).alias("confidence"), one(F.col("c_name")).alias("names"),
            one(text(k % 3 == 0, F.col("c_mktsegment"))).alias("taxonomy"), one(text(k % 4 < 2, F.lower("c_mktsegment"))).alias("categories"),
            F.array(source(k, "a"), source(F.col("c_nationkey"), "a")).alias("sources"),
        ).alias("properties"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.places(features(spark, sf_dir), 0.25)


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.provider_counts(features(spark, sf_dir))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviews of suppliers, with digests of orders."""
    e = _t(spark, sf_dir, "events")
    edge = lambda n: (F.col("event_id") % n) / 20.0
    box = F.array(edge(7), edge(5), 0.3 + edge(11), 0.2 + edge(17))
    r = e.select(
        F.col("event_id").alias("seq"), (F.col("user_id") * 3 % 280).alias("id"), (F.col("event_id") % 20000).alias("photo"),
        F.md5(F.when(F.col("event_id") % 13 > 0, F.col("event_id") % 20000).cast("string")).alias("sha256"), F.when(F.col("event_type") != "error", F.col("ts")).alias("captured"), box.alias("box"),
    )
    records = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    files = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("photo"), F.md5(F.col("o_orderkey").cast("string")).alias("sha256"))
    return op.admitted_reviews(r, records, files).select("seq", "issue")


def roofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    px = li.select(F.col("l_partkey").alias("building"), (F.col("l_quantity") * 5).cast("int").alias("r"), (F.col("l_linenumber") * 36).cast("int").alias("g"),
                   (F.col("l_orderkey") % 256).cast("int").alias("b"), (F.col("l_tax") > 0.01).alias("valid"))
    return op.roof_colours(px, least=12)


def forecast_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wave 1 with the forecasts made for the objects that have a wave 0."""
    w = panel.waves(spark, sf_dir).select("object_id", "wave", "state")
    fit = panels.transition_matrix(panel.panel(spark, sf_dir), panel.LABELS)
    p = panels.predict(w.where("wave = 0").select("object_id", F.col("state").alias("current_state"), F.lit(1).alias("interval_years")), fit)
    out = op.forecast_on(w.where("wave = 1").select("object_id", "state"), p.where("object_id % 7 > 0"), panel.LABELS)
    each = [F.round(F.get("p", F.lit(i)), 9).alias(f"p_{k}") for i, k in enumerate(panel.LABELS)]
    return out.select("object_id", "state", *each)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    o = _t(spark, sf_dir, "orders")
    by = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v")).where("v > 350000")
    out = op.reference_status(refs, [("verified", by("F")), ("listed", by("O")), ("exported", by("P"))], "reference only")
    return out.groupBy("kind", "status").agg(F.count("*").alias("n"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderpriority")
    return op.enriched(c, o, "c_custkey")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ordered_transitions(panels.transition_counts(panel.panel(spark, sf_dir))).select("current_state", "target_state", "n")


def _starts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _t(spark, sf_dir, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("area"), "p_type", F.col("p_size").alias("width"), F.col("p_retailprice").alias("length"))
    rules: list[tuple[str, Column]] = [("class", F.col("p_type") == "ECONOMY"), ("narrow", F.col("width") < 12), ("short", F.col("length") < 950), ("conflict", F.col("id") % 4 == 0)]
    return op.best_starts(c, rules, [F.desc("width"), F.desc("length")])


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _starts(spark, sf_dir)[0].select("area", "id", "width", "length")


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _starts(spark, sf_dir)[1]


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as buildings, suppliers' balances as their morphology."""
    p, n = _t(spark, sf_dir, "part"), F.col("p_partkey")
    o = p.select(
        n.alias("object_id"), F.when(n % 4 > 0, F.lower("p_type")).alias("state"), F.when(n % 3 > 0, F.col("p_size") - 10.0).alias("area"), (F.col("p_retailprice") / 10).alias("shape_area"),
        (2018 + F.col("p_size") % 9).alias("permit_year"), F.when(n % 5 > 0, (2019 + n % 9).cast("int")).alias("completed_year"))
    m = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("object_id"), F.col("s_acctbal").alias("lidar_height"))
    out = panels.snapshot(o, m, 2023)
    return out.withColumns({"area": F.round("area", 4), "sources": F.array_join("sources", ",")})


def multipolygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of two half lines, the second drawn backwards, with a square hole; every third lacks a half."""
    p = points(spark, sf_dir).where("id % 10 = 0")
    half = 0.4 + (F.col("id") % 7) * 0.01
    at = lambda h, *ij: F.array(*(F.struct((F.col("x") + i * h).alias("x"), (F.col("y") + j * h).alias("y")) for i, j in ij))
    part = lambda k, role, pts: F.struct(F.lit(k).alias("seq"), F.lit(role).alias("role"), pts.alias("points"))
    first, second = at(half, (-1, -1), (1, -1), (1, 1)), at(half, (-1, -1), (-1, 1), (1, 1))
    hole = at(F.lit(0.05), (-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    every = F.array(part(0, "outer", first), part(1, None, second), part(2, "inner", hole), part(3, "label", F.lit(None)))
    some = F.when(F.col("id") % 30 == 0, F.filter(every, lambda m: m["seq"] != 1)).otherwise(every)
    members = p.select(F.col("id").alias("relation"), F.explode(some).alias("m")).select("relation", "m.*")
    return rings.multipolygons(members).select("relation", "polygon", "hole", F.round(fn.ring_area(F.col("ring")), 5).alias("area"))


def _case(key: str, table: dict) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def _name(key: str) -> str:
    return key.replace(":", "_")


_TAGS = ", ".join(f"nullif(([{', '.join(repr(v) for v in vs)}])[1 + p_partkey % {len(vs)}], '') as {_name(k)}" for k, vs in TURNS.items())
_QUOTED = lambda vs: "(" + ", ".join(f"'{v}'" for v in vs) + ")"
T = f"t as (select p_partkey as id, case when p_size % 2 = 0 then 'way' else 'node' end as type, {_TAGS} from part)"
VEG = f"""v as (select *, coalesce({_case('"natural"', op.NATURAL)}, case when barrier in ('hedge', 'hedge_bank') then 'hedge' end, case when man_made = 'planter' then 'planter' end,
 {_case('landcover', op.LANDCOVER)}, {_case('landuse', op.LANDUSE)}, case when leisure in ('park', 'garden') then leisure when leisure = 'nature_reserve' then 'greenery' end,
 case when surface in ('grass', 'grass_paver') and highway is null then surface end) as kind from t)"""
T = T.replace(" as natural", ' as "natural"')
ROAD = "(type = 'way' and highway is not null)"
JOB = f"""case when {ROAD} then null when office = 'government' then 'government' when office is not null then 'office'
 when amenity in ('school', 'university', 'college', 'hospital') then amenity when shop is not null then 'shop' when amenity in {_QUOTED(op.SERVICES)} then 'service' end"""
FT = """f as (select c_custkey as k, c_custkey::varchar as id, case when c_custkey % 5 = 0 then 'Polygon' else 'Point' end as gt, (c_custkey % 360) / 7 as lon, c_acctbal / 1000 as lat,
 case when c_custkey % 2 = 0 then c_name end as pid, case when c_custkey % 11 > 0 then (c_custkey % 100) / 99 end as conf, c_name,
 coalesce(case when c_custkey % 3 = 0 then c_mktsegment end, case when c_custkey % 4 < 2 then lower(c_mktsegment) end) as cat, c_nationkey as nk from customer)"""
WAVES = """s as (select user_id as object_id, cast(least(floor((day(ts) - 1) / 10.0), 2) as int) as wave, arg_max(event_type, (ts, event_id)) as raw from events group by 1, 2),
 w as (select object_id, wave, case raw when 'view' then 'planned' when 'click' then 'active' when 'purchase' then 'complete' when 'error' then 'stalled' else 'unknown' end as state from s),
 pan as (select a.object_id, a.state as c, b.state as t, b.wave - a.wave as years from w a join w b on a.object_id = b.object_id and b.wave > a.wave)"""
_ST = """c as (select p_partkey as id, p_brand as area, p_size as width, p_retailprice as length, case when p_type = 'ECONOMY' then 'class' when p_size < 12 then 'narrow'
 when p_retailprice < 950 then 'short' when p_partkey % 4 = 0 then 'conflict' end as reason from part)"""
_LABEL = ", ".join(f"('{x}')" for x in panel.LABELS)
QUERIES = {
    "elements_greenery": greenery, "elements_heights": heights, "elements_walk_layers": layers, "elements_categories": categories, "elements_painted_crossings": painted,
    "places_allowlisted": places, "places_providers": providers, "reviews_admitted": reviews, "roof_colours": roofs, "forecast_on_snapshot": forecast_on,
    "references_status": status, "places_enriched": enriched, "panel_transitions_ordered": transitions, "starts_best": starts, "starts_excluded": excluded,
    "panel_snapshot": snapshot, "rings_multipolygons": multipolygons,
}
ORACLES = {
    "elements_greenery": f"with {T}, {VEG} select type || '/' || id as id, kind from v where kind is not null or genus is not null",
    "elements_heights": f"""with {T}, {VEG}, h as (select *, try_cast(nullif(regexp_extract(coalesce(height, ''), '^\\s*(\\d+(?:\\.\\d+)?)\\s*m?\\s*$', 1), '') as double) as hh from v where kind is not null),
 k as (select id, kind, case when hh > 0 and hh <= 100 then hh end as said, case kind when 'tree' then 6.0 when 'shrub' then 1.2 when 'tree_stump' then 0.4 when 'hedge' then 1.5 when 'planter' then 0.6 end::double as usual from h)
 select id, kind, coalesce(said, usual) as height_m, case when said is not null then 'tag' when usual is not null then 'default' end as height_source from k""",
    "elements_walk_layers": f"""with {T}, a as (select *, {JOB} as job_kind, {ROAD} as road from t) select id,
 road and not (highway in {_QUOTED(op.NOT_WALKABLE)} or coalesce(foot = 'no', false)) as walkable, coalesce(not road and highway = 'bus_stop', false) as bus_stop,
 coalesce(not road and leisure in ('park', 'garden'), false) as park, coalesce(not road and amenity = 'place_of_worship', false) as worship,
 not road and (shop is not null or coalesce(amenity in {_QUOTED(op.SERVICES)}, false)) as amenity, job_kind,
 case job_kind {' '.join(f"when '{k}' then {v}" for k, v in op.JOBS.items())} end as jobs from a""",
    "elements_categories": f"""with {T}, c as (select case when man_made in ('pier', 'quay') then 'pier' when power is not null then 'power' when man_made in ('mast', 'tower') then 'mast'
 when seamark_type is not null then 'harbour' end as category from t) select category, count(*) as n from c where category is not null group by 1""",
    "elements_painted_crossings": f"""with {T}, c as (select id, coalesce(crossing, '') as s, coalesce(crossing_markings, '') as m from t)
 select id, id % 3 > 0 and m <> 'no' and s not in ('no', 'unmarked', 'informal') and (m <> '' or s in {_QUOTED(op.PAINTED)}) as painted from c""",
    "places_allowlisted": f"""with {FT} select coalesce(pid, id) as id, c_name as name, cat as category, round(conf, 3) as confidence, round(lon, 7) as lon, round(lat, 7) as lat from f
 where gt = 'Point' and cat is not null and conf >= 0.25""",
    "places_providers": """with s as (select distinct c_custkey, unnest([c_custkey, c_nationkey]) as n from customer), d as (select distinct c_custkey, 'a' || (n % 3) as dataset, case when n % 2 = 0 then 'odbl' else 'cdla' end as license from s)
 select dataset, license, count(*) as n from d group by 1, 2""",
    "reviews_admitted": """with r as (select event_id as seq, user_id * 3 % 280 as id, event_id % 20000 as photo, md5(case when event_id % 13 > 0 then event_id % 20000 end::varchar) as sha, event_type = 'error' as undated,
 event_id % 7 / 20.0::double as a, event_id % 5 / 20.0::double as b, 0.3::double + event_id % 11 / 20.0::double as c, 0.2::double + event_id % 17 / 20.0::double as d, min(event_id) over (partition by user_id * 3 % 280) as first from events)
 select seq, case when s_suppkey is null then 'unknown' when seq <> first then 'duplicate' when undated then 'undated' when not (a < c and c <= 1 and b < d and d <= 1) then 'box'
 when o_orderkey is null or sha is null or sha <> md5(o_orderkey::varchar) then 'changed' end as issue from r left join supplier on id = s_suppkey left join orders on photo = o_orderkey""",
    "roof_colours": """with x as (select l_partkey as building, cast(l_quantity * 5 as int) as r, l_linenumber * 36 as g, cast(l_orderkey % 256 as int) as b, l_tax > 0.01 as valid from lineitem),
 k as (select *, valid and greatest(r, g, b) > 45 and greatest(r, g, b) < 250 and not (g > r * 1.15 and g > b * 1.1) as keep from x),
 s as (select building, count(*) filter (where valid) as valid, count(*) filter (where keep) as kept, quantile_cont(r::double, 0.5) filter (where keep) as mr, quantile_cont(g::double, 0.5) filter (where keep) as mg,
 quantile_cont(b::double, 0.5) filter (where keep) as mb from k group by 1),
 t as (select *, case when valid < 12 then 'too few valid' when kept < 12 or kept < valid * 0.4 then 'too few kept' else 'candidate' end as status from s)
 select building, valid, kept, status, case when status = 'candidate' then cast(round_even(mr, 0) as int) end as r, case when status = 'candidate' then cast(round_even(mg, 0) as int) end as g,
 case when status = 'candidate' then cast(round_even(mb, 0) as int) end as b from t""",
    "forecast_on_snapshot": f"""with {WAVES}, l(k) as (values {_LABEL}), n as (select c, t, count(*) as n from pan where years = 1 group by 1, 2),
 m as (select a.k as c, b.k as t, (coalesce(n.n, 0) + {panels.SMOOTHING}) / sum(coalesce(n.n, 0) + {panels.SMOOTHING}) over (partition by a.k) as p from l a cross join l b left join n on n.c = a.k and n.t = b.k)
 select w1.object_id, w1.state, {', '.join(f"round(max(m.p) filter (where m.t = '{x}'), 9) as p_{x}" for x in panel.LABELS)}
 from w w1 left join w w0 on w0.object_id = w1.object_id and w0.wave = 0 and w0.object_id % 7 > 0 left join m on m.c = w0.state where w1.wave = 1 group by 1, 2""",
    "references_status": """with o as (select distinct o_custkey as id, o_orderstatus as s from orders where o_totalprice > 350000), m as (select id, bool_or(s = 'F') as f, bool_or(s = 'O') as o, bool_or(s = 'P') as p from o group by 1)
 select c_mktsegment as kind, case when f then 'verified' when o then 'listed' when p then 'exported' else 'reference only' end as status, count(*) as n from customer left join m on id = c_custkey group by 1, 2""",
    "places_enriched": """with o as (select o_custkey, o_totalprice, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderpriority desc) = 1)
 select c_custkey, c_nationkey, o_totalprice, o_orderpriority from customer left join o on o_custkey = c_custkey""",
    "panel_transitions_ordered": f"with {WAVES} select c as current_state, t as target_state, count(*) as n from pan group by 1, 2",
    "starts_best": f"with {_ST} select area, id, width, length from c where reason is null qualify row_number() over (partition by area order by width desc, length desc, id) = 1",
    "starts_excluded": f"with {_ST} select area, reason, count(*) as n from c where reason is not null group by 1, 2",
    "panel_snapshot": """with o as (select p_partkey as object_id, case when p_partkey % 4 > 0 then lower(p_type) end as state, case when p_partkey % 3 > 0 and p_size >= 10 then p_size - 10.0 end::double as area, p_retailprice / 10 as shape,
 2018 + p_size % 9 as py, case when p_partkey % 5 > 0 then cast(2019 + p_partkey % 9 as int) end as cy from part)
 select object_id, coalesce(state, 'unknown') as state, round(coalesce(area, shape), 4) as area, py <= 2023 as permit_known, coalesce(cy <= 2023, false) as completion_known, case when py <= 2023 then 2023 - py end as years_since_permit,
 case when cy <= 2023 then 2023 - cy end as years_since_completion, s_suppkey is not null as lidar_available, s_acctbal as lidar_height,
 case when area is null then 'area:shape' else 'area:stated' end || case when state is null then ',state:unknown' else ',state:table' end || case when s_suppkey is null then '' else ',morphology:points' end as sources
 from o left join supplier on s_suppkey * 3 = object_id""",
    "rings_multipolygons": """select vec_id as relation, 0::int as polygon, h as hole, round(case when h then 0.01 else 4 * (0.4::double + vec_id % 7 * 0.01::double) ** 2 end, 5) as area
 from embeddings, (values (false), (true)) t(h) where vec_id % 10 = 0 and vec_id % 30 <> 0""",
}
