"""Queries of lines, areas and screening. Points come from `embeddings`; each odd point starts a segment to (x + 1, y + 0.5);
districts are unit squares that hold a point whose id is divisible by three."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.operators import lines as op
from cityweave.plans.more import P
from cityweave.plans.spatial import points

BOX = (-0.6, -0.6, 0.9, 0.7)
WAYS_BOX = (10.0, 5.0, 12.0, 50.0)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _xy(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).where("id % 2 = 1")
    return p.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 1).alias("x2"), (F.col("y") + 0.5).alias("y2"))


def square(cx, cy, half):
    return F.array(*(_xy(cx + i * half, cy + j * half) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).where("id % 3 = 0").select(F.floor("x").alias("cx"), F.floor("y").alias("cy")).distinct()
    return p.select((F.col("cx") * 1000 + F.col("cy")).alias("id"), square(F.col("cx") + 0.5, F.col("cy") + 0.5, 0.5).alias("ring"))


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares around every tenth point over the cells of 0.25 that points fall in."""
    p = points(spark, sf_dir)
    cells = p.select(F.floor(F.col("y") * 4).alias("row"), F.floor(F.col("x") * 4).alias("col")).distinct()
    out = op.terrain_coverage(cells, 0.25, p.where("id % 10 = 0").select("id", square(F.col("x"), F.col("y"), 0.6).alias("ring")), 0.5)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("area", "terrain", "share")))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lengths_inside(segments(spark, sf_dir), districts(spark, sf_dir), 1.0)


def inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths(spark, sf_dir).where("length > 0.0001").withColumn("length", F.round("length", 5))


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.districts_crossed(lengths(spark, sf_dir).where("length > 0.0001"))
    return out.select("id", F.array_join(F.transform("polygons", lambda v: v.cast("string")), ",").alias("polygons"), "owner")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    out = op.coverage(s, lengths(spark, sf_dir), s.where("id % 4 = 1"))
    return out.select("lines", "exported_lines", *(F.round(c, 4).alias(c) for c in out.columns if not c.endswith("lines")))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return op.snapped_signals(p.where("id % 5 = 0"), p.where("id % 3 = 0"), 0.2)


def parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    w = p.where("id % 2 = 0").select("id", "x", "y", F.cos("z").alias("dx"), F.sin("z").alias("dy"))
    s = p.where("id % 2 = 1").select("id", (F.col("id") % 50).alias("road"), "x", "y", F.cos(2 * F.col("z")).alias("dx"), F.sin(2 * F.col("z")).alias("dy"))
    return op.parallel_roads(w, s, 0.4).withColumn("dist", F.round("dist", 6))


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    at = lambda k: p.where(f"id % 10 = {k}").select("id", square(F.col("x"), F.col("y"), 0.4).alias("ring"))
    return op.labelled_ground(p, at(0), at(5), 0.5).select("id", "ground")


def canopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    c = p.where("id % 2 = 0").select("id", "x", "y", (F.col("z") * 10).alias("height"), (F.col("id") % 6 == 0).alias("on_footprint"))
    water = p.where("id % 7 = 0").select(F.floor(F.col("y") * 2).alias("row"), F.floor(F.col("x") * 2).alias("col"))
    return op.screened(c, water, p.where("id % 2 = 1"), 0.5, -2.0, 0.1).select("id", "reason")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = segments(spark, sf_dir), points(spark, sf_dir)
    model = s.join(p.select("id", (F.col("z") * 20 + 50).alias("speed")), "id").where("id % 9 > 0")
    roads = s.select("id", (F.col("x2") + (F.col("id") % 10) * 0.005).alias("x"), F.col("y2").alias("y"))
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    v = s.select("id", "x1", "y1", k.alias("k")).select("id", (F.col("x1") + F.col("k") * 0.3).alias("x"), F.col("y1").alias("y"))
    g = p.where("id % 3 = 0").groupBy(F.floor(F.col("y") * 2).alias("row"), F.floor(F.col("x") * 2).alias("col")).agg(F.round(F.min("z"), 6).alias("z"))
    return op.annotated(roads, model, v, g, 0.5, 0.0201, -0.5)


def two_points(shift, z):
    at = lambda i: F.struct((F.col("x") + shift + i).alias("x"), (F.col("y") + i / 2).alias("y"), (z + i).alias("z"))
    return F.array(at(0), at(1))


def elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    way = (F.col("id") % 50).alias("way")
    roads = p.select("id", way, two_points(F.lit(0.0), F.lit(0.0)).alias("line"))
    survey = p.select("id", way, two_points((F.col("id") % 7) * 0.02, F.col("z")).alias("line"))
    out = op.transferred_elevations(roads, survey.unionAll(survey.where("id % 11 = 0").withColumn("id", F.col("id") + 10**9)), 0.05)
    return out.select("id", "other", *(F.round(c, 6).alias(c) for c in ("gap", "z1", "z2")))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    lane = lambda shift, width: p.select("id", width.alias("width"), two_points(shift, F.lit(0.0)).alias("line"))
    a = lane(F.lit(0.0), F.lit(3.0)).where("id % 10 < 9")
    b = lane((F.col("id") % 5) * 0.03, 3 + (F.col("id") % 4) * 0.02).where("id % 10 > 0")
    out = op.alignment_issues(a, b.unionAll(b.where("id % 11 = 0")), 0.05)
    return out.select("id", F.array_join("issues", ",").alias("issues"))


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = segments(spark, sf_dir), points(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(4)))
    samples = s.select("id", "x1", "y1", k.alias("k")).select("id", (F.col("x1") + F.col("k") * 0.25).alias("x"), (F.col("y1") + F.col("k") * 0.125).alias("y"))
    cells = p.where("id % 2 = 0").groupBy(F.floor(F.col("y") * 2).alias("row"), F.floor(F.col("x") * 2).alias("col")).agg(F.max("z").alias("z"))
    return op.cover_share(samples, cells.select("row", "col", (F.col("z") > -0.5).alias("valid"), (F.col("z") > 0.8).alias("canopy")), 0.5)


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return op.date_shares(o.select(F.year("o_orderdate").alias("date"), F.col("o_totalprice").alias("area")), 6e9)


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 150).alias("way"))
    ways = _t(spark, sf_dir, "events").select(F.col("user_id").alias("way"), (F.col("event_id") % 100).cast("double").alias("x"), F.col("value").alias("y"))
    return op.route_paths(members, ways, WAYS_BOX)


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).withColumn("ways", F.array_join(F.transform("ways", lambda v: v.cast("string")), ","))


def hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = _t(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("way"))
    return op.routes_hit(_routes(spark, sf_dir), closed)


def _boxed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, sf_dir)
    return op.network_in_box(s, BOX, s.select(F.col("id").alias("from_road"), (F.col("id") + 2).alias("to_road")))


def boxed_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir)[0].select("id", "index")


def boxed_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark, sf_dir)[1]


def street(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    gone = F.when(F.col("id") % 8 > 0, F.col("x")).alias("x")
    roads = p.where("id % 2 = 1").select("id", "x", "y", (F.col("id") % 3).alias("level"), F.round("z", 6).alias("heading"))
    return op.street_features(p.where("id % 2 = 0").select("id", gone, "y"), roads, districts(spark, sf_dir), p.where("id % 10 = 3"), 0.5, 1.0)


def row_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of five trees a quarter apart, against the even points as mapped trees."""
    s = segments(spark, sf_dir).select("id", "x1", "y1", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    s = s.select("id", "k", (F.col("x1") + F.col("k") * 0.25).alias("x"), (F.col("y1") + F.col("k") * 0.125).alias("y"))
    return op.row_trees(s, points(spark, sf_dir).where("id % 2 = 0"), 0.1)


def kerbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = segments(spark, sf_dir), points(spark, sf_dir)
    unit = 1.25**0.5
    k = F.explode(F.sequence(F.lit(1), F.lit(3)))
    samples = s.select(F.col("id").alias("road"), "x1", "y1", k.alias("k")).select(
        "road", "k", (F.col("x1") + F.col("k") * 0.25).alias("x"), (F.col("y1") + F.col("k") * 0.125).alias("y"), F.lit(1 / unit).alias("dx"), F.lit(0.5 / unit).alias("dy"))
    others = s.select("id", F.col("id").alias("road"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    out = op.kerb_slots(samples, p.where("id % 10 = 0"), others, 0.05, 0.2, 0.1, 0.6, 7)
    return out.select("road", "k", "side", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


S = f"{P}, s as (select * from p where id % 2 = 1)"
D = f"{S}, d as (select distinct floor(x) as cx, floor(y) as cy from p where id % 3 = 0)"
L = f"""{D}, l as (select s.id, cast(cx * 1000 + cy as bigint) as polygon, sqrt(1.25) * (least(1.0, cx + 1 - x, (cy + 1 - y) / 0.5::double) - greatest(0.0, cx - x, (cy - y) / 0.5::double)) as length
 from s join d on cx <= x + 1 and cx + 1 >= x and cy <= y + 0.5 and cy + 1 >= y)"""
LL = f"{L}, ll as (select * from l where length > 0.0001)"
#: Gap of the two-point lines from (x, y) to (x + 1, y + 0.5) of a and b, b moved by sh: ends of each against the other.
GAP = """e as (select *, unnest([0, 1]) as i from pr), q as (select id, other, sh, (ox + sh + i - x) as px, (oy + i / 2.0::double - y) as py, (x + i - ox - sh) as qx, (y + i / 2.0::double - oy) as qy from e),
 r as (select *, least(1.0, greatest(0.0, (px + py * 0.5::double) / 1.25::double)) as t, least(1.0, greatest(0.0, (qx + qy * 0.5::double) / 1.25::double)) as u from q),
 g as (select id, other, greatest(max(sqrt((px - t) ** 2 + (py - t / 2) ** 2)), max(sqrt((qx - u) ** 2 + (qy - u / 2) ** 2))) as gap from r group by 1, 2)"""
W = f"""m as (select o_custkey as route, o_orderkey as seq, o_orderkey % 150 as way from orders), w as (select user_id as way, count(*) as n from events group by 1
 having count(*) > 1 and bool_or(event_id % 100 between {WAYS_BOX[0]} and {WAYS_BOX[2]} and value between {WAYS_BOX[1]} and {WAYS_BOX[3]})), j as (select * from m join w using (way))"""
_B = f"""{S}, c as (select id, greatest(0.0, {BOX[0]}::double - x, ({BOX[1]}::double - y) / 0.5::double) as a, least(1.0, {BOX[2]}::double - x, ({BOX[3]}::double - y) / 0.5::double) as b from s),
 n as (select id, row_number() over (order by id) - 1 as index from c where a <= b)"""
QUERIES = {
    "lines_inside": inside, "lines_districts": crossed, "lines_coverage": coverage, "terrain_coverage": terrain, "signals_snapped": signals, "walks_parallel": parallel, "ground_labelled": ground,
    "canopy_screened": canopy, "roads_annotated": annotated, "elevations_transferred": elevations, "alignment_issues": alignment, "canopy_cover": cover, "area_date_shares": dates,
    "routes_in_box": routes, "routes_hit": hit, "network_box_roads": boxed_roads, "network_box_bans": boxed_bans, "street_features": street, "trees_of_rows": row_trees, "kerb_slots": kerbs,
}
ORACLES = {
    "lines_inside": f"with {LL} select id, polygon, round(length, 5) as length from ll",
    "lines_districts": f"with {LL} select id, string_agg(polygon::varchar, ',' order by polygon) as polygons, arg_max(polygon, (length, -polygon)) as owner from ll group by id",
    "terrain_coverage": f"""with {P}, c as (select distinct floor(y * 4) / 4 as v, floor(x * 4) / 4 as u from p), d as (select * from p where id % 10 = 0),
 h as (select d.id, sum((least(d.x + 0.6, u + 0.25) - greatest(d.x - 0.6, u)) * (least(d.y + 0.6, v + 0.25) - greatest(d.y - 0.6, v))) as t from d join c on u < d.x + 0.6 and u + 0.25 > d.x - 0.6 and v < d.y + 0.6 and v + 0.25 > d.y - 0.6 group by 1)
 select id, 1.44::double as area, round(coalesce(t, 0), 6) as terrain, round(coalesce(t, 0) / 1.44, 6) as share from d left join h using (id)""",
    "lines_coverage": f"""with {L}, i as (select id, sum(greatest(length, 0)) as inside from l group by 1), r as (select s.id, coalesce(inside, 0) as inside, s.id % 4 = 1 as out from s left join i on i.id = s.id)
 select count(*) as lines, count(*) filter (where out) as exported_lines, round(count(*) * sqrt(1.25), 4) as length, round(count(*) filter (where out) * sqrt(1.25), 4) as exported_length,
 round(sum(inside), 4) as inside, round(sum(inside) filter (where out), 4) as exported_inside, round(sum(inside) filter (where out) / sum(inside), 4) as exported_share from r""",
    "signals_snapped": f"""with {P}, g as (select * from p where id % 5 = 0), j as (select * from p where id % 3 = 0), n as (select g.id as signal, j.id as junction, sqrt((g.x - j.x) ** 2 + (g.y - j.y) ** 2) as d from g join j on true where g.id % 3 > 0)
 select id as signal, id as junction from g where id % 3 = 0 union all select signal, arg_min(junction, (d, junction)) from n where d <= 0.2 group by 1""",
    "walks_parallel": f"""with {P}, n as (select a.id, b.id % 50 as road, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d from p a join p b on a.id % 2 = 0 and b.id % 2 = 1 and abs(cos(a.z) * cos(2 * b.z) + sin(a.z) * sin(2 * b.z)) >= 0.8)
 select id, arg_min(road, (d, road)) as road, round(min(d), 6) as dist from n where d <= 0.4 group by 1""",
    "ground_labelled": f"""with {P}, h as (select p.id, bool_or(c.id % 10 = 0) as a, bool_or(c.id % 10 = 5) as b from p join p c on c.id % 5 = 0 and abs(p.x - c.x) < 0.4 and abs(p.y - c.y) < 0.4 group by 1)
 select p.id, coalesce(a and not b, false) as ground from p left join h on h.id = p.id""",
    "canopy_screened": f"""with {P}, w as (select distinct floor(y * 2) as r, floor(x * 2) as c from p where id % 7 = 0), n as (select distinct a.id from p a join p b on b.id % 2 = 1 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.1)
 select p.id, case when p.id % 6 = 0 then 'on_footprint' when z * 10 < -2 then 'low' when w.r is not null then 'water' when n.id is not null then 'carriageway' end as reason
 from p left join w on w.r = floor(y * 2) and w.c = floor(x * 2) left join n on n.id = p.id where p.id % 2 = 0""",
    "roads_annotated": f"""with {S}, g as (select floor(y * 2) as r, floor(x * 2) as c, round(min(z), 6) <= -0.5 as wet from p where id % 3 = 0 group by 1, 2),
 v as (select id, x + 0.3::double * k.range as x, y from s, range(4) k), w as (select v.id, avg(coalesce(wet, false)::int) as wet from v left join g on r = floor(v.y * 2) and c = floor(v.x * 2) group by 1)
 select s.id, s.id % 9 > 0 and s.id % 10 <= 4 as matched, case when s.id % 9 > 0 and s.id % 10 <= 4 then round(z * 20 + 50, 1) end as speed,
 case when s.id % 9 > 0 and s.id % 10 <= 4 then wet >= 0.25 end as over_water from s join w on w.id = s.id""",
    "elevations_transferred": f"""with {P}, sv as (select id as other, id, x as ox, y as oy, z, id % 7 * 0.02::double as sh from p union all select id + 1000000000, id, x, y, z, id % 7 * 0.02::double from p where id % 11 = 0),
 pr as (select p.id, other, p.x, p.y, ox, oy, sh from p join sv on p.id % 50 = sv.id % 50), {GAP}, k as (select *, count(*) over (partition by id) as a, count(*) over (partition by other) as b from g where gap <= 0.05)
 select k.id, other, round(gap, 6) as gap, round(sv.z, 6) as z1, round(sv.z + 1, 6) as z2 from k join sv using (other) where a = 1 and b = 1""",
    "alignment_issues": f"""with {P}, pr as (select id, id as other, x, y, x as ox, y as oy, id % 5 * 0.03::double as sh from p), {GAP}, c as (select p.id, p.id % 10 < 9 as exp, p.id % 10 > 0 as got, gap from p join g on g.id = p.id)
 select id, array_to_string(list_filter([case when not got then 'missing' end, case when not exp then 'extra' end, case when got and id % 11 = 0 then 'duplicate' end, case when exp and got and id % 4 = 3 then 'width' end,
 case when exp and got and gap > 0.05 then 'geometry' end], lambda v: v is not null), ',') as issues from c where not got or not exp or id % 11 = 0 or id % 4 = 3 or gap > 0.05""",
    "canopy_cover": f"""with {S}, c as (select floor(y * 2) as r, floor(x * 2) as c, max(z) as z from p where id % 2 = 0 group by 1, 2), v as (select id, x + 0.25::double * k.range as x, y + 0.125::double * k.range as y from s, range(5) k)
 select id, count(*) as samples, round(avg(coalesce(c.z > -0.5, false)::int), 4) as valid_share, round(avg((c.z > 0.8)::int) filter (where c.z > -0.5), 4) as cover from v left join c on c.r = floor(v.y * 2) and c.c = floor(v.x * 2) group by 1""",
    "area_date_shares": """with s as (select year(o_orderdate)::varchar as date, sum(o_totalprice) / 6e9 as share from orders group by 1)
 select date, round(share, 4) as share from s union all select 'no footprint', round(greatest(0, 1 - sum(share)), 4) from s""",
    "routes_in_box": f"with {W} select route, string_agg(way::varchar, ',' order by seq) as ways, cast(sum(n) as bigint) as points from j group by 1",
    "routes_hit": f"with {W} select route, count(distinct way) as closed from j join supplier on s_suppkey = way and s_acctbal > 5000 group by 1",
    "network_box_roads": f"with {_B} select * from n",
    "network_box_bans": f"with {_B} select a.index as from_road, b.index as to_road from n a join n b on b.id = a.id + 2",
    "street_features": f"""with {D}, f as (select id, case when id % 8 > 0 then x end as x, y from p where id % 2 = 0),
 n as (select f.id, arg_min(s.id, (s.id % 3 <> 0, sqrt((f.x - s.x) ** 2 + (f.y - s.y) ** 2), s.id)) as road from f join s on sqrt((f.x - s.x) ** 2 + (f.y - s.y) ** 2) <= 0.5 group by 1),
 c as (select f.id, arg_min(p.id, (sqrt((f.x - p.x) ** 2 + (f.y - p.y) ** 2), p.id)) as near from f join p on p.id % 10 = 3 where f.x is not null group by 1)
 select f.id, road, round(s.z, 6) as heading, case when road is not null then coalesce(cast(cx * 1000 + cy as bigint), near) end as owner, case when f.x is null then 'no position' when road is null then 'no road' end as reason
 from f left join n on n.id = f.id left join s on s.id = road left join d on cx = floor(f.x) and cy = floor(f.y) left join c on c.id = f.id""",
    "kerb_slots": f"""with {S}, a as (select id as road, k.range + 1 as k, d.side, x + 0.25::double * (k.range + 1) - d.side * 0.05::double * 0.5 / sqrt(1.25) as x, y + 0.125::double * (k.range + 1) + d.side * 0.05::double / sqrt(1.25) as y
 from s, range(3) k, (values (-1), (1)) d(side)), f as (select * from a where ('0x' || substr(sha256('7:' || road || ':' || k || ':' || side), 1, 8))::bigint / 4294967296.0::double < 0.6)
 select road, k, side, round(x, 6) as x, round(y, 6) as y from f where not exists (select 1 from p where p.id % 10 = 0 and sqrt((p.x - f.x) ** 2 + (p.y - f.y) ** 2) <= 0.2)
 and not exists (select 1 from s where s.id <> road and sqrt((s.x - f.x) ** 2 + (s.y - f.y) ** 2) <= 0.1)""",
}
