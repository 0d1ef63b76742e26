"""Map elements: road tags, classification with first rule wins, node references, turn restrictions, line sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tag(name: str) -> Column:
    return F.element_at("tags", name)


def road_attributes(ways: DataFrame, lanes_by_class: dict[str, int]) -> DataFrame:
    """Adds oneway (1, 0, -1), lanes for one direction, name and level from tags."""
    oneway = F.when(tag("oneway").isin("yes", "1", "true"), 1).when(tag("oneway") == "-1", -1).when((tag("junction") == "roundabout") | tag("highway").isin("motorway", "motorway_link"), 1).otherwise(0)
    given = F.regexp_extract(tag("lanes"), r"^\s*(\d+)", 1).try_cast("int")
    usual = F.element_at(F.create_map(*[F.lit(x) for kv in lanes_by_class.items() for x in kv]), tag("highway"))
    lanes = F.greatest(F.when(F.col("oneway") == 0, F.floor(given / 2)).otherwise(given), F.lit(1))
    level = F.coalesce(tag("layer").try_cast("int"), F.when(tag("bridge").isNotNull() & (tag("bridge") != "no"), 1).when(tag("tunnel").isNotNull() & (tag("tunnel") != "no"), -1), F.lit(0))
    return ways.withColumn("oneway", oneway).withColumns({"lanes": F.coalesce(lanes, usual, F.lit(1)).cast("int"), "name": F.coalesce(tag("name"), tag("ref"), F.lit("")), "level": level})


def first_rule(elements: DataFrame, rules: list[tuple[str, str]], out: str = "kind") -> DataFrame:
    """Adds the name of the first rule (name, SQL test) that holds."""
    return elements.withColumn(out, F.coalesce(*(F.when(F.expr(test), name) for name, test in rules)))


def placements(points: DataFrame, key: str, test: str, existing: DataFrame | None = None) -> DataFrame:
    """(key, reason): null for points that are placed; else why they are not, the first reason counts."""
    n = points.groupBy(key).agg(F.count("*").alias("_n"))
    j = points.join(n, key)
    if existing is not None:
        j = j.join(existing.select(F.col(key), F.lit(True).alias("_e")).distinct(), key, "left")
    else:
        j = j.withColumn("_e", F.lit(None).cast("boolean"))
    reason = F.when(F.col("_n") > 1, "duplicate").when(F.col("_e"), "exists").when(~F.coalesce(F.expr(test), F.lit(False)), "other kind")
    return j.withColumn("reason", reason).drop("_n", "_e")


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, points) of ways (id, nodes) in order; ways with a missing node are left out."""
    n = ways.select("id", F.size("nodes").alias("size"), F.posexplode("nodes").alias("pos", "node"))
    j = n.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node")
    g = j.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    return g.where(F.size("p") == F.col("size")).select("id", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"))


def turn_bans(relations: DataFrame, roads: DataFrame) -> DataFrame:
    """(from_road, to_road) banned by restrictions (id, restriction, from_way, via, to_way) over roads (road, way, u, v).

    no_ bans the turn named; only_ bans every other way out of the node."""
    came = relations.join(roads.select(F.col("road").alias("from_road"), F.col("way").alias("from_way"), F.col("v").alias("via")), ["from_way", "via"])
    out = roads.select(F.col("road").alias("to_road"), F.col("way").alias("out_way"), F.col("u").alias("via"))
    j = came.join(out, "via")
    hit = F.col("out_way") == F.col("to_way")
    return j.where(F.when(F.col("restriction").startswith("only_"), ~hit).otherwise(hit)).select("from_road", "to_road").distinct()


def line_samples(points: DataFrame, step: float) -> DataFrame:
    """(id, k, x, y): points every `step` along lines (id, seq, x, y), both ends kept."""
    w = Window.partitionBy("id").orderBy("seq")
    s = points.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    s = s.withColumn("len", F.coalesce(F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2), F.lit(0.0)))
    s = s.withColumn("past", F.sum("len").over(w)).withColumn("before", F.col("past") - F.col("len"))
    total = s.groupBy("id").agg(F.max("past").alias("total")).withColumn("n", F.greatest(F.ceil(F.col("total") / step), F.lit(1)))
    at = total.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).withColumn("d", F.col("total") * F.col("k") / F.col("n"))
    j = at.join(s.where("x2 is not null"), "id").where("d >= before and d <= past")
    first = Window.partitionBy("id", "k").orderBy("seq")
    t = F.coalesce((F.col("d") - F.col("before")) / F.nullif(F.col("len"), F.lit(0.0)), F.lit(0.0))
    return j.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("id", "k", (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))


def combined_disruptions(parts: list[DataFrame]) -> DataFrame:
    """One row per road from parts (road, closed, factor, reason): closed if any is, strongest slowdown, first reason."""
    out = parts[0].withColumn("_p", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_p", F.lit(i)))
    return out.groupBy("road").agg(F.max("closed").alias("closed"), F.min("factor").alias("factor"), F.min_by("reason", "_p").alias("reason"))
