"""Lines against areas, grids and each other: lengths inside, owners, snapping, screening, transfers.

All joins are equi-joins on cells or keys followed by an exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.functions.columns import inside_ring, ring_area
from cityweave.operators.iterate import kept
from cityweave.operators.polygons import overlaps
from cityweave.operators.spatial import nearest, points_in_polygons, runs, within


def share_inside(x1: Column, y1: Column, x2: Column, y2: Column, ring: Column) -> Column:
    """Share of the segment from (x1, y1) to (x2, y2) inside a ring of structs x, y, which need not be convex.

    The segment is cut where it crosses the ring's edges; a piece counts by its middle."""
    dx, dy = x2 - x1, y2 - y1
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def crossing(p: Column, q: Column) -> Column:
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        turn = F.nullif(dx * ey - dy * ex, F.lit(0.0))
        t, s = ((p["x"] - x1) * ey - (p["y"] - y1) * ex) / turn, ((p["x"] - x1) * dy - (p["y"] - y1) * dx) / turn
        return F.when(t.between(0, 1) & s.between(0, 1), t)

    cuts = F.filter(F.zip_with(ring, nxt, crossing), lambda t: t.isNotNull())
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts))
    pieces = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    middle = lambda p: (p["a"] + p["b"]) / 2
    inside = F.filter(pieces, lambda p: inside_ring(x1 + middle(p) * dx, y1 + middle(p) * dy, ring))
    return F.aggregate(inside, F.lit(0.0), lambda s, p: s + p["b"] - p["a"])


def lengths_inside(segments: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """(id, polygon, length) summed over a line's segments (id, x1, y1, x2, y2), where it is above zero. Boxes meet in cells,
    once a pair; the rings are joined to the pairs left."""
    cell = lambda c: F.floor(c / size)
    spread = lambda lo, hi, name: F.explode(F.sequence(cell(lo), cell(hi))).alias(name)
    end = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    key = F.xxhash64("id", "x1", "y1", "x2", "y2").alias("_s")
    s = segments.select("*", key, spread(F.least("x1", "x2"), F.greatest("x1", "x2"), "_cx")).select("*", spread(F.least("y1", "y2"), F.greatest("y1", "y2"), "_cy"))
    p = polygons.select(F.col("id").alias("polygon"), "ring", spread(end(F.array_min, "x"), end(F.array_max, "x"), "_cx"))
    p = p.select("polygon", "_cx", spread(end(F.array_min, "y"), end(F.array_max, "y"), "_cy"))
    pairs = s.join(p, ["_cx", "_cy"]).select("id", "_s", "x1", "y1", "x2", "y2", "polygon").distinct()
    share = share_inside(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("ring"))
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    j = pairs.join(polygons.select(F.col("id").alias("polygon"), "ring"), "polygon").withColumn("length", share * length)
    return j.groupBy("id", "polygon").agg(F.sum("length").alias("length")).where("length > 0")


def districts_crossed(lengths: DataFrame) -> DataFrame:
    """(id, polygons, owner): all polygons a line crosses in order, and the one with most of it, the smaller on ties."""
    best = F.max_by("polygon", F.struct("length", (-F.col("polygon")).alias("_n"))).alias("owner")
    return lengths.groupBy("id").agg(F.sort_array(F.collect_set("polygon")).alias("polygons"), best)


def coverage(segments: DataFrame, lengths: DataFrame, exported: DataFrame) -> DataFrame:
    """One row: lines, their length, what of it lies inside the polygons (which don't overlap), and the same of the
    exported lines (id)."""
    length = F.sum(F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)).alias("length")
    rows = segments.groupBy("id").agg(length).join(lengths.groupBy("id").agg(F.sum("length").alias("inside")), "id", "left")
    rows = rows.join(exported.select("id").distinct().withColumn("out", F.lit(True)), "id", "left")
    total = lambda c, only=False: F.coalesce(F.sum(F.when(F.col("out"), F.col(c))) if only else F.sum(c), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("lines"), F.count("out").alias("exported_lines"), total("length").alias("length"), total("length", True).alias("exported_length"),
        total("inside").alias("inside"), total("inside", True).alias("exported_inside"),
        (total("inside", True) / F.nullif(total("inside"), F.lit(0.0))).alias("exported_share"),
    )


def terrain_coverage(cells: DataFrame, size: float, districts: DataFrame, reach: float) -> DataFrame:
    """(id, area, terrain, share) of districts (id, ring): how much of each lies on cells (row, col) of a terrain grid.

    Neighbouring cells of a row are one rectangle of at most 64, so no rectangle reaches over more than a few districts."""
    one = runs(cells.select("row", F.floor(F.col("col") / 64).alias("_part"), "col").distinct().select(F.struct("row", "_part").alias("row"), "col"))
    edge = {"x0": F.col("first") * size, "x1": (F.col("last") + 1) * size, "y0": F.col("row.row") * size, "y1": (F.col("row.row") + 1) * size}
    at = lambda x, y: F.struct(edge[x].alias("x"), edge[y].alias("y"))
    boxes = one.select(F.struct("row.row", "first").alias("id"), F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")).alias("ring"))
    held = overlaps(districts, boxes, reach).groupBy(F.col("a").alias("id")).agg(F.sum("area").alias("terrain"))
    out = districts.select("id", ring_area(F.col("ring")).alias("area")).join(held, "id", "left").withColumn("terrain", F.coalesce("terrain", F.lit(0.0)))
    return out.withColumn("share", F.col("terrain") / F.nullif("area", F.lit(0.0)))


def snapped_signals(signals: DataFrame, junctions: DataFrame, reach: float) -> DataFrame:
    """(signal, junction): a signal (id, x, y) at the junction of its own id, else at the nearest within reach; others go."""
    own = signals.join(junctions.select("id"), "id", "left_semi").select(F.col("id").alias("signal"), F.col("id").alias("junction"))
    rest = signals.join(junctions.select("id"), "id", "left_anti")
    near = within(rest, junctions, reach).groupBy("id").agg(F.min(F.struct("dist", "other")).alias("m"))
    return own.unionAll(near.select(F.col("id").alias("signal"), F.col("m.other").alias("junction")))


def parallel_roads(walks: DataFrame, samples: DataFrame, reach: float, least: float = 0.8) -> DataFrame:
    """(id, road, dist): the nearest sample (id, road, x, y, dx, dy) within reach of a walk (id, x, y, dx, dy) that runs
    along it either way; directions are unit vectors."""
    pairs = within(walks, samples, reach)
    j = pairs.join(walks.select("id", "dx", "dy"), "id").join(samples.select(F.col("id").alias("other"), "road", F.col("dx").alias("ex"), F.col("dy").alias("ey")), "other")
    along = j.where(F.abs(F.col("dx") * F.col("ex") + F.col("dy") * F.col("ey")) >= least)
    best = along.groupBy("id").agg(F.min(F.struct("dist", "road")).alias("m"))
    return best.select("id", "m.road", "m.dist")


def labelled_ground(points: DataFrame, include: DataFrame, exclude: DataFrame, size: float) -> DataFrame:
    """points (id, x, y) with ground: inside a footprint to include and in none to exclude."""
    hit = lambda polygons, name: points_in_polygons(points, polygons, size).select("id").distinct().withColumn(name, F.lit(True))
    j = points.join(hit(include, "_in"), "id", "left").join(hit(exclude, "_out"), "id", "left")
    return j.withColumn("ground", F.col("_in").isNotNull() & F.col("_out").isNull()).drop("_in", "_out")


def screened(candidates: DataFrame, water: DataFrame, roads: DataFrame, size: float, least: float, clear: float) -> DataFrame:
    """candidates (id, x, y, height, on_footprint) with `reason`, the first that rules them out, null for those kept:
    on_footprint, low, water (their cell of `size` is in water (row, col)), carriageway (a road point within `clear`)."""
    near = within(candidates, roads, clear).select("id").distinct().withColumn("_road", F.lit(True))
    wet = water.select("row", "col").distinct().withColumn("_wet", F.lit(True))
    c = candidates.withColumns({"row": F.floor(F.col("y") / size), "col": F.floor(F.col("x") / size)})
    j = c.join(wet, ["row", "col"], "left").join(near, "id", "left")
    reason = (
        F.when(F.col("on_footprint"), "on_footprint").when(F.col("height") < least, "low").when(F.col("_wet"), "water").when(F.col("_road"), "carriageway")
    )
    return j.withColumn("reason", reason).select(*candidates.columns, "reason")


def annotated(roads: DataFrame, model: DataFrame, vertices: DataFrame, ground: DataFrame, size: float, reach: float, level: float, share: float = 0.25) -> DataFrame:
    """(id, matched, speed, over_water) of roads (id, x, y: their first point). A road of model (id, speed, x1, y1, x2, y2)
    is the same where an end lies within reach. It is over water where at least `share` of its vertices (id, x, y) lie on
    cells of ground (row, col, z) that are null or not above `level`; vertices off the grid are dry."""
    at = vertices.select("id", F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("col"))
    cells = ground.select("row", "col", (F.col("z").isNull() | (F.col("z") <= level)).alias("wet"))
    wet = at.join(cells, ["row", "col"], "left").groupBy("id").agg(F.avg(F.coalesce("wet", F.lit(False)).cast("int")).alias("_wet"))
    gap = lambda k: F.sqrt((F.col("x") - F.col(f"x{k}")) ** 2 + (F.col("y") - F.col(f"y{k}")) ** 2)
    j = roads.join(model, "id", "left").join(wet, "id", "left")
    same = F.coalesce(F.least(gap(1), gap(2)) <= reach, F.lit(False))
    return j.select("id", same.alias("matched"), F.when(same, F.round("speed", 1)).alias("speed"), F.when(same, F.coalesce(F.col("_wet") >= share, F.lit(False))).alias("over_water"))


def point_to_line(p: Column, line: Column) -> Column:
    """Distance of a struct x, y from a polyline, an array of such structs with two points or more."""
    def gap(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.sqrt((p["x"] - a["x"] - t * dx) ** 2 + (p["y"] - a["y"] - t * dy) ** 2)

    n = F.size(line)
    return F.array_min(F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n), gap))


def line_gap(a: Column, b: Column) -> Column:
    """How far the points of two polylines lie from the other line at most."""
    far = lambda p, q: F.array_max(F.transform(p, lambda v: point_to_line(v, q)))
    return F.greatest(far(a, b), far(b, a))


def transferred_elevations(roads: DataFrame, surveyed: DataFrame, tolerance: float) -> DataFrame:
    """(id, other, gap, z1, z2): heights of the ends of the one surveyed line (id, way, line of x, y, z) of a road's way (id,
    way, line) whose shape is the road's to within the tolerance. Roads with several such lines, and lines that several
    roads claim, get none."""
    other = surveyed.select(F.col("id").alias("other"), "way", F.col("line").alias("_l"))
    j = roads.join(other, "way").withColumn("gap", line_gap(F.col("line"), F.col("_l"))).where(F.col("gap") <= tolerance)
    one = lambda k: F.count("*").over(Window.partitionBy(k))
    j = j.withColumns({"_a": one("id"), "_b": one("other")}).where("_a = 1 and _b = 1")
    end = lambda p: F.element_at(F.array_sort(F.transform("_l", lambda v: F.struct(((v["x"] - p["x"]) ** 2 + (v["y"] - p["y"]) ** 2).alias("d"), v["z"].alias("z")))), 1)["z"]
    return j.select("id", "other", "gap", end(F.element_at("line", 1)).alias("z1"), end(F.element_at("line", -1)).alias("z2"))


def alignment_issues(expected: DataFrame, exported: DataFrame, tolerance: float, width: float = 0.05) -> DataFrame:
    """(id, issues) of lanes (id, width, line) that are not alike on both sides: missing, extra, duplicate (exported twice),
    width, geometry. One row a lane, lanes without issue left out."""
    e = exported.groupBy("id").agg(F.count("*").alias("_n"), F.min("width").alias("_w"), F.min("line").alias("_l"))
    j = expected.select("id", "width", "line", F.lit(True).alias("_e")).join(e, "id", "full_outer")
    both = F.col("_e") & F.col("_n").isNotNull()
    said = [
        F.when(F.col("_n").isNull(), "missing"), F.when(F.col("_e").isNull(), "extra"), F.when(F.col("_n") > 1, "duplicate"),
        F.when(both & (F.abs(F.col("width") - F.col("_w")) > width), "width"), F.when(both & (line_gap(F.col("line"), F.col("_l")) > tolerance), "geometry"),
    ]
    return j.select("id", F.array_compact(F.array(*said)).alias("issues")).where(F.size("issues") > 0)


def cover_share(samples: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(id, samples, valid_share, cover): share of a road's samples (id, x, y) on cells (row, col, valid, canopy) that are
    valid, and of those the share with canopy, null where none is valid."""
    at = samples.select("id", F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("col"))
    j = at.join(cells, ["row", "col"], "left").withColumn("_ok", F.coalesce("valid", F.lit(False)))
    hit = F.coalesce("canopy", F.lit(False)).cast("int")
    return j.groupBy("id").agg(F.count("*").alias("samples"), F.round(F.avg(F.col("_ok").cast("int")), 4).alias("valid_share"), F.round(F.avg(F.when(F.col("_ok"), hit)), 4).alias("cover"))


def date_shares(overlaps: DataFrame, total: float) -> DataFrame:
    """(date, share) of an area by acquisition date from clipped areas (date, area), the rest under 'no footprint'."""
    shares = overlaps.groupBy(F.col("date").cast("string").alias("date")).agg((F.sum("area") / total).alias("share"))
    rest = shares.agg(F.lit("no footprint").alias("date"), F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("share"), F.lit(0.0))).alias("share"))
    return shares.unionAll(rest).withColumn("share", F.round("share", 4))


def route_paths(members: DataFrame, ways: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(route, ways, points): ways of each route (route, seq, way) that have a point (way, x, y) inside the box, in order of
    seq, and how many points they have in all. Ways of fewer than two points, and routes without ways, are left out."""
    x1, y1, x2, y2 = box
    inside = F.bool_or(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))
    near = ways.groupBy("way").agg(F.count("*").alias("n"), inside.alias("_in")).where("n > 1 and _in").drop("_in")
    j = members.join(near, "way")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "way"))), lambda s: s["way"])
    return j.groupBy("route").agg(listed.alias("ways"), F.sum("n").alias("points"))


def routes_hit(routes: DataFrame, closed: DataFrame) -> DataFrame:
    """(route, closed): routes (route, ways) that use closed ways (way), and how many."""
    each = routes.select("route", F.explode(F.array_distinct("ways")).alias("way"))
    return each.join(closed.select("way").distinct(), "way", "left_semi").groupBy("route").agg(F.count("*").alias("closed"))


def network_in_box(roads: DataFrame, box: tuple[float, float, float, float], bans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roads with new numbers `index` from zero in order of id, bans (from_road, to_road) under those numbers) of the roads
    (id, x1, y1, x2, y2) that touch the box. Numbers come from counts of id ranges, so no task sees all roads."""
    bx1, by1, bx2, by2 = map(F.lit, box)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    enter, leave = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for d, a, lo, hi in ((dx, F.col("x1"), bx1, bx2), (dy, F.col("y1"), by1, by2)):
        u, v = (lo - a) / F.nullif(d, F.lit(0.0)), (hi - a) / F.nullif(d, F.lit(0.0))
        enter, leave = F.greatest(enter, F.least(u, v)), F.least(leave, F.greatest(u, v))
        outside = outside | ((d == 0) & ((a < lo) | (a > hi)))
    part = roads.where(~outside & (enter <= leave))
    span = 1 << 16
    part = part.withColumn("_range", F.floor(F.col("id") / span))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("id")) - 1
    out = part.withColumn("_place", place).join(starts, "_range").withColumn("index", F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")
    new = lambda k: out.select(F.col("id").alias(f"{k}_road"), F.col("index").alias(f"_{k}"))
    moved = bans.join(new("from"), "from_road").join(new("to"), "to_road").select(F.col("_from").alias("from_road"), F.col("_to").alias("to_road"))
    return out, moved


def street_features(features: DataFrame, roads: DataFrame, districts: DataFrame, centres: DataFrame, reach: float, size: float) -> DataFrame:
    """features (id, x, y) with road, heading and owner, or a reason why not placed.

    The road (id, x, y, level, heading: sampled points) is the nearest at ground level within reach, else the nearest at any
    level; the owner is the district (id, ring) around the feature, the smallest id of several, else the nearest centre (id,
    x, y). Features without a position or without a road within reach are not placed."""
    placed = features.where("x is not null and y is not null")
    near = within(placed, roads, reach).join(roads.select(F.col("id").alias("other"), "level", "heading"), "other")
    best = near.groupBy("id").agg(F.min(F.struct((F.col("level") != 0).alias("up"), "dist", "other", "heading")).alias("m"))
    inside = points_in_polygons(placed, districts, size).groupBy("id").agg(F.min("polygon").alias("_in"))
    rest = placed.join(inside, "id", "left_anti")
    other = nearest(rest, centres, reach).select("id", F.col("other").alias("_near"))
    j = features.join(best, "id", "left").join(inside, "id", "left").join(other, "id", "left")
    reason = F.when(F.col("x").isNull() | F.col("y").isNull(), "no position").when(F.col("m").isNull(), "no road")
    when = lambda c: F.when(reason.isNull(), c)
    return j.select("id", when(F.col("m.other")).alias("road"), when(F.col("m.heading")).alias("heading"), when(F.coalesce("_in", "_near")).alias("owner"), reason.alias("reason"))


def row_trees(samples: DataFrame, trees: DataFrame, gap: float) -> DataFrame:
    """(id, k, x, y) of tree-row samples (id, k, x, y) that are further than `gap` from every mapped tree (id, x, y) and from
    every sample kept before them in order of id and k."""
    key = F.struct("id", "k")
    s = samples.select(key.alias("id"), "x", "y")
    free = s.join(within(s, trees, gap).select("id").distinct(), "id", "left_anti")
    pairs = within(free, free, gap).where("id > other")
    # A sample falls only to one that stays itself: those that nothing smaller touches stay, what they touch goes, and so on.
    pairs, left, stay = kept(pairs), kept(free.select("id")), None
    while True:
        touched = pairs.select("id").distinct()
        now = kept(left.join(touched, "id", "left_anti"))
        stay = now if stay is None else stay.unionAll(now)
        gone = pairs.join(now.withColumnRenamed("id", "other"), "other", "left_semi").select("id").distinct()
        left = kept(left.join(now, "id", "left_anti").join(gone, "id", "left_anti"))
        if left.isEmpty():
            break
        pairs = kept(pairs.join(left, "id", "left_semi").join(left.withColumnRenamed("id", "other"), "other", "left_semi"))
    return free.join(stay, "id", "left_semi").select("id.id", "id.k", "x", "y")


def kerb_slots(samples: DataFrame, junctions: DataFrame, others: DataFrame, offset: float, mouth: float, clear: float, fill: float, seed: int) -> DataFrame:
    """(road, k, side, x, y): parking places beside road samples (road, k, x, y, dx, dy), `offset` to either side, filled at a
    rate by hash, not within `mouth` of a junction (id, x, y) nor within `clear` of a point of another road (id, road, x, y)."""
    side = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    s = samples.select("road", "k", "x", "y", "dx", "dy", side)
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "road", "k", "side"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    s = s.where(draw < fill).select("road", "k", "side", (F.col("x") - F.col("side") * offset * F.col("dy")).alias("x"), (F.col("y") + F.col("side") * offset * F.col("dx")).alias("y"))
    p = s.select(F.struct("road", "k", "side").alias("id"), "x", "y")
    mouths = within(p, junctions, mouth).select("id")
    roads = within(p, others, clear).join(others.select(F.col("id").alias("other"), "road"), "other").where("id.road <> road").select("id")
    return p.join(mouths.unionAll(roads).distinct(), "id", "left_anti").select("id.road", "id.k", "id.side", "x", "y")
