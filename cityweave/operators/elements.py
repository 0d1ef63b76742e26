"""Classes of map elements by their tags (a map column `tags`), reduced places, reviews and screened pixels.

A missing tag is null; the first rule that applies decides. Null tags fall under no rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.operators.osm import tag

# Display classes of vegetation by the tags natural, landuse and landcover.
NATURAL = {
    "tree": "tree", "tree_row": "tree_row", "tree_stump": "tree_stump", "shrub": "shrub", "bush": "shrub", "wood": "wood",
    "scrub": "scrub", "shrubbery": "shrubbery", "heath": "heath", "grassland": "grass", "meadow": "grass", "fell": "heath",
    "tundra": "heath", "moor": "heath", "wetland": "wetland", "reedbed": "reedbed", "moss": "moss", "lichen": "moss",
}
LANDUSE = {
    "forest": "wood", "grass": "grass", "meadow": "grass", "recreation_ground": "grass", "orchard": "orchard",
    "vineyard": "vineyard", "plant_nursery": "plant_nursery", "allotments": "allotments", "farmland": "farmland",
    "flowerbed": "flowerbed", "greenery": "greenery", "shrubbery": "shrubbery", "village_green": "village_green",
    "greenfield": "greenfield", "greenhouse_horticulture": "greenhouse_horticulture", "plantation": "orchard",
    "cemetery": "cemetery",
}
LANDCOVER = {
    "trees": "wood", "tree": "wood", "wood": "wood", "forest": "wood", "grass": "grass", "grasses": "grass", "meadow": "grass",
    "shrubs": "shrubbery", "scrub": "scrub", "bushes": "shrubbery", "shrubbery": "shrubbery", "flowerbed": "flowerbed",
    "flowers": "flowerbed", "greenery": "greenery", "moss": "moss", "reeds": "reedbed", "reedbed": "reedbed", "heath": "heath",
}
BOTANICAL = ("species", "genus", "taxon", "leaf_type", "leaf_cycle", "vegetation")
#: Heights in metres of kinds without a height tag.
DEFAULT_HEIGHTS = {"tree": 6.0, "shrub": 1.2, "tree_stump": 0.4, "hedge": 1.5, "planter": 0.6}
MOST_HEIGHT = 100.0
#: Ways nobody walks on, amenities that serve, and jobs of a place by its kind.
NOT_WALKABLE = ("motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed", "raceway", "bus_guideway", "escape", "platform")
SERVICES = (
    "restaurant", "cafe", "bar", "pub", "fast_food", "ice_cream", "pharmacy", "bank", "atm", "clinic", "dentist", "doctors",
    "bureau_de_change", "post_office", "marketplace", "theatre", "cinema", "library", "arts_centre", "nightclub", "food_court",
)
JOBS = {"office": 15, "shop": 3, "service": 4, "school": 40, "university": 150, "college": 60, "hospital": 250, "government": 60}
PAINTED = ("zebra", "marked", "uncontrolled", "traffic_signals")
UNPAINTED = ("no", "unmarked", "informal")


def coded(table: dict, key: Column) -> Column:
    """The table's value of a key, null where it has none."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def vegetation_kind() -> Column:
    leisure, surface = tag("leisure"), tag("surface")
    return F.coalesce(
        coded(NATURAL, tag("natural")),
        F.when(tag("barrier").isin("hedge", "hedge_bank"), "hedge"),
        F.when(tag("man_made") == "planter", "planter"),
        coded(LANDCOVER, tag("landcover")),
        coded(LANDUSE, tag("landuse")),
        F.when(leisure.isin("park", "garden"), leisure).when(leisure == "nature_reserve", "greenery"),
        F.when(tag("roof:material").isin("grass", "vegetation", "green_roof") | (tag("green_roof") == "yes"), "green_roof"),
        F.when(F.coalesce(tag("garden:type"), F.lit("")) != "", "garden").when(F.coalesce(tag("garden:style"), F.lit("")) != "", "garden"),
        F.when(surface.isin("grass", "grass_paver") & (F.coalesce(tag("highway"), F.lit("")) == ""), surface),
    )


def greenery(elements: DataFrame) -> DataFrame:
    """(id, kind, tags) of the elements (type, id, tags) with a class of vegetation or a botanical tag, kind then null."""
    botanical = F.arrays_overlap(F.map_keys("tags"), F.array(*map(F.lit, BOTANICAL)))
    out = elements.withColumn("kind", vegetation_kind()).where(F.col("kind").isNotNull() | botanical)
    return out.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("id"), "kind", "tags")


def with_heights(features: DataFrame) -> DataFrame:
    """features (kind, tags) with height_m and height_source: the tag in (0, 100], else the kind's default, else null."""
    said = F.regexp_extract(F.coalesce(tag("height"), F.lit("")), r"^\s*(\d+(?:\.\d+)?)\s*m?\s*$", 1).try_cast("double")
    said = F.when((said > 0) & (said <= MOST_HEIGHT), said)
    usual = coded(DEFAULT_HEIGHTS, F.col("kind"))
    source = F.when(said.isNotNull(), "tag").when(usual.isNotNull(), "default")
    return features.withColumns({"height_m": F.coalesce(said, usual), "height_source": source})


def walk_layers(elements: DataFrame) -> DataFrame:
    """elements (type, tags) with flags walkable, bus_stop, park, worship and amenity, and job_kind and jobs, in one pass.

    A way with a highway tag is walkable or nothing."""
    t, has = tag, lambda k: tag(k).isNotNull()
    road = (F.col("type") == "way") & has("highway")
    other = ~F.coalesce(road, F.lit(False))
    no = t("highway").isin(*NOT_WALKABLE) | F.coalesce(t("foot") == "no", F.lit(False)) | F.coalesce(t("access") == "private", F.lit(False))
    serves = t("amenity").isin(*SERVICES)
    yes = lambda c: F.coalesce(other & c, F.lit(False))
    job = (
        F.when(t("office") == "government", "government").when(has("office"), "office")
        .when(t("amenity").isin("school", "university", "college", "hospital"), t("amenity"))
        .when(has("shop"), "shop").when(serves, "service")
    )
    out = elements.withColumns({
        "walkable": F.coalesce(road & ~no, F.lit(False)), "bus_stop": yes(t("highway") == "bus_stop"), "park": yes(t("leisure").isin("park", "garden")),
        "worship": yes(t("amenity") == "place_of_worship"), "amenity": yes(has("shop") | F.coalesce(serves, F.lit(False))), "job_kind": F.when(other, job),
    })
    return out.withColumn("jobs", coded(JOBS, F.col("job_kind")))


def tag_category(rules: list[tuple[str, str, tuple[str, ...] | None]], prefixes: dict[str, str] | None = None) -> Column:
    """The name of the first rule (name, key, values or None for any) that the tags meet, else that of a key's prefix."""
    tests = [F.when(tag(k).isNotNull() if values is None else tag(k).isin(*values), name) for name, k, values in rules]
    tests += [F.when(F.exists(F.map_keys("tags"), lambda k: k.startswith(p)), name) for p, name in (prefixes or {}).items()]  # noqa: B023
    return F.coalesce(*tests)


def inventory(elements: DataFrame, category: Column) -> DataFrame:
    """Number of elements of each category; those without one are left out."""
    return elements.select(category.alias("category")).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


def is_painted(kind: str = "kind") -> Column:
    """Whether a crossing has paint on the road, by its style and markings tags."""
    text = lambda k: F.coalesce(tag(k), F.lit(""))
    style, marks = text("crossing"), text("crossing:markings")
    barred = ~F.col(kind).eqNullSafe("crossing") | (marks == "no") | style.isin(*UNPAINTED)
    return ~barred & ((marks != "") | style.isin(*PAINTED))


def places(features: DataFrame, least: float = 0.0) -> DataFrame:
    """(id, name, category, confidence, lon, lat) of point features with id, category and enough confidence; all else goes.

    features: id, geometry (type, coordinates), properties (id, confidence, names, taxonomy, categories: each .primary)."""
    p = lambda k: F.col(f"properties.{k}")
    some = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    out = features.where("geometry.type = 'Point'").select(
        some(p("id"), F.col("id")).alias("id"), F.coalesce(p("names.primary"), F.lit("")).alias("name"),
        some(p("taxonomy.primary"), p("categories.primary")).alias("category"), p("confidence").alias("confidence"),
        F.round(F.get("geometry.coordinates", F.lit(0)), 7).alias("lon"), F.round(F.get("geometry.coordinates", F.lit(1)), 7).alias("lat"),
    )
    return out.where(F.col("id").isNotNull() & F.col("category").isNotNull() & (F.col("confidence") >= least)).withColumn("confidence", F.round("confidence", 3))


def provider_counts(features: DataFrame) -> DataFrame:
    """Features of each (dataset, license) among properties.sources; one that a feature names twice counts once."""
    named = features.select(F.explode(F.array_distinct("properties.sources")).alias("s"))
    return named.groupBy("s.dataset", "s.license").agg(F.count("*").alias("n"))


def admitted_reviews(reviews: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """reviews (seq, id, photo, sha256, captured, box) with `issue`, the first fault or null where all is well.

    unknown: no such record (id); duplicate: not the record's first review by seq; undated; box: not four ordered numbers
    within the unit square; changed: not the digest of files (photo, sha256). Ids and photos are looked up by joins."""
    b = lambda i: F.get("box", F.lit(i))
    fits = (F.size("box") == 4) & (b(0) >= 0) & (b(0) < b(2)) & (b(2) <= 1) & (b(1) >= 0) & (b(1) < b(3)) & (b(3) <= 1)
    known = records.select("id").distinct().withColumn("_known", F.lit(True))
    digests = files.groupBy("photo").agg(F.min("sha256").alias("_sha"))
    firsts = reviews.groupBy("id").agg(F.min("seq").alias("_first"))
    j = reviews.join(known, "id", "left").join(firsts, "id", "left").join(digests, "photo", "left")
    issue = (
        F.when(F.col("_known").isNull(), "unknown").when(F.col("seq") != F.col("_first"), "duplicate").when(F.col("captured").isNull(), "undated")
        .when(~F.coalesce(fits, F.lit(False)), "box").when(~F.coalesce(F.col("_sha") == F.col("sha256"), F.lit(False)), "changed")
    )
    return j.withColumn("issue", issue).select(*reviews.columns, "issue")


def roof_colours(pixels: DataFrame, least: int = 25, share: float = 0.4) -> DataFrame:
    """(building, valid, kept, status, r, g, b): median colour of the pixels (building, r, g, b, valid) that are neither
    dark, glaring nor green; null where too few are left."""
    top = F.greatest("r", "g", "b")
    green = (F.col("g") > F.col("r") * 1.15) & (F.col("g") > F.col("b") * 1.1)
    keep = F.col("valid") & (top > 45) & (top < 250) & ~green
    med = lambda c: F.percentile(F.when(keep, F.col(c)), 0.5).alias(f"_{c}")
    sums = pixels.groupBy("building").agg(F.count_if("valid").alias("valid"), F.count_if(keep).alias("kept"), med("r"), med("g"), med("b"))
    few = F.when(F.col("valid") < least, "too few valid").when((F.col("kept") < least) | (F.col("kept") < F.col("valid") * share), "too few kept")
    status = F.coalesce(few, F.lit("candidate"))
    colour = lambda c: F.when(few.isNull(), F.bround(F.col(f"_{c}")).cast("int")).alias(c)
    return sums.select("building", "valid", "kept", status.alias("status"), colour("r"), colour("g"), colour("b"))


def forecast_on(snapshot: DataFrame, forecast: DataFrame, labels: list[str]) -> DataFrame:
    """snapshot (object_id, ...) with p, the forecast's probabilities in the labels' order, zeros where a label has none;
    null for objects without a forecast (object_id, p map)."""
    p = F.transform(F.array(*map(F.lit, labels)), lambda k: F.coalesce(F.element_at("_p", k), F.lit(0.0)))
    j = snapshot.join(forecast.select("object_id", F.col("p").alias("_p")), "object_id", "left")
    return j.withColumn("p", F.when(F.col("_p").isNotNull(), p)).drop("_p")


def reference_status(references: DataFrame, tables: list[tuple[str, DataFrame]], other: str) -> DataFrame:
    """references (id, ...) with status: the name of the first table (id) that has the id, else `other`."""
    out, names = references, []
    for i, (name, df) in enumerate(tables):
        out = out.join(df.select("id").distinct().withColumn(f"_{i}", F.lit(name)), "id", "left")
        names.append(F.col(f"_{i}"))
    return out.withColumn("status", F.coalesce(*names, F.lit(other))).select(*references.columns, "status")


def enriched(rows: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """rows with the columns of a second scan by key; of several rows of a key the last by all its columns."""
    extra = [c for c in second.columns if c != key]
    one = second.groupBy(key).agg(F.max(F.struct(*extra)).alias("_e"))
    return rows.join(one, key, "left").select(*rows.columns, *(F.col(f"_e.{c}").alias(c) for c in extra))


def ordered_transitions(counts: DataFrame) -> DataFrame:
    """Transition counts, most frequent first, then by states."""
    return counts.orderBy(F.desc("n"), "current_state", "target_state")


def best_starts(candidates: DataFrame, rules: list[tuple[str, Column]], rank: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(best, excluded): each area's first candidate (area, id, ...) by rank among those that break no rule, and
    (area, reason, n), counted by the first rule (reason, broken) a candidate breaks."""
    reason = F.coalesce(*(F.when(broken, name) for name, broken in rules))
    judged = candidates.withColumn("reason", reason)
    order = Window.partitionBy("area").orderBy(*rank, "id")
    best = judged.where("reason is null").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "reason")
    return best, judged.where("reason is not null").groupBy("area", "reason").agg(F.count("*").alias("n"))
