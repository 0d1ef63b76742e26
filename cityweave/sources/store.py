"""Tables that belong together, saved with a schema tag: panels, snapshots, road models, grids, guarded results, exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.functions.columns import utm_to_lonlat


def save_model(tables: dict[str, DataFrame], path: str, tag: str) -> None:
    """Each table as Parquet under the path, and the tag last, so that an unfinished save has none. The path must be new."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    names = ",".join(sorted(tables))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(tag, names)], "tag string, tables string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/tag-table")


def load_model(spark: SparkSession, path: str, tag: str) -> dict[str, DataFrame]:
    """The tables saved under a path; ValueError where its tag is another."""
    row = spark.read.parquet(f"{path}/tag-table").first()
    if row is None or row.tag != tag:
        raise ValueError(f"{path} holds {row and row.tag}, not {tag}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in row.tables.split(",")}


def write_panel(panel: DataFrame, path: str) -> None:
    """A panel as Parquet by interval, so that an interval is read alone."""
    panel.write.mode("errorifexists").partitionBy("start_year", "target_year").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("nullValue", "\\N").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema; a row that does not fit it stops the read, as does a header of other names."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.option("nullValue", "\\N").option("emptyValue", "").csv(path)


#: Cells of a side of a stored tile of a grid.
TILE = 256


def save_grid(cells: DataFrame, path: str, crs: str, x0: float, y0: float, cell: float, source: str) -> None:
    """A grid (row, col, z) in single precision by tiles, and where it lies: x0, y0 the outer corner of its first cell. Cells
    without a finite height are left out."""
    z = F.col("z").cast("float")
    good = cells.where("z is not null and not isnan(z) and abs(z) < double('inf')")
    tile = [F.floor(F.col(c) / TILE).cast("int").alias(f"tile_{c}") for c in ("row", "col")]
    tiles = good.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), z.alias("z"), *tile)
    tiles.write.mode("errorifexists").partitionBy("tile_row", "tile_col").parquet(f"{path}/cells")
    row = [(crs, float(x0), float(y0), float(cell), source)]
    place = cells.sparkSession.createDataFrame(row, "crs string, x0 double, y0 double, cell double, source string")
    save_model({"place": place}, f"{path}/about", "grid/1")


def load_grid(spark: SparkSession, path: str, crs: str | None = None, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, dict]:
    """(cells (row, col, z), where they lie) of a saved grid; with a box (west, south, east, north; rows count down from y0)
    only the tiles that meet it are read. ValueError where the grid is in another reference system than asked for."""
    place = load_model(spark, f"{path}/about", "grid/1")["place"].first().asDict()
    if crs is not None and place["crs"] != crs:
        raise ValueError(f"{path} is in {place['crs']}, not {crs}")
    schema = "row int, col int, z float, tile_row int, tile_col int"
    cells = spark.read.schema(schema).parquet(f"{path}/cells")
    if box is not None:
        west, south, east, north = box
        size = place["cell"]
        c0, c1 = (int((v - place["x0"]) // size) for v in (west, east))
        r0, r1 = (int((place["y0"] - v) // size) for v in (north, south))
        cells = cells.where(F.col("tile_row").between(r0 // TILE, r1 // TILE) & F.col("tile_col").between(c0 // TILE, c1 // TILE))
        cells = cells.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return cells.select("row", "col", F.col("z").cast("double").alias("z")), place


def save_snapshot(objects: DataFrame, path: str, snapshot: str) -> None:
    """Objects (object_id, ...) of one snapshot under its name."""
    save_model({"objects": objects}, path, f"snapshot/{snapshot}")


def load_snapshot(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """The objects of a saved snapshot; ValueError where it is another one, or where an object is there twice or has no id."""
    objects = load_model(spark, path, f"snapshot/{snapshot}")["objects"]
    bad = objects.groupBy("object_id").agg(F.count("*").alias("n")).where("n > 1 or object_id is null")
    if not bad.isEmpty():
        raise ValueError(f"{path} holds objects that are not told apart by their id")
    return objects


def write_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls written out."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def geojson_lines(df: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """One text column `value`: a GeoJSON feature a line, from an array of structs x, y (a point where it has one entry)."""
    at = F.transform(line, lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6)))
    many = F.to_json(F.struct(F.lit("LineString").alias("type"), at.alias("coordinates")))
    one = F.to_json(F.struct(F.lit("Point").alias("type"), F.get(at, F.lit(0)).alias("coordinates")))
    shape = F.when(F.size(line) == 1, one).otherwise(many)
    props = F.to_json(F.struct(*keep), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def point_export(points: DataFrame, zone: int, north: bool = True) -> tuple[DataFrame, DataFrame]:
    """(points (x, y, z, red, green, blue) as lon, lat, z and colours of eight bits, one row of their number and bounds).
    Colours of sixteen bits are scaled where any is above 255."""
    lon, lat = utm_to_lonlat(F.col("x"), F.col("y"), zone, north)
    deep = (points.agg(F.max(F.greatest("red", "green", "blue")).alias("m")).first().m or 0) > 255
    colour = lambda c: (F.floor(F.col(c) / 257) if deep else F.col(c)).cast("int").alias(c)
    out = points.select(F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"), F.round("z", 3).alias("z"), *map(colour, ("red", "green", "blue")))
    bounds = out.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("lon", "lat", "z") for n, f in (("least", F.min), ("most", F.max))))
    return out, bounds


def class_sample(points: DataFrame, every: int) -> DataFrame:
    """(class, n) of every so-many-th point record (record_index, class); the share, not the number, is fixed."""
    return points.where(F.col("record_index") % every == 0).groupBy("class").agg(F.count("*").alias("n"))


def guarded_write(result: DataFrame, path: str, source: str, config: str) -> None:
    """Write a result with the digests it was made from; refused where the path holds a result of other digests, and left as
    it is where it holds one of the same."""
    try:
        there = result.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        result.withColumns({"_source": F.lit(source), "_config": F.lit(config)}).write.mode("errorifexists").parquet(path)
        return
    if not there.where((F.col("_source") != source) | (F.col("_config") != config)).isEmpty():
        raise ValueError(f"{path} holds a result of another source or configuration")
