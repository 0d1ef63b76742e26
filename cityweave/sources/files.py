"""Readers and writers of city data files with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBES = "date string, time string, place string, course string, velocity string, way string, _corrupt string"
RING = "array<array<array<double>>>"
BUILDINGS = (
    "features array<struct<properties: struct<OBJECTID: bigint, BULBuildingID: bigint, ParcelID: string, Sector: string, Building_Use: string, "
    f"NoofFloor: double, Building_Hight_m: double, YearCompleted: int, PermitYear: int, Status2018: string, Status2022: string>, geometry: struct<type: string, coordinates: {RING}>>>"
)
ELEMENTS = (
    "elements array<struct<type: string, id: bigint, tags: map<string,string>, lat: double, lon: double, nodes: array<bigint>, "
    "geometry: array<struct<lat: double, lon: double>>, members: array<struct<type: string, ref: bigint, role: string>>>>"
)


def probes(spark: SparkSession, path: str) -> DataFrame:
    """All rows of probe CSV files as text, malformed ones kept in _corrupt."""
    return (
        spark.read.schema(PROBES).option("header", True).option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).csv(path)
    )


def parsed_probes(raw: DataFrame, unit: float) -> DataFrame:
    """(way, ts, lon, lat, course, speed) of valid rows; speed in km/h after the given unit factor, within 3 to 160."""
    place = F.split("place", ",")
    speed = F.expr("try_cast(velocity as double)") * unit
    out = raw.select(
        F.regexp_extract("way", "^way/([0-9]{1,12})$", 1).try_cast("bigint").alias("way"),
        F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        place[0].try_cast("double").alias("lon"), place[1].try_cast("double").alias("lat"), F.expr("try_cast(course as double)").alias("course"), speed.alias("speed"),
    )
    return out.where("way is not null and ts is not null and speed between 3 and 160")


def buildings(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature of GeoJSON collections; only the allowed fields are read."""
    f = spark.read.schema(BUILDINGS).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", "f.geometry")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements with open tags."""
    e = spark.read.schema(ELEMENTS).option("multiLine", True).json(path)
    return e.select(F.explode("elements").alias("e"), F.input_file_name().alias("file")).select("e.*", "file")


def merged_elements(groups: DataFrame, order: str = "group") -> DataFrame:
    """One row per (type, id): the one of the last group."""
    fields = [c for c in groups.columns if c not in ("type", "id", order)]
    last = groups.groupBy("type", "id").agg(F.max_by(F.struct(*fields), order).alias("e"))
    return last.select("type", "id", "e.*")


def bbox_scan(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows of Parquet files whose bbox struct meets a box; the comparisons prune row groups."""
    b = spark.read.parquet(path)
    return b.where((F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south))


def file_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, modified) of landed files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def release(df: DataFrame, path: str, issues: DataFrame) -> None:
    """Publish a table at a new path; refused where the audit found issues or the path exists."""
    if not issues.isEmpty():
        raise ValueError("the audit found issues")
    df.write.mode("errorifexists").parquet(path)


def page_issues(pages: DataFrame, key: str, least: int) -> DataFrame:
    """(issue, n): keys that come twice and pages (file) shorter than the others allow, the last excepted."""
    twice = pages.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("issue"), "n")
    short = pages.groupBy("file").agg(F.count("*").alias("c"))
    last = pages.agg(F.max("file").alias("last"))
    short = short.join(F.broadcast(last), F.col("file") != F.col("last")).where(F.col("c") < least).agg(F.count("*").alias("n"))
    return twice.unionAll(short.select(F.lit("short_page").alias("issue"), "n")).where("n > 0")
