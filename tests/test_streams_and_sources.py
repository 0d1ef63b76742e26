import os
import struct

import pytest
from pyspark.sql import functions as F

from cityweave.operators import ledger
from cityweave.plans import ledger as ledger_plan
from cityweave.plans import speeds as speed_plan
from cityweave.sources import files
from cityweave.sources.las import LasSource
from cityweave.streaming import probes

AT = "/root/testdata/sf0.001"


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def landed(df, path, parts=3):
    df.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.parquet(str(path))
    for i, f in enumerate(sorted(path.glob("part-*"))):  # a stream takes files by their time
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_hourly_stream_equals_batch_on_closed_windows(spark, tmp_path):
    r = speed_plan.readings(spark, AT, 4).select("road", "speed", F.col("ts").cast("timestamp").alias("ts"))
    drain(probes.hourly_speeds(landed(r, tmp_path / "r")), "hourly", "append")
    got = {(x.road, x.hour): (x.n, round(x.median, 6)) for x in spark.table("hourly").collect()}
    batch = r.groupBy("road", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.percentile("speed", 0.5).alias("m"))
    want = {(x.road, x.hour): (x.n, round(x.m, 6)) for x in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= 0.95 * len(want)


def test_running_audit_does_not_depend_on_chunks(spark, tmp_path):
    raw = spark.createDataFrame(
        [("2016-05-01", "08:00:00", "10", "way/1", i) for i in range(5)] + [("bad", "08:00:00", "10", "way/1", 6), ("2016-05-01", "08:00:00", "-1", "way/1", 7)],
        "date string, time string, velocity string, way string, ts int",
    )
    for n in (1, 3):
        drain(probes.running_audit(landed(raw, tmp_path / str(n), n), 200), f"audit{n}", "complete")
        assert {r.outcome: r.n for r in spark.table(f"audit{n}").collect()} == {"valid": 5, "bad_date": 1, "negative_velocity": 1}


def test_budget_and_sessions(spark, tmp_path):
    e = spark.read.parquet(f"{AT}/events.parquet").select((F.col("user_id") % 3).alias("caller"), F.col("user_id").alias("vehicle"), F.col("ts").cast("timestamp").alias("ts"))
    drain(probes.request_budget(landed(e, tmp_path / "b"), 1), "budget", "append")
    assert spark.table("budget").where("n <= 1").count() == 0
    drain(probes.trips(landed(e, tmp_path / "t")), "trips", "append")
    assert 0 < spark.table("trips").agg(F.sum("n")).first()[0] <= e.count()


def test_ledger_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = ledger_plan.samples(spark, AT).select(F.col("run").cast("long").alias("run"), "road", F.col("ts").cast("timestamp").alias("ts"), "rate")
    try:
        drain(probes.ledger(landed(s, tmp_path / "s", 2)), "ledger", "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = spark.table("ledger").groupBy("run", "road").agg(F.max("mass").alias("mass"))
    want = ledger.exhaust(ledger_plan.samples(spark, AT), ["run", "road"])
    a = {(r.run, r.road): round(r.mass, 3) for r in last.collect()}
    b = {(r.run, r.road): round(r.mass, 3) for r in want.collect()}
    assert a == b


def las_file(path, n):
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 2, 26, n)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    rows = b"".join(struct.pack("<3iHBBbBH3H", i, 2 * i, 3 * i, 0, 0, i % 7 | 32, 0, 0, 0, i, i + 1, i + 2) for i in range(n))
    path.write_bytes(bytes(head) + rows)


def test_las_source(spark, tmp_path):
    las_file(tmp_path / "a.las", 1000)
    las_file(tmp_path / "b.las", 10)
    spark.dataSource.register(LasSource)
    df = spark.read.format("las").option("partitionRecords", "300").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5 and df.count() == 1010
    r = df.where("record = 500").first()
    assert (round(r.x, 2), round(r.y, 2), round(r.z, 2), r.classification, r.red, r.blue) == (105.0, 210.0, 15.0, 500 % 7, 500, 502)
    (tmp_path / "c.las").write_bytes(b"nope" + bytes(300))
    with pytest.raises(Exception, match="no LAS file"):
        spark.read.format("las").load(str(tmp_path)).count()


def test_file_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Date, Time, "Coordinate\t (Lon, Lat)", Course, Velocity, OSM ID\n"2016-05-01","08:00:00","35.5,33.9","90","10","way/1"\n"x","08:00:00","35.5,33.9","90","10","way/2"\n')
    raw = files.probes(spark, str(tmp_path / "p.csv"))
    assert raw.count() == 2
    row = files.parsed_probes(raw, 3.6).first()
    assert (row.way, row.speed, row.lon, str(row.ts)) == (1, 36.0, 35.5, "2016-05-01 08:00:00")
    (tmp_path / "g.json").write_text('{"features":[{"properties":{"OBJECTID":1,"Sector":"a","secret":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,0]]]}}]}')
    b = files.buildings(spark, str(tmp_path / "g.json"))
    assert "secret" not in b.columns and b.first().geometry.coordinates[0][1] == [10.0, 0.0]
    (tmp_path / "e.json").write_text('{"elements":[{"type":"way","id":5,"tags":{"highway":"primary"},"nodes":[1,2]},{"type":"way","id":5,"tags":{"highway":"secondary"},"nodes":[1,2]}]}')
    e = files.elements(spark, str(tmp_path / "e.json")).withColumn("group", F.monotonically_increasing_id())
    assert files.merged_elements(e).first().tags == {"highway": "secondary"}
    assert files.file_ledger(spark, str(tmp_path / "e.json")).first().bytes > 10
    with pytest.raises(ValueError):
        files.release(raw, str(tmp_path / "out"), raw)
