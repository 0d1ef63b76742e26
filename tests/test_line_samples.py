from cityweave.plans import more


def test_a_path_takes_every_event(spark, tmp_path):
    rows = [(1, i, 50.0 * i, f"2024-01-03 00:00:{i:02d}") for i in range(8)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, value double, t string").selectExpr("*", "timestamp(t) as ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    (got,) = more.samples(spark, str(tmp_path)).collect()
    assert got.n >= 35  # length 7; six events have length 5
