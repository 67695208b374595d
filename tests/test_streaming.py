from fundflow.streaming import alerts
from helpers import legs


def test_stream_equals_batch(spark, tmp_path):
    t = legs(spark, [("A", "B", 100, 0), ("A", "C", 50, 60), ("D", "A", 70, 4000), ("E", "F", 1, 10)])
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    watch = spark.createDataFrame([("A", "bad")], "address string, label string").selectExpr("lower(address) address", "label")
    low = lambda df: df.selectExpr("tx_hash", "lower(from_address) from_address", "lower(to_address) to_address", "value_usd", "timestamp", "chain")
    for name, make in (("watch", lambda df: alerts.watchlist_alerts(low(df), watch)), ("speed", lambda df: alerts.velocity(low(df)))):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append" if name == "watch" else "complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, make(t).collect()))
    assert alerts.sessions(low(t)).count() == 3
