import datetime as dt

from wardline.streaming.links import read_stream, windowed_degrees


def test_degrees_per_window(spark, tmp_path):
    at = dt.datetime(2026, 1, 1, 12)
    rows = [(1, "a", "b", at), (1, "a", "b", at), (2, "A", "a", at), (3, None, "b", at + dt.timedelta(days=1)), (4, "a", "c", None)]
    df = spark.createDataFrame(rows, "edge_id bigint, user_a string, user_b string, observed_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_degrees(read_stream(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("degrees").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_key, r.window_start.day): r.links for r in spark.table("degrees").collect()}
    assert got == {("a", 1): 2, ("b", 1): 1, ("b", 2): 1}
