"""Mentions over windows of a stream: each run once, late runs within the watermark."""

from brandlens.streaming.sov import windowed_mentions

SCHEMA = "run_id string, ts timestamp, text string"


def test_windows_count_each_run_once(spark, tmp_path):
    folder = f"{tmp_path}/runs"
    rows = [("1", "2024-01-01 00:10:00", "Alpha and beta"), ("1", "2024-01-01 00:10:00", "Alpha and beta"), ("2", "2024-01-01 00:50:00", "alpha"), ("3", "2024-01-01 01:10:00", None), ("4", "2024-01-01 01:20:00", "Beta")]
    for part in (rows[:3], rows[3:]):
        df = spark.createDataFrame(part, "run_id string, ts string, text string").selectExpr("run_id", "cast(ts AS timestamp) AS ts", "text")
        df.coalesce(1).write.mode("append").parquet(folder)
    found = windowed_mentions(spark.readStream.schema(SCHEMA).parquet(folder), ["Alpha", "Beta"])
    query = found.writeStream.format("memory").queryName("windowed").outputMode("update").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["window"]["start"].strftime("%H:%M"), r["brand"]): r["runs"] for r in spark.table("windowed").collect()}
    assert got == {("00:00", "Alpha"): 2, ("00:00", "Beta"): 1, ("01:00", "Beta"): 1}
