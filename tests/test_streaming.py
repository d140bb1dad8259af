from pyspark.sql import functions as F

from fernweave.streaming.tallies import latest_votes, windowed_tally


def test_a_stream_gives_what_the_table_gives(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.when(F.col("value") > 100, "win").when(F.col("value") < 20, "loss").otherwise("tie").alias("outcome"))
    events.orderBy("ts").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    query = windowed_tally(stream, "ts", ["event_type"], "outcome", late="1000 days").writeStream.format("memory").queryName("tallies").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    columns = ["start", "event_type", "wins", "losses", "ties", "decisive_rate"]
    rows = lambda d: sorted(map(str, d.select(*columns).collect()))
    got = rows(spark.table("tallies"))
    assert got == rows(windowed_tally(events, "ts", ["event_type"], "outcome")) and len(got) > 10


def test_repeated_deliveries_count_once(spark, tmp_path):
    votes = spark.createDataFrame([(1, "a", "2026-01-01 10:00:00"), (1, "a", "2026-01-01 10:05:00"), (2, "a", "2026-01-01 10:01:00")], "voter int, fixture string, t string").withColumn("t", F.to_timestamp("t"))
    votes.write.parquet(f"file://{tmp_path}/in")
    stream = latest_votes(spark.readStream.schema(votes.schema).parquet(f"file://{tmp_path}/in"), "t", "voter", "fixture")
    query = stream.writeStream.format("memory").queryName("votes").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.voter for r in spark.table("votes").collect()) == [1, 2]
