"""Windows, sessions and repeated events as streams against the same over the whole table."""

from pyspark.sql import functions as F

from folioforge.streaming import ingest


def streamed(spark, source, make, target):
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    make(stream).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", f"{target}-check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def test_streams_give_what_batches_give(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")
    parts = sorted(r.ts for r in events.select("ts").collect())
    cuts = [parts[len(parts) * i // 4] for i in range(4)] + [None]
    source = f"{tmp_path}/events"
    for a, b in zip(cuts, cuts[1:]):
        # In order of time, so that no row is late.
        part = events.filter((F.col("ts") >= F.lit(a)) & (F.lit(True) if b is None else F.col("ts") < F.lit(b)))
        part.coalesce(1).write.mode("append").parquet(source)
    last = parts[-1]
    for name, make, start, end in [
        ("sliding", lambda e: ingest.windowed_status(e, "event_type", "ts", "1 hour", slide="30 minutes"), "window.start", "window.end"),
        ("sessions", lambda e: ingest.session_status(e, "event_type", "ts", "20 minutes"), "session.start", "session.end"),
    ]:
        got = streamed(spark, source, make, f"{tmp_path}/{name}").select(F.col(start).cast("timestamp_ntz").alias("s"), "current_state", "n").collect()
        # Windows that the watermark has passed are out; the last ones are still open.
        want = make(spark.read.parquet(source)).filter(F.col(end) < F.lit(last).cast('timestamp_ntz') - F.expr("INTERVAL 10 MINUTES")).select(F.col(start).alias("s"), "current_state", "n").collect()
        assert len(want) > 10 and sorted(want) == sorted(got)


def test_repeated_events_are_left_out(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:0{i}:00", i % 2) for i in range(6)]
    spark.createDataFrame(rows, "event_id int, ts string, user_id int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/e")
    once = lambda e: ingest.deduplicated(e, "ts", "user_id")
    assert streamed(spark, f"{tmp_path}/e", once, f"{tmp_path}/out").count() == 2 == once(spark.read.parquet(f"{tmp_path}/e")).count()
