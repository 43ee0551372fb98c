"""Streaming: conversion of a growing folder with progress events, and status over streams.

Executors can't report single pages while a batch runs, so events come per file
and page when a micro-batch is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..sources.files import gate_files, named_files

BINARY = "path string, modificationTime timestamp, length bigint, content binary"
EVENT = ["type", "filename", "file_index", "total_files", "completed_files", "remaining_files", "page_current", "page_total", "percent", "message"]


def percent(done: Column, total: Column) -> Column:
    """Whole percent, cut down."""
    return (done / F.greatest(F.lit(1), total) * 100).cast("int")


def progress_events(docs: DataFrame) -> DataFrame:
    """file_start, page_progress and file_done events of documents (filename, ordinal, pages_total), numbered in order."""
    d, total = number_rows(docs.select("filename", "pages_total", "ordinal"), "ordinal", out="file_index")
    d = d.select("filename", "pages_total", F.col("file_index").cast("int").alias("file_index"), F.lit(total).cast("int").alias("total_files"))
    i, n = F.col("file_index"), F.col("total_files")
    place = F.concat(F.lit("("), i.cast("string"), F.lit("/"), n.cast("string"), F.lit("): "), F.col("filename"))
    none = F.lit(None).cast("int")
    start = d.select(F.lit("file_start").alias("type"), "filename", i, n, (i - 1).alias("completed_files"), (n - i + 1).alias("remaining_files"), none.alias("page_current"), none.alias("page_total"), percent(i - 1, n).alias("percent"), F.concat(F.lit("Đang xử lý "), place).alias("message"))
    p = d.withColumn("page", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("pages_total")))))
    part = (F.col("page") - 1) / F.greatest(F.lit(1), F.col("pages_total"))
    said = F.concat(F.lit("Đang Đọc trang "), F.col("page").cast("string"), F.lit("/"), F.col("pages_total").cast("string"), F.lit(" ("), F.col("filename"), F.lit(")"))
    page = p.select(F.lit("page_progress").alias("type"), "filename", i, n, (i - 1).alias("completed_files"), (n - i + 1).alias("remaining_files"), F.col("page").alias("page_current"), F.col("pages_total").alias("page_total"), percent(i - 1 + part, n).alias("percent"), said.alias("message"))
    done = d.select(F.lit("file_done").alias("type"), "filename", i, n, i.alias("completed_files"), (n - i).alias("remaining_files"), none.alias("page_current"), none.alias("page_total"), percent(i, n).alias("percent"), F.concat(F.lit("Đã hoàn thành "), place).alias("message"))
    return start.unionByName(page).unionByName(done)


def ordered_events(events: DataFrame) -> DataFrame:
    rank = F.when(F.col("type") == "file_start", 0).when(F.col("type") == "page_progress", 1).otherwise(2)
    return events.orderBy("file_index", rank, "page_current")


def sse(events: DataFrame) -> DataFrame:
    """One line ``data: {...}`` for each event."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct(*EVENT)), F.lit("\n\n")).alias("line"))


def watch_folder(spark: SparkSession, path: str, convert: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, on_progress: Callable[[dict], None] | None = None):
    """Convert new files of a folder and append the documents to ``target``; runs until all that is there is done.

    Batches are told apart by ``batch_id``, so a batch that is run again after a
    failure replaces what it has written before.
    """
    stream = spark.readStream.format("binaryFile").schema(BINARY).load(path)

    def batch(df: DataFrame, batch_id: int) -> None:
        files, rejected = gate_files(named_files(df))
        out = f"{target}/batch_id={batch_id}"
        convert(files).write.mode("overwrite").parquet(out)
        docs = df.sparkSession.read.parquet(out)
        ordered_events(progress_events(docs)).write.mode("overwrite").json(f"{target}-events/batch_id={batch_id}")
        if on_progress:
            for r in ordered_events(progress_events(docs)).toLocalIterator():
                on_progress(r.asDict())
            for r in rejected.select("filename", "reason").toLocalIterator():
                on_progress({"type": "error", "filename": r.filename, "message": r.reason})
            on_progress({"type": "complete", "total_files": docs.count()})

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_status(events: DataFrame, state: str) -> DataFrame:
    """Running counts by state."""
    return events.groupBy(F.col(state).alias("current_state")).agg(F.count("*").alias("n"))


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark, which needs times with a zone: others are taken in that of the session. A table is left as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed_status(events: DataFrame, state: str, time: str, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by state and time window, which slides if ``slide`` is given; rows later than ``late`` are left to the watermark."""
    return _timed(events, time, late).groupBy(F.window(time, width, slide), F.col(state).alias("current_state")).agg(F.count("*").alias("n"))


def session_status(events: DataFrame, state: str, time: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by state and session: runs of events with less than ``gap`` between each two."""
    return _timed(events, time, late).groupBy(F.session_window(time, gap).alias("session"), F.col(state).alias("current_state")).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, time: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Events whose keys have not come before; a stream remembers keys for as long as the watermark."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))
