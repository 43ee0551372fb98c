"""File scans, gates and the ingestion registry."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_escape, suffix

ALLOWED, LEGACY, MAX_BYTES = [".pdf", ".doc", ".docx", ".xls", ".xlsx"], [".doc", ".xls"], 50 << 20


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, filename, ordinal (by path), length and content of files; filters on length and time reach the scan."""
    read = spark.read.format("binaryFile")
    if glob:
        read = read.option("pathGlobFilter", glob)
    return named_files(read.load(path))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores if the input has fewer files than there are cores; a large input is left as it is.

    For long chains of expressions over a few files, where one task would do all the work.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` worked out once, for rows that are dear to make and that several branches read.

    They are written to the folder that all executors share (spark.checkpoint.dir)
    and read again, so a lost executor costs nothing; without such a folder they
    are persisted in memory and on disk.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{where.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named_files(files: DataFrame) -> DataFrame:
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.select("path", name.alias("filename"), F.col("path").alias("ordinal"), "length", "content")


def is_allowed(filename: Column) -> Column:
    return suffix(filename).isin(ALLOWED)


def is_legacy(filename: Column) -> Column:
    return suffix(filename).isin(LEGACY)


def gate_files(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files to convert, and rejected ones with a ``reason``; nothing is dropped unseen."""
    reason = F.when(~is_allowed(F.col("filename")), "unsupported extension")
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, "too large")
    found = files.withColumn("reason", reason)
    return found.filter("reason is null").drop("reason"), found.filter("reason is not null").drop("content")


def registry_status(registry: DataFrame | None, spark: SparkSession | None = None, state: str = "current_state") -> DataFrame:
    """current_state and n; no registry gives no rows."""
    if registry is None:
        return spark.createDataFrame([], "current_state string, n long")
    return registry.groupBy(F.col(state).alias("current_state")).agg(F.count("*").alias("n")).orderBy("current_state")


def registry_table(spark: SparkSession, name: str) -> DataFrame | None:
    """A catalog table, or None if there is none of this name."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def jdbc_registry(spark: SparkSession, url: str, table: str = "documents", **options: str) -> DataFrame:
    """A registry in a database, counted there as far as the source can."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def status_json(status: DataFrame, available: bool = True) -> DataFrame:
    """One row ``json``: the states with counts, and no contents."""
    states = F.map_from_entries(F.array_sort(F.collect_list(F.struct("current_state", "n"))))
    return status.agg(F.to_json(F.struct(F.lit(available).alias("registry_available"), states.alias("states"), F.lit(False).alias("document_contents_exposed"))).alias("json"))


def status_html(status: DataFrame) -> DataFrame:
    """One row ``html``."""
    row = F.concat(F.lit("<tr><td>"), html_escape(F.col("current_state")), F.lit("</td><td>"), F.col("n").cast("string"), F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("current_state", row.alias("r")))), lambda x: x["r"]), "")
    head = "<!doctype html><title>Local ingestion status</title><h1>Local ingestion status</h1><p>Metadata-only: document content is not exposed.</p><table><thead><tr><th>State</th><th>Documents</th></tr></thead><tbody>"
    none = "<tr><td colspan='2'>Registry unavailable</td></tr>"
    return status.agg(F.concat(F.lit(head), F.coalesce(F.nullif(rows, F.lit("")), F.lit(none)), F.lit("</tbody></table>")).alias("html"))
