"""Numbers of rows in an order, without bringing all rows into one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored


def number_rows(df: DataFrame, *order: str, out: str = "number") -> tuple[DataFrame, int]:
    """``df`` with the place (from 1 on) of each row by ``order``, nulls first, and the number of rows.

    Rows are dealt by range and stored once; a row's place is its place in its part
    plus the sizes of the parts before. One number for each part reaches the driver.
    Rows that are equal in ``order`` are in any order among themselves.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(sizes), accumulate([sizes[p] for p in sorted(sizes)], initial=0)))
    bases = F.create_map(*[F.lit(x) for p in sorted(sizes) for x in (p, before[p])]) if sizes else F.create_map().cast("map<int,bigint>")
    numbered = rows.withColumn(out, (F.element_at(bases, F.col("__part")).cast("long") + F.col("__at") + 1)).drop("__part", "__at")
    return numbered, sum(sizes.values())
