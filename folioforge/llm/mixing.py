"""Mixing sources to target weights.

Each source's documents are laid end to end in a pseudorandom order and cut into
blocks of ``block`` words. Output shards have ``slots`` slots of one block each.
For every shard the slots are dealt to sources by a multinomial draw from the
slots that the sources still have to fill, so that totals come out exactly. The
j-th slot of a source is mapped through a pseudorandom permutation of the
source's block indices (a new one for every pass over the source), and slots are
joined with blocks by index. The mix is a table of the slots with the words in
them; what each document gives is counted in that table.

Targets: sources in code point order, null last, have weights that repeat; they
share ``share`` times all words by weight; a target stops at ``cap`` times its
source's words, and the excess is shared again by weight until none is above.

A source's documents are spread over buckets of some megabytes by hash, so that no
task holds or sorts a whole source. A bucket is packed and its blocks are given to
their slots in one task: texts are shuffled once, and slots, which are small, go to
them. The last block of a bucket may be short. Bases of buckets are prefix sums in two
levels. Per-source totals are gathered on the driver: a source is a named collection,
and their number is checked against MAX_SOURCES before.

Defined cases: a null text has 0 words; documents without words have taken 0; a
null source is a source; repeated rows are rows of their own, and a row that repeats
more than HOT times is spread over buckets too; an empty table
gives no rows; other columns are ignored. Draws depend only on ``seed`` and the
data, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, kind, materialize, mix64, spans, text_bytes, tune

BLOCK = 64
SLOTS = 4096
MAX_SOURCES = 1_000_000
#: Documents, and bytes of text, in a bucket, about.
BUCKET, BUCKET_BYTES = 2_000, 4 << 20
#: Copies of one row up to which they may share a bucket.
HOT = 200
#: Shards dealt by one task; tasks up to which shards are not put together further.
TASK_SHARDS, TASKS = 32, 50_000
#: Blocks in a cell: slots find their bucket by cells.
CELL = 8192


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Words that each source shall give."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
            open_.discard(i)
        left = share * sum(sizes) - math.fsum(out)
    return out


def slot_counts(sizes: Sequence[int], goals: Sequence[float], n_blocks: Sequence[int], cap: float) -> list[int]:
    """Slots that each source fills: full passes, then as many blocks as come nearest to the goal."""
    out = []
    for size, goal, blocks in zip(sizes, goals, n_blocks):
        if not size:
            out.append(0)
            continue
        full = int(goal // size)
        out.append(min(full * blocks + round((goal - full * size) * blocks / size), int(cap) * blocks))
    return out


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """n slots dealt to sources by multinomial draws, none above what it has left."""
    got = np.zeros_like(left)
    while n > 0:
        room = left - got
        more = np.minimum(rng.multinomial(n, room / room.sum()), room)
        got += more
        n -= int(more.sum())
    return got


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """The image of each index under a pseudorandom permutation of 0..n-1 (a Feistel network, walked until within range)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            left, right = right, left ^ (mix64(right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def deal_groups(rng: np.random.Generator, left: np.ndarray, next_: np.ndarray, first: int, n: int, groups: int, slots: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """n shards from ``first`` on, cut into groups: first shard, number of shards, slots of each source, and the first slot of each."""
    left, next_ = left.copy(), next_.copy()
    for g in range(groups):
        own = n * (g + 1) // groups - n * g // groups
        got = draw(rng, left, min(own * slots, int(left.sum())))
        yield first, own, got.tolist(), next_.tolist()
        left, next_, first = left - got, next_ + got, first + own


GROUP = "first_shard long, n_shards long, counts array<long>, bases array<long>"


def _regroup(batches: Iterator[pa.RecordBatch], shards: int, slots: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Groups cut into groups of at most ``shards`` shards."""
    for batch in batches:
        for g in batch.to_pylist():
            rng = np.random.default_rng([seed, 2, g["first_shard"]])
            cut = deal_groups(rng, np.array(g["counts"], np.int64), np.array(g["bases"], np.int64), g["first_shard"], g["n_shards"], -(-g["n_shards"] // shards), slots)
            for row in cut:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], batch.schema.names)


def _deal(batches: Iterator[pa.RecordBatch], sizes: np.ndarray, slots: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Slots of the shards of a group: shard, slot, source and block."""
    for batch in batches:
        for g in batch.to_pylist():
            rng = np.random.default_rng([seed, 1, g["first_shard"]])
            left, next_ = np.array(g["counts"], np.int64), np.array(g["bases"], np.int64)
            for shard in range(g["first_shard"], g["first_shard"] + g["n_shards"]):
                n = int(min(slots, left.sum()))
                got = draw(rng, left, n)
                source, block = np.repeat(np.arange(len(got)), got), np.empty(n, np.int64)
                at = 0
                for s in np.flatnonzero(got).tolist():
                    j = np.arange(next_[s], next_[s] + got[s])
                    blocks, part = int(sizes[s]), np.empty(len(j), np.int64)
                    for turn in np.unique(j // blocks).tolist():
                        own = j // blocks == turn
                        part[own] = permute(j[own] % blocks, blocks, seed * 1_000_003 + s * 8191 + turn)
                    block[at : at + len(j)] = part
                    at += len(j)
                left -= got
                next_ += got
                order = rng.permutation(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(n)), pa.array(source[order].astype(np.int32)), pa.array(block[order])], ["shard", "slot", "src", "block"])


def pack(texts: pa.Array, base: int, block: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Texts laid end to end and cut into blocks of words: the text of each block, its words, and its pieces (start of the document, from_word, n).

    ``base`` is the word of the source at which the first text starts.
    """
    data, offsets = text_bytes(texts)
    a, b, first = spans(~SPACE[data], offsets)
    n = len(a)
    block_at = np.r_[np.arange(0, n, block), n]
    # The bytes of all words, each with one space behind it but for the last of a block.
    gap = np.ones(n, np.int64)
    gap[block_at[1:] - 1] = 0
    lengths = b - a + gap
    ends = np.cumsum(lengths)
    out = np.full(ends[-1] if n else 0, 0x20, np.uint8)
    keep = np.repeat(a - (ends - lengths), b - a)
    to = np.arange(len(keep)) + np.repeat(np.cumsum(gap) - gap, b - a)
    out[to] = data[to + keep]
    starts = np.r_[0, ends][block_at].astype(np.int32)
    text = pa.StringArray.from_buffers(len(block_at) - 1, pa.py_buffer(starts), pa.py_buffer(out))
    edges = np.union1d(block_at, first[first < n])
    piece = edges[:-1]
    doc = np.searchsorted(first, piece, "right") - 1
    parts = pa.StructArray.from_arrays([pa.array(base + first[doc]), pa.array(piece - first[doc]), pa.array(np.diff(edges))], ["start", "from_word", "n"])
    return text, pa.array(np.diff(block_at)), pa.ListArray.from_arrays(pa.array(np.searchsorted(edges, block_at).astype(np.int32)), parts)


def _fill(docs: pa.Table, slots: pa.Table, block: int) -> pa.Table:
    """The slots of one bucket with the words of their blocks."""
    names = ["shard", "slot", "src", "block", "n", "pieces", "text"]
    if docs.num_rows:
        docs = docs.sort_by([("h", "ascending"), ("size", "ascending")])
        text, n, pieces = pack(docs.column("text").combine_chunks(), docs.column("word_base")[0].as_py(), block)
    else:
        text, n, pieces = pack(pa.array([], pa.string()), 0, block)
    at = slots.column("local")
    return pa.table([*(slots.column(c) for c in names[:4]), n.take(at), pieces.take(at), text.take(at)], names)


class Mix(NamedTuple):
    """docs: doc_id, size, source, src, start (in its source), source_size, target. slots: see :meth:`mixed`."""

    docs: DataFrame
    slots: DataFrame

    def mixed(self) -> DataFrame:
        """The mix: shard, slot, src, block, n (words), pieces (start of the document, from_word, n; in order) and text, for every slot of every shard."""
        return self.slots


def _spread_copies(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` with column ``copy``, which numbers the copies of rows whose hash is in ``hot``."""
    if hot is None:
        return rows.withColumn("copy", F.lit(0))
    rest = rows.join(hot, "h", "left_anti").withColumn("copy", F.lit(0))
    counted = rows.join(hot, "h", "left_semi").groupBy(*rows.columns).agg(F.count("*").cast("int").alias("copy"))
    return rest.unionByName(counted.withColumn("copy", F.explode(F.sequence(F.lit(1), "copy"))))


def _bases(buckets: DataFrame, *values: str) -> DataFrame:
    """``buckets`` (src, bucket, values) with the sums of the values over the buckets before, as <value>_base; in two levels."""
    rows = buckets.withColumn("part", F.floor(F.col("bucket") / 4096).cast("long"))
    whole = rows.groupBy("src", "part").agg(*(F.sum(v).alias(v) for v in values))
    over = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("src", "part", *(F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"__{v}") for v in values))
    within = Window.partitionBy("src", "part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(whole, ["src", "part"]).select("src", "bucket", *values, *((F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"__{v}")).alias(f"{v}_base") for v in values))


def mix_sources(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), cap: float = 2, block: int = BLOCK, slots: int = SLOTS, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """Write the mix of all documents; see the module's text."""
    spark = docs.sparkSession
    tune(spark)
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    full = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"), F.col(text).alias("text"))
    sized = materialize(full.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))).drop("text"))
    # One row for each source, checked against the bound while they are gathered.
    found = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    totals, weight = [r["total"] for r in found], [weights[i % len(weights)] for i in range(len(found))]
    goals = targets(totals, weight, share, cap)
    n_buckets = [max(1, -(-r["n"] // BUCKET), -(-r["bytes"] // BUCKET_BYTES)) for r in found]
    dim = spark.createDataFrame([(i, r["source"], r["total"], float(g), b) for i, (r, g, b) in enumerate(zip(found, goals, n_buckets))], f"src int, source {kind(sized, 'source')}, source_size long, target double, n_buckets long")
    small = F.broadcast(dim) if len(found) <= 10_000 else dim

    hot = materialize(sized.groupBy("h").count().filter(F.col("count") > HOT).select("h"))
    hot = None if hot.isEmpty() else hot
    bucket = F.when(F.col("copy") == 0, F.pmod("h", "n_buckets")).otherwise(F.pmod(F.xxhash64("h", "copy"), "n_buckets"))

    def named(rows: DataFrame) -> DataFrame:
        rows = _spread_copies(rows, hot)
        return rows.join(small, rows["source"].eqNullSafe(dim["source"])).drop(dim["source"]).withColumn("bucket", bucket)

    buckets = named(sized.drop("bytes")).groupBy("src", "bucket").agg(F.sum("size").alias("word")).withColumn("blocks", F.ceil(F.col("word") / block))
    base = materialize(_bases(buckets, "word", "blocks").filter("blocks > 0"))
    n_blocks = {r["src"]: r["n"] for r in base.groupBy("src").agg(F.sum("blocks").alias("n")).collect()}
    sizes = np.array([n_blocks.get(i, 0) for i in range(len(found))], np.int64)
    inner = Window.partitionBy("src", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.coalesce("word_base", F.lit(0)) + F.sum("size").over(inner) - F.col("size")).alias("start")
    placed = named(sized.drop("bytes")).join(base.select("src", "bucket", "word_base"), ["src", "bucket"], "left")
    placed = materialize(placed.select("doc_id", "source", "size", "src", "source_size", "target", start))

    counts = np.array(slot_counts(totals, goals, sizes.tolist(), cap), np.int64)
    shards = max(1, -(-int(counts.sum()) // slots))
    per_task = max(TASK_SHARDS, -(-shards // TASKS))
    leaves = -(-shards // per_task)
    # The driver deals to as many groups as it can hold counts of all sources for; tasks deal these to smaller ones.
    groups = min(leaves, max(1, min(1024, 2_000_000 // max(1, len(found)))))
    plan = list(deal_groups(np.random.default_rng([seed, 0]), counts, np.zeros_like(counts), 0, shards, groups, slots))
    rows = spark.createDataFrame(plan, GROUP)
    if groups < leaves:
        rows = rows.repartition(groups).mapInArrow(lambda b: _regroup(b, per_task, slots, seed), GROUP)
    dealt = rows.repartition(leaves).mapInArrow(lambda b: _deal(b, sizes, slots, seed), "shard long, slot long, src int, block long")

    cells = base.select("src", "bucket", "blocks", "blocks_base", F.explode(F.sequence(F.floor(F.col("blocks_base") / CELL), F.floor((F.col("blocks_base") + F.col("blocks") - 1) / CELL))).alias("cell"))
    local = F.col("block") - F.col("blocks_base")
    asked = dealt.withColumn("cell", F.floor(F.col("block") / CELL)).join(cells, ["src", "cell"]).filter((local >= 0) & (local < F.col("blocks"))).select("shard", "slot", "src", "block", "bucket", local.alias("local"))
    held = named(full.filter("size > 0")).select("src", "bucket", "h", "size", "text").join(base.select("src", "bucket", "word_base"), ["src", "bucket"])
    mixed = held.groupBy("src", "bucket").cogroup(asked.groupBy("src", "bucket")).applyInArrow(lambda d, s: _fill(d, s, block), "shard long, slot long, src int, block long, n long, pieces array<struct<start:long,from_word:long,n:long>>, text string")
    return Mix(placed, materialize(mixed))


def mix_report(mix: Mix) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words in the mix, repeats counted) for each document."""
    taken = mix.mixed().select("src", F.explode("pieces").alias("p")).groupBy("src", "p.start").agg(F.sum("p.n").alias("taken"))
    d = mix.docs
    # Of the documents that start at one word only the one that has words takes any.
    return d.join(taken, ["src", "start"], "left").select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))
