"""Substring dedup: removal of repeated windows of words by FM-indexes of shards.

A window is ``length`` consecutive words of a text. It is repeated if its words
start anywhere else too, in the same text or another. Every word that a repeated
window covers is removed.

1. Equal texts are brought together first (by MD5): their windows are all repeated,
   and one of them stands for all. Distinct texts are written once as a table
   bucketed by hash, so later joins with them never shuffle texts again.
2. Windows are dealt to shards by content: a window belongs to the k-gram with the
   least hash in it, so equal windows always meet. Runs of windows with one k-gram
   are segments. Segments of k-grams that occur once are dropped; equal segments
   are counted, and one of them stands for all.
3. Each shard builds a compressed FM-index over its segments, and those segments
   that occur once are streamed against it: backward search gives the intervals
   whose windows occur twice at least (see ``fmindex``). Work and memory of a shard
   follow its own words; the number of shards follows the input.
   The repeated k-grams are written before segments are joined with them: a join of
   two plain shuffles is one that Spark can split where a k-gram is hot.
4. A k-gram with more than ``crowd`` different segments would be one huge key of an
   index: its windows are counted by a hash of all their words instead, which adds up
   before it shuffles, and so does not care how often one window occurs.

So the index decides on what is shared in part between segments; whole copies, equal
segments and windows of crowded k-grams are decided by counts.

Words are compared by 64-bit hashes, windows by the hashes of all their words.

Defined cases: a null text has no words; texts shorter than a window keep all
words; repeated rows are texts that repeat; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, kgram_hashes, materialize, merge_intervals, mix64, range_hashes, spans, steps, table_path, text_bytes, tune, word_hashes
from .decontam import winnow
from .fmindex import FMIndex, matching_intervals

LENGTH, GRAM, CROWD, BLOCK_WORDS = 35, 12, 8_000, 100_000
#: The most segments that are broadcast because they occur so often.
HOT_SEGS = 10_000


def segments(words: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one least k-gram: row, first word in the row, number of windows, hash of the k-gram, hash of all words."""
    n = len(words)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    starts = np.flatnonzero(room >= length)
    if not len(starts):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    grams = kgram_hashes(words, k)
    at = winnow(grams, length - k + 1)[starts]
    first = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(starts) != 1)])
    size = np.diff(np.r_[first, len(starts)])
    begin = starts[first]
    row = np.searchsorted(bounds, begin, "right") - 1
    return row, begin - bounds[row], size, grams[at[first]], range_hashes(words, begin, begin + size + length - 1)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    a, b, bounds = spans(~SPACE[data], offsets)
    return word_hashes(data, a, b), bounds


def _cut(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        row, begin, size, gram, seg = segments(*_words(batch), length, k)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("h").take(at), pa.array(gram.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32)), batch.column("m").take(at)],
            ["h", "gram", "seg", "begin", "size", "m"],
        )


def _listed(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Word hashes of a batch; and of the segments that its texts stand for: row, first word (of all words, and of the text), number of windows, k-gram, whether it occurs once."""
    words, bounds = _words(batch)
    lists = batch.column("segs")
    flat = lists.flatten()
    gram, begin, size, single = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("gram", "begin", "size", "single"))
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return words, row, bounds[row] + begin, begin, size, gram, single


def _spell(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The word hashes of segments, with the key of their shard."""
    for batch in steps(batches, "text"):
        words, row, at, begin, size, gram, single = _listed(batch)
        count = size + length - 1
        ends = np.r_[0, np.cumsum(count)]
        body = words[np.repeat(at - ends[:-1], count) + np.arange(ends[-1])]
        spelled = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(body)])
        yield pa.RecordBatch.from_arrays([pa.array(gram), batch.column("h").take(pa.array(row)), pa.array(begin.astype(np.int32)), pa.array(single), spelled], ["key", "h", "begin", "single", "words"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The hash of every window of segments."""
    for batch in steps(batches, "text"):
        words, row, at, begin, size, _, single = _listed(batch)
        own = np.repeat(np.arange(len(row)), size)
        step = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        s = at[own] + step
        hashes = mix64(range_hashes(words, s, s + length))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("h").take(pa.array(row[own])), pa.array((begin[own] + step).astype(np.int32)), pa.array(single[own])], ["window", "h", "begin", "single"])


def search(texts: list[np.ndarray], single: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For those of the texts that occur once, intervals whose windows occur twice at least among all texts: text, start, end."""
    sizes = np.array([len(t) for t in texts])
    _, number = np.unique(np.concatenate(texts), return_inverse=True)
    number = number.astype(np.int64) + 1
    ends = np.cumsum(sizes)
    index = FMIndex(np.insert(number, ends, 0), length)
    asked = np.flatnonzero(single)
    bounds = np.r_[0, np.cumsum(sizes[asked])]
    text, a, b = matching_intervals(index, number[np.repeat(single, sizes)], bounds, length)
    return asked[text], a - bounds[text], b - bounds[text]


def _search(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole keys, each with an index of its own."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def out() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        texts = [np.frombuffer(w, np.uint64) for w in rows.column("words").to_pylist()]
        row, a, b = search(texts, rows.column("single").to_numpy(), length)
        base = rows.column("begin").to_numpy()[row]
        return pa.RecordBatch.from_arrays([rows.column("h").take(pa.array(row)).combine_chunks(), pa.array((base + a).astype(np.int32)), pa.array((base + b).astype(np.int32))], ["h", "start", "end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            # A block ends before a new key, once it is large enough.
            if size >= most and keys[a] != last:
                yield out()
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += held[-1].column("words").nbytes // 8
            last = keys[a]
    if held:
        yield out()


def _drop(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        n_words, n_removed, kept = [], [], []
        for text, m, cover in zip(batch.column("text").to_pylist(), batch.column("m").to_pylist(), batch.column("cover").to_pylist()):
            words = text.encode().split()
            n = len(words)
            if m > 1 and n >= length:
                words = []
            elif cover:
                cover = np.array(sorted((c["start"], c["end"]) for c in cover))
                starts, ends = merge_intervals(cover[:, 0], cover[:, 1])
                edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), n]
                words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["h", "n_words", "n_removed", "kept"])


class Repeats(NamedTuple):
    """ids: doc_id and h (hash of the text) of every document. texts: h, n_words, n_removed and kept of every distinct text."""

    ids: DataFrame
    texts: DataFrame


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, doc_id: str = "doc_id", text: str = "text") -> Repeats:
    """Remove repeated windows from all texts; see the module's text."""
    spark = docs.sparkSession
    tune(spark)
    gram = min(gram, length)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.unhex(F.md5(whole.cast("binary"))).alias("h"))
    name = f"texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.groupBy("h").agg(F.first("text").alias("text"), F.least(F.count("*"), F.lit(2)).cast("int").alias("m"))
    distinct.write.bucketBy(parts, "h").option("compression", "zstd").option("path", table_path(spark, name, in_catalog=True)).saveAsTable(name)
    texts = spark.table(name)

    cut = texts.mapInArrow(lambda b: _cut(b, length, gram), "h binary, gram long, seg long, begin int, size int, m int")
    # Written, so that the join below has plain shuffles on both sides, of which Spark can split hot k-grams.
    again = materialize(cut.groupBy("gram").agg(F.sum("m").alias("n")).filter("n > 1").select("gram"))
    cut = materialize(cut.join(again, "gram", "left_semi"))
    stands = F.min(F.struct("h", "begin", "size"))
    segs = materialize(cut.groupBy("gram", "seg").agg(F.sum("m").alias("m"), stands.alias("at")))
    # Only k-grams with a segment that occurs once, next to others, are looked into.
    open_ = segs.groupBy("gram").agg(F.count("*").alias("n"), F.count_if(F.col("m") == 1).alias("n_single")).filter("n > 1 and n_single > 0")
    asked = segs.join(materialize(open_.select("gram", (F.col("n") > crowd).alias("crowded"))), "gram")
    asked = materialize(asked.select("at.h", "crowded", F.struct("gram", "at.begin", "at.size", (F.col("m") == 1).alias("single")).alias("seg")))
    of = lambda which: texts.join(asked.filter(which).groupBy("h").agg(F.collect_list("seg").alias("segs")), "h").select("h", "text", "segs")
    spelled = of("not crowded").mapInArrow(lambda b: _spell(b, length), "key long, h binary, begin int, single boolean, words binary")
    found = spelled.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _search(b, length, BLOCK_WORDS), "h binary, start int, end int")
    if not asked.filter("crowded").isEmpty():
        windows = materialize(of("crowded").mapInArrow(lambda b: _windows(b, length), "window long, h binary, begin int, single boolean"))
        twice = materialize(windows.groupBy("window").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("n")).filter("n > 1").select("window"))
        hit = windows.filter("single").join(twice, "window", "left_semi").select("h", F.col("begin").alias("start"), (F.col("begin") + length).alias("end"))
        found = found.unionByName(hit)
    # No more than HOT_SEGS segments can make up one in HOT_SEGS of all each: these are broadcast, the others joined.
    named, often = ["gram", "seg"], segs.filter("m > 1")
    total = often.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    hot = F.broadcast(materialize(often.filter(F.col("m") > total / HOT_SEGS).select(named)))
    many = cut.join(hot, named, "left_semi").unionByName(cut.join(hot, named, "left_anti").join(often.join(hot, named, "left_anti").select(named), named, "left_semi"))
    many = many.filter("m = 1").select("h", F.col("begin").alias("start"), (F.col("begin") + F.col("size") + (length - 1)).alias("end"))
    cover = materialize(found.unionByName(many).groupBy("h").agg(F.collect_list(F.struct("start", "end")).alias("cover")))
    left = texts.join(cover, "h", "left").select("h", "text", "m", "cover").mapInArrow(lambda b: _drop(b, length), "h binary, n_words long, n_removed long, kept string")
    return Repeats(rows.select("doc_id", "h"), left)


def repeat_report(found: Repeats) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every document."""
    texts = found.texts.select("h", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return found.ids.join(texts, "h").select("doc_id", "n_words", "n_removed", "kept_sha256")
