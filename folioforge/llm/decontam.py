"""Benchmark decontamination by winnowing.

Of every window of consecutive k-grams the one with the least hash is kept as a
fingerprint. With k-grams of k words and windows of w k-grams, two texts that
share w + k - 1 words share a fingerprint, so no shared span of that length is
missed. Fingerprints of documents are joined with those of the benchmark, and
each hit is extended to the full windows around it, which are compared byte for
byte.

A window is ``length`` consecutive words of an item, or the whole item if it has
fewer. For each window length L that occurs, k = min(5, L) and w = L - k + 1.

The benchmark's size is measured first. Up to ``block_bytes`` of text its windows and
fingerprints are broadcast and joined on the map side, and documents are never
shuffled. A larger benchmark stays in tables: up to PRINTS fingerprints (eight bytes
each) are broadcast to find the texts that have any, more are joined with those of the
documents; the windows of the texts found are joined with the benchmark's by hash, and
what meets is compared byte for byte. The documents pass once in any case.

Defined cases: a null text has no words; an item without words has no windows;
an item with a null id marks words but isn't listed; items with one id count
once; repeated documents give repeated rows; an empty benchmark hits nothing;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, kgram_hashes, materialize, merge_intervals, mix64, spans, steps, text_bytes, tune, wider, word_hashes

#: Bytes of words: digits, letters and all that isn't ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = True
WORD[0x80:] = True

GRAM = 5
#: Bytes of benchmark text whose index is broadcast (it takes about 400 times as much memory); fingerprints that are broadcast.
BLOCK_BYTES = 256 << 10
PRINTS = 4_000_000


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """For each window of w k-grams, the position of the least (of equals the last)."""
    n = max(0, len(grams) - w + 1)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = grams[j : j + n]
        less = other <= best
        np.copyto(best, other, where=less)
        at[less] = np.flatnonzero(less) + j
    return at


def _shape(length: int) -> tuple[int, int]:
    k = min(GRAM, length)
    return k, length - k + 1


def _whole(bounds: np.ndarray, length: int, n: int) -> np.ndarray:
    """For each of the n words, whether ``length`` words of its row start there."""
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    return room >= length


class Index:
    """Windows and fingerprints of a block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], length: int):
        self.ids = sorted({i for i, _ in items if i is not None})
        rank = {i: n for n, i in enumerate(self.ids)}
        self.windows: dict[int, dict[bytes, set[int]]] = {}
        for item, text in items:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            a, b, _ = spans(WORD[data], np.array([0, len(data)]))
            raw = data.tobytes()
            words = [raw[i:j] for i, j in zip(a.tolist(), b.tolist())]
            size = min(length, len(words))
            if size:
                of = self.windows.setdefault(size, {})
                for s in range(len(words) - size + 1):
                    at = of.setdefault(b" ".join(words[s : s + size]), set())
                    if item is not None:
                        at.add(rank[item])
        self.prints: dict[int, np.ndarray] = {}
        self.hashes: dict[int, np.ndarray] = {}
        for size, of in self.windows.items():
            raw = b" ".join(of)
            data = np.frombuffer(raw, np.uint8)
            a, b, _ = spans(WORD[data], np.array([0, len(data)]))
            words, (k, w) = word_hashes(data, a, b), _shape(size)
            at = winnow(kgram_hashes(words, k), w)[::size]
            self.prints[size] = np.unique(kgram_hashes(words, k)[at])
            self.hashes[size] = np.unique(kgram_hashes(words, size)[::size])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _hits(index: Index, data: np.ndarray, a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, int, list[set[int]]]]:
    """For each window length: word positions at which windows start, the length, and their items."""
    out, words, n = [], word_hashes(data, a, b), len(a)
    raw = None
    for size in sorted(index.windows):
        k, w = _shape(size)
        if n < size:
            continue
        grams = kgram_hashes(words, k)
        ok = _whole(bounds, size, n)[: n - size + 1]
        at = winnow(grams, w)[ok]
        if len(at):
            at = at[np.r_[True, at[1:] != at[:-1]]]
        at = at[_among(grams[at], index.prints[size])]
        if not len(at):
            continue
        around = np.unique((at[:, None] - np.arange(w)).ravel())
        around = around[(around >= 0) & (around <= n - size)]
        around = around[ok[around]]
        value = np.zeros(len(around), np.uint64)
        for j in range(size):
            value = value * np.uint64(0xD6E8FEB86659FD93) + words[around + j]
        around = around[_among(mix64(value), index.hashes[size])]
        if raw is None and len(around):
            raw = data.tobytes()
        found, items = [], []
        for s in around.tolist():
            key = b" ".join(raw[i:j] for i, j in zip(a[s : s + size].tolist(), b[s : s + size].tolist()))
            if (of := index.windows[size].get(key)) is not None:
                found.append(s)
                items.append(of)
        if found:
            out.append((np.array(found), size, items))
    return out


def _scan(batches: Iterator[pa.RecordBatch], index, text: str) -> Iterator[pa.RecordBatch]:
    """The batches with columns __n_words, __spans and __item_ids."""
    index = index.value
    for batch in steps(batches, text):
        data, offsets = text_bytes(batch.column(text))
        data = LOWER[data]
        a, b, bounds = spans(WORD[data], offsets)
        marks: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        names: list[set[int]] = [set() for _ in range(batch.num_rows)]
        cut: dict[int, list[tuple[int, int]]] = {}
        for at, size, items in _hits(index, data, a, b, bounds):
            for s, row, of in zip(at.tolist(), (np.searchsorted(bounds, at, "right") - 1).tolist(), items):
                cut.setdefault(row, []).append((s - int(bounds[row]), s - int(bounds[row]) + size))
                names[row] |= of
        ids = [[index.ids[i] for i in sorted(x)] for x in names]
        for row, found in cut.items():
            found.sort()
            s, e = merge_intervals(*np.array(found).T)
            marks[row] = [{"start": i, "end": j} for i, j in zip(s.tolist(), e.tolist())]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.diff(bounds)), pa.array(marks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(ids, pa.list_(pa.string()))],
            [*batch.schema.names, "__n_words", "__spans", "__item_ids"],
        )


def _parsed(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with small letters, start, end and hash of each word, and the first word of each text, and the end."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    a, b, bounds = spans(WORD[data], offsets)
    return data.tobytes(), a, b, word_hashes(data, a, b), bounds


def _item_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """item, size, hash and words of every window of items."""
    for batch in steps(batches, "words"):
        raw, a, b, words, bounds = _parsed(batch.column("words"))
        out: list[tuple] = []
        for item, lo, hi in zip(batch.column("item").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            size = min(length, hi - lo)
            if size:
                hashes = kgram_hashes(words[lo:hi], size).view(np.int64).tolist()
                cut = [raw[i:j].decode() for i, j in zip(a[lo:hi].tolist(), b[lo:hi].tolist())]
                out += [(item, size, h, " ".join(cut[s : s + size])) for s, h in enumerate(hashes)]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["item", "size", "hash", "window"])


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size and fingerprint of windows."""
    for batch in steps(batches, "window"):
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            _, _, _, words, bounds = _parsed(batch.column("window").filter(pa.array(sizes == size)))
            k, w = _shape(size)
            grams = kgram_hashes(words, k)
            found = np.unique(grams[winnow(grams, w)[bounds[:-1]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), size, np.int32)), pa.array(found.view(np.int64))], ["size", "print"])


def _doc_prints(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """The distinct fingerprints of each text, for each window size: key, size, print."""
    for batch in steps(batches, "text"):
        _, _, _, words, bounds = _parsed(batch.column("text"))
        for size in sizes:
            k, w = _shape(size)
            grams = kgram_hashes(words, k)
            starts = np.flatnonzero(_whole(bounds, size, len(words)))
            if len(starts):
                rows = np.searchsorted(bounds, starts, "right") - 1
                found = np.unique(np.stack([rows.astype(np.uint64), grams[winnow(grams, w)[starts]]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(found[:, 0].astype(np.int64))), pa.array(np.full(len(found), size, np.int32)), pa.array(found[:, 1].view(np.int64))], ["key", "size", "print"])


def _doc_windows(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """key, start, size and hash of every window of texts."""
    for batch in steps(batches, "text"):
        _, _, _, words, bounds = _parsed(batch.column("text"))
        for size in sizes:
            starts = np.flatnonzero(_whole(bounds, size, len(words)))
            if len(starts):
                rows = np.searchsorted(bounds, starts, "right") - 1
                hashes = kgram_hashes(words, size)[starts]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), pa.array((starts - bounds[rows]).astype(np.int32)), pa.array(np.full(len(starts), size, np.int32)), pa.array(hashes.view(np.int64))], ["key", "start", "size", "hash"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and item ids of the hits whose words are those of the window."""
    for batch in steps(batches, "text"):
        raw, a, b, _, bounds = _parsed(batch.column("text"))
        marks, names = [], []
        for lo, hits in zip(bounds[:-1].tolist(), batch.column("hits").to_pylist()):
            cut, ids = [], set()
            for h in hits:
                i, j = lo + h["start"], lo + h["start"] + h["size"]
                if b" ".join(raw[x:y] for x, y in zip(a[i:j].tolist(), b[i:j].tolist())) == h["window"].encode():
                    cut.append((h["start"], h["start"] + h["size"]))
                    ids.update(h["items"])
            cut.sort()
            s, e = merge_intervals(*np.array(cut).reshape(-1, 2).T)
            marks.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
            names.append(sorted(ids))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(marks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(names, pa.list_(pa.string()))], ["__key", "__spans", "__item_ids"])


def _among_batches(batches: Iterator[pa.RecordBatch], known, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """The rows whose text has a known fingerprint."""
    for batch in steps(batches, "text"):
        _, _, _, words, bounds = _parsed(batch.column("text"))
        hit = np.zeros(batch.num_rows, bool)
        for size in sizes:
            k, w = _shape(size)
            grams = kgram_hashes(words, k)
            starts = np.flatnonzero(_whole(bounds, size, len(words)))
            at = starts[_among(grams[winnow(grams, w)[starts]], known.value[size])]
            hit[np.searchsorted(bounds, at, "right") - 1] = True
        yield batch.filter(pa.array(hit))


def _joined(docs: DataFrame, items: DataFrame, length: int, text: str, most_prints: int) -> DataFrame:
    """The hits of a benchmark of any size, by joins of tables."""
    spark = docs.sparkSession
    windows = items.mapInArrow(lambda b: _item_windows(b, length), "item string, size int, hash long, window string")
    windows = materialize(windows.groupBy("size", "hash", "window").agg(F.collect_set("item").alias("items")))
    prints = materialize(windows.select("size", "window").mapInArrow(_item_prints, "size int, print long").distinct())
    # At most ``length`` numbers.
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    texts = docs.select(key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if prints.count() <= most_prints:
        found = prints.toArrow()
        of = found.column("size").to_numpy()
        known = spark.sparkContext.broadcast({n: np.sort(found.column("print").to_numpy()[of == n].view(np.uint64)) for n in sizes})
        some = texts.mapInArrow(lambda b: _among_batches(b, known, sizes), "key binary, text string")
    else:
        has = texts.mapInArrow(lambda b: _doc_prints(b, sizes), "key binary, size int, print long").join(prints, ["size", "print"], "left_semi")
        some = texts.join(materialize(has.select("key").distinct()), "key", "left_semi")
    some = materialize(some.groupBy("key").agg(F.min("text").alias("text")))
    met = some.mapInArrow(lambda b: _doc_windows(b, sizes), "key binary, start int, size int, hash long").join(windows, ["size", "hash"])
    hits = met.groupBy("key").agg(F.collect_list(F.struct("start", "size", "window", "items")).alias("hits"))
    spot = materialize(some.join(hits, "key").mapInArrow(_compare, "__key binary, __spans array<struct<start:int,end:int>>, __item_ids array<string>"))
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    out = docs.withColumn("__of", key).join(spot, F.col("__of") == F.col("__key"), "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(spot.schema[c].dataType)).alias(c)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), n_words.alias("__n_words"), none("__spans"), none("__item_ids"))


def with_hits(docs: DataFrame, benchmark: DataFrame, length: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, most_prints: int = PRINTS) -> DataFrame:
    """``docs`` with __n_words, __spans (hit words as intervals) and __item_ids (sorted as strings)."""
    spark = docs.sparkSession
    tune(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("words"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("words"), F.lit(0)) + 64)).first()[0] or 0
    if total > block_bytes:
        return _joined(docs, items, length, text, most_prints)
    index = spark.sparkContext.broadcast(Index([(r["item"], r["words"]) for r in items.collect()], length))
    schema = wider(docs, __n_words="long", __spans="array<struct<start:int,end:int>>", __item_ids="array<string>")
    return docs.mapInArrow(lambda batches: _scan(batches, index, text), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, text: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return with_hits(docs, benchmark, length, text).filter(F.size("__spans") == 0).select(docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, most_prints: int = PRINTS) -> DataFrame:
    """doc_id, text, n_words, spans and item_ids for each document.

    ``spans`` has the hit words as intervals (end exclusive), ``item_ids`` the
    items of the windows found, sorted as strings.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = with_hits(rows, benchmark, length, "text", item_id, item_text, block_bytes, most_prints)
    return found.select("doc_id", "text", F.col("__n_words").alias("n_words"), F.col("__spans").alias("spans"), F.col("__item_ids").alias("item_ids"))


def contamination_report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from :func:`decontaminate`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
