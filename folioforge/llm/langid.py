"""Language identification by n-gram filters with language bitmasks.

The filters of all languages are one bit-sliced Bloom filter: a row of the table
has one bit for each language, and an n-gram's k rows, and-ed, give all languages
that contain it. A text's n-grams are looked up, the bits of each language are
counted, the counts are corrected for the false positives that each language's
filling gives, and the highest corrected count decides (of equals the first
language in code point order).

An n-gram (3 to 5 characters, letters as small, other characters as one space) belongs
to a language if at least ``share`` of its sampled texts have it. The sample is
about ``most`` texts a language, picked by hash; all whole texts are judged, long ones
in pieces of PIECE characters that overlap, so memory is a few times the text.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so
is every text if there is no language to learn; null languages teach nothing;
repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, mix64, steps, text_bytes, train_fold, tune

ORDERS = (3, 4, 5)
HASHES = 3
MOST = 1000
SHARE = 0.02
#: Characters whose n-grams are looked up at once.
PIECE = 1 << 18


def gram_pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit hashes of all n-grams of all texts (whole words and their borders), and the text of each, piece by piece."""
    texts = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[\x00-\x60\x7B-\x7F]+", " ")
    texts = pc.binary_join_element_wise("", texts, " ", " ")
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    for at in range(0, len(points), PIECE):
        wide, own = points[at : at + PIECE + max(ORDERS) - 1].astype(np.uint64), row[at : at + PIECE + max(ORDERS) - 1]
        value, hashes, rows = np.zeros(len(wide), np.uint64), [], []
        for n in range(1, max(ORDERS) + 1):
            size = len(wide) - n + 1
            if size <= 0:
                break
            value = value[:size] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :]
            if n in ORDERS:
                ok = own[:size] == own[n - 1 :]
                # N-grams that start beyond the piece are those of the next one.
                ok[PIECE:] = False
                hashes.append(value[ok] ^ np.uint64(n << 56))
                rows.append(own[:size][ok])
        if hashes:
            yield np.concatenate(hashes), np.concatenate(rows)


def gram_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All of :func:`gram_pieces`."""
    parts = list(gram_pieces(texts)) or [(np.empty(0, np.uint64), np.empty(0, np.int32))]
    return np.concatenate([h for h, _ in parts]), np.concatenate([r for _, r in parts])


def once(grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram of a text once."""
    order = np.lexsort((row, grams))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], row[new]


class Filters(NamedTuple):
    """langs in code point order; table: (words, rows) of uint64 with bit l % 64 of word l // 64 for language l."""

    langs: list[str]
    table: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> Filters:
        langs = sorted(grams)
        size = 1 << max(12, (8 * max([len(g) for g in grams.values()], default=1)).bit_length())
        table = np.zeros((-(-max(1, len(langs)) // 64), size), np.uint64)
        for i, lang in enumerate(langs):
            for at in slots(grams[lang], size):
                table[i // 64, at] |= np.uint64(1 << i % 64)
        return cls(langs, table)

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram, the bitmask of the languages that contain it, shape (words, n-grams)."""
        out = None
        for at in slots(grams, self.table.shape[1]):
            out = self.table[:, at] if out is None else out & self.table[:, at]
        return out

    def false_positives(self) -> np.ndarray:
        """For each language, the chance that an n-gram which it lacks passes."""
        return np.array([float((self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) ** HASHES for i in range(len(self.langs))])

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text."""
        n = len(texts)
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        total, rates, counts = np.zeros(n), self.false_positives(), np.zeros((len(self.langs), n))
        for grams, row in gram_pieces(texts):
            masks = self.lookup(grams)
            total += np.bincount(row, minlength=n)
            for i in range(len(self.langs)):
                counts[i] += np.bincount(row, (masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(float), n)
        right = np.maximum((counts - total * rates[:, None]) / (1 - np.minimum(rates, 0.99))[:, None], 0)
        best = right.argmax(0)
        score = np.clip(right[best, np.arange(n)] / np.maximum(total, 1), 0, 1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, score, 0.0)


def slots(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The rows of each n-gram, one hash after the other."""
    h = mix64(grams)
    step = h >> np.uint64(32) | np.uint64(1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


def train(docs: DataFrame, most: int = MOST, share: float = SHARE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters of all languages, from about ``most`` texts of the training fold for each."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & train_fold(F.col("id")))
    known = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not known:
        return Filters.build({})
    rates = F.create_map(*[x for k, n in sorted(known.items()) for x in (F.lit(k), F.lit(min(1.0, most / n)))])
    picked = rows.filter(F.pmod(F.xxhash64("text", "id"), F.lit(1 << 20)) < F.lit(1 << 20) * F.element_at(rates, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            names = batch.column("lang").to_pylist()
            langs = sorted(set(names))
            code = np.array([langs.index(x) for x in names])
            # Once for each text, then the number of texts for each language.
            parts = [once(*p) for p in gram_pieces(batch.column("text"))]
            grams, row = once(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            of = code[row]
            for i, name in enumerate(langs):
                values, counts = np.unique(grams[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    counted = picked.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    least = F.create_map(*[x for k, n in sorted(known.items()) for x in (F.lit(k), F.lit(max(1.0 if n < 50 else 2.0, share * min(n, most))))])
    kept = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.element_at(least, F.col("lang"))).select("lang", "gram").toArrow()
    names, grams = np.array(kept.column("lang").to_pylist(), object), kept.column("gram").to_numpy().view(np.uint64)
    return Filters.build({k: np.sort(grams[names == k]) for k in known})


def identify(docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(filters)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            langs, scores = shared.value.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    found = rows.mapInArrow(run, f"doc_id {kind(rows, 'doc_id')}, lang_pred string, score double")
    return found.select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
