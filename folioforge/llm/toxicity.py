"""Toxicity scores from a character n-gram linear classifier with naive Bayes features.

A text's features are the character n-grams (orders 4 to 6) that it has, hashed
to 2^20 numbers; letters count as small, and runs of other characters as one
space. A feature is scaled by its naive Bayes log-count ratio between toxic and
other labelled texts, and a logistic regression is fitted on the scaled features.

Features whose counts differ between the labels by no more than chance are left
out, by a chi-square test over the sample; only the others reach the driver.

It is fitted on at most ``most`` labelled documents, those with the least hash of
their id; all whole texts are scored.

Defined cases: a null text is empty, and an empty text has the score of the
intercept; a document with several labels is toxic if any says so; null labels
teach nothing; without labels of both kinds every score is the share of toxic
labels (0 without any); repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, steps, train_fold, tune, wider

ORDERS = (4, 5, 6)
BITS = 20
MOST = 10_000
SURPRISE = 10.0
THRESHOLD = 0.3
#: Characters that are hashed at once.
PIECE = 1 << 18


def characters(text: str) -> np.ndarray:
    """Code points of the text in small letters, between spaces; runs of other characters are one space."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    other = (points < 97) | ((points > 122) & (points < 128))
    if not other[1:-1].any():
        return np.where(other, np.uint32(32), points)
    keep = ~other
    keep[0] = True
    keep[1:] |= ~other[:-1]
    return np.where(other, np.uint32(32), points)[keep]


def gram_numbers(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed numbers of all n-grams, piece by piece."""
    for at in range(0, max(1, len(points)), PIECE):
        part = points[at : at + PIECE + max(ORDERS) - 1].astype(np.uint32)
        value = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            value = value[:size] * np.uint32(0x01000193) + part[n - 1 :] * np.uint32(0x9E3779B1)
            if n in ORDERS:
                x = value ^ value >> np.uint32(15)
                x *= np.uint32(0x2C1B3C6D) + np.uint32(2 * n)
                yield x >> np.uint32(32 - BITS)


def present(text: str | None, used: np.ndarray | None = None) -> np.ndarray:
    """The features of a text, each once; only those marked in ``used`` if it is given."""
    found = [n if used is None else n[used[n]] for n in gram_numbers(characters(text or ""))]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def differs(toxic: Column, total: Column, n_toxic: int, n: int, least: int = 3, surprise: float = SURPRISE) -> Column:
    """Whether a feature is in ``least`` texts and its counts differ between the labels (chi-square over ``surprise``)."""
    share = n_toxic / max(1, n)
    return (total >= least) & (total < n) & ((toxic - total * share) ** 2 > surprise * share * (1 - share) * total * (1 - total / max(1, n)))


def fit(rows: list[np.ndarray], labels: np.ndarray, ridge: float = 1.0, rounds: int = 150, alpha: float = 1.0) -> Model:
    """Naive Bayes ratios, then logistic regression on the scaled features by accelerated gradient steps."""
    size, n = 1 << BITS, len(labels)
    share = float(labels.mean()) if n else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(size, np.float32), 30.0 if share else -30.0)
    features, owner = np.concatenate(rows), np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    if not len(features):
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    known = np.flatnonzero(np.bincount(features, minlength=size))
    place, m = np.zeros(size, np.int32), len(known)
    place[known] = np.arange(m)
    features = place[features]
    p = np.bincount(features, labels[owner], m) + alpha
    q = np.bincount(features, 1 - labels[owner], m) + alpha
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    value = ratio[features]
    # The largest curvature, by a few power steps, gives the step size.
    x = np.ones(m)
    for _ in range(8):
        x = np.bincount(features, value * np.bincount(owner, value * x[features], n)[owner], m)
        top = float(np.linalg.norm(x))
        x /= top or 1.0
    step = 1.0 / (0.3 * (top + n) + ridge)
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        z = np.bincount(owner, value * vw[features], n) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        w2, b2 = vw - step * (np.bincount(features, value * g[owner], m) + ridge * vw), vb - step * g.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    weights = np.zeros(size, np.float32)
    weights[known] = w * ratio
    return Model(weights, b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and toxic texts, that have each feature."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in steps(batches, "text"):
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
            found = present(text)
            counts[0, found] += 1
            counts[1, found] += y
    found = np.flatnonzero(counts[0])
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[0, part]), pa.array(counts[1, part])], ["feature", "n", "toxic"])


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``most`` labelled documents of the training fold."""
    spark = docs.sparkSession
    tune(spark)
    known = labels.filter(F.col(label).isNotNull() & train_fold(F.col(doc_id))).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(most)
    # At most ``most`` rows of two numbers. The few texts that they pick go to a few partitions, not one for each of the corpus.
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id").select(F.col("y").cast("int").alias("y"), "text")
    rows = materialize(rows.repartition(min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    counted = rows.mapInArrow(_count, "feature int, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    # At most 2^BITS numbers, of which few differ.
    used = np.zeros(1 << BITS, bool)
    used[counted.filter(differs(F.col("toxic"), F.col("n"), n_toxic, n)).select("feature").toArrow().column("feature").to_numpy()] = True
    shared = spark.sparkContext.broadcast(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            found = [present(t, shared.value).astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.binary())], ["y", "grams"])

    table = rows.mapInArrow(run, "y int, grams binary").toArrow()
    found = sorted(zip(table.column("y").to_pylist(), table.column("grams").to_pylist()))
    del table
    return fit([np.frombuffer(g, np.int32) for _, g in found], np.array([y for y, _ in found], float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with two more columns, named in ``out``: the score (0 to 1), and 1 if it is at least the threshold."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        used = weights != 0
        for batch in steps(batches, text):
            z = np.array([float(weights[present(t, used)].sum(dtype=np.float64)) for t in batch.column(text).to_pylist()]) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, *out])

    return docs.mapInArrow(run, wider(docs, **{out[0]: "double", out[1]: "int"}))


def toxicity_report(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return score(rows, model, threshold).select("doc_id", (~train_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")
