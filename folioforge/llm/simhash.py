"""SimHash near-duplicates with pigeonring filtering.

The fingerprint of a text has 64 bits; a bit is 1 if it is set in over half the
hashes of the text's word shingles. Two texts are linked if their fingerprints
differ in at most MOST bits (3). ``similar`` has the same method for a similarity of
texts instead of a number of bits, and ``keep_one``.

A fingerprint is a ring of 4 segments of 16 bits. If two fingerprints differ in
at most 3 bits, then from some segment on every chain of l consecutive segments
differs in at most l * 3 / 4 bits: 0, 1, 2, 3. Candidates share a key made of an
equal segment and a next segment with one difference at most (one side sets each
of its zero bits in turn); the chains of three and four are checked on the pair.

Only distinct fingerprints are compared, so exact copies cost nothing, and every
task gives a spanning forest of the links that it finds instead of all pairs.
Links of a key are found in blocks, so a large group of near copies is neither
cut nor held as pairs; a key with many fingerprints is cut into parts of about PART,
and every two parts are one unit of work, wherever it is done. (Keys are known to be
large from a share of the fingerprints; what that misses costs time, no links.)
Components come from star steps over tables.

Defined cases: a null or blank text has fingerprint zero and is linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows stay
rows of their own with one component; a null id is never the least id unless a
component has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, steps, tune, wider
from .forests import forest
from .graph import components
from .similar import keep_one  # noqa: F401

SEGMENTS, WIDTH, MOST = 4, 16, 3
#: Fingerprints in a part of a large key; one in SHARE fingerprints tells large keys.
PART, SHARE = 2048, 16


def fingerprint(text: bytes, words_in: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of a text; letters A-Z count as small."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_in:
        hashes = [digest(joined, seed)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[words_in - 1 :])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", words_in: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long in column ``out``."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            found = [fingerprint(t.encode() if t else b"", words_in) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(found, np.uint64).view(np.int64))], [*batch.schema.names, out])

    return docs.mapInArrow(run, wider(docs, **{out: "long"}))


def ring_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the first two segments of every chain: key, index of the fingerprint, whether it is unchanged."""
    mask, n = np.uint64((1 << WIDTH) - 1), np.arange(len(fps))
    keys, rows, exact = [], [], []
    for i in range(SEGMENTS):
        a = fps >> np.uint64(WIDTH * i) & mask
        b = fps >> np.uint64(WIDTH * ((i + 1) % SEGMENTS)) & mask
        head = np.uint64(i) << np.uint64(2 * WIDTH) | a << np.uint64(WIDTH)
        keys.append(head | b)
        rows.append(n)
        exact.append(np.ones(len(n), bool))
        for bit in range(WIDTH):
            zero = np.flatnonzero(b >> np.uint64(bit) & np.uint64(1) == 0)
            keys.append(head[zero] | b[zero] | np.uint64(1 << bit))
            rows.append(zero)
            exact.append(np.zeros(len(zero), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(exact)


def chains_hold(diff: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the differing bits keep to 2 over three segments from ``first`` on, and to 3 over all."""
    three = np.uint64((1 << 3 * WIDTH) - 1)
    turn = (first * WIDTH).astype(np.uint64)
    turned = diff >> turn | diff << (np.uint64(64) - turn & np.uint64(63))
    # Without a turn both parts are the same bits.
    return (np.bitwise_count(turned & three) <= 2) & (np.bitwise_count(diff) <= MOST)


def links(keys: np.ndarray, fps: np.ndarray, exact: np.ndarray, units: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the linked fingerprints among rows sorted by key and unit; in a unit with two halves, of the links between these."""
    edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (units[1:] != units[:-1]), True])
    sizes = np.diff(edge)
    first = (keys >> np.uint64(2 * WIDTH)).astype(np.int64)
    us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    small = np.repeat((sizes > 1) & (sizes <= 32), sizes)
    own = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.flatnonzero(small)
    for d in range(1, min(32, int(sizes.max(initial=1)))):
        i = rows[rows + d < len(keys)]
        i = i[own[i] == own[i + d]]
        if not len(i):
            break
        i = i[(exact[i] | exact[i + d]) & (fps[i] != fps[i + d])]
        ok = chains_hold(fps[i] ^ fps[i + d], first[i])
        us.append(fps[i[ok]])
        vs.append(fps[i[ok] + d])
    for g in np.flatnonzero(sizes > 32).tolist():
        x, e, left = (a[edge[g] : edge[g + 1]] for a in (fps, exact, half))
        start = first[edge[g] : edge[g] + 1]
        for asked, other in [(x[e], x)] if left.all() else [(x[e & left], x[~left]), (x[e & ~left], x[left])]:
            for at in range(0, len(asked), 256):
                part = asked[at : at + 256]
                i, j = np.nonzero(chains_hold(part[:, None] ^ other[None, :], start))
                a, b = forest(part[i], other[j])
                us.append(a)
                vs.append(b)
    return forest(np.concatenate(us), np.concatenate(vs))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, rows, exact = ring_keys(fps)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[rows].view(np.int64)), pa.array(exact)], ["key", "fp", "exact"])


def _link(batches: Iterator[pa.RecordBatch], at_once: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    size = 0

    def out(parts):
        u, v = links(*parts)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        parts[:2] = (p.view(np.uint64) for p in parts[:2])
        key, unit = parts[0], parts[3]
        # What is held ends with the first key and unit of this batch.
        ends = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1
        if size >= at_once and len(ends):
            yield out([np.concatenate([*(h[i] for h in held), p[: ends[0]]]) for i, p in enumerate(parts)])
            held, size, parts = [], 0, [p[ends[0] :] for p in parts]
        held.append(parts)
        size += len(parts[0])
    if held:
        yield out([np.concatenate([h[i] for h in held]) for i in range(5)])


def link_components(nodes: DataFrame, part: int = PART) -> DataFrame:
    """fp and root (the least fingerprint reachable) for those of the distinct fingerprints ``fp`` that have links."""
    keyed = lambda some: some.select("fp").mapInArrow(_expand, "key long, fp long, exact boolean")
    rows = keyed(nodes)
    counts = keyed(nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(SHARE)) == 0)).groupBy("key").count()
    large = materialize(counts.filter(F.col("count") * SHARE > part).select("key", F.ceil(F.col("count") * SHARE / part).alias("parts")))
    if large.isEmpty():
        rows = rows.select("*", F.lit(0).cast("long").alias("unit"), F.lit(True).alias("half"))
    else:
        own = F.pmod(F.xxhash64("fp", F.lit(1)), "parts")
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.struct((F.least(own, q) * F.col("parts") + F.greatest(own, q)).alias("unit"), (own <= q).alias("half")))
        alone = F.array(F.struct(F.lit(0).cast("long").alias("unit"), F.lit(True).alias("half")))
        rows = rows.join(large, "key", "left").select("key", "fp", "exact", F.inline(F.when(F.col("parts").isNull(), alone).otherwise(pairs)))
    rows = rows.repartition("key", "unit").sortWithinPartitions("key", "unit")
    return components(rows.mapInArrow(_link, "u long, v long")).withColumnRenamed("u", "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_in: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least id of its component) for every document."""
    found = materialize(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words_in=words_in).select("doc_id", "fp"))
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = nodes.join(link_components(nodes), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicate_report(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
