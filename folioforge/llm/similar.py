"""SimHash near-duplicates at a similarity: wide rings, chains of segments, exact check.

Two texts are near-duplicates if the Jaccard similarity of their sets of word
shingles (five words, letters A-Z as small; fewer words: the whole sequence) is at
least ``similarity`` (0.8). Texts that differ in case and white space only are one.

A fingerprint has BITS bits, each the majority vote of the shingles' hashes. At a
similarity s, a bit differs with chance acos(2s / (1 + s)) / pi, so ``budget`` is the
number of bits that may differ, SIGMAS deviations above the mean at the least
similarity. The bits are a ring, cut into segments; as the budget is wider than the
number of segments, no segment need be equal on one ring, so the ring is laid out
anew in several pseudorandom turns. Candidates have an equal segment (``key``), from
which on every chain of consecutive segments stays within its share of the budget;
then comes the full Hamming check, and last the exact similarity. Width and turns
follow from the number of texts and from RECALL, the chance at the least similarity
that some segment is equal (higher for more similar pairs).

Texts that have a candidate are *active*; the others are done with. Of the active ones
the shingles are counted: what two sets have in common is at most what each of them
has of shingles that are in several texts, which leaves out most candidates that miss
the similarity, and texts that can't reach it with any other.

Not all candidates are checked. In ROUNDS rounds a text is proposed, for each of its
keys, one of another group than its own (that with the fewest shingles of its own, as
the texts in the middle of a group have), and at most TRIES of them are checked
exactly; what is similar is one group from then on. So a large group of near copies is
soon one, after a few checks a text. What candidates connect is a *cell*; in each the
texts that are not of its commonest group are then compared with all others of the
cell, exactly, by an index over blocks of their shingles. Blocks are units of work of
bounded size, and only what is similar leaves them, so no list of candidates is made.

Defined cases: texts without words are equal to each other; repeated rows have one
component; a null id is never the least id unless a component has no other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, kgram_hashes, materialize, mix64, range_hashes, release, spans, steps, text_bytes, tune, wider, word_hashes
from .forests import forest
from .graph import components

WORDS, SIMILARITY = 5, 0.8
BITS, CHAIN = 512, 64
SIGMAS, RECALL = 3.0, 0.995
SMALL = 64
ROUNDS, TRIES = 1, 8
#: Pairs with one text that a task checks.
PAIRS = 500
#: Texts in a block of those that are compared with a cell, and in a part of the cell.
ASKED, MEMBERS = 500, 2_000
PRINT = [f"f{i}" for i in range(BITS // 64)]


class Rings(NamedTuple):
    """width: bits of a segment. turns: how often the ring is laid out. budget: bits that may differ."""

    width: int
    turns: int
    budget: int


def plan_rings(n: int, similarity: float, recall: float = RECALL) -> Rings:
    """Rings for n texts: a key has about four texts by chance."""
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    budget = BITS * (chance + SIGMAS * math.sqrt(chance * (1 - chance) / BITS))
    width = min(40, max(10, n.bit_length() - 3))
    keys = math.log(1 - recall) / math.log(1 - min(1 - 1e-9, (1 - chance) ** width))
    return Rings(width, max(1, math.ceil(keys / (BITS // width))), math.ceil(budget))


def text_key(text: Column) -> Column:
    """MD5 of the words, A-Z as small, with one space between."""
    small = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.md5(F.trim(F.regexp_replace(small, r"[\x20\x09-\x0D]+", " ")).cast("binary")))


def shingles(texts: pa.Array, words_in: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of all texts, in order within each, and the number of each text's first, and the end."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    a, b, bounds = spans(~SPACE[data], offsets)
    words, n = word_hashes(data, a, b), len(a)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    grams = kgram_hashes(words, words_in)
    whole = row[: len(grams)] == row[n - len(grams) :]
    short = np.flatnonzero((np.diff(bounds) < words_in) & (np.diff(bounds) > 0))
    hashes = np.r_[grams[whole], range_hashes(words, bounds[short], bounds[short + 1])]
    of = np.r_[row[: len(grams)][whole], short]
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.searchsorted(of[new], np.arange(len(texts) + 1))


def wide_prints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The majority bits of each text's hashes, shape (texts, BITS / 64); 0 without any."""
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), BITS // 64), np.uint64)
    if len(some):
        for j in range(BITS // 64):
            bits = np.unpackbits(mix64(hashes + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int32)
            out[some, j] = np.packbits(votes * 2 > sizes[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def ring_keys(prints: np.ndarray, rings: Rings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every segment of every turn, the key of each print, and the CHAIN bits that follow the segment."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    number = 0
    for turn in range(rings.turns):
        order = np.random.default_rng([11, turn]).permutation(BITS)
        laid = bits.take(np.r_[order, order[: CHAIN + rings.width]], 1)
        for i in range(BITS // rings.width):
            at = i * rings.width
            part = np.zeros((len(prints), 64), np.uint8)
            part[:, : rings.width] = laid[:, at : at + rings.width]
            after = laid[:, at + rings.width : at + rings.width + CHAIN]
            value, chain = (np.ascontiguousarray(np.packbits(x, axis=1, bitorder="little")).view("<u8")[:, 0] for x in (part, after))
            yield value | np.uint64(number << rings.width), chain
            number += 1


def chain_limits(rings: Rings) -> list[tuple[int, int]]:
    """Masks of the bits after an equal segment, and how many of them may differ in a chain that keeps within its share of the budget."""
    ends = [*range(rings.width, CHAIN, rings.width), CHAIN]
    return [((1 << e) - 1, (e + rings.width) * rings.budget // BITS) for e in ends]


def chains_hold(diff: np.ndarray, rings: Rings) -> np.ndarray:
    ok = np.ones(diff.shape, bool)
    for mask, most in chain_limits(rings):
        ok &= np.bitwise_count(diff & np.uint64(mask)) <= most
    return ok


ROW = ["id", "root", "size", "common"]
KEYED = "key long, chain long, id long, root long, size long, common long"


def _expand(batches: Iterator[pa.RecordBatch], rings: Rings, more: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            prints = np.stack([part.column(f).to_numpy().view(np.uint64) for f in PRINT], 1)
            for key, chain in ring_keys(prints, rings):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(chain.view(np.int64)), *(part.column(c) for c in (*ROW, *more))], ["key", "chain", *ROW, *more])


def reachable(size: tuple, common: tuple, similarity: float, least):
    """Whether two sets can be similar: of columns or of arrays. least: the lesser of two."""
    both = least(common[0], common[1])
    return both >= similarity * (size[0] + size[1] - both)


def _propose(batches: Iterator[pa.RecordBatch], rings: Rings, small: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """For texts of rows sorted by key, a candidate v of another root for each u and key; and each text that has any, or is in a key with more than ``small``, with v null.

    Of a key that goes on in the next batch only its first row and its last ``small`` are held.
    """
    held = None

    def found(key, chain, id_, root, size, common):
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes = np.diff(edge)
        rank = np.arange(len(key)) - np.repeat(edge[:-1], sizes)
        many = np.repeat(sizes > small, sizes)
        partner, marked = np.full(len(key), -1), many.copy()
        fits = lambda i, j: (root[i] != root[j]) & reachable((size[i], size[j]), (common[i], common[j]), similarity, np.minimum) & chains_hold(chain[i] ^ chain[j], rings)
        rows = np.flatnonzero(~many)
        for d in range(1, min(small, int(sizes.max(initial=0)))):
            rows = rows[rank[rows] >= d]
            if not len(rows):
                break
            ok = rows[fits(rows, rows - d)]
            partner[ok] = ok - d
            marked[ok] = marked[ok - d] = True
        rows = np.flatnonzero(many & (rank > 0))
        first = rows - rank[rows]
        ok = fits(rows, first)
        partner[rows[ok]] = first[ok]
        u = np.flatnonzero(partner >= 0)
        if len(u):
            pair = np.unique(np.stack([id_[u], id_[partner[u]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["u", "v"])
        if marked.any():
            seen = np.unique(id_[marked])
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.nulls(len(seen), pa.int64())], ["u", "v"])

    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(6)]
        rows[1] = rows[1].view(np.uint64)
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
        key = rows[0]
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield from found(*(r[:cut] for r in rows))
        held = [r[cut:] for r in rows]
        if len(held[0]) > 4 * small:
            # A large key: proposals so far; its first row and enough others to count as large stay.
            yield from found(*held)
            held = [np.r_[h[:1], h[-small:]] for h in held]
    if held is not None:
        yield from found(*held)


def _sets(batches: Iterator[pa.RecordBatch], words_in: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        hashes, bounds = shingles(batch.column("text"), words_in)
        made = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(hashes)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), made], ["id", "set"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shingle and id of every set."""
    for batch in steps(batches, "set"):
        data, offsets = text_bytes(batch.column("set"))
        yield pa.RecordBatch.from_arrays([pa.array(data.view(np.int64)), batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8)))], ["shingle", "id"])


def _check(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by v, salt and u, that of v itself (u null) first: the pairs that are similar."""
    now, own = None, None
    for batch in batches:
        us, vs = [], []
        for u, v, salt, raw in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "salt", "set"))):
            if u is None:
                now, own = (v, salt), np.frombuffer(raw, np.uint64)
                continue
            assert now == (v, salt)
            other = np.frombuffer(raw, np.uint64)
            both = len(own) + len(other) - len(np.union1d(own, other)) if len(own) else 0
            if both >= similarity * (len(own) + len(other) - both):
                us.append(u)
                vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def keyed(nodes: DataFrame, rings: Rings, *more: str) -> DataFrame:
    """A row for every segment of every turn, with columns ``more`` (numbers) of the nodes."""
    kinds = "".join(f", {c} long" for c in more)
    return nodes.select(*ROW, *PRINT).mapInArrow(lambda b: _expand(b, rings, more), KEYED + kinds)


def proposed(nodes: DataFrame, rings: Rings, similarity: float, small: int) -> DataFrame:
    """u and vs (up to TRIES) of the texts ``nodes`` (columns ROW and the print) that have or may have candidates; written."""
    rows = keyed(nodes, rings).repartition("key").sortWithinPartitions("key", F.col("size") - F.col("common"), "id")
    pairs = rows.mapInArrow(lambda b: _propose(b, rings, small, similarity), "u long, v long")
    # A text has no more proposals than keys.
    of = F.array_sort(F.collect_set(F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("h"), "v"))))
    return materialize(pairs.groupBy("u").agg(F.transform(F.slice(of, 1, TRIES), lambda x: x["v"]).alias("vs")))


def differing(a: str, b: str) -> Column:
    """Bits in which two prints differ, whose columns have prefixes."""
    bits = [F.bit_count(F.col(f"{a}{f}").bitwiseXOR(F.col(f"{b}{f}"))) for f in PRINT]
    return sum(bits[1:], bits[0])


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, rings: Rings, similarity: float) -> DataFrame:
    """Those of the distinct pairs u, v whose prints differ within the budget and whose sets are similar; written."""
    side = lambda c: nodes.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("size", "common", *PRINT)))
    two = lambda x: (F.col(f"u_{x}"), F.col(f"v_{x}"))
    near = (differing("u_", "v_") <= rings.budget) & reachable(two("size"), two("common"), similarity, F.least)
    pairs = materialize(pairs.join(side("u"), "u").join(side("v"), "v").filter(near).select("u", "v"))
    count = materialize(pairs.groupBy("v").agg(F.ceil(F.count("*") / PAIRS).alias("salts")))
    first = sets.join(count, sets["id"] == count["v"]).select(F.lit(None).cast("long").alias("u"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), "set")
    rest = pairs.join(count, "v").join(sets, sets["id"] == pairs["u"]).select("u", "v", F.pmod(F.xxhash64("u"), "salts").cast("long").alias("salt"), "set")
    rows = first.unionByName(rest).repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first())
    return materialize(rows.mapInArrow(lambda b: _check(b, similarity), "u long, v long"))


def _connect(batches: Iterator[pa.RecordBatch], rings: Rings, small: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the candidates of each key; in a key with more than ``small`` rows all are taken to be connected."""
    held = None

    def found(key, chain, id_, root, size, common, *prints):
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes = np.diff(edge)
        rank = np.arange(len(key)) - np.repeat(edge[:-1], sizes)
        many = np.repeat(sizes > small, sizes)
        rows = np.flatnonzero(many & (rank > 0))
        us, vs = [id_[rows]], [id_[rows - rank[rows]]]
        rows = np.flatnonzero(~many)
        for d in range(1, min(small, int(sizes.max(initial=0)))):
            rows = rows[rank[rows] >= d]
            if not len(rows):
                break
            i = rows[reachable((size[rows], size[rows - d]), (common[rows], common[rows - d]), similarity, np.minimum)]
            i = i[sum(np.bitwise_count(p[i] ^ p[i - d]).astype(np.int64) for p in prints) <= rings.budget]
            us.append(id_[i])
            vs.append(id_[i - d])
        a, b = forest(np.concatenate(us).astype(np.uint64), np.concatenate(vs).astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["u", "v"])

    for batch in batches:
        # The bits of prints are counted without a sign.
        rows = [batch.column(i).to_numpy() for i in range(6)] + [batch.column(i).to_numpy().view(np.uint64) for i in range(6, batch.num_columns)]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
        key = rows[0]
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield found(*(r[:cut] for r in rows))
        held = [r[cut:] for r in rows]
        if len(held[0]) > 4 * small:
            yield found(*held)
            held = [np.r_[h[:1], h[-small:]] for h in held]
    if held is not None:
        yield found(*held)


def _compare(batches: Iterator[pa.RecordBatch], similarity: float, at_once: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Similar pairs of different roots in rows sorted by unit: first the asked texts, then those that they are compared with."""
    names = ["cell", "chunk", "part"]
    now, asked, index = None, [], None

    def built():
        ids, roots = (np.array([a[i] for a in asked], np.int64) for i in (0, 1))
        sets = [a[2] for a in asked]
        sizes = np.array([len(x) for x in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(every, kind="stable")
        return ids, roots, sizes, every[order], owner[order]

    for batch in batches:
        out_u, out_v = [], []
        unit = list(zip(*(batch.column(n).to_pylist() for n in names)))
        for u, side, id_, root, raw in zip(unit, *(batch.column(n).to_pylist() for n in ("side", "id", "root", "set"))):
            if u != now:
                now, asked, index = u, [], None
            own = np.frombuffer(raw, np.uint64)
            if side == 0:
                asked.append((id_, root, own))
                continue
            if not asked:
                continue
            index = index or built()
            ids, roots, sizes, every, owner = index
            lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            both, step = np.zeros(len(ids), np.int64), max(1, at_once // len(ids))
            for at in range(0, len(own), step):
                a, n = lo[at : at + step], (hi - lo)[at : at + step]
                where = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both += np.bincount(owner[where], minlength=len(ids))
            hit = np.flatnonzero((both >= similarity * (sizes + len(own) - both)) & (roots != root))
            out_u += [id_] * len(hit)
            out_v += ids[hit].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])


def crossing(nodes: DataFrame, sets: DataFrame, rings: Rings, similarity: float, small: int) -> DataFrame:
    """Similar pairs of different roots within cells; written."""
    rows = keyed(nodes, rings, *PRINT).repartition("key").sortWithinPartitions("key")
    cells = components(rows.mapInArrow(lambda b: _connect(b, rings, small, similarity), "u long, v long")).select(F.col("u").alias("id"), F.col("root").alias("cell"))
    of = materialize(nodes.select("id", "root").join(cells, "id", "left").withColumn("cell", F.coalesce("cell", "id")))
    mains = of.groupBy("cell", "root").count().groupBy("cell").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("n"), F.count("*").alias("roots"))
    mains = materialize(mains.filter("roots > 1"))
    of = of.join(mains.select("cell", "main", "n"), "cell")
    counts = of.filter("root <> main").groupBy("cell").agg(F.ceil(F.count("*") / ASKED).alias("chunks"))
    of = materialize(of.join(counts, "cell").withColumn("parts", F.ceil(F.col("n") / MEMBERS)))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("long")
    asked = of.filter("root <> main").select("cell", own("chunks").alias("chunk"), number("parts").alias("part"), F.lit(0).alias("side"), "id", "root")
    others = of.select("cell", number("chunks").alias("chunk"), own("parts").alias("part"), F.lit(1).alias("side"), "id", "root")
    units = asked.unionByName(others).join(sets, "id").repartition("cell", "chunk", "part").sortWithinPartitions("cell", "chunk", "part", "side")
    return materialize(units.mapInArrow(lambda b: _compare(b, similarity), "u long, v long"))


def similar_groups(docs: DataFrame, words_in: int = WORDS, similarity: float = SIMILARITY, small: int = SMALL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node (key of the text) and component (a number of its group) for every document; written."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("node"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            hashes, bounds = shingles(batch.column("text"), words_in)
            made = wide_prints(hashes, bounds)
            keep = [batch.column("doc_id"), batch.column("node"), pa.array(np.diff(bounds))]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(made[:, j].view(np.int64)) for j in range(made.shape[1]))], ["doc_id", "node", "size", *PRINT])

    printed = materialize(rows.mapInArrow(run, wider(rows.select("doc_id", "node"), size="long", **dict.fromkeys(PRINT, "long"))))
    # Written numbers stay what they are when tasks are run again.
    distinct = printed.groupBy("node").agg(*(F.min(c).alias(c) for c in ("size", *PRINT)))
    nodes = materialize(distinct.withColumn("id", F.monotonically_increasing_id()))
    rings = plan_rings(nodes.count(), similarity)
    alone = nodes.filter("size > 0").withColumn("root", F.col("id")).withColumn("common", F.col("size"))
    active = nodes.join(proposed(alone, rings, similarity, small).select(F.col("u").alias("id")), "id", "left_semi")
    one = rows.select("node", "text").join(active.select("node", "id"), "node").groupBy("id").agg(F.min("text").alias("text"))
    sets = materialize(one.mapInArrow(lambda b: _sets(b, words_in), "id long, set binary"))
    own = sets.mapInArrow(_spread, "shingle long, id long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").groupBy("id").agg(F.count("*").alias("own"))
    active = active.join(own, "id", "left").withColumn("common", F.col("size") - F.coalesce("own", F.lit(0))).filter(F.col("common") >= similarity * F.col("size"))
    active = materialize(active.withColumn("root", F.col("id")))
    release(docs.sparkSession)
    links = None
    for _ in range(ROUNDS):
        pairs = proposed(active, rings, similarity, small).select("u", F.explode("vs").alias("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        new = verified(pairs, active, sets, rings, similarity)
        links = links.unionByName(new) if links else new
        labels = components(links).withColumnRenamed("u", "id")
        active = materialize(active.drop("root").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id")))
    release(docs.sparkSession)
    more = crossing(active, sets, rings, similarity, small)
    labels = labels if more.isEmpty() else components(links.unionByName(more)).withColumnRenamed("u", "id")
    named = nodes.select("node", "id").join(labels, "id", "left").select("node", F.coalesce("root", "id").alias("component"))
    return materialize(printed.select("doc_id", "node").join(named, "node"))


def keep_one(docs: DataFrame, words_in: int = WORDS, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, the one with the least id; of equal ids that with the least key."""
    rows = similar_groups(docs, words_in, similarity, doc_id=doc_id, text=text)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("node").alias("node"))
    least = rows.groupBy("component").agg(F.min(rank).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.node").alias("__kept"))
    again = rows.groupBy("doc_id", "node").count().select(F.col("doc_id").alias("__of"), F.col("node").alias("__text"), "count")
    least = least.join(again, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__kept") == F.col("__text"))).select("__id", "__kept", (F.col("count") > 1).alias("__again"))
    least = materialize(least)
    # ``keys`` of documents: a hash brings both parts of the key together, and null ids.
    named = docs.withColumn("__node", text_key(F.col(text)))
    on = (F.col("__node") == F.col("__kept")) & F.col(doc_id).eqNullSafe(F.col("__id"))
    kept = named.join(least.filter("not __again"), on, "left_semi").drop("__node")
    if least.filter("__again").isEmpty():
        return kept
    return kept.unionByName(named.join(least.filter("__again"), on, "left_semi").dropDuplicates([doc_id, "__node"]).drop("__node"))
