"""Near-duplicates at a similarity against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import similar


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def linked(a, b, similarity=0.8):
    return a == b or bool(a and b) and min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b)


def brute_groups(texts, similarity=0.8):
    """A label for each text, the same for all of a group."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and linked(sets[i], sets[j], similarity):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def pairs_found(texts, group):
    """Linked pairs of texts with different words: all, and those in one group."""
    sets, keys = [shingle_set(t) for t in texts], [tuple(words(t)) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    near = {(i, j) for of in where.values() if len(of) < 400 for i in of for j in of if j < i}
    near = [(i, j) for i, j in near if keys[i] != keys[j] and linked(sets[i], sets[j])]
    return len(near), sum(group[i] == group[j] for i, j in near)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [None, "", " \n", "One two", "one  TWO", "a", "a b c d e", "A b c d e", "a b c d e f", "Straße ÉTÉ été x\ty\x0bz q"]
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 150, 600]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 6])):
            other = list(base)
            for _ in range(max(1, round(len(other) * rng.choice([0.005, 0.01, 0.02, 0.03])))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append("\n".join(other).upper() if rng.random() < 0.2 else " ".join(other))
    return texts


def groups_of(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(5)
    return {r.doc_id: r.component for r in similar.similar_groups(docs, **how).collect()}


@pytest.mark.parametrize("small", [64, 3])
def test_groups_match_all_pairs(spark, small):
    texts = corpus(1)
    got, label = groups_of(spark, texts, small=small), brute_groups(texts)
    by = {}
    for i in range(len(texts)):
        by.setdefault(got[i], set()).add(label[i])
    # Nothing is brought together that is not linked.
    assert all(len(x) == 1 for x in by.values())
    n, found = pairs_found(texts, got)
    assert n > 100 and found >= 0.97 * n


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(700):
        other = list(base)
        for _ in range(rng.choice([1, 3, 5])):
            other[rng.randrange(300)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(other))
    # A second group that is close to the first, but not near enough.
    far = base[:220] + [f"u{i}" for i in range(80)]
    texts += [" ".join(far[:k] + ["q"] + far[k:]) for k in range(100, 120)]
    got = groups_of(spark, texts, small=16)
    label = brute_groups(texts)
    assert len({got[i] for i in range(700)}) == len(set(label[:700])) == 1
    assert len({got[i] for i in range(700, 720)}) == 1 and got[700] != got[0] and label[700] != label[0]


def test_prints_of_similar_texts_are_near(spark):
    rng = np.random.default_rng(3)
    for similarity in (0.8, 0.9):
        both = [rng.integers(1 << 63, size=400).astype(np.uint64) for _ in range(60)]
        more = round(400 * (1 - similarity) / (2 * similarity))
        a = [np.r_[x, rng.integers(1 << 63, size=more).astype(np.uint64)] for x in both]
        b = [np.r_[x, rng.integers(1 << 63, size=more).astype(np.uint64)] for x in both]
        made = [similar.wide_prints(np.concatenate(x), np.cumsum([0] + [len(y) for y in x])) for x in (a, b)]
        rings = similar.plan_rings(1 << 18, 0.8)
        assert (np.bitwise_count(made[0] ^ made[1]).sum(1) <= rings.budget).all()
        hit = np.zeros(60, bool)
        for (k, c), (l, d) in zip(similar.ring_keys(made[0], rings), similar.ring_keys(made[1], rings)):
            hit |= (k == l) & similar.chains_hold(c ^ d, rings)
        assert hit.mean() >= 0.95
    assert (np.bitwise_count(made[0] ^ np.roll(made[1], 1, 0)).sum(1) > rings.budget).all()


def test_shingles():
    hashes, bounds = similar.shingles(pa.array(["a b c d e f", None, "A B", "a b", "a b c d e a b c d e a b c d e"]), 5)
    each = [set(hashes[bounds[i] : bounds[i + 1]].tolist()) for i in range(5)]
    assert [len(x) for x in each] == [2, 0, 1, 1, 5] and each[2] == each[3] and len(each[0] & each[4]) == 1


def test_keep_one_with_repeated_ids_and_nulls(spark):
    a, b = "one two three four five six", "other words that are not at all near to it"
    docs = spark.createDataFrame([(None, a, 1), (4, a.upper(), 2), (4, a, 2), (None, b, 3), (None, b, 3), (9, None, 4), (8, "", 5)], "doc_id long, text string, node int")
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.node) for r in kept.collect()) == [("4", 2), ("8", 5), ("None", 3)]
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_recall_on_the_tables(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    n, found = pairs_found(texts, groups_of(spark, texts))
    assert n >= 5 and found == n


def test_group_in_which_most_pairs_miss_the_similarity(spark):
    rng = random.Random(21)
    base = [f"v{i}" for i in range(150)]
    texts = []
    for _ in range(400):
        other = list(base)
        for p in rng.sample(range(150), rng.randrange(8)):
            other[p] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(other))
    sets = [shingle_set(t) for t in texts]
    near = [linked(sets[i], sets[j]) for i in range(400) for j in range(i)]
    assert 0.05 < sum(near) / len(near) < 0.3
    got, label = groups_of(spark, texts), brute_groups(texts)
    pairs = lambda of: {tuple(sorted(i for i in range(400) if of[i] == x)) for x in {of[i] for i in range(400)}}
    assert pairs(got) == pairs(dict(enumerate(label))) and len(set(label)) > 50


def test_comparing_takes_blocks_of_any_order(spark):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(40)]
    rows = [(0, c, 0, side, i, i % 3, sets[i].tobytes()) for c in range(2) for side in (0, 1) for i in range(40) if side or (i % 2 == c and i < 30)] + [(0, 2, 0, 1, 5, 0, sets[5].tobytes())]
    names = ["cell", "chunk", "part", "side", "id", "root", "set"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[at : at + 7]]) for at in range(0, len(rows), 7)]
    got = {(u, v) for b in similar._compare(iter(batches), 0.4, at_once=50) for u, v in zip(*(b.column(c).to_pylist() for c in ("u", "v")))}
    want = {(i, j) for i in range(40) for j in range(30) if i % 3 != j % 3 and len(set(sets[i]) & set(sets[j])) >= 0.4 * len(set(sets[i]) | set(sets[j]))}
    assert got == want and len(want) > 10
