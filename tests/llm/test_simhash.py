"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash

from folioforge.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "One two", "one TWO", "a", "Straße ÉTÉ été x\ty\x0bz"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([40, 200, 600]))]
        texts.append(" ".join(base))
        for _ in range(8):
            other = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append("\n".join(other))
    return texts


def test_fingerprints_and_components(spark):
    texts = corpus()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "", None)]
    got = simhash.near_duplicate_report(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()
    prints = [brute_print(t) for _, t, _ in rows]
    label = brute_components(prints)
    least = {}
    for (i, _, _), x in zip(rows, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    want = sorted((str(i), f"{p:016x}", least[x]) for (i, _, _), p, x in zip(rows, prints, label))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert len(set(label)) < len(prints) - 20


def test_links_of_close_and_crowded_fingerprints(spark):
    rng = np.random.default_rng(5)
    bits = [0, 1, 7, 16, 17, 31, 40, 47, 50, 63]
    base = int(rng.integers(1 << 63))
    fps = {base ^ sum(1 << b for b in bits if rng.random() < 0.5) for _ in range(300)} | {int(x) for x in rng.integers(1 << 63, size=200)}
    far = [int(x) for x in rng.integers(1 << 63, size=60)]
    for x in far:
        y = x
        for b in rng.choice(64, size=int(rng.integers(1, 6)), replace=False):
            y ^= 1 << int(b)
        fps |= {x, y}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    root = {r.fp & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.link_components(nodes).collect()}
    label = brute_components(fps)
    groups = {}
    for x, y in zip(fps, label):
        groups.setdefault(y, set()).add(root.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_forest_matches_union_find():
    u, v = np.array([5, 9, 1, 7], np.uint64), np.array([9, 5, 2, 9], np.uint64)
    a, b = simhash.forest(u, v)
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 1), (7, 5), (9, 5)]


def test_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "A b c d", "y"), (5, "other words here now", "z"), (None, None, "n"), (7, "", "e")], "doc_id long, text string, source string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.source) for r in kept.collect()) == [("1", "x"), ("5", "z"), ("7", "e")]


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
