"""One passage in very many texts, and very many fingerprints of one key: whole results, and no task with most of the work."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioforge.llm import simhash, substrings


def test_one_passage_in_very_many_texts(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for i in range(12_000):
        say = [f"w{rng.randrange(10**6)}" for _ in range(20)]
        docs.append((i, " ".join(say[:10] + passage + say[10:])))
    docs += [(20_000 + i, " ".join([f"x{i}"] + passage[k : k + 40])) for i, k in enumerate(range(20))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substrings.repeat_report(substrings.drop_repeats(d, crowd=500)).collect()}
    lists = {i: t.split() for i, t in docs}
    count = Counter(tuple(w[s : s + 35]) for w in lists.values() for s in range(len(w) - 34))
    for i, w in lists.items():
        gone = {p for s in range(len(w) - 34) if count[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_removed, got[i].kept_sha256) == (len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_fingerprints_of_one_key(spark):
    rng = np.random.default_rng(12)
    # All share 32 bits; near ones are planted among them.
    low = rng.integers(1 << 32, size=20_000).astype(np.uint64)
    fps = np.unique(np.uint64(0x5A5A5A5A << 32) | low)
    near = fps[:400] ^ np.uint64(0b101)
    fps = np.unique(np.r_[fps, near])
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    root = {r.fp: r.root for r in simhash.link_components(nodes).collect()}
    label = np.arange(len(fps))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for at in range(0, len(fps), 500):
        a, b = np.nonzero(np.bitwise_count(fps[at : at + 500, None] ^ fps[None, :]) <= 3)
        for i, j in zip((a + at).tolist(), b.tolist()):
            if i != j:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    want = {int(fps.view(np.int64)[i]): int(fps.view(np.int64)[find(i)]) for i in range(len(fps))}
    groups = {}
    for x, y in want.items():
        groups.setdefault(y, set()).add(root.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups) < len(fps)


def test_parts_of_a_large_key_are_alike(spark):
    fps = np.unique(np.uint64(0x11112222 << 32) | np.random.default_rng(1).integers(1 << 32, size=30_000).astype(np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    # What is in one unit of work is two parts at most; none is near the whole key.
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(15))
    parts = [r["count"] for r in nodes.groupBy(own).count().collect()]
    assert len(parts) == 15 and max(parts) < 1.2 * 30_000 / 15
    assert simhash.link_components(nodes).count() < 30_000
