"""A benchmark too large for a broadcast index: the same hits by joins, in bounded memory of the driver."""

import random
import resource

import pytest

from folioforge.llm import decontam
from test_decontam import brute, data


@pytest.mark.parametrize("most_prints", [1 << 20, 0])
def test_joined_hits_match_all_windows(spark, most_prints):
    docs, items = data()
    items += [(200 + i, items[2][1]) for i in range(30)]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, __key int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = decontam.contamination_report(decontam.decontaminate(d, b, block_bytes=0, most_prints=most_prints)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(docs, items)


def test_driver_memory_does_not_follow_the_benchmark(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=400))) for i in range(2500)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=50)) + " " + (" ".join(items[i][1].split()[20:40]) if i % 2 else "")) for i in range(60)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.contamination_report(decontam.decontaminate(d, b)).collect()}
    # Eight megabytes of text: a broadcast index would take three gigabytes.
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    assert all(got[i] == ((20, 1) if i % 2 else (0, 0)) for i in got) and len(got) == 60
