"""Texts far longer than a step, and n-grams in pieces."""

import random
import resource

import numpy as np
import pyarrow as pa

from folioforge.llm import langid, similar, simhash, substrings
from test_simhash import brute_print
from test_substrings import brute


def test_pieces_give_the_same_ngrams(monkeypatch):
    texts = pa.array(["Été — the house and the garden " * 40, None, "ab", "das haus, ÜBER alles " * 70, ""])
    whole, row = langid.gram_hashes(texts)
    monkeypatch.setattr(langid, "PIECE", 37)
    parts, of = langid.gram_hashes(texts)
    order = lambda h, r: sorted(zip(r.tolist(), h.tolist()))
    assert order(whole, row) == order(parts, of) and len(whole) > 5000
    filters = langid.Filters.build({"x": np.unique(whole[row == 0]), "y": np.unique(whole[row == 3])})
    assert filters.judge(texts)[0][:4:3] == ["x", "y"]


def test_ngrams_are_of_characters():
    # Three characters of two bytes each are one n-gram of order 3, 4 and 5 with their borders.
    hashes, row = langid.gram_hashes(pa.array(["éèü"]))
    assert len(hashes) == sum(max(0, len("  éèü ") - n + 1) for n in langid.ORDERS) or len(hashes) == sum(max(0, len(" éèü  ") - n + 1) for n in langid.ORDERS)


def test_memory_follows_the_text():
    text = pa.array(["some words of a very long text that goes on and on " * 160_000])
    filters = langid.Filters.build({"x": np.unique(langid.gram_hashes(pa.array(["some words of a long text"]))[0])})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert filters.judge(text)[0] == ["x"]
    # Eight megabytes of text; once it took a hundred times as much.
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_long_texts_of_operators(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(3000)}" for _ in range(120_000)]
    docs = [(1, " ".join(long)), (2, " ".join(["x"] * 5 + long[40_000:40_060] + ["y"])), (3, " ".join(long[:119_990] + ["z"] * 10)), (4, "short text")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = substrings.repeat_report(substrings.drop_repeats(d)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(docs, 35)
    found = {r.doc_id: r for r in simhash.near_duplicate_report(simhash.near_duplicates(d)).collect()}
    assert all(found[i].fingerprint == f"{brute_print(t):016x}" for i, t in docs)
    groups = {r.doc_id: r.component for r in similar.similar_groups(d).collect()}
    assert groups[1] == groups[3] and len(set(groups.values())) == 3
