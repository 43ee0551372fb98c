"""Rows that repeat very often, and sources of many buckets."""

import re

import numpy as np

from folioforge.llm import mixing


def test_repeated_rows_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 40)
    monkeypatch.setattr(mixing, "HOT", 100)
    rng = np.random.default_rng(2)
    same = (1, " ".join(f"s{k}" for k in range(30)), "a")
    data = [same] * 900 + [(10 + i, " ".join(f"w{i}_{k}" for k in range(int(rng.integers(0, 200)))), "abc"[i % 3]) for i in range(300)] + [(9, None, None)] * 150
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    mix = mixing.mix_sources(docs)
    got = mixing.mix_report(mix).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(mixing.mix_sources(docs.repartition(2))).collect()))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len((t or "").split())) for i, t, _ in data)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken, goal = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + mixing.BLOCK for s in taken)
    at = {(r.src, r.start): r.doc_id for r in mix.docs.filter("size > 0").collect()}
    words = {i: re.findall(r"\S+", t or "") for i, t, _ in data}
    mixed = mix.mixed().collect()
    assert len(at) == sum(len((t or "").split()) > 0 for _, t, _ in data) and sum(r.n for r in mixed) == sum(taken.values())
    for r in mixed:
        assert r.text.split(" ") == [w for p in r.pieces for w in words[at[r.src, p.start]][p.from_word : p.from_word + p.n]]


def test_groups_of_shards_are_dealt_exactly():
    left = np.array([1000, 0, 77, 12_345])
    groups = list(mixing.deal_groups(np.random.default_rng(0), left, np.zeros(4, np.int64), 0, 14, 5, 1000))
    assert [g[:2] for g in groups] == [(0, 2), (2, 3), (5, 3), (8, 3), (11, 3)]
    assert np.sum([g[2] for g in groups], 0).tolist() == left.tolist()
    assert all(np.array_equal(np.sum([g[2] for g in groups[:i]], 0) if i else np.zeros(4), groups[i][3]) for i in range(5))
