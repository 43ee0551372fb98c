"""Source mixing: targets by hand, and what every mix must keep."""

import re

import numpy as np
import pytest

from folioforge.llm import mixing


def brute_targets(sizes, weights):
    goal = [0.0] * len(sizes)
    extra, free = 1.5 * sum(sizes), list(range(len(sizes)))
    while extra > 1e-9 and free:
        total = sum(weights[i] for i in free)
        for i in free:
            goal[i] += extra * weights[i] / total
        extra = 0.0
        for i in list(free):
            if goal[i] > 2 * sizes[i]:
                extra += goal[i] - 2 * sizes[i]
                goal[i] = 2 * sizes[i]
                free.remove(i)
    return goal


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 10, 5, 0, 300], [0], [7], [5, 90000, 3, 40, 40, 40], []])
def test_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, 1.5, 2)
    assert got == pytest.approx(brute_targets(sizes, weights))
    assert sum(got) == pytest.approx(1.5 * sum(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutation(n):
    a, b = mixing.permute(np.arange(n), n, 5), mixing.permute(np.arange(n), n, 6)
    assert sorted(a.tolist()) == list(range(n)) == sorted(b.tolist())
    assert n < 64 or a.tolist() != b.tolist()


def test_draw_is_exact_and_within_what_is_left():
    left = np.array([5, 0, 100, 17])
    got = mixing.draw(np.random.default_rng(0), left, 120)
    assert got.sum() == 120 and (got <= left).all()


def rows():
    rng = np.random.default_rng(1)
    out = [(i, " ".join(["w"] * int(rng.integers(0, 900))), ["big", "big", "big", "mid", "smäll", None][int(rng.integers(0, 6))]) for i in range(400)]
    return out + [(400, None, "mid"), (401, "", "empty"), (402, "one two", "tiny"), (5, out[5][1], out[5][2]), (None, "a\tb\x0bc", "mid"), (403, "x " * 60000, "big")]


def test_mix(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, source string, target int").repartition(5)
    mix = mixing.mix_sources(docs)
    got = mixing.mix_report(mix).collect()
    again = mixing.mix_report(mixing.mix_sources(docs.repartition(3))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), size(t)) for i, t, _ in data)
    totals = {}
    for _, t, s in data:
        totals[s] = totals.get(s, 0) + size(t)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, brute_targets([totals[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    taken = {}
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(goals[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - goals[s]) <= mixing.BLOCK for s in names)
    mixed = mix.mixed().collect()
    assert sum(r.n for r in mixed) == sum(taken.values())
    per_slot = {}
    for r in mixed:
        per_slot[r.shard, r.slot] = per_slot.get((r.shard, r.slot), 0) + r.n
    assert max(per_slot.values()) == mixing.BLOCK
    assert max(s for _, s in per_slot) < mixing.SLOTS


def test_empty(spark):
    assert mixing.mix_report(mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string"))).count() == 0
