"""Repeated windows against counting all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioforge.llm import substrings
from folioforge.llm.fmindex import FMIndex, matching_intervals


def brute(docs, length):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    count = Counter(tuple(w[s : s + length]) for w in lists for s in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(docs, lists):
        gone = {p for s in range(len(w) - length + 1) if count[tuple(w[s : s + length])] > 1 for p in range(s, s + length)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(length):
    rng = random.Random(length)
    say = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("éxy12") for _ in range(n)]
    shared, passage, docs = say(3 * length), say(length + 2), []
    for i in range(40):
        w = say(rng.randrange(4 * length))
        if i % 3 == 0:
            a = rng.randrange(len(shared) - length)
            w[len(w) // 2 : len(w) // 2] = shared[a : a + rng.randrange(length - 2, 2 * length)]
        if i % 4 == 0:
            w += passage
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(50, " ".join(["la"] * (3 * length))), (51, " ".join(["do", "re"] * length)), (52, None), (53, ""), (54, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (55, " ".join(docs[9][1].split()))]
    return docs


@pytest.mark.parametrize(("length", "crowd"), [(35, 20_000), (6, 20_000), (6, 2), (1, 20_000)])
def test_same_words_removed_as_by_counting(spark, length, crowd):
    docs = corpus(length)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, h string").repartition(3)
    got = substrings.repeat_report(substrings.drop_repeats(d, length=length, crowd=crowd)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(docs, length)


def test_empty(spark):
    assert substrings.repeat_report(substrings.drop_repeats(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_backward_search_counts():
    rng = np.random.default_rng(2)
    for _ in range(20):
        texts = [rng.integers(1, 4, int(rng.integers(0, 40))) for _ in range(6)]
        index = FMIndex(np.concatenate([np.r_[t, 0] for t in texts]).astype(np.int64), 5)
        for n in (1, 3, 5):
            count = Counter(tuple(t[i : i + n].tolist()) for t in texts for i in range(len(t) - n + 1))
            assert all(index.count(np.array(k)) == v for k, v in count.items())
            assert index.count(np.array([9][:1]) % index.sigma * 0 + 3) == sum(int((t == 3).sum()) for t in texts)


def test_blocks_of_keys_are_searched_whole():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 4, 30).astype(np.uint64) for _ in range(8)]
    row, a, b = substrings.search(texts, np.ones(8, bool), 4)
    count = Counter(tuple(t[i : i + 4].tolist()) for t in texts for i in range(27))
    for r, t in enumerate(texts):
        got = {p for x, s, e in zip(row, a, b) if x == r for p in range(s, e)}
        assert got == {p for i in range(27) if count[tuple(t[i : i + 4].tolist())] > 1 for p in range(i, i + 4)}


def test_no_match_at_all():
    index = FMIndex(np.array([1, 2, 3, 4, 0]), 3)
    assert len(matching_intervals(index, np.array([1, 2, 3, 4]), np.array([0, 4]), 2)[0]) == 0
