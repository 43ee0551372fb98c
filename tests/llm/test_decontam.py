"""Winnowing decontamination against a scan of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from folioforge.llm import decontam
from folioforge.llm.common import kgram_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, of in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    ids |= of
        names = sorted(str(i) for i in ids if i is not None)
        out.append((str(d), len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def data():
    rng = random.Random(4)
    vocabulary = ["été", "Haus", "a", "b", "c", "d", "e", "x9", "9", "zz", "q"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([12, 14, 30]))) for i in range(12)] + [(12, say(7)), (13, say(6)), (13, say(11)), (14, ""), (15, None), (None, say(12)), (101, "Zebra-Yak")]
    docs = [(i, say(rng.randrange(60))) for i in range(40)] + [(40, None), (41, ""), (42, "...")]
    for n, (_, t) in enumerate(items):
        docs.append((50 + n, f"{say(9)}, {(t or '').upper().replace('É', 'é')}! {say(5)}"))
    docs += [(80, "say Zebra\nyak zebra yak"), docs[3], (None, items[0][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_same_hits_as_all_windows(spark, block_bytes):
    docs, items = data()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination_report(decontam.decontaminate(d, b, block_bytes=block_bytes)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(docs, items)


def test_drop_keeps_columns_and_clean_rows(spark):
    docs, items = data()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, __kept string")
    kept = decontam.drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    assert kept.count() == sum(not r[-1] for r in brute(docs, items))


def test_empty_sides(spark):
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.contamination_report(decontam.decontaminate(d, b)).collect()] == [0]
    assert decontam.decontaminate(d.limit(0), d.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_every_window_gives_a_print():
    grams = kgram_hashes(np.random.default_rng(0).integers(1 << 63, size=500).astype(np.uint64), 5)
    at = decontam.winnow(grams, 6)
    assert all(i <= p < i + 6 and grams[p] == grams[i : i + 6].min() for i, p in enumerate(at.tolist()))
