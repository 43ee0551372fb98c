"""The words that the mix has in its slots."""

import re

import numpy as np

from folioforge.llm import mixing


def test_slots_hold_the_words_of_documents(spark):
    rng = np.random.default_rng(4)
    data = [(i, " \n".join(f"é{i}_{k}" for k in range(int(rng.integers(0, 300)))), "ab"[i % 2]) for i in range(60)]
    data += [(3, data[3][1], "b"), (None, "no\tid\x0bhere", None), (60, None, "a"), (61, "", "b"), (62, " ".join(f"long{k}" for k in range(20_000)), "a")]
    mix = mixing.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3))
    at = {(r.src, r.start): r.doc_id for r in mix.docs.filter("size > 0").collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, _ in data}
    got = mix.mixed().collect()
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    taken = {}
    for r in got:
        want = []
        for p in r.pieces:
            i = at[r.src, p.start]
            want += words[i][p.from_word : p.from_word + p.n]
            taken[r.src, p.start] = taken.get((r.src, p.start), 0) + p.n
        assert r.text.split(" ") == want and len(want) == r.n <= mixing.BLOCK
    report = mixing.mix_report(mix).collect()
    assert sum(r.taken for r in report) == sum(len(r.text.split(" ")) for r in got) == sum(taken.values())
    assert sum(r.taken for r in report if r.doc_id == 62) == sum(n for k, n in taken.items() if at[k] == 62) > 0
