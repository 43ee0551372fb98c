"""Toxicity and language: held-out accuracy on the tables, and the cases at the edge."""

import zlib

import numpy as np
import pyarrow as pa

from folioforge.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_toxicity_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [(got[i].predicted, y) for i, y in labels.items() if held(i)]
    assert sum(p == y for p, y in out) / len(out) > 0.93
    assert sum(p and not y for p, y in out) <= 2


def test_toxicity_edges(spark):
    clean, bad = ["a fine day in the park", "we went to the market", "good bread and cheese"], ["you stupid moron", "what a stupid moron he is", "stupid moron go away"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate((clean + bad) * 12)] + [(900, None, 1), (901, "", 1), (None, "x", 1), (0, clean[0], 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 6 >= 3)) for i in range(72)] + [(3, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {(r.doc_id, r.text): r for r in toxicity.score(docs, model, out=("p", "y")).collect()}
    assert got[3, bad[0]].y == 1 and got[0, clean[0]].y == 0
    assert got[900, None].p == got[901, ""].p == 1 / (1 + np.exp(-model.bias))
    assert toxicity.toxicity_report(docs, model).count() == 76
    none = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.toxicity_report(docs, none).collect()} == {0}
    assert toxicity.toxicity_report(docs.limit(0), model).count() == 0


def test_presence_matches_all_grams():
    text = "Été — ABC abc 12 x"
    points = toxicity.characters(text)
    assert "".join(map(chr, points)) == " été — abc abc x ".replace("—", "—")
    values = set()
    for n in toxicity.gram_numbers(points):
        values |= set(n.tolist())
    assert set(toxicity.present(text).tolist()) == values
    long = "word and other " * 40000
    assert set(toxicity.present(long).tolist()) == set(toxicity.present("word and other " * 3).tolist())


def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op5_language(spark, SF).collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(langs)
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(got[i].lang_pred == y for i, y in langs.items() if held(i)) / sum(map(held, langs)) > 0.98


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, y) for i in range(40) for t, y in [("the house and the garden", "en"), ("das haus und der garten", "de")]] + [(90, None, "en"), (91, "", None), (92, "123 !?", "de"), (93, "É", None), (None, "und der", None)], "doc_id long, text string, lang string")
    filters = langid.train(docs)
    assert filters.langs == ["de", "en"]
    got = {(r.doc_id): r for r in langid.identify(docs, filters).collect()}
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and got[92].score == 0
    assert got[93].lang_pred in ("de", "en") and got[None].lang_pred == "de"
    empty = langid.train(docs.filter("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), filters).count() == 0


def test_filters_hold_all_that_was_put_in():
    rng = np.random.default_rng(0)
    grams = {f"l{i:02d}": rng.integers(1 << 62, size=200).astype(np.uint64) for i in range(70)}
    filters = langid.Filters.build(grams)
    for i, lang in enumerate(filters.langs):
        masks = filters.lookup(grams[lang])
        assert (masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    strange = rng.integers(1 << 62, size=20000).astype(np.uint64)
    seen = filters.lookup(strange)[0] & np.uint64(1)
    assert abs(seen.mean() - filters.false_positives()[0]) < 0.01


def test_grams_stay_within_texts():
    hashes, row = langid.gram_hashes(pa.array(["ab", None, "AB!"]))
    each = [sorted(hashes[row == i].tolist()) for i in range(3)]
    assert each[0] == each[2] or set(each[0]) < set(each[2])
    assert len(each[1]) <= 1
