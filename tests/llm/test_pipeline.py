"""The pipeline against a plain Python version of its filters."""

import re

import corpus_pipeline
from folioforge.llm import secrets, toxicity
from test_decontam import brute as brute_hits
from test_similar import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    rows = [[r.asDict() for r in d.collect()] for d in kept]
    assert all(d.columns == docs.columns for d in kept[:-1])
    scores = toxicity.score(docs, toxicity.train(docs, labels)).filter("predicted = 1").collect()
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r in rows[0]} - {r.doc_id for r in scores}
    texts = sorted((r["doc_id"], r["text"]) for r in rows[1])
    label = brute_groups([t for _, t in texts])
    first = {}
    for (i, _), x in zip(texts, label):
        first.setdefault(x, i)
    assert {r["doc_id"] for r in rows[2]} == set(first.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {int(r[0]) for r in brute_hits([(r["doc_id"], r["text"]) for r in rows[2]], items) if r[-1]}
    assert {r["doc_id"] for r in rows[3]} == {r["doc_id"] for r in rows[2]} - hit
    assert [r["doc_id"] for r in sorted(rows[4], key=lambda r: r["doc_id"])] == sorted(r["doc_id"] for r in rows[3])
    for r in rows[4]:
        assert not re.search(f"{secrets.ACCESS}|{secrets.HEX}", r["text"]) and r["n_chars"] == len(r["text"])
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows[4]}
    assert {r["doc_id"]: r["size"] for r in rows[5]} == sizes
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, kept[-1].collect()))


def test_other_columns_pass_through_the_filters(spark):
    from folioforge.llm import decontam, simhash

    docs = spark.sql("SELECT 1L AS doc_id, 'one two three four' AS text, named_struct('a b', 1, 'c', array('x')) AS `odd name`, timestamp'2024-01-01' AS score, 2 AS fp, array(3) AS spans")
    bench = spark.createDataFrame([(1, "none of these")], "item_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    for out in (simhash.keep_one(docs), decontam.drop_contaminated(docs, bench), toxicity.score(docs, model, out=("__s", "__p")).select(docs.columns), secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs)), out="__x").select(docs.columns)):
        assert out.collect() == docs.collect()


def test_written_tables_can_be_dropped(spark):
    from pathlib import Path

    from folioforge.llm import common

    kept = common.materialize(spark.range(3))
    path = Path(common._written[-1].removeprefix("file:"))
    assert kept.count() == 3 and path.exists()
    assert common.drop_tables(spark) > 0 and not path.exists() and not common._written


def test_nulls_and_repeated_rows_pass(spark, tmp_path):
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words that are here to stay", None, None, 32), (3, "some words that are here to stay", None, None, 32), (None, "another text of other words entirely", "en", "a", 36)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == [("1", 0), ("3", 7), ("None", 6)]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
