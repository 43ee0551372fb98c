"""Registered queries of the training-data operators: SQL where there is some, contracts else."""

import re

import duckdb
import pytest

import corpus_pipeline
from folioforge.llm import queries

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, found = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    show = lambda rows, names: sorted(str([r[i] for i in sorted(range(len(names)), key=names.__getitem__)]) for r in rows)
    assert show(df.collect(), df.columns) == show(found.fetchall(), list(found.columns))


CONTRACT = {
    1: "doc_id n_words n_hit n_items items_sha256 contaminated", 2: "doc_id n_words n_removed kept_sha256", 3: "doc_id n_assign n_access n_hex base_sha256 spans", 4: "doc_id held_out score predicted",
    5: "doc_id held_out lang_pred score", 6: "doc_id size source_size target taken", 7: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", 8: "page_id host path rule verdict",
    9: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", 10: "doc_id fingerprint component_id",
}


def test_one_query_for_each_operator(spark, sf):
    by = {int(re.match(r"op(\d+)_", k)[1]): k for k in queries.QUERIES}
    assert sorted(by) == list(range(1, 11)) and len(corpus_pipeline.STAGES) == 5
    for n, columns in CONTRACT.items():
        assert set(columns.split()) <= set(queries.QUERIES[by[n]](spark, sf).columns)
