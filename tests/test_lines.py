"""Artifacts in lines against those in one row, and numbers without a window over all rows."""

import json
from pathlib import Path

from folioforge import catalogue
from folioforge.operators.numbering import number_rows
from folioforge.plans import package


def written(target):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(Path(target).glob("part-*")))


def test_lines_are_the_artifacts(spark, sf, tmp_path):
    docs = catalogue.gated_documents(spark, sf).cache()
    for name, lines, whole in [
        ("index", package.index_lines(docs, "now"), package.master_index(docs, "now")),
        ("report", package.report_lines(docs), package.conversion_report(docs)),
    ]:
        package.write_lines(lines, f"{tmp_path}/{name}")
        assert written(f"{tmp_path}/{name}").rstrip() == whole.first().content
    package.write_lines(package.manifest_lines(docs, "now"), f"{tmp_path}/manifest")
    found, want = json.loads(written(f"{tmp_path}/manifest")), json.loads(package.manifest(docs, "now").first().content)
    assert found == want and found["documents"] and found["failed_documents"]
    one = docs.filter("doc_id = 1")
    assert package.index_lines(one, "now").count() == 0
    package.write_lines(package.manifest_lines(docs.limit(0), "now"), f"{tmp_path}/none")
    assert json.loads(written(f"{tmp_path}/none"))["documents"] == []


def test_numbers(spark):
    rows = spark.range(1000).selectExpr("(id * 617) % 1009 AS k", "id").repartition(7)
    found, n = number_rows(rows, "k")
    got = sorted((r.k, r.number) for r in found.collect())
    assert n == 1000 and [i for _, i in got] == list(range(1, 1001))
    assert number_rows(rows.limit(0), "k")[1] == 0 and number_rows(rows.limit(0), "k")[0].count() == 0
