"""Rules mined from some urls, held against the listed verdicts of others."""

from pyspark.sql import functions as F

from folioforge.llm import queries, urls

SF = "/root/testdata/sf0.1"


def measured(spark, sf, confidence=urls.CONFIDENCE):
    fold = F.pmod(F.crc32(F.col("url")), F.lit(4)) == 2
    mined = urls.mine(queries.url_labels(spark, sf).filter(~fold), confidence=confidence)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").filter(fold)
    want = {r.page_id: r.verdict for r in urls.judge(pages, queries.URL_RULES, None).collect()}
    got = {r.page_id: r.verdict for r in urls.judge(pages, [], mined).collect()}
    both = sum(got[i] == want[i] == "block" for i in want)
    return mined.count(), both / sum(v == "block" for v in want.values()), both / sum(v == "block" for v in got.values()), len(want)


def test_mined_rules_know_held_out_urls(spark):
    rules, recall, precision, _ = measured(spark, SF)
    assert rules > 5 and recall > 0.9 and precision > 0.9


def test_the_query_goes_through_mined_rules(spark):
    mined = urls.mine(queries.url_labels(spark, SF))
    rows = queries.op8_url_filter(spark, SF).collect()
    open_ = [r for r in rows if r.rule is None]
    assert mined.count() > 5 and {r.verdict for r in rows if r.rule} == {"allow", "block"}
    assert all(r.verdict in ("allow", "block") for r in open_) and len(open_) > 100
