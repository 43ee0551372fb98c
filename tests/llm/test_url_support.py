"""Rules of hosts that hold a small share of the urls."""

from folioforge.llm import urls


def test_rare_bad_host_gives_a_rule(spark):
    rows = [(f"http://blog{i % 50}.org/read/{i}", False) for i in range(6000)] + [(f"http://rare.org/read/{i}", True) for i in range(11)]
    # Nine urls are too few.
    rows += [(f"http://few.org/read/{i}", True) for i in range(9)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = urls.mine(labelled)
    assert mined is not None and any(r.tokens == ["host:rare"] for r in mined.collect())
    new = spark.createDataFrame([("http://rare.org/new/1",), ("http://few.org/new/1",), ("http://blog1.org/new/1",)], "url string")
    assert [r.verdict for r in urls.judge(new, [], mined).orderBy("url").collect()] == ["allow", "allow", "block"]
