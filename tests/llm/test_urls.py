"""URL filters against plain Python and a scan of all token combinations."""

import re
from itertools import combinations

from folioforge.llm import queries, urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_listed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_listed_rules(spark):
    some = ["http://Example.COM/en/a", "https://www.example.com/en/", "x://a.example.com/fr/1", "http://net/es/x", "http://a.net/fr/?q", "http://notnet/es/", "http://com", "http://com/", "http://x.com?p=/en/", None, "", "no url", "a://b://c/d", "://net/es/", "http://É.net/es/ü#f", "http://h.org/en/1"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(some)] + [(0, some[0], "y"), (None, some[3], None)], "page_id long, url string, token string")
    got = urls.judge(pages, queries.URL_RULES, None).collect()
    assert len(got) == len(some) + 2
    for r in got:
        rule, verdict = brute_listed(*parse(r.url))
        assert (r.host, r.path, r.rule, r.verdict) == (*parse(r.url), rule, verdict or "allow")


def test_mined_rules_match_all_combinations(spark):
    rows = []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((f"http://{'spam' if bad and i % 8 else 'blog'}{'.x' if i % 3 else ''}.org/{'buy' if bad else 'read'}/{i}?{'ref' if i % 5 else 'id'}={i}", bad))
    rows += [(rows[1][0], None), (None, True)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = urls.mine(labelled, support=0.05, confidence=0.7)
    known = [(u, b) for u, b in rows if u and b is not None]
    df = spark.createDataFrame([(u,) for u, _ in known], "url string").select("url", urls.url_tokens(urls.F.col("url")).alias("t")).collect()
    items = [(set(r.t), b) for r, (_, b) in zip(df, known)]
    want = {}
    for k in range(1, 10):
        for combo in combinations(sorted({t for s, _ in items for t in s if "#" in t or ":" in t}), k):
            all_, bad = sum(set(combo) <= s for s, _ in items), sum(set(combo) <= s and b for s, b in items)
            if bad >= 0.05 * len(items) and bad / all_ >= 0.7:
                want[frozenset(combo)] = round(bad / all_, 6)
    got = {frozenset(r.tokens): round(r.confidence, 6) for r in mined.collect()}
    assert got == want and len(want) > 3
    pages = spark.createDataFrame([(u,) for u, _ in known] + [(None,), (known[0][0],)], "url string")
    for r in urls.judge(pages, [], mined).collect():
        has = next((s for (s, _), (u, _) in zip(items, known) if u == r.url), set())
        assert r.verdict == ("block" if any(k <= has for k in want) else "allow")


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "url string, bad boolean")
    assert urls.mine(empty) is None
    assert urls.judge(empty, queries.URL_RULES, None).count() == 0
