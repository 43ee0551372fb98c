"""URL filters by association rules, in DataFrame functions only.

A listed rule (host, path) fits its host and all subdomains of it, if the url's
path starts with the rule's; the longest rule that fits decides. Where none fits,
mined rules decide: FP-growth finds combinations of url tokens that go with bad
labels; rules above a confidence that rest on ``LEAST`` urls stay; each is indexed under its
rarest token, and a url is blocked if it has all tokens of a rule.

FP-growth is fitted on at most ``most`` labelled urls, those with the least hash.

Defined cases: a null url, or one without ``://``, has an empty host and path and
no tokens, and is allowed; null labels teach nothing; a url with several labels is
bad if any says so; without labels nothing is mined; repeated rows give repeated
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MOST = 20_000
CONFIDENCE = 0.8
#: Labelled urls that a rule must rest on at least: fewer can agree by chance. No share of the sample is asked for besides.
LEAST = 10
#: Mined rules up to which they are broadcast.
FEW = 20_000
BAD = "label:bad"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that decides, as text, and its verdict; null where none fits. rules: verdict, host, path."""
    name = verdict = None
    for word, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, word) if verdict is None else verdict.when(fits, word)
    empty = F.lit(None).cast("string")
    return (empty, empty) if name is None else (name, verdict)


def url_tokens(url: Column) -> Column:
    """Tokens of a url: scheme, labels of the host, path segments (runs of digits as #) and query keys, each once."""
    after = _after(url)
    scheme = F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))
    hosts = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "#")))
    query = F.regexp_extract(after, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    return F.when(after != "", F.array_distinct(F.concat(F.array(scheme), hosts, parts, keys))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", most: int = MOST, support: float = 0, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame | None:
    """Rules: tokens, token (the rarest of them), confidence, support. Their support is at least ``support`` and ``least`` urls. ``bad`` is true for urls to block. None without any rule."""
    rows = labelled.filter(F.col(url).isNotNull() & F.col(bad).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.max(F.col(bad).cast("int")).alias("bad"))
    rows = rows.orderBy(F.xxhash64("url"), "url").limit(most)
    items = rows.select(F.concat(url_tokens(F.col("url")), F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")).filter(F.size("items") > 0)
    # At most ``most`` rows, which FP-growth reads several times.
    items = materialize(items)
    n = items.count()
    if n < least:
        return None
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / n), minConfidence=confidence).fit(items)
    rules = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).select(F.col("antecedent").alias("tokens"), "confidence", "support")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    one = rules.withColumn("token", F.explode("tokens")).join(single, "token").groupBy("tokens", "confidence", "support").agg(F.min(F.struct("freq", "token"))["token"].alias("token"))
    one = materialize(one)
    return None if one.isEmpty() else one


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], mined: DataFrame | None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    col = F.col(url)
    name, verdict = listed(F.col("host"), F.col("path"), rules)
    out = pages.withColumn("host", F.coalesce(host_of(col), F.lit(""))).withColumn("path", F.coalesce(path_of(col), F.lit("")))
    out = out.withColumn("rule", name).withColumn("__listed", verdict)
    if mined is None:
        return out.withColumn("verdict", F.coalesce("__listed", F.lit("allow"))).drop("__listed")
    index = F.broadcast(mined) if mined.count() <= FEW else mined
    open_ = out.filter("__listed is null").select(col.alias("__url")).filter("__url is not null").distinct().withColumn("has", url_tokens(F.col("__url")))
    hit = open_.withColumn("token", F.explode("has")).join(index, "token").filter(F.size(F.array_except("tokens", "has")) == 0)
    hit = hit.select("__url").distinct().withColumn("__bad", F.lit("block"))
    return out.join(hit, F.col("__url") == col, "left").withColumn("verdict", F.coalesce("__listed", "__bad", F.lit("allow"))).drop("__listed", "__url", "__bad")
