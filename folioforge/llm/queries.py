"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chat, decontam, langid, mixing, secrets, simhash, substrings, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontam.contamination_report(found)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_report(substrings.drop_repeats(_table(spark, sf_dir, "documents")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.secret_report(secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_report(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(mixing.mix_sources(_table(spark, sf_dir, "documents"))).drop("source")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], chats.schema)
    return chat.chat_digest(chat.format_chats(chats.unionByName(own)))


#: Listed rules: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and bad: a page is bad if a listed rule blocks it, or the document with its number is labelled as of low quality.

    So rules that are mined carry what the listed ones know over to hosts and paths that these don't name.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    low = _table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("page_id")).distinct().withColumn("low", F.lit(True))
    listed = urls.judge(pages, URL_RULES, None).join(low, "page_id", "left")
    return listed.select("page_id", "url", ((F.col("verdict") == "block") | F.coalesce("low", F.lit(False))).alias("bad"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = urls.mine(url_labels(spark, sf_dir))
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, mined).select("page_id", "host", "path", "rule", "verdict")


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_digest(audio.store_audio(_table(spark, sf_dir, "documents"), "text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substrings": op2_substrings,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_chat_format": op7_chat_format,
    "op8_url_filter": op8_url_filter,
    "op9_audio": op9_audio,
    "op10_simhash": op10_simhash,
}



# What SQL can express of the queries above, by the same operators, as queries of their own.


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3_secrets; the model adds spans of its own kind only."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target", ((F.col("taken") >= 0) & (F.col("taken") <= 2 * F.col("size"))).alias("bounded"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_url_filter that listed rules decide."""
    return op8_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("listed"))


def audio_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PARTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"secret_patterns": secret_patterns, "mix_targets": mix_targets, "url_rules": url_rules, "audio_payloads": audio_payloads}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS1 = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS1.format("coalesce(text, '')")} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS1.format("coalesce(text, '')")} AS w FROM documents),
spot AS (
  SELECT r, s, size, array_to_string(w[s : s + size - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT size FROM wins), unnest(range(1, len(w) - size + 2)) AS t(s)),
hit AS (SELECT r, s, spot.size, item FROM spot JOIN wins USING (win) WHERE spot.size = wins.size),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, s, size FROM hit), unnest(range(s, s + size)) AS t(p) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

_OP2 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT r, s, md5(array_to_string(w[s : s + 34], ' ')) AS win FROM docs, unnest(range(1, len(w) - 33)) AS t(s)),
again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY win) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT r, p FROM again, unnest(range(s, s + 35)) AS t(p)),
lists AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(coalesce(ps, [])) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM docs LEFT JOIN lists USING (r)
"""


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in sorted({chat.OPEN, chat.CLOSE[:-1], *chat.CONTROL}, key=lambda c: (-len(c), c)):
        out = f"replace({out}, '{c}', '{c[0]}\\-{c[1:]}')"
    return out


_OP7 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.OPEN) + 1 + len(chat.CLOSE)} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_QUOTED = {kind: pattern.replace("'", "''") for kind, pattern in (("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX))}
_MATCHES = " UNION ALL ".join(
    f"SELECT r, {i} AS k, '{kind}' AS kind, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}') AS found FROM docs WHERE regexp_matches(t, '{p}')" for i, (kind, p) in enumerate(_QUOTED.items())
)
_SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({_MATCHES}),
each AS (SELECT r, k, kind, found[i] AS m, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS s FROM parts, unnest(range(1, len(found) + 1)) AS t(i)),
kept AS (SELECT *, CAST(s AS BIGINT) AS a, CAST(s + length(m) AS BIGINT) AS b FROM each WHERE kind <> 'assign' OR length(regexp_extract(m, '{_QUOTED["assign"]}', 2)) >= 6),
named AS (SELECT r, count_if(k = 0) AS n0, count_if(k = 1) AS n1, count_if(k = 2) AS n2, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS said FROM kept GROUP BY r)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(said, '')) AS base_sha256 FROM docs LEFT JOIN named USING (r)
"""

# Capped sources are those with the least room for their weight; the others share what is left.
_TARGETS = r"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM docs GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM per),
ranked AS (SELECT *, 2.0::DOUBLE * n / w AS room, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST) AS i FROM weighed),
cuts AS (SELECT a.i, coalesce((SELECT sum(n) FROM ranked b WHERE b.i < a.i), 0) AS taken, (SELECT sum(w) FROM ranked b WHERE b.i >= a.i) AS weight, room FROM ranked a),
cut AS (SELECT *, (1.5::DOUBLE * (SELECT sum(n) FROM per) - 2 * taken) AS rest FROM cuts WHERE (1.5::DOUBLE * (SELECT sum(n) FROM per) - 2 * taken) / weight <= room ORDER BY i LIMIT 1),
goals AS (SELECT source, n, CASE WHEN cut.i IS NOT NULL AND ranked.i >= cut.i THEN cut.rest * w / cut.weight ELSE 2.0::DOUBLE * n END AS target FROM ranked LEFT JOIN cut ON true)
SELECT doc_id, size, n AS source_size, CAST(target AS DOUBLE) AS target, true AS bounded FROM docs JOIN goals ON docs.source IS NOT DISTINCT FROM goals.source
"""

_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in enumerate(sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r))))
_BY_LENGTH = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r))
_URLS = f"""
WITH after AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
parts AS (SELECT page_id, {_LOWER.format("regexp_extract(u, '^[^/?#]*')")} AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM after)
SELECT page_id, host, path, CASE {_FITS.format(*(f"'{h}{p}'" for _, h, p in _BY_LENGTH))} END AS rule, CASE {_FITS.format(*(f"'{v}'" for v, _, _ in _BY_LENGTH))} END AS listed FROM parts
"""

_PAYLOADS = """
WITH raw AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
full_ AS (SELECT *, greatest(64, (n + 63) // 64 * 64) AS m FROM raw)
SELECT doc_id, n AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(t || repeat(chr(0), CAST(m - n AS INT))) AS payload_sha256 FROM full_
"""

ORACLES: dict[str, str] = {"op1_decontamination": _OP1, "op2_substrings": _OP2, "op7_chat_format": _OP7}
PART_ORACLES: dict[str, str] = {"secret_patterns": _SECRETS, "mix_targets": _TARGETS, "url_rules": _URLS, "audio_payloads": _PAYLOADS}
