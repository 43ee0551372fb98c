"""Secret scans with character Markov models, in DataFrame functions only.

Three base patterns find credentials with a known shape. Beyond them, runs of 20
or more token characters are scored: two first-order Markov models over
characters, one of random strings and one of ordinary identifiers, give a
log-likelihood ratio, and a run whose mean ratio is above a threshold is a secret.

The models are trained from labelled samples (text, label); without samples of
label 1 the random model is uniform, and a pair of characters that no sample has
says nothing. ``labelled_samples`` makes such samples: label 1 for strings drawn
evenly from each of ALPHABETS and values of base matches, label 0 for words,
identifiers and paths made of them and of ``rules/words.txt``, dates, counters
and separator rules. Values and words come from about ``most`` different texts
each, those whose hash falls below their share (values: of POOL times as many texts);
words within runs and base matches are left out.

Positions are code points, end exclusive. All work is linear in the length of a text
and in the number of its spans: values are bound once, folds go over chunks of CHUNK
items, and masked texts are put together from pieces of PIECE characters.

Defined cases: a null text is empty and has no spans; added runs that overlap a base span are left out; of spans that
overlap, redaction masks their union; repeated rows give repeated rows; an empty
table gives no rows; other columns are ignored (or kept, by redaction).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shapes of known credentials.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = 128
THRESHOLD = 0.25
#: Characters that runs can have; weight of a character's own share against the pair's.
IN_RUNS, PRIOR = 67, 16
#: What a character's own share and the even share add to a pair's chance: no pair weighs more the larger the samples are.
OWN, EVEN = 0.1, 0.02
MOST = 2000
#: Texts looked through for values of base matches, for each one wanted.
POOL = 50
#: Items of a chunk of a fold; characters of a piece of a text.
CHUNK, PIECE = 256, 1024
#: What random strings are drawn from: hexadecimal, base32, letters, letters and digits, base64 and its form for urls.
_CAPITALS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_SMALL = _CAPITALS.lower()
ALPHABETS = [
    "0123456789abcdef", "0123456789ABCDEF", _SMALL + "234567", _CAPITALS + "234567", _SMALL, _CAPITALS, _SMALL + _CAPITALS,
    _SMALL + _DIGITS, _CAPITALS + _DIGITS, _SMALL + _CAPITALS + _DIGITS, _SMALL + _CAPITALS + _DIGITS + "+/", _SMALL + _CAPITALS + _DIGITS + "-_",
]

SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,match:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """All arrays that ``step`` gives, end to end. step: state and item to the next state and an array of type ``kind``.

    Arrays only grow within chunks, and once for each chunk.
    """
    none = F.array().cast(kind)

    def inner(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).cast(kind).alias("out"))

    def outer(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).cast(f"array<{kind}>").alias("out")))

    last = lambda x: F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / CHUNK).cast("int")
    chunks = _let(items, lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda c: F.slice(x, c * CHUNK + 1, CHUNK)))
    return F.flatten(F.aggregate(chunks, F.struct(first.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), outer, lambda acc: acc["out"]))


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches; texts without any cost one search."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The piece behind the last match has none.
    items = F.filter(F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("match"))), lambda x: x["match"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.length(x["match"])
        return end, F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match")))

    return F.when(text.rlike(pattern), _fold(items, F.lit(0), step, SPAN)).otherwise(F.array().cast(SPAN))


def _assigned(text: Column) -> Column:
    return F.filter(_spans(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start, then kind."""
    return F.array_sort(F.concat(_assigned(text), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def _apart(runs: Column, assigned: Column) -> Column:
    """The runs that no assigned span overlaps. Both are by start, and apart among themselves.

    Of all spans by start, a run is overlapped if the last assigned span before it
    reaches into it, or the next span is an assigned one that starts within it.
    """
    ahead = lambda x: F.zip_with(x, F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), lambda s, n: F.struct(s.alias("s"), n["start"].alias("next"), n["kind_no"].alias("next_kind")))

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        run, s = x["s"]["kind_no"] == KINDS.index("markov"), x["s"]
        hit = (reach > s["start"]) | F.coalesce((x["next_kind"] == KINDS.index("assign")) & (x["next"] < s["end"]), F.lit(False))
        return F.when(run, reach).otherwise(s["end"]), F.when(run & ~hit, F.array(s)).otherwise(F.array().cast(SPAN))

    return _let(F.array_sort(F.concat(assigned, runs)), lambda all_: _fold(ahead(all_), F.lit(0), step, SPAN))


def _pick(options: list, *by: Column | str) -> Column:
    """One of the options for each row, by a hash."""
    cols = [x if isinstance(x, Column) else F.lit(x) for x in options]
    return F.element_at(F.array(*cols), F.pmod(F.xxhash64(*by), F.lit(len(cols))).cast("int") + 1)


def _below(n: int, *by: Column | str) -> Column:
    """A number from 0 to n - 1 for each row, by a hash."""
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """text: n strings of 20 to 64 characters drawn evenly from each of ALPHABETS."""
    rows = spark.range(n * len(ALPHABETS), numPartitions=4).withColumn("of", F.element_at(F.array(*map(F.lit, ALPHABETS)), F.pmod("id", F.lit(len(ALPHABETS))).cast("int") + 1))
    one = lambda i: F.substring("of", F.pmod(F.xxhash64("id", i), F.length("of")).cast("int") + 1, F.lit(1))
    return rows.select(F.array_join(F.transform(F.sequence(F.lit(1), 20 + _below(45, "id", F.lit("size"))), one), "").alias("text"))


def dates_and_rules(spark: SparkSession, n: int) -> DataFrame:
    """text: n strings of dates, times, counters or separator rules."""
    h = lambda k, of: _below(of, "id", F.lit(k))
    ymd = lambda k: (1900 + h(f"{k}y", 200), 1 + h(f"{k}m", 12), 1 + h(f"{k}d", 28))
    hms = (h("h", 24), h("min", 60), h("s", 60))
    pair = F.concat(_pick(list("-=_+/"), "id", F.lit("c")), _pick(list("-=_+/"), "id", F.lit("d")))
    made = [
        F.array_join(F.transform(F.sequence(F.lit(0), 1 + h("n", 4)), lambda i: F.format_string("%04d-%02d-%02d", 1900 + _below(200, "id", i), 1 + _below(12, "id", i, F.lit("m")), 1 + _below(28, "id", i, F.lit("d")))), ""),
        F.concat_ws("_", F.format_string("%04d-%02d-%02d", *ymd("a")), F.format_string("%02d-%02d-%02d", *hms)),
        F.concat_ws("-", F.format_string("%04d%02d%02d", *ymd("a")), F.format_string("%02d%02d%02d", *hms), F.format_string("%06d", h("no", 1_000_000))),
        F.concat_ws("/", F.format_string("%04d/%02d/%02d", *ymd("a")), F.format_string("%04d/%02d/%02d", *ymd("b"))),
        F.concat_ws("-", F.format_string("%d-%05d", h("a", 100), h("b", 100_000)), F.format_string("%08d", h("no", 1_000_000))),
        F.expr("repeat(p, 24)"),
        F.expr("repeat(substring(p, 1, 1), 48)"),
        F.expr("repeat(concat('+', repeat(substring(p, 1, 1), 6)), 5)"),
    ]
    return spark.range(n, numPartitions=4).withColumn("p", pair).select(_pick(made, "id", F.lit("kind")).alias("text"))


def identifiers(words: DataFrame) -> DataFrame:
    """text: names and paths, each of up to three words that follow each other in the array ``w``."""
    parts = words.filter("size(w) > 0").select(F.explode(F.expr("transform(sequence(0, (size(w) - 1) div 3), i -> slice(w, i * 3 + 1, 3))")).alias("w"))
    small, large, title = (F.transform("w", f) for f in (F.lower, F.upper, F.initcap))
    no = _below(1000, "w", F.lit("no")).cast("string")
    head = F.lower(F.get("w", F.lit(0)))
    camel = F.concat(head, F.array_join(F.slice(title, 2, 2), ""))
    made = [
        F.array_join(small, ""), F.array_join(large, ""), F.array_join(title, ""), camel, F.array_join(small, "_"), F.array_join(large, "_"), F.array_join(small, "-"), F.array_join(title, "-"),
        F.concat(F.lit("/"), F.array_join(small, "/")), F.concat(F.array_join(title, "/"), F.lit("/")), F.concat(F.array_join(small, "_"), no), F.concat(head, no, F.lit("/"), F.array_join(small, "-"), F.lit("_"), no), F.concat(F.array_join(small, "="), F.lit("="), no), F.array_join(small, "+"),
    ]
    return parts.select(_pick(made, "w", F.lit("kind")).alias("text"))


def common_words(spark: SparkSession, n: int) -> DataFrame:
    """w: n arrays of three words of ``rules/words.txt``."""
    known = (resources.files("folioforge.rules") / "words.txt").read_text(encoding="utf-8").split()
    word = lambda k: F.element_at(F.split(F.lit(" ".join(known)), " "), _below(len(known), "id", F.lit(k)) + 1)
    return spark.range(n, numPartitions=4).select(F.array(*map(word, range(3))).alias("w"))


def labelled_samples(docs: DataFrame, most: int = MOST, text: str = "text") -> DataFrame:
    """text, label: random strings and values of base matches (1); words, identifiers, dates and rules (0). Values and words are from about ``most`` different texts each."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text")).filter("text is not null")
    hits = F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")
    low = lambda share: F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, share))
    n = max(1, rows.count())
    pool = POOL * most / n
    n_hit = max(1, rows.filter(low(pool)).filter(hits).count())
    hit = rows.filter(low(min(1.0, pool) * most / n_hit) & low(pool)).filter(hits).distinct()
    found = hit.select(F.explode(base_spans(F.col("text"))).alias("s"))
    value = F.when(F.col("s.kind") == "assign", F.regexp_extract("s.match", ASSIGN, 2)).otherwise(F.col("s.match"))
    plain = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}|{RUN}", " ")
    words = rows.filter(low(most / n)).distinct().select(F.regexp_extract_all(plain, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    ordinary = words.select(F.explode("w").alias("text")).unionByName(identifiers(words)).distinct().unionByName(identifiers(common_words(spark, 5 * most))).unionByName(dates_and_rules(spark, most))
    odd = found.select(value.alias("text")).unionByName(random_strings(spark, max(1, most // 10)))
    return odd.withColumn("label", F.lit(1)).unionByName(ordinary.withColumn("label", F.lit(0)))


def train(samples: DataFrame, text: str = "text", label: str = "label") -> list[float]:
    """Log-likelihood ratios, random against ordinary, of each pair of ASCII characters (row by row)."""
    at = F.col("i")
    code = lambda i: F.ascii(F.substring(F.col("text"), i, F.lit(1)))
    pairs = samples.select(F.col(text).alias("text"), (F.col(label).cast("int") == 1).cast("int").alias("label")).filter("label is not null and length(text) > 1").withColumn("i", F.explode(F.sequence(F.lit(2), F.length("text"))))
    counted = pairs.select("label", code(at - 1).alias("a"), code(at).alias("b")).filter(f"a between 0 and {ALPHABET - 1} and b between 0 and {ALPHABET - 1}").groupBy("label", "a", "b").count()
    # One number for each pair of characters and label.
    counts = {(r["label"], r["a"], r["b"]): r["count"] for r in counted.collect()}
    chance = []
    for y in (0, 1):
        before = [sum(counts.get((y, a, b), 0) for b in range(ALPHABET)) for a in range(ALPHABET)]
        after = [sum(counts.get((y, a, b), 0) for a in range(ALPHABET)) for b in range(ALPHABET)]
        alone = [(after[b] + 0.5) / (sum(after) + 0.5 * IN_RUNS) for b in range(ALPHABET)]
        pair = lambda a, b: (counts.get((y, a, b), 0) + PRIOR * alone[b]) / (before[a] + PRIOR)  # noqa: B023, E731
        chance.append([math.log((1 - OWN - EVEN) * pair(a, b) + OWN * alone[b] + EVEN / IN_RUNS) for a in range(ALPHABET) for b in range(ALPHABET)])
    # A pair that neither sample has says nothing, however large the samples are.
    seen = [(0, a, b) in counts or (1, a, b) in counts for a in range(ALPHABET) for b in range(ALPHABET)]
    return [r - o if known else 0.0 for o, r, known in zip(*chance, seen)]


def mean_ratio(run: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of the character pairs of a run of ASCII characters."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        ratio = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["last"] * ALPHABET + code))
        return F.struct(code.alias("last"), (acc["total"] + ratio).alias("total"))

    total = F.aggregate(F.split(run, ""), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total")), add, lambda acc: acc["total"])
    return total / (F.length(run) - 1)


def find_secrets(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with all secrets in column ``out``: start, kind_no, end, kind and match, by start, then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # A run that a span of the other kinds overlaps holds that span, for all of their characters are those of runs.
    runs = F.filter(_spans(whole, RUN, "markov"), lambda r: ~r["match"].rlike(f"{ACCESS}|{HEX}") & (mean_ratio(r["match"], model) > threshold))
    found = docs.withColumn("__base", base_spans(whole)).withColumn("__runs", runs)
    assigned = F.filter("__base", lambda s: s["kind_no"] == KINDS.index("assign"))
    added = F.when((F.size("__runs") > 0) & F.exists("__base", lambda s: s["kind_no"] == KINDS.index("assign")), _apart(F.col("__runs"), assigned)).otherwise(F.col("__runs"))
    return found.withColumn(out, F.when(F.size("__runs") > 0, F.array_sort(F.concat("__base", added))).otherwise(F.col("__base"))).drop("__base", "__runs")


def redact(found: DataFrame, text: str = "text", spans: str = "spans", mask: str = "[SECRET]") -> DataFrame:
    """Every secret of ``text`` replaced by ``mask``."""
    whole = F.col(text)

    def masked(pieces: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            """The characters from a to b, from the pieces that hold them."""
            i, j = (F.floor(x / PIECE).cast("int") for x in (a, b))
            return F.substring(F.array_join(F.slice(pieces, i + 1, j - i + 1), ""), a - i * PIECE + 1, b - a)

        def step(at: Column, s: Column) -> tuple[Column, Column]:
            fresh = F.array(part(at, s["start"]), F.lit(mask))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, fresh).otherwise(F.array().cast("array<string>"))

        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        rest = _let(end, lambda e: part(e, F.greatest(e, F.length(whole))))
        return F.array_join(F.concat(_fold(F.col(spans), F.lit(0), step, "array<string>"), F.array(rest)), "")

    made = _let(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), masked)
    return found.withColumn(text, F.when(F.size(spans) > 0, made).otherwise(whole))


def secret_report(found: DataFrame, doc_id: str = "doc_id", spans: str = "spans") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (as text) from :func:`find_secrets`."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans, lambda s: s["kind"] != "markov")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col(doc_id).alias("doc_id"), n("assign"), n("access"), n("hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform(spans, line), ",").alias("spans"),
    )
