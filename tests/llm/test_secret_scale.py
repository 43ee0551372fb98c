"""Texts with very many secrets, in time that follows their length."""

import random
import time

from folioforge.llm import secrets
from test_secrets import brute, digest


def model(spark):
    rng = random.Random(5)
    odd = [("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40)), 1) for _ in range(300)]
    return secrets.train(spark.createDataFrame(odd + [("understanding", 0), ("configuration", 0), ("-----=====", 0)], "text string, label int"))


def long_text(n):
    rng = random.Random(n)
    hexes = lambda: "".join(rng.choices("0123456789abcdef", k=32))
    odd = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=24))
    kinds = [lambda: f"{hexes()} é", lambda: f"{odd()}\n", lambda: f"token={odd()}.{odd()} ", lambda: f"{odd()}/secret:{hexes()} ", lambda: f"AKIA{odd().upper()}", lambda: f"password = {odd()[:5]},{odd()} "]
    return " ".join(rng.choice(kinds)() for _ in range(n))


def all_spans(text, model):
    """Base spans, and the runs that none of them overlaps and the model takes for random; and the text with all masked."""
    import re

    base = brute(text)
    ratio = lambda run: sum(model[ord(a) * secrets.ALPHABET + ord(b)] for a, b in zip(run, run[1:])) / (len(run) - 1)
    runs = [("markov", m.start(), m.end()) for m in re.finditer(secrets.RUN, text) if ratio(m[0]) > secrets.THRESHOLD]
    runs = [r for r in runs if not any(a < r[2] and r[1] < b for _, a, b in base)]
    spans = sorted(base + runs, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    out, at = "", 0
    for _, a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return spans, out + text[at:]


def test_all_spans_and_masks_match_brute_force(spark):
    m = model(spark)
    texts = [long_text(n) for n in (1, 2, 5, 40, 300, 700)] + ["token=" + "a1B2" * 8 + "." + "zQ9xW8vU7tS6rP5q" * 2 + " end", "x" * 3000 + " secret=abcdefgh " + "y" * 5000, "é" * 1024 + "token=123456" + "😀" * 2048]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = secrets.find_secrets(docs, m)
    got = {r.doc_id: ([(s.kind, s.start, s.end) for s in r.spans], [s.match for s in r.spans]) for r in found.collect()}
    masked = {r.doc_id: r.text for r in secrets.redact(found).collect()}
    kinds = set()
    for i, t in enumerate(texts):
        spans, want = all_spans(t, m)
        assert got[i] == (spans, [t[a:b] for _, a, b in spans]) and masked[i] == want
        kinds |= {s[0] for s in spans}
    assert kinds == set(secrets.KINDS)


def test_twenty_thousand_secrets_in_a_text(spark):
    m = model(spark)
    text = long_text(24_000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = secrets.secret_report(secrets.find_secrets(docs, m)).collect()[0]
    masked = secrets.redact(secrets.find_secrets(docs, m)).collect()[0].text
    took = time.time() - began
    assert len(text) > 800_000 and r.base_sha256 == digest(brute(text)) and len(r.spans.split(",")) >= 20_000
    assert masked.count("[SECRET]") >= 20_000 and not brute(masked)[:1]
    assert took < 60


def test_one_run_of_a_megabyte(spark):
    docs = spark.createDataFrame([(1, "see " + "abcdefgH" * 125_000)], "doc_id long, text string")
    began = time.time()
    assert len(secrets.find_secrets(docs, model(spark)).collect()[0].spans) <= 1
    assert time.time() - began < 60
