"""Secret scans against Python's re."""

import hashlib
import random
import re

from folioforge.llm import secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def brute(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def rows():
    rng = random.Random(1)
    texts = [None, "", "no secrets", "Token = 'abc'", "secret=token: abcdefg", "token=api_key=abcdefgh", "😀 PASSWORD: \"Zx9+Zx9+Zx9\" é", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 15, "AKIA" + "B" * 15, "f" * 24, "0123456789abcdef" * 3, "token = " + "ab12" * 6]
    bits = ["token", "secret", "api_key", "APIKEY", "=", ":", " ", "'", "AKIA", "Q7" * 9, "deadbeef" * 3, "xyz", "é", "\n", "abcdef", "KKey", "ſecret"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(150)]
    return [(i, t, "x") for i, t in enumerate(texts)] + [(0, None, None), (None, texts[6], "y")]


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def test_base_spans_match_re(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, spans string").drop("spans")
    got = secrets.secret_report(secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs)))).collect()
    want = sorted((str(i), digest(b := brute(t)), *(sum(k == n for k, _, _ in b) for n in ("assign", "access", "hex"))) for i, t, _ in data)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == want


def test_markov_adds_random_runs_and_leaves_words_alone(spark):
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    odd = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(220)]
    plain = ["international", "responsibility", "configuration", "documentation", "understanding", "relationship", "environment", "transportation", "conservative", "electronic", "development", "management", "everything", "experience", "department", "particular", "performance", "organization", "significant", "traditional", "professional"]
    samples = spark.createDataFrame([(x, 1) for x in odd[20:]] + [(x, 0) for x in plain] + [(None, 1), ("x", None)], "text string, label int")
    model = secrets.train(samples)
    long_words = ["internationaldocumentation", "environmentrelationship", "understandingtransportation"]
    docs = spark.createDataFrame([(i, f"see {x} here") for i, x in enumerate(odd[:20] + long_words)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs, model).collect()}
    assert sum([(s.kind, s.start, s.end) for s in found[i]] == [("markov", 4, 36)] for i in range(20)) >= 18
    assert all(not found[i] for i in range(20, 23))


def test_no_samples_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.secret_report(secrets.find_secrets(empty, secrets.train(secrets.labelled_samples(empty)))).count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é token=abcdefghij, AKIA" + "Z" * 16 + "!"), (2, None), (3, "secret = " + "0a" * 15)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in secrets.redact(secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs)))).collect()}
    assert out == {1: "é [SECRET], [SECRET]!", 2: None, 3: "[SECRET]"}
