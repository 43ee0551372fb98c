"""Models of random strings and ordinary identifiers, on strings that the samples don't have."""

import random
import string

from folioforge.llm import secrets

SMALL, CAPITALS, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits


def score(run, model):
    return sum(model[ord(a) * secrets.ALPHABET + ord(b)] for a, b in zip(run, run[1:])) / (len(run) - 1)


def test_random_strings_apart_from_identifiers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = secrets.train(secrets.labelled_samples(docs))
    rng = random.Random(17)
    for letters in (SMALL, SMALL + "234567", CAPITALS + "234567", SMALL + CAPITALS, SMALL + CAPITALS + DIGITS, SMALL + CAPITALS + DIGITS + "+/"):
        for n in (20, 32, 40):
            found = [score("".join(rng.choices(letters, k=n)), model) > secrets.THRESHOLD for _ in range(300)]
            assert sum(found) >= 0.94 * len(found), (letters, n)
    plain = [c * n for c in "-=_+/" for n in (20, 24, 60)] + ["2024-01-31-2023-12-24", "20240131_235959_20240201", "2019/10/11/2020/11/12"]
    plain += ["get_current_user_permissions", "parseRequestHeadersFromStream", "MAXIMUM_NUMBER_OF_RETRIES", "terms-of-service-and-privacy", "/usr/local/share/applications"]
    assert not [x for x in plain if score(x, model) > secrets.THRESHOLD]
    rows = spark.createDataFrame([(1, "see " + "qXvBzKwJpRtYmNcDfGhL" + " here"), (2, "-" * 24), (3, "on 2024-01-31-2023-12-24")], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in secrets.find_secrets(rows, model).collect()} == {1: 1, 2: 0, 3: 0}


def test_pair_of_no_sample_does_not_depend_on_sizes(spark):
    rows = [("abcd", 0), ("xyzw", 1)]
    for more in ([], [("abcd", 0)] * 500, [("xyzw", 1)] * 500):
        model = secrets.train(spark.createDataFrame(rows + more, "text string, label int"))
        assert model[ord("-") * secrets.ALPHABET + ord("-")] == 0
