"""Small documents for the tests, and plain versions of what the operators compute."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "score double, predicted int, kept boolean, n int, rep long, root long, token long, size long, shape string, part int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_rows():
    """Nulls, empty, blank, letterless, repeated, very long and ordinary rows."""

    rng = random.Random(5)
    plain = prose(rng, 120)
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, None, 4),
        (4, "123 456 !!!", "de", "b", 11),
        (5, plain, "en", "a", len(plain)),
        (5, plain, "en", "a", len(plain)),
        (6, plain, "en", "b", len(plain)),
        (7, prose(rng, 30_000), "de", "a", 0),
        (None, prose(rng, 60), "en", None, 0),
        (9, "é ü 😀 ß " * 20, "fr", "c", 0),
        (10, "one\n\none\n two\n", "en", "c", 0),
    ]
    return rows + [(20 + i, prose(rng, 40 + i), rng.choice(["en", "de"]), rng.choice("abc"), 0) for i in range(12)]


def edge(spark, clash=False):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    if clash:
        for part in CLASHING.split(", "):
            name, kind = part.split()
            df = df.selectExpr("*", f"cast(1 as {kind}) as {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
