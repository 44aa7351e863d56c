import random

from pyspark.sql import functions as F

from spanloom import schema as S
from spanloom.functions import text as X
from spanloom.functions.arrays import running_sum


def test_apostrophes_keep_length_and_possessive(ev):
    text = "G'ulom Domino's bilan O‘zbekistonda"
    value, found = ev(
        {"t": (text, "string")}, X.normalize_apostrophes(F.col("t")), X.apostrophe_matches(F.col("t"))
    )
    assert value == "Gʻulom Domino's bilan Oʻzbekistonda"
    assert found == ["'", "‘"] and len(value) == len(text)


def test_apostrophe_edges(ev):
    cases = {"o's": "o's", "o'sa": "oʻsa", "g'": "g'", "o'1": "o'1", "xo`y G’S": "xoʻy G’S", "o'S\n": "o'S\n", "O'ʼa": "O'ʼa"}
    for text, want in cases.items():
        assert ev({"t": (text, "string")}, X.normalize_apostrophes(F.col("t"))) == want


def test_occurrences_match_brute_force(spark):
    rng = random.Random(3)
    rows = [("ababa", "aba"), ("", "a"), ("aaaa", "a"), ("a.b$\\E(x)", ".b$\\E("), ("😀a😀a😀", "😀a😀"), ("0101", "0"), ("11", "1")]
    rows += [
        ("".join(rng.choice("ab0é😀\n.") for _ in range(40)), "".join(rng.choice("ab0é😀\n.") for _ in range(rng.randint(1, 3))))
        for _ in range(200)
    ]
    df = spark.createDataFrame(rows, "t string, n string")
    for r in df.select("t", "n", X.occurrence_starts(F.col("t"), F.col("n")).alias("s")).collect():
        assert r["s"] == [i for i in range(len(r["t"])) if r["t"].startswith(r["n"], i)], r


def test_expand_suffix(spark):
    rng = random.Random(5)
    alphabet = "aZ9é٣'’ʻʼ-_ .,😀"
    rows = [("".join(rng.choice(alphabet) for _ in range(20)), rng.randint(1, 20)) for _ in range(200)]

    def want(t, end):
        while end < len(t) and (t[end].isalnum() or t[end] in "'’ʻʼ-_"):
            end += 1
        return end

    df = spark.createDataFrame(rows, "t string, e bigint")
    one = X.expand_suffix(F.col("t"), F.col("e"))
    span = F.array(F.struct(F.lit("ORG").alias("label"), F.lit(0).cast("bigint").alias("start"), F.col("e").alias("end")))
    many = X.expand_suffixes(F.col("t"), span)[0]["end"]
    for r in df.select("t", "e", one.alias("one"), many.alias("many")).collect():
        assert r["one"] == r["many"] == want(r["t"], r["e"]), r


def test_expand_suffixes_of_odd_ends_without_an_object_per_character(spark):
    rows = [("ab-c d😀e", [3, 0, None, 99, -1, 5, 7, 8]), ("", [0]), (None, [1]), ("ab", None), ("ab", [])]
    df = spark.createDataFrame(rows, "t string, e array<bigint>")
    df = df.withColumn("spans", F.transform("e", lambda e: F.struct(F.lit("ORG").alias("label"), e.alias("end"))))
    moved = df.select(X.expand_suffixes(F.col("t"), F.col("spans")).alias("x"))
    got = [None if r.x is None else [s["end"] for s in r.x] for r in moved.collect()]
    assert got == [[4, 4, 8, 8, 8, 6, 8, 8], [0], [None], None, []]
    assert "split(" not in moved._jdf.queryExecution().toString()


def test_clean_value_and_key(spark):
    rows = {
        " «Toshkent  shahri». ": "Toshkent shahri",
        "O‘zbek`ʹ": "O'zbek''",
        "ＡＢ　Ｃ": "AB C",
        "a\x1c\x85b": "a b",
        "ﬁne": "fine",
    }
    df = spark.createDataFrame([(k,) for k in rows], "v string")
    got = {r["v"]: r["c"] for r in df.select("v", X.clean_value(F.col("v")).alias("c")).collect()}
    assert got == rows
    key = spark.createDataFrame([("Straße.",), ("ǅ",), (None,)], "v string").select(X.casefold_key(F.col("v")).alias("k"))
    assert [r["k"] for r in key.collect()] == ["strasse", "dž", None]


def test_tokens_and_surfaces_use_code_points(ev):
    tokens = ev({"t": ("😀a  b\nc ", "string")}, X.space_tokens(F.col("t")))
    assert [(t["pos"], t["tok"], t["start"], t["end"]) for t in tokens] == [(0, "😀a", 0, 2), (2, "b\nc", 4, 7)]
    assert ev({"t": ("", "string")}, X.space_tokens(F.col("t"))) == []
    assert ev({"t": ("Али Toshkent", "string")}, X.surface(F.col("t"), F.lit(4), F.lit(12))) == "Toshkent"


def test_quoted_is_a_python_literal(spark):
    values = ["plain", "it's", "a\"b'c", "tab\t\\", "é", "​"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(X.quoted(F.col("v"))).collect()] == [repr(v) for v in values]


def test_running_sum_handles_zeros(ev):
    assert ev({"n": ([0, 3, 0, 2], "array<int>")}, running_sum(F.col("n"))) == [0, 3, 3, 5]
    assert ev({"n": ([], "array<int>")}, running_sum(F.col("n"))) == []


def test_cleaned_surfaces_take_one_python_pass(spark):
    import re
    import unicodedata

    values = ["  Plain,  VALUE. ", "Oʻzbek iston", "‘ﬁne’ Straße", "ǅ\x1c x", "", " ", None, "İstanbul", "a\u0085b", "«Кино»"] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string").repartition(2)
    rows = df.select("v", X.cleaned_surface(F.col("v")).alias("c"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in rows.collect():
        if r.v is None:
            assert (r.c.cleaned, r.c.key) == (None, None)
            continue
        plain = "".join("'" if c in S.VALUE_APOSTROPHES else c for c in unicodedata.normalize("NFKC", r.v))
        want = re.sub(r"\s+", " ", plain).strip(S.EDGE_PUNCTUATION)
        assert (r.c.cleaned, r.c.key) == (want, want.casefold())
