import pytest
from pyspark.sql import functions as F

from spanloom.operators import validate as V


def errors(records, mode="contract"):
    return sorted((r["hash"], r["idx"], r["error"]) for r in V.validate_spans(records, mode).collect())


def test_cyrillic_offsets_are_code_points(make):
    assert errors(make(("r", "Шаҳри Нукус 😀 бор", [("GEO", 6, 11), ("ORG", 12, 13), ("NAME", 14, 17)]))) == []


def test_rules_and_modes(make):
    bad = make(
        ("overlap", "Zarafshon suvi", [("GEO", 0, 9), ("ORG", 7, 14)]),
        ("range", "Nodir", [("NAME", 2, 6)]),
        ("label", "Nodir", [("RIVER", 0, 5)]),
        ("twice", "Nodir", [("NAME", 1, 5), ("NAME", 1, 5)]),
        ("touch", "NodirX", [("NAME", 0, 5), ("GEO", 5, 6)]),
        ("empty", "Nodir", [("NAME", 3, 3), (None, 0, 2), ("ORG", None, 2)]),
    )
    common = [("empty", 0, "offsets"), ("empty", 1, "label"), ("empty", 2, "offsets")]
    assert errors(bad) == sorted(
        common + [("overlap", 1, "overlap"), ("range", 0, "offsets"), ("label", 0, "label"), ("twice", 1, "duplicate")]
    )
    assert errors(bad, "score") == sorted(
        common + [("range", 0, "offsets"), ("label", 0, "label"), ("twice", 1, "duplicate")]
    )
    assert errors(bad, "inspect") == sorted(
        common + [("overlap", 1, "overlap"), ("range", 0, "offsets"), ("twice", 1, "overlap")]
    )


def test_input_batch(spark):
    batch = spark.createDataFrame(
        [(0, "a", "one"), (1, "b", "two"), (2, "a", "x"), (3, "", "x"), (4, "c", None)], "ord bigint, hash string, text string"
    )
    assert sorted(map(tuple, V.validate_input_batch(batch).collect())) == [(2, "duplicate_hash"), (3, "hash"), (4, "text")]
    assert list(map(tuple, V.validate_input_batch(batch.limit(0)).collect())) == [(None, "empty")]


def test_predictions_by_position(make):
    inputs = make(("a", "Ali", []), ("b", "Bob", []), ("c", "Cy", []))
    answers = make(("a", None, [("NAME", 0, 3)]), ("x", None, []))
    assert sorted(map(tuple, V.validate_predictions(answers, inputs).collect())) == [(1, None, "hash"), (2, None, "count")]


def test_hash_sets(make):
    gold = make(*[(f"g{i}", "t", []) for i in range(7)])
    pred = make(("g0", "t", []), ("p", "t", []))
    rows = V.hash_set_equality(gold, pred).collect()
    missing = sorted(r["hash"] for r in rows if r["side"] == "missing")
    assert missing == ["g1", "g2", "g3", "g4", "g5"] and {r["total"] for r in rows if r["side"] == "missing"} == {6}


def test_prefix_source_takes_the_first_listed(spark):
    df = spark.createDataFrame([("aa-1",), ("b-1",)], "h string")
    assert [r[0] for r in df.select(V.prefix_source(F.col("h"), ("a", "aa-"))).collect()] == ["a", None]
    with pytest.raises(ValueError):
        V.prefix_source(F.col("h"), ("a", "a"))


def test_canonical_order(make):
    row = V.canonical_entities(make(("r", "abcdef", [("ORG", 3, 4), ("NAME", 0, 2), ("GEO", 0, 1)]))).first()
    assert [tuple(e) for e in row["entities"]] == [("GEO", 0, 1), ("NAME", 0, 2), ("ORG", 3, 4)]
