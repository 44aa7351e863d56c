from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from spanloom.operators import corpus, scoring, typography
from spanloom.operators.joins import lookup_join
from spanloom.operators.materialize import materialize
from workload import views as V


def thin_input(make):
    return make(
        ("original-empty", "a", []),
        ("mendeley-empty-one", "b", []),
        ("mendeley-full", "Ali", [("NAME", 0, 3)]),
        ("mendeley-empty-two", "c", []),
        ("uzner-v2-empty-one", "d", []),
        ("uzner-v2-empty-two", "e", []),
    )


def test_thinning_takes_only_added_empties(make):
    records = thin_input(make)
    kept = [r["hash"] for r in corpus.drop_empty_added(records, 0.75, 42).orderBy("ord").collect()]
    again = [r["hash"] for r in corpus.drop_empty_added(records, 0.75, 42).orderBy("ord").collect()]
    assert kept == again and len(kept) == 3
    assert kept[0] == "original-empty" and "mendeley-full" in kept
    for fraction, left in ((0.0, 6), (1.0, 2), (0.5, 4)):
        assert corpus.drop_empty_added(records, fraction, 1).count() == left
    with pytest.raises(ValueError):
        corpus.drop_empty_added(records, 1.1, 42)


def test_filter_manifest(make):
    rows = {r["prefix"]: r for r in corpus.filter_manifest(corpus.mark_empty_added(thin_input(make), 0.75, 42)).collect()}
    total = rows[None]
    assert (total["input_records"], total["output_records"], total["eligible_records"], total["removed_records"]) == (6, 3, 4, 3)
    assert total["name_before"] == total["name_after"] == 1
    assert rows["original"]["removed_records"] == 0


def test_sample(make):
    records = make(*[(f"h{i}", "t", []) for i in range(50)])
    first = {r["hash"] for r in corpus.sample_n(records, 20, 1).collect()}
    assert len(first) == 20 and first == {r["hash"] for r in corpus.sample_n(records, 20, 1).collect()}
    assert first != {r["hash"] for r in corpus.sample_n(records, 20, 2).collect()}
    with pytest.raises(Exception, match="exceeds"):
        corpus.sample_n(records, 51, 1).collect()
    with pytest.raises(ValueError):
        corpus.sample_n(records, 0, 1)


def test_dedup_and_append(make):
    train = make(("t0", "old", []), ("t1", "older", []))
    dev = make(("d0", "dev", []))
    new = make(("n0", "old", []), ("n1", "fresh", []), ("n2", "dev", []), ("n3", "fresh", []), ("n4", "more", []))
    fresh = corpus.dedup_against(new, train, dev)
    assert [r["hash"] for r in fresh.orderBy("ord").collect()] == ["n1", "n4"]
    merged = corpus.append_train(train, fresh).orderBy("ord").collect()
    assert [r["hash"] for r in merged] == ["t0", "t1", "n1", "n4"]


def test_alias_index_and_join(spark):
    aliases = spark.createDataFrame(
        [
            ("GEO", "toshkentda", "Toshkent"),
            ("GEO", "TOSHKENTDA.", "Toshkent"),
            ("GEO", "a", "X"),
            ("GEO", "A", "Y"),
            ("ORG", "...", "Z"),
            ("PER", "b", "B"),
        ],
        "label string, alias string, canonical string",
    )
    index = typography.alias_index(aliases)
    assert {(r["label"], r["alias_key"]): r["error"] for r in index.collect()} == {
        ("GEO", "toshkentda"): None, ("GEO", "a"): "conflict", ("ORG", ""): "empty", ("PER", "b"): "label"
    }
    spans = spark.createDataFrame(
        [("h", "GEO", 0, 10, "TOSHKENTDA"), ("h", "ORG", 0, 10, "TOSHKENTDA!"), ("h", "GEO", 11, 12, "a")],
        "hash string, label string, start bigint, end bigint, surface string",
    )
    got = sorted((r["label"], r["normalized"]) for r in typography.alias_join(spans, index).collect())
    assert got == [("GEO", "Toshkent"), ("GEO", "a"), ("ORG", "TOSHKENTDA")]


def test_lookup_join_beyond_the_broadcast_limit(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i bigint, k string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 300, 3)], "k string, v bigint")
    small = lookup_join(rows, table, ["k"])
    salted = lookup_join(rows, table, ["k"], limit=5)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, salted.select(*small.columns).collect()))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_entities_unchanged(make):
    before = make(("a", "Ali", [("NAME", 0, 3)]), ("b", "x", []))
    assert [r["unchanged"] for r in scoring.entities_unchanged(before, before.filter("hash = 'a'")).collect()] == [True]
    assert [r["unchanged"] for r in scoring.entities_unchanged(before, before.filter("hash = 'b'")).collect()] == [False]


def test_apostrophe_stats(make):
    stats = typography.apostrophe_stats(make(("a", "G'ulom O‘z o‘y", []), ("b", "x", [])))
    assert {(r["metric"], r["key"]): r["value"] for r in stats.collect()} == {
        ("records", ""): 2, ("changed_records", ""): 1, ("replacements", ""): 3, ("by_variant", "'"): 1, ("by_variant", "‘"): 2
    }
    normal = typography.normalize_records(make(("a", "G'ulom", [("NAME", 0, 6)]))).select(F.length("text")).first()[0]
    assert normal == 6


def test_counters_taken_while_writing_equal_the_manifests(spark, make):
    marked, seen = corpus.observe_marked(corpus.mark_empty_added(thin_input(make), 0.75, 42))
    materialize(marked.filter(~F.col("removed")))
    report = corpus.filter_report(spark, seen)
    want = corpus.filter_manifest(corpus.mark_empty_added(thin_input(make), 0.75, 42))
    assert report.columns == want.columns
    assert sorted(report.collect(), key=str) == sorted(want.collect(), key=str)
    # nothing is read for it
    assert "Relation [" not in report._jdf.queryExecution().optimizedPlan().toString()


def test_merge_counters_read_source_labels_only(spark, make):
    train, dev = make(("t", "old", []), ("u", "Ali", [("NAME", 0, 3)])), make(("d", "dev", []))
    rows = make(("n", "Ali GEO", [("NAME", 0, 3), ("GEO", 4, 7)]), ("m", "old", []), ("k", "bad", []))
    labels = F.when(F.col("hash") == "n", F.array(F.lit("PER"), F.lit("DATE"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"source_labels": labels, "dropped_overlaps": F.lit(2), "error": F.when(F.col("hash") == "k", "contract")})
    counted, seen = corpus.observe_converted(rows)
    counted = materialize(counted).filter("error is null")
    added, seen_added = corpus.observe_added(corpus.dedup_against(counted, train, dev))
    added = materialize(added)
    report = corpus.merge_report(train, dev, counted, seen, seen_added)
    want = corpus.merge_manifest(train, dev, counted, added)
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, want.collect()))
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_thinning_queries_derive_the_records_once(spark, tmp_path, capsys):
    rows = [(i, None if i == 5 else f"{chr(97 + i % 26)}{i} b c d e f g", None if i == 7 else f"src{i % 4}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    import __spark_entry__ as contract

    found = contract.queries()["entities_unchanged"](spark, str(tmp_path))
    found.explain()
    assert "EvalPython" not in capsys.readouterr().out
    kept = {r["ord"] for r in contract.queries()["drop_empty_added"](spark, str(tmp_path)).collect()}
    assert 0 < len(kept) < len(rows)
    before, after = Counter(), Counter()
    for r in V.gold(spark, str(tmp_path)).collect():
        labels = [e["label"] for e in r["entities"] or [] if md5(f"{r['hash']}|hollow".encode()).hexdigest()[0] >= "8"]
        before.update(labels)
        after.update(labels if r["ord"] in kept else [])
    assert before == after and sum(before.values()) > 5
    assert {(r["label"], r["before"], r["after"], r["unchanged"]) for r in found.collect()} == {(k, n, n, True) for k, n in before.items()}
