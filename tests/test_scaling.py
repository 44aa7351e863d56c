"""Work per task and passes over the input stay bounded as tables grow."""

from pyspark.sql import functions as F

from spanloom.operators import decode as D
from spanloom.operators import scoring
from workload import views as V


def test_spread_follows_the_size_of_the_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    spark.range(20_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).write.parquet(path)
    table = spark.read.parquet(path)
    monkeypatch.setattr(V, "SPLIT", 50_000)
    dealt = V.spread(table.select("id"), "id")
    size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("*.parquet"))
    assert dealt.rdd.getNumPartitions() == -(-size // 50_000) > spark.sparkContext.defaultParallelism
    assert dealt.count() == dealt.distinct().count() == 20_000
    assert V.spread(spark.range(3), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_mean_token_scores_groups_tokens_and_not_classes(spark, capsys):
    rows = [
        ("a", 0, 1, c, p)
        for c, p in [(0, 0.5), (0, 0.25), (6, 0.1), (7, 0.3), (13, 0.4), (None, 0.9), (None, 0.7), (2, None), (-1, 0.2)]
    ]
    rows += [("a", None, 1, 3, 0.4), (None, 0, 1, 3, 0.4), ("b", 0, 1, 0, 0.5)]
    df = spark.createDataFrame(rows, "hash string, start bigint, end bigint, class_id bigint, p double")
    plain = df.groupBy("hash", "start", "end", "class_id").agg(F.avg("p").alias("p"))
    means = D.mean_token_scores(df)
    assert means.schema == plain.schema
    assert not means.exceptAll(plain).count() and not plain.exceptAll(means).count()
    means.explain()
    keys = [line.split("keys=[")[1].split("]")[0] for line in capsys.readouterr().out.splitlines() if "HashAggregate" in line]
    assert keys and not any("class_id" in k for k in keys)


def test_metrics_by_split_derives_each_side_once(spark):
    key = "hash string, split string, label string, start bigint, end bigint"
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    gold = spark.createDataFrame([("a", "x", "ORG", 0, 1), ("a", "x", None, 2, 3), ("b", "y", "GEO", 0, 1)], key)
    found = [("a", "x", "ORG", 0, 1, 1), ("a", "x", None, 2, 3, 1), ("a", "x", "ORG", 5, 6, 1), ("a", "x", "ORG", 0, 1, 2)]
    preds = spark.createDataFrame(found, f"{key}, epoch int")
    records = spark.createDataFrame([("a", "x"), ("b", "y")], "hash string, split string")
    report = scoring.metrics_by_split(gold.mapInArrow(counted, gold.schema), preds.mapInArrow(counted, preds.schema), records)
    rows = {(r["split"], r["epoch"]): (r["tp"], r["fp"], r["fn"], r["records"]) for r in report.filter("scope = 'micro'").collect()}
    assert rows == {("x", 1): (1, 1, 0, 1), ("x", 2): (1, 0, 0, 1), ("y", 1): (0, 0, 1, 1), ("y", 2): (0, 0, 1, 1)}
    assert seen.value == 7


def test_decode_tag_records_keeps_the_dealing_of_its_scores(spark, capsys):
    rows = [("a", w, 3 * t, 3 * t + 2, c, float((t + c + w) % 7)) for w in range(2) for t in range(4) for c in range(7)]
    scores = spark.createDataFrame(rows, "hash string, window_id bigint, start bigint, end bigint, class_id bigint, p double")
    inputs = spark.createDataFrame([("a",), ("b",)], "hash string")
    plain = {r["hash"]: r["entities"] for r in D.decode_tag_records(scores, inputs).collect()}
    dealt = D.decode_tag_records(scores.repartition(3, "hash"), inputs.repartition(3, "hash"))
    dealt.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2
    assert plain == {r["hash"]: r["entities"] for r in dealt.collect()} and plain["a"] and plain["b"] == []


def test_entity_status_keeps_the_dealing_of_its_spans(spark, capsys):
    key = "hash string, label string, start bigint, end bigint"
    gold = spark.createDataFrame([("a", "ORG", 0, 3), ("a", "ORG", 0, 3), ("a", "GEO", 5, 8), ("b", "ORG", 0, 1)], key)
    pred = spark.createDataFrame([("a", "ORG", 0, 3), ("a", "GEO", 6, 9), ("b", "ORG", 2, 4)], key)
    dealt = scoring.entity_status(gold.repartition(3, "hash"), pred.repartition(3, "hash"))
    dealt.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2
    want = {
        ("gold", "a", "ORG", 0, 3, "correct"), ("pred", "a", "ORG", 0, 3, "correct"), ("gold", "a", "GEO", 5, 8, "boundary_error"),
        ("pred", "a", "GEO", 6, 9, "boundary_error"), ("gold", "b", "ORG", 0, 1, "missed"), ("pred", "b", "ORG", 2, 4, "false_positive"),
    }
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, scoring.entity_status(gold, pred).collect())) == sorted(want)


def test_class_scores_convert_a_digest_once(spark, tmp_path, capsys):
    from hashlib import md5

    text = "one two three"
    spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    scores = V.class_scores(spark, str(tmp_path))
    row = scores.first()
    names = [w + "|0" if w else "0" for w in ["", *text.split(" "), ""]]
    assert row["scores"] == [[b / 256 for b in md5(n.encode()).digest()[:7]] for n in names]
    scores.explain()
    assert "sequence(0, 6" not in capsys.readouterr().out
