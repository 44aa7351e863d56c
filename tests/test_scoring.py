import random
from collections import Counter

from pyspark.sql import functions as F

from spanloom.operators import report, scoring
from tests_support import random_records


def spans(spark, rows):
    return spark.createDataFrame(rows, "hash string, label string, start bigint, end bigint")


def test_report_with_an_unsupported_label(spark):
    gold = spans(spark, [("a", "ORG", 0, 3), ("a", "NAME", 4, 6), ("b", "ORG", 0, 2)])
    pred = spans(spark, [("a", "ORG", 0, 3), ("a", "NAME", 4, 7), ("b", "NAME", 0, 2)])
    records = spark.createDataFrame([("a",), ("b",), ("c",)], "hash string")
    rows = {r["scope"]: r for r in scoring.metric_report(gold, pred, records).collect()}
    assert (rows["ORG"]["tp"], rows["ORG"]["fp"], rows["ORG"]["fn"]) == (1, 0, 1)
    assert (rows["ORG"]["precision"], rows["ORG"]["recall"]) == (1.0, 0.5)
    assert rows["GEO"]["f1"] == 0.0 and rows["GEO"]["gold"] == 0
    assert (rows["micro"]["tp"], rows["micro"]["fp"], rows["micro"]["fn"]) == (1, 2, 2)
    assert abs(rows["macro"]["recall"] - 0.5 / 3) < 1e-15 and rows["macro"]["records"] == 3
    for field in ("tp", "fp", "fn"):
        assert rows["micro"][field] == sum(rows[label][field] for label in ("ORG", "NAME", "GEO"))


def test_report_on_nothing(spark):
    empty = spans(spark, [])
    rows = scoring.metric_report(empty, empty, empty).collect()
    assert len(rows) == 5 and all(r["f1"] == 0.0 for r in rows)


def test_best_epoch_takes_the_first_best(spark):
    history = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.7), ("r", 3, 0.7), ("s", 1, 0.1)], "run string, epoch int, f1 double")
    assert sorted(map(tuple, scoring.best_epoch(history).collect())) == [("r", 2, 0.7), ("s", 1, 0.1)]
    assert sorted(map(tuple, scoring.best_epoch(history, maximize=False).collect())) == [("r", 1, 0.5), ("s", 1, 0.1)]


def test_best_epoch_never_takes_nan(spark):
    rows = [("r", 1, 0.1), ("r", 2, float("nan")), ("r", 3, None), ("s", 1, float("nan"))]
    history = spark.createDataFrame(rows, "run string, epoch int, f1 double")
    for maximize in (True, False):
        assert list(map(tuple, scoring.best_epoch(history, maximize=maximize).collect())) == [("r", 1, 0.1)]


def test_metrics_by_split_with_shared_hash_and_silent_split(spark):
    span = "split string, hash string, label string, start bigint, end bigint"
    gold = spark.createDataFrame([("train", "h", "ORG", 0, 2), ("dev", "h", "ORG", 0, 2), ("quiet", "q", "GEO", 1, 2)], span)
    preds = spark.createDataFrame([("dev", "h", "ORG", 0, 2, 1), ("dev", "h", "NAME", 3, 4, 2)], span + ", epoch int")
    records = spark.createDataFrame([("train", "h"), ("dev", "h"), ("dev", "e"), ("quiet", "q")], "split string, hash string")
    rows = scoring.metrics_by_split(gold, preds, records).filter("scope = 'micro'").collect()
    got = {(r["split"], r["epoch"]): (r["tp"], r["fp"], r["fn"], r["records"]) for r in rows}
    assert got == {
        ("train", 1): (0, 0, 1, 1), ("train", 2): (0, 0, 1, 1), ("quiet", 1): (0, 0, 1, 1), ("quiet", 2): (0, 0, 1, 1),
        ("dev", 1): (1, 0, 0, 2), ("dev", 2): (0, 1, 1, 2),
    }


def test_status_and_segments_match_brute_force(make):
    rng = random.Random(9)
    gold_rows, pred_rows = random_records(rng, 40), random_records(rng, 40)
    pred_rows = [(h, t, p) for (h, t, _), (_, _, p) in zip(gold_rows, pred_rows)]
    pred_rows = [(h, t, [e for e in p if e[2] <= len(t)]) for h, t, p in pred_rows]
    # make some spans agree
    pred_rows = [(h, t, g if i % 4 == 0 else p) for i, ((h, t, p), (_, _, g)) in enumerate(zip(pred_rows, gold_rows))]
    gold, pred = make(*gold_rows), make(*pred_rows)
    touch = lambda a, b: a[1] < b[2] and b[1] < a[2]
    want = set()
    for (h, _, g), (_, _, p) in zip(gold_rows, pred_rows):
        for side, own, other, alone in (("gold", g, p, "missed"), ("pred", p, g, "false_positive")):
            for e in own:
                status = "correct" if e in other else "boundary_error" if any(touch(e, o) for o in other) else alone
                want.add((side, h, *e, status))
    got = {tuple(r) for r in scoring.entity_status(scoring.explode_spans(gold), scoring.explode_spans(pred)).collect()}
    assert got == want
    pieces = {}
    for r in scoring.comparison_segments(scoring.compare_join(gold, pred)).collect():
        pieces.setdefault(r["hash"], []).append((r["start"], r["end"], r["status"], r["piece"]))
    for (h, t, g), (_, _, p) in zip(gold_rows, pred_rows):
        chars = []
        for c in range(len(t)):
            a = next((e for e in g if e[1] <= c < e[2]), None)
            b = next((e for e in p if e[1] <= c < e[2]), None)
            chars.append(("correct" if a == b else "boundary_error") if a and b else "missed" if a else "false_positive" if b else None)
        found = sorted(pieces.get(h, []))
        assert [s for s, e, status, _ in found for _ in range(e - s) for s in [status]] == chars
        assert "".join(x[3] for x in found) == t
        assert all(x[2] != y[2] for x, y in zip(found, found[1:]))


def test_comparison_example(make):
    gold = make(("h", "Ali Toshkentda", [("NAME", 0, 3)]))
    pred = make(("h", None, [("NAME", 0, 3), ("GEO", 4, 14)]))
    pair = scoring.compare_join(gold, pred)
    marked = pair.select(scoring.mark_comparison(F.col("text"), F.col("gold_entities"), F.col("pred_entities"))).first()[0]
    assert marked == "[correct:Ali] [false_positive:Toshkentda]"


def test_marks_and_lines(make):
    records = make(("h", "Ali va It's", [("NAME", 0, 3), ("ORG", 7, 11)]), ("e", "", []))
    marked = {r[0]: r[1] for r in records.select("hash", scoring.mark_text(F.col("text"), F.col("entities"))).collect()}
    assert marked == {"h": "[NAME:Ali] va [ORG:It's]", "e": ""}
    lines = [r["line"] for r in report.entity_lines(records).orderBy("start").collect()]
    assert lines == ["  - NAME: [0:3] 'Ali'", '  - ORG: [7:11] "It\'s"']
    parts = [tuple(r)[1:] for r in scoring.label_segments(records).orderBy("start").collect()]
    assert parts == [(0, 3, "NAME", "Ali"), (3, 7, None, " va "), (7, 11, "ORG", "It's")]


def test_comparison_holds_no_array_of_characters(make, monkeypatch, capsys):
    monkeypatch.setattr("spanloom.functions.runs.SLICE", 64)
    monkeypatch.setattr("spanloom.functions.agreement.ROWS", 100)
    text = "Али 😀 Toshkent, " * 300
    every = lambda label, first, last: [(label, i + first, i + last) for i in range(0, len(text), 16)]
    golds = [("a", text, every("NAME", 0, 3)), ("b", "", []), ("c", "Ali", [("NAME", 0, 3)]), ("a", "é", []), ("d", None, None), (None, "x", [])]
    preds = [("a", every("NAME", 0, 5)), ("a", every("NAME", 0, 3) + [("GEO", len(text) - 2, len(text) + 9)]), ("b", []), ("c", []), ("d", None)]

    def pieces(text, gold, pred):
        state = []
        for c in range(len(text)):
            g, p = (next((e for e in side if e[1] <= c < e[2]), None) for side in (gold, pred))
            state.append(("correct" if g == p else "boundary_error") if g and p else "missed" if g else "false_positive" if p else None)
        opens = [c for c in range(len(text)) if c == 0 or state[c] != state[c - 1]]
        return [(a, b, state[a], text[a:b]) for a, b in zip(opens, [*opens[1:], len(text)])]

    want = [(h, *x) for h, t, g in golds for k, p in preds if h == k and t is not None for x in pieces(t, g, p)]
    pairs = scoring.compare_join(make(*golds), make(*[(h, "-", p) for h, p in preds]))
    found = scoring.comparison_segments(pairs)
    found.explain()
    plan = capsys.readouterr().out
    assert "split(" not in plan and "array_join" not in plan
    assert Counter(tuple(r) for r in found.collect()) == Counter(want)
    marked = pairs.select("hash", scoring.mark_comparison(F.col("text"), F.col("gold_entities"), F.col("pred_entities")).alias("m"))
    show = lambda t, g, p: "".join(x if s is None else f"[{s}:{x}]" for _, _, s, x in pieces(t, g, p))
    shown = [(h, None if t is None else show(t, g, p)) for h, t, g in golds for k, p in preds if h == k]
    assert Counter(tuple(r) for r in marked.collect()) == Counter(shown)
