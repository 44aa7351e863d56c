import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.scorers import load_digest_scorer
from spanloom.operators import decode as D
from spanloom.operators import windows as N
from spanloom.operators.scoring import explode_spans
from spanloom.plans.predict import predict_spans
from spanloom.schema import ENTITIES_DDL, TAGS

TOK = "array<struct<start:bigint,end:bigint>>"


def records(spark, *rows):
    return spark.createDataFrame(rows, f"hash string, text string, tokens {TOK}, entities {ENTITIES_DDL}")


def parted(spark, rows, max_length, stride):
    windows = N.token_windows(records(spark, *rows), max_length, stride)
    return N.partition_entities(N.window_bounds(windows))


def test_window_with_a_cut_and_a_complete_entity(spark):
    tokens = [(0, 3), (3, 5), (6, 9), (9, 13)]
    row = ("h", "qwert yuiopas", tokens, [("NAME", 0, 3), ("GEO", 6, 13)])
    masked = N.span_mask(parted(spark, [row], max_length=5, stride=1))
    windows = masked.orderBy("window_id").collect()
    assert [[tuple(t) for t in w["tokens"]] for w in windows] == [
        [(0, 0), (0, 3), (3, 5), (6, 9), (0, 0)], [(0, 0), (6, 9), (9, 13), (0, 0)]
    ]
    assert windows[0]["mask"] == [False, True, True, False, False]
    targets = N.span_targets(masked).orderBy("window_id").collect()
    assert [(t["label_id"], t["token_start"], t["token_end"]) for t in targets] == [(1, 1, 1), (2, 1, 2)]
    counts = N.trainable_windows(masked).first()
    assert (counts["windows"], counts["trainable"], counts["with_partial"]) == (2, 2, 1)
    assert N.coverage_check(explode_spans(records(spark, row)), N.span_targets(N.usable(masked))).count() == 0


def test_inexact_boundary(spark):
    rows = parted(spark, [("h", "Boston", [(0, 6)], [("ORG", 0, 5)])], 8, 0)
    span = N.entity_token_span(rows).first()
    assert (span["token_start"], span["token_end"], span["exact"]) == (1, 1, False)
    with pytest.raises(Exception, match="not exactly representable"):
        N.span_targets(rows, strict=True).collect()


def test_random_windows_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for d in range(25):
        tokens, at = [], 0
        for _ in range(rng.randint(0, 30)):
            at += rng.randint(0, 2)
            size = rng.randint(1, 4)
            tokens.append((at, at + size))
            at += size
        entities, at2 = [], 0
        while at2 < at - 3:
            at2 += rng.randint(0, 6)
            size = rng.randint(1, 9)
            if at2 + size > at:
                break
            entities.append((rng.choice(["ORG", "NAME", "GEO"]), at2, at2 + size))
            at2 += size
        rows.append((f"d{d}", "x" * at, tokens, entities))
    content, stride = 5, 2
    got = {}
    for w in N.span_mask(parted(spark, rows, content + 2, stride)).collect():
        got[(w["hash"], w["window_id"])] = w
    spans = {}
    for r in N.entity_token_span(parted(spark, rows, content + 2, stride)).collect():
        spans.setdefault((r["hash"], r["window_id"]), set()).add(
            (r["label"], r["start"], r["end"], r["token_start"], r["token_end"])
        )
    n = 0
    for hash_, _, tokens, entities in rows:
        start, number = 0, 0
        while True:
            offsets = [(0, 0), *tokens[start : start + content], (0, 0)]
            w = got[(hash_, number)]
            assert [tuple(t) for t in w["tokens"]] == offsets
            real = [t for t in offsets if t[0] != t[1]]
            lo, hi = (min(t[0] for t in real), max(t[1] for t in real)) if real else (None, None)
            whole = [e for e in entities if real and lo <= e[1] and e[2] <= hi]
            cut = [e for e in entities if real and e not in whole and e[1] < hi and e[2] > lo]
            touch = lambda e: [i for i, t in enumerate(offsets) if t[0] != t[1] and t[0] < e[2] and t[1] > e[1]]  # noqa: E731, B023
            assert [tuple(e)[:3] for e in w["partial"]] == [e for e in cut if touch(e)]
            assert w["mask"] == [t[0] != t[1] and not any(t[0] < e[2] and t[1] > e[1] for e in cut) for t in offsets]
            want = {(*e, touch(e)[0], touch(e)[-1]) for e in whole if touch(e)}
            assert spans.get((hash_, number), set()) == want
            n, number, start = n + 1, number + 1, start + content - stride
            if start + stride >= len(tokens):
                break
    assert n == len(got)


def test_align_bio(spark):
    rows = [("h", "Ali Toshkentda x", [(0, 3), (4, 10), (10, 14), (14, 14), (15, 16)], [("NAME", 0, 3), ("GEO", 4, 14)])]
    tags = [t["tag"] for t in N.align_bio(records(spark, *rows)).first()["tokens"]]
    assert tags == [TAGS.index("B-NAME"), TAGS.index("B-GEO"), TAGS.index("I-GEO"), -100, 0]


def test_bad_window_parameters(spark):
    with pytest.raises(ValueError):
        N.token_windows(records(spark, ("h", "", [], [])), 4, 2)


def sequential_bio(tokens):
    out = []
    for start, end, tag in tokens:
        if tag == "O":
            out.append(None)
            continue
        prefix, label = tag.split("-")
        if prefix == "B" or not out or out[-1] is None or out[-1][0] != label:
            out.append([label, start, end])
        else:
            out[-1][2] = max(out[-1][2], end)
    return [tuple(e) for e in out if e]


def test_decode_bio_matches_a_sequential_decoder(spark):
    rng = random.Random(2)
    rows = [(f"d{d}", 3 * i, 3 * i + 2, rng.choice(TAGS)) for d in range(60) for i in range(rng.randint(1, 15))]
    df = spark.createDataFrame(rows, "hash string, start bigint, end bigint, tag string")
    got = {}
    for r in D.decode_bio(df).collect():
        got.setdefault(r["hash"], []).append((r["label"], r["start"], r["end"]))
    for doc in {r[0] for r in rows}:
        assert sorted(got.get(doc, [])) == sorted(sequential_bio([r[1:] for r in rows if r[0] == doc]))
    with pytest.raises(Exception, match="unsupported tag"):
        D.decode_bio(df.withColumn("tag", F.lit("B-PER"))).collect()


def test_tag_scores_are_averaged_over_windows(spark):
    p = lambda c: [0.9 if i == c else 0.0 for i in range(7)]
    weak = [0.5 if i == 0 else 0.4 if i == 1 else 0.0 for i in range(7)]
    rows = [("h", 0, s, e, c, x) for s, e, v in ((0, 2, weak), (3, 5, p(2))) for c, x in enumerate(v)]
    rows += [("h", 1, 0, 2, c, x) for c, x in enumerate(p(1))]
    scores = spark.createDataFrame(rows, "hash string, window_id bigint, start bigint, end bigint, class_id bigint, p double")
    inputs = spark.createDataFrame([("h",), ("none",)], "hash string")
    got = {r["hash"]: [tuple(e) for e in r["entities"]] for r in D.decode_tag_records(scores, inputs).collect()}
    assert got == {"h": [("ORG", 0, 5)], "none": []}


def test_threshold_is_strict_and_skips_bad_pairs(spark):
    rows = [("h", 0, [(0, 0), (0, 3), (4, 6), (0, 0)], [(0, 1, 1, 0.0), (1, 1, 2, 0.5), (2, 2, 9, 1.0), (2, 0, 0, 1.0)])]
    df = spark.createDataFrame(
        rows,
        f"hash string, window_id bigint, tokens {TOK}, "
        "scores array<struct<label_id:bigint,token_start:bigint,token_end:bigint,score:double>>",
    )
    assert [tuple(r)[2:] for r in D.threshold_spans(df, 0.0).collect()] == [("NAME", 0, 6, 0.5)]


def test_predict_keeps_every_input(spark):
    rows = [("a", "one two three four five six"), ("b", ""), ("c", "G'ulom")]
    df = spark.createDataFrame(rows, "hash string, text string")
    got = {r["hash"]: r["entities"] for r in predict_spans(df, load_digest_scorer, max_length=5, stride=1).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"] == [] and got["a"]
    for (_, text), entities in zip(rows, (got["a"], got["b"], got["c"])):
        ends = [0] + [e["end"] for e in entities]
        assert all(0 <= e["start"] < e["end"] <= len(text) for e in entities)
        assert all(e["start"] >= end for e, end in zip(entities, ends))


def test_scorer_must_answer_every_window(spark):
    windows = N.token_windows(N.tokenize_offsets(spark.createDataFrame([("a", "x y")], "hash string, text string")).select("hash", "tokens"), 8, 1)
    with pytest.raises(Exception, match="one result per window"):
        D.score_windows(windows, lambda: lambda batch: []).collect()
