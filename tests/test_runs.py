"""Spans derived in Arrow batches against the column functions they replace."""

from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from spanloom.functions import runs
from workload import views as V

TEXTS = ["", " ", "a", "é 😀b  \nc ", None, "x y z " * 50, " ".join(f"w{i} é{i}" for i in range(300)), "same same same"]


def digit(*parts):
    return int(md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()[0], 16)


def gold_tag(tok, _ord, _pos):
    return {0: "ORG", 1: "ORG", 2: "NAME", 3: "NAME", 4: "GEO"}.get(digit(tok, "g"), "O")


def pred_tag(tok, ord_, pos):
    a, b = digit(tok, "g"), digit(tok, ord_, pos)
    if b == 0:
        return "O"
    if a in (2, 3):
        return "ORG" if b == 1 else "NAME"
    return "ORG" if a < 2 else "GEO" if a == 4 or (a == 5 and b == 2) else "O"


def expected(text, ord_, tag):
    if text is None:
        return None
    spans, at, last = [], 0, None
    for pos, tok in enumerate(text.split(" ")):
        if tok:
            label = tag(tok, ord_, pos)
            if label == last:
                spans[-1][2] = at + len(tok)
            else:
                spans.append([label, at, at + len(tok)])
            last = label
        at += len(tok) + 1
    return [tuple(s) for s in spans if s[0] != "O"]


def test_derived_spans_equal_word_by_word_tags(spark):
    rows = [(None if i % 4 == 3 else i, t) for i in range(5) for t in TEXTS]
    df = spark.createDataFrame(rows, "ord bigint, text string").coalesce(1)
    found = df.select("ord", "text", V.gold_entities(F.col("text")).alias("g"), V.pred_entities(F.col("text")).alias("p"))
    for r in found.collect():
        assert r["g"] == expected(r["text"], r["ord"], gold_tag)
        assert r["p"] == expected(r["text"], r["ord"], pred_tag)


def test_texts_are_worked_on_in_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(runs, "SLICE", 10)
    texts = pa.array(["a" * 30, None, "bb", "cc", "", "d" * 9, "e" * 11])
    slices = list(runs._slices(texts))
    assert [a for a, _ in slices] == [0, *[b for _, b in slices][:-1]] and slices[-1][1] == len(texts)
    assert all(b - a == 1 or sum(len(t or "") for t in texts[a:b].to_pylist()) <= 10 for a, b in slices)
    one = lambda words, row, pos, more: np.ones(len(words), np.uint8)
    assert runs._spans(texts, [], ("X",), one).to_pylist()[2] == [{"label": "X", "start": 0, "end": 2}]


def test_both_sides_of_a_comparison_meet_without_a_shuffle_of_spans(spark, tmp_path, capsys):
    rows = [(i, "a b c d e " * 20, "s") for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    from workload.q_scoring import gold_spans, pred_spans

    from spanloom.operators import scoring

    scoring.side_flags(gold_spans(spark, str(tmp_path)), pred_spans(spark, str(tmp_path))).explain()
    plan = capsys.readouterr().out.split("Exchange hashpartitioning")[1:]
    # each side is dealt before and after its spans are derived, and the spans never
    assert len(plan) == 4 and not any("start" in part.split(")")[0] for part in plan)
