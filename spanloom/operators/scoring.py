"""Exact-span scoring and gold/prediction comparison.

Counting unions both span tables under side flags and groups by the full key
``(hash, label, start, end)``: one shuffle, map-side combine, no join, and no key
that many rows can share.  Everything after that is arithmetic on a single row.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql import Window as W

from spanloom.operators.materialize import materialize
from spanloom.operators.rows import each
from spanloom.functions.agreement import PIECES, agreement_pieces, piece_rows
from spanloom.functions.arrays import last_end, let
from spanloom.functions.text import characters, cut
from spanloom.schema import LABELS

KEY = ["hash", "label", "start", "end"]


def explode_spans(records: DataFrame, *keep: str) -> DataFrame:
    """``(hash, *keep, label, start, end)`` from records."""

    rows = each(records, ["hash", *keep], "entities")
    return rows.select("hash", *keep, "label", "start", "end")


def _flagged(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """The spans of both sides with ``in_gold`` and ``in_pred`` (0/1)."""

    return gold.select(*KEY, F.lit(1).alias("in_gold"), F.lit(0).alias("in_pred")).unionByName(
        predictions.select(*KEY, F.lit(0).alias("in_gold"), F.lit(1).alias("in_pred"))
    )


def side_flags(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per distinct span key with ``in_gold`` and ``in_pred`` (0/1)."""

    return _flagged(gold, predictions).groupBy(*KEY).agg(
        F.max("in_gold").alias("in_gold"), F.max("in_pred").alias("in_pred")
    )


def _wide_counts(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """A single row ``counts: array<struct<label,tp,fp,fn>>`` covering every label."""

    g, p = F.col("in_gold"), F.col("in_pred")
    sums = [
        F.coalesce(F.count_if(condition & (F.col("label") == label)), F.lit(0)).alias(f"{name}_{label}")
        for label in LABELS
        for name, condition in (
            ("tp", (g == 1) & (p == 1)),
            ("fp", (g == 0) & (p == 1)),
            ("fn", (g == 1) & (p == 0)),
        )
    ]
    rows = [
        F.struct(
            F.lit(label).alias("label"),
            *[F.col(f"{name}_{label}").alias(name) for name in ("tp", "fp", "fn")],
        )
        for label in LABELS
    ]
    return side_flags(gold, predictions).agg(*sums).select(F.array(*rows).alias("counts"))


def exact_span_counts(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(label, tp, fp, fn)``, always one row per label."""

    return _wide_counts(gold, predictions).selectExpr("inline(counts)")


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall, F1, counts and totals as named columns; 0/0 is 0."""

    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(F.lit(2.0) * precision * recall, precision + recall).alias("f1"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        (tp + fn).alias("gold"),
        (tp + fp).alias("predicted"),
    ]


def prf_by_label(counts: DataFrame) -> DataFrame:
    """Metrics for each row of ``(label, tp, fp, fn)``."""

    return counts.select("label", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def micro_metrics(counts: DataFrame) -> DataFrame:
    """Metrics on the label-summed counts."""

    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return total.select(*prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_metrics(by_label: DataFrame) -> DataFrame:
    """Plain mean over the labels, unsupported ones included."""

    return by_label.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def _report_rows(counts: Column) -> Column:
    """Per-label, micro and macro rows from ``array<struct<label,tp,fp,fn>>``."""

    def total(name: str) -> Column:
        return sum((counts[i][name] for i in range(1, len(LABELS))), counts[0][name])

    def row(scope: Column | str, tp: Column, fp: Column, fn: Column) -> Column:
        name = F.lit(scope) if isinstance(scope, str) else scope
        return F.struct(name.alias("scope"), *prf(tp, fp, fn))

    labels = [row(label, *[counts[i][c] for c in ("tp", "fp", "fn")]) for i, label in enumerate(LABELS)]
    none = F.lit(None).cast("bigint")
    return let(
        F.array(*labels, row("micro", total("tp"), total("fp"), total("fn"))),
        lambda rows: F.concat(
            rows,
            F.array(
                F.struct(
                    F.lit("macro").alias("scope"),
                    *[
                        (
                            sum((rows[i][m] for i in range(1, len(LABELS))), rows[0][m])
                            / F.lit(len(LABELS))
                        ).alias(m)
                        for m in ("precision", "recall", "f1")
                    ],
                    *[none.alias(c) for c in ("tp", "fp", "fn", "gold", "predicted")],
                )
            ),
        ),
    )


def metric_report(gold: DataFrame, predictions: DataFrame, records: DataFrame) -> DataFrame:
    """Five rows (labels, micro, macro) with the number of gold records."""

    n = records.agg(F.count("*")).scalar()
    report = each(_wide_counts(gold, predictions), [], _report_rows(F.col("counts")))
    return report.withColumn("records", n)


def metrics_by_split(gold: DataFrame, predictions: DataFrame, records: DataFrame) -> DataFrame:
    """The report for every split and epoch, with the number of gold ``records`` of the split.

    Gold and ``records`` carry ``split``; predictions carry ``split`` and ``epoch``.  A
    hash may be in several splits.  A split of ``records`` without a predicted span has a report
    for every epoch of the predictions.  Gold is counted once per split and not copied for each epoch: misses
    are totals minus hits.
    """

    key = ["split", *KEY]
    # both sides are derived once; what is counted of them is small and read several times
    sides = gold.select(*key, F.lit(None).cast(predictions.schema["epoch"].dataType).alias("epoch"), F.lit(1).alias("in_gold")).unionByName(
        predictions.select(*key, "epoch", F.lit(0).alias("in_gold"))
    )
    # no key with a NULL is that of a gold span
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    golds = F.when(whole, F.sum("in_gold").over(W.partitionBy(*key))).otherwise(F.lit(0))
    tallies = materialize(
        sides.withColumn("golds", golds)
        .groupBy("in_gold", "split", "epoch", "label")
        .agg(F.sum("golds").alias("tp"), F.sum(F.greatest("golds", F.lit(1))).alias("predicted"), F.count("*").alias("n"))
    )
    hits, found = tallies.filter("in_gold = 0"), tallies.filter("in_gold = 1")
    per_epoch = hits.groupBy("split", "epoch").agg(
        *[
            F.coalesce(F.max(F.when(F.col("label") == label, F.col(c))), F.lit(0)).alias(f"{c}_{label}")
            for label in LABELS
            for c in ("tp", "predicted")
        ]
    )
    totals = found.groupBy("split").agg(
        *[F.coalesce(F.max(F.when(F.col("label") == label, F.col("n"))), F.lit(0)).alias(f"gold_{label}") for label in LABELS]
    )
    counts = F.array(
        *[
            F.struct(
                F.col(f"tp_{label}").alias("tp"),
                (F.col(f"predicted_{label}") - F.col(f"tp_{label}")).alias("fp"),
                (F.coalesce(f"gold_{label}", F.lit(0)) - F.col(f"tp_{label}")).alias("fn"),
            )
            for label in LABELS
        ]
    )
    # one row per split; the epochs, a few numbers, come as one array
    sizes = records.groupBy("split").agg(F.count("*").alias("records"))
    epochs = hits.agg(F.sort_array(F.collect_set("epoch")).alias("epochs")).scalar()
    rows = sizes.withColumn("epoch", F.explode(epochs))
    filled = rows.join(per_epoch, ["split", "epoch"], "left").join(totals, "split", "left").na.fill(0)
    return each(filled, ["split", "epoch", "records"], _report_rows(counts))


def best_epoch(history: DataFrame, metric: str = "f1", maximize: bool = True) -> DataFrame:
    """``(run, epoch, metric)``: the first epoch reaching the best value of each run.

    NaN and NULL are never the best; a run with no other value has no row.
    """

    history = history.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    value = F.col(metric) if maximize else -F.col(metric)
    best = F.struct(value.alias("value"), (-F.col("epoch")).alias("early"))
    return history.groupBy("run").agg(
        F.max_by("epoch", best).alias("epoch"), F.max_by(metric, best).alias(metric)
    )


def weighted_mean(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """``sum(value * weight) / sum(weight)`` per key; fails on a zero total weight."""

    total = F.sum(weight)
    return df.groupBy(*keys).agg(
        F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total)
        .otherwise(F.raise_error(F.lit("no labelled weight")).cast("double"))
        .alias("mean"),
        total.alias("weight"),
    )


def entity_status(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(side, hash, label, start, end, status)`` for every span of both sides.

    A span overlaps the other side iff some span starting at or before it reaches past
    its start, or some span starting after it starts before its end.  Both are running
    extremes in start order, so a document costs two sorts instead of all pairs.  They come ahead of the
    grouping by key, so spans that are dealt by ``hash`` are not shuffled and others once, by ``hash``.
    """

    flags = _flagged(gold, predictions)
    forward = W.partitionBy("hash").orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow)
    backward = (
        W.partitionBy("hash").orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, W.currentRow)
    )
    here = {side: F.col(f"in_{side}") == 1 for side in ("gold", "pred")}
    # both sides of one direction share a sort
    reach = flags.withColumns(
        {f"{side}_reach": F.max(F.when(here[side], F.col("end"))).over(forward) for side in here}
    ).withColumns(
        {f"{side}_next": F.min(F.when(here[side], F.col("start"))).over(backward) for side in here}
    )
    # rows of one key have the same extremes
    reach = reach.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in reach.columns if c not in KEY])

    def touches(side: str) -> Column:
        return F.coalesce(F.col(f"{side}_reach") > F.col("start"), F.lit(False)) | F.coalesce(
            F.col(f"{side}_next") < F.col("end"), F.lit(False)
        )

    both = (F.col("in_gold") == 1) & (F.col("in_pred") == 1)

    def status(other: str, alone: str) -> Column:
        return F.when(both, "correct").when(touches(other), "boundary_error").otherwise(alone)

    sides = F.array(
        F.when(
            F.col("in_gold") == 1,
            F.struct(F.lit("gold").alias("side"), status("pred", "missed").alias("status")),
        ),
        F.when(
            F.col("in_pred") == 1,
            F.struct(F.lit("pred").alias("side"), status("gold", "false_positive").alias("status")),
        ),
    )
    return each(reach, KEY, F.filter(sides, lambda s: s.isNotNull())).select("side", *KEY, "status")


def status_counts(statuses: DataFrame) -> DataFrame:
    """``(side, label, correct, boundary_error, missed, false_positive)``."""

    names = ("correct", "boundary_error", "missed", "false_positive")
    return statuses.groupBy("side", "label").agg(
        *[F.count_if(F.col("status") == name).alias(name) for name in names]
    )


def compare_join(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(hash, text, gold_entities, pred_entities)``, one row per shared hash."""

    return gold.select("hash", "text", F.col("entities").alias("gold_entities")).join(
        predictions.select("hash", F.col("entities").alias("pred_entities")), "hash"
    )


def comparison_segments(pairs: DataFrame) -> DataFrame:
    """``(hash, start, end, status, piece)`` from ``compare_join`` rows."""

    kind = StructType([pairs.schema["hash"], *PIECES.elementType.fields])
    return pairs.select("hash", "text", "gold_entities", "pred_entities").mapInArrow(piece_rows, kind)


def label_segment_array(text: Column, entities: Column) -> Column:
    """Pieces inside and outside the (sorted) spans of one text."""

    def piece(start: Column, end: Column, label: Column) -> Column:
        return F.struct(
            start.cast("bigint").alias("start"), end.alias("end"), label.alias("label")
        )

    none = F.lit(None).cast("string")

    def build(spans: Column) -> Column:
        parts = F.flatten(
            F.transform(
                spans,
                lambda e, i: F.array(
                    piece(F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), e["start"], none),
                    piece(e["start"], e["end"], e["label"]),
                ),
            )
        )
        tail = piece(last_end(spans), F.length(text).cast("bigint"), none)
        return F.filter(F.concat(parts, F.array(tail)), lambda p: p["start"] < p["end"])

    return let(entities, build)


def label_segments(records: DataFrame) -> DataFrame:
    """``(hash, start, end, label, piece)`` covering each text."""

    pieces = let(
        characters(F.col("text")),
        lambda chars: F.transform(
            label_segment_array(F.col("text"), F.col("entities")),
            lambda s: s.withField("piece", cut(chars, s["start"], s["end"])),
        ),
    )
    return each(records, ["hash"], pieces)


def _marked(segments: Column, name: str, piece: Callable[[Column], Column]) -> Column:
    pieces = F.transform(
        segments,
        lambda s: F.when(s[name].isNull(), piece(s)).otherwise(
            F.concat(F.lit("["), s[name], F.lit(":"), piece(s), F.lit("]"))
        ),
    )
    return F.array_join(pieces, "")


def mark_text(text: Column, entities: Column) -> Column:
    """The text with every span written inline as ``[LABEL:surface]``."""

    return let(
        characters(text),
        lambda chars: _marked(label_segment_array(text, entities), "label", lambda s: cut(chars, s["start"], s["end"])),
    )


def mark_comparison(text: Column, gold: Column, pred: Column) -> Column:
    """The text with agreement pieces written inline as ``[status:piece]``."""

    return _marked(agreement_pieces(text, gold, pred), "status", lambda s: s["piece"])


def entity_counts(records: DataFrame) -> DataFrame:
    """``(label, entities)`` over a dataset."""

    return each(records, [], "entities").groupBy("label").agg(F.count("*").alias("entities"))


def entities_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(label, before, after, unchanged)`` entity counts of two datasets."""

    def labels(df: DataFrame, b: int, a: int) -> DataFrame:
        return each(df, [], "entities").select("label", F.lit(b).alias("b"), F.lit(a).alias("a"))

    sides = labels(before, 1, 0).unionByName(labels(after, 0, 1))
    return (
        sides.groupBy("label")
        .agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
        .withColumn("unchanged", F.col("before") == F.col("after"))
    )
