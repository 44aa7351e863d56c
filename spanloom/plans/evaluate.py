"""Scoring prediction files against gold files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import scoring, validate
from spanloom.sources.records import read_predictions, read_records
from spanloom.sources.sinks import write_report


def _paired(gold: DataFrame, predictions: DataFrame, mode: str) -> None:
    """Same hashes, same texts, offsets within the gold text; raises otherwise.

    One outer join by hash answers all three; only if something differs are the examples
    looked for.
    """

    left = gold.select("hash", F.sha2("text", 256).alias("want"), F.length("text").cast("bigint").alias("length"))
    right = predictions.select(F.col("hash").alias("got_hash"), F.sha2("text", 256).alias("got"), "entities")
    met = left.join(right, F.col("hash") == F.col("got_hash"), "full_outer")
    errors = F.size(validate.entity_errors(F.col("entities"), F.col("length"), mode))
    wrong = F.when(
        F.col("hash").isNotNull() & F.col("got_hash").isNotNull(),
        F.coalesce(F.col("want") != F.col("got"), F.lit(False)) | (errors > 0),
    ).otherwise(True)
    if not met.agg(F.count_if(wrong)).first()[0]:
        return
    differing = validate.hash_set_equality(gold, predictions).collect()
    if differing:
        sides = {s: [r["hash"] for r in differing if r["side"] == s] for s in ("missing", "extra")}
        raise ValueError(f"gold/prediction hashes differ: {sides}")
    other = validate.text_agreement(gold, predictions).first()
    if other is not None:
        raise ValueError(f"prediction text differs from gold for {other['hash']}")
    against = predictions.select("hash", "entities").join(gold.select("hash", "text"), "hash")
    bad = validate.validate_spans(against, mode).first()
    if bad is not None:
        raise ValueError(f"{bad['hash']}/entities[{bad['idx']}]: {bad['error']}")


def evaluate_files(
    spark: SparkSession, gold_path: str, predictions_path: str, output: str | None = None
) -> DataFrame:
    """Metric report of a prediction file, all checks passed."""

    gold = read_records(spark, gold_path, mode="score")
    predictions = read_predictions(spark, predictions_path)
    _paired(gold, predictions, "score")
    report = scoring.metric_report(scoring.explode_spans(gold), scoring.explode_spans(predictions), gold)
    if output is not None:
        write_report(report, output, overwrite=True)
    return report


def load_comparison(spark: SparkSession, gold_path: str, predictions_path: str) -> DataFrame:
    """``(hash, text, gold_entities, pred_entities)`` for inspection."""

    gold = read_records(spark, gold_path, mode="inspect")
    predictions = read_predictions(spark, predictions_path, mode="inspect")
    _paired(gold, predictions, "inspect")
    return scoring.compare_join(gold, validate.canonical_entities(predictions))
