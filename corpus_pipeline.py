"""The training-data pipeline: toxicity, quality rules, near copies, mixing, packing.

Every stage takes the rows its predecessor kept and all but the last return the columns of
``documents``.  Each result is written and read again, so a lost executor costs a task, not
the stages before.
"""

import sys
from collections.abc import Callable
from functools import wraps
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from spanloom.llm.mixing import mix_sources  # noqa: E402
from spanloom.llm.overlap_join import keep_one_of_each  # noqa: E402
from spanloom.llm.packing import pack_documents  # noqa: E402
from spanloom.llm.quality_rules import language_references, quality_rules  # noqa: E402
from spanloom.llm.stage import fold_of, staged  # noqa: E402
from spanloom.llm.toxicity import score_toxicity, train_toxicity  # noqa: E402


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """A stage that sees the other columns of its table under names no operator uses, and returns them all."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        renamed = docs.toDF(*[c if c in DOCUMENT else f"other__{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, renamed, sf_dir).select(*renamed.columns).toDF(*docs.columns)

    return run_stage


@apart
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3; the model learns from ``labels``."""

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = train_toxicity(docs, labels.where(fold_of("doc_id", 4) != 2))
    scored = score_toxicity(docs, model, threshold=0.3, keep_text=True)
    return scored.where("predicted = 0").select(*docs.columns)


@apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near enough to a language."""

    judged = quality_rules(docs, language_references(docs), keep_text=True)
    return judged.where("kept").select(*docs.columns)


@apart
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest identifier, of each group linked by five-word shingles."""

    return keep_one_of_each(docs, k=5, percent=80)


@apart
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in the order of its slots: small sources come round again, none is cut."""

    mixed = mix_sources(docs)
    ordered = mixed.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", F.xxhash64("doc_id"))
    return ordered.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of several lengths, filled from neighbouring documents of the mixture."""

    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, every stage before it written as Parquet and read again."""

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# boosted trees and greedy packing are beyond SQL; tests/llm compares with brute force
ORACLE_SQL = None
