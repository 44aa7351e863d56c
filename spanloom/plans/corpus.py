"""Corpus builds: merge an outside corpus into train, thin the result."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import converters as C
from spanloom.operators import corpus
from spanloom.operators.materialize import materialize
from spanloom.operators.validate import duplicate_hash
from spanloom.schema import ADDED_PREFIXES
from spanloom.sources.records import read_records, read_source_arrays
from spanloom.sources.sinks import write_jsonl, write_report
from spanloom.sources.token_rows import read_token_rows


def _require_good(converted: DataFrame, strict: bool) -> DataFrame:
    """Converted rows without an error; strict mode fails on any."""

    if strict:
        bad = converted.filter("error is not null").first()
        if bad is not None:
            raise ValueError(f"conversion failed: {bad['error']} in {bad['hash']}")
    return converted.filter("error is null")


def _merge(
    spark: SparkSession, converted: DataFrame, train_path: str, dev_path: str, output: str, overwrite: bool,
    unique_hash: bool, counted: Observation,
) -> DataFrame:
    if converted.limit(1).count() == 0:
        raise ValueError("no source records")
    train = read_records(spark, train_path, extra=True)
    dev = read_records(spark, dev_path, extra=True)
    fresh, added = corpus.observe_added(corpus.dedup_against(converted, train, dev))
    fresh = materialize(fresh)
    if unique_hash and duplicate_hash(fresh).first() is not None:
        raise ValueError("duplicate generated hash")
    merged = corpus.append_train(train, fresh.select("ord", "hash", "text", "entities"))
    # the export keeps train before the added records
    write_jsonl(merged, f"{output}/train", overwrite=overwrite, ordered=True)
    write_jsonl(dev, f"{output}/dev", overwrite=overwrite)
    return corpus.merge_report(train, dev, converted, counted, added)


def merge_array_corpus(
    spark: SparkSession,
    source_path: str,
    train_path: str,
    dev_path: str,
    output: str,
    *,
    strict: bool = True,
    overwrite: bool = False,
) -> DataFrame:
    """Convert parallel-array rows, append the new ones to train, copy dev, return the audit.

    The conversion is checkpointed: it is read by the error check, by deduplication and by
    the audit.
    """

    converted, counted = corpus.observe_converted(C.convert_arrays(read_source_arrays(spark, source_path)))
    converted = materialize(converted)
    good = _require_good(converted, strict)
    manifest = materialize(_merge(spark, good, train_path, dev_path, output, overwrite, unique_hash=True, counted=counted))
    write_report(manifest, f"{output}/merge_manifest", overwrite=overwrite)
    return manifest


def merge_token_corpus(
    spark: SparkSession,
    source_path: str,
    train_path: str,
    dev_path: str,
    output: str,
    *,
    sheets: tuple[str, ...] = ("Dataset_1", "Dataset_2"),
    max_sentences: int | None = None,
    strict: bool = True,
    overwrite: bool = False,
) -> DataFrame:
    """The same for a BIOES token table; the audit also has the tag quality counts."""

    rows = read_token_rows(spark, source_path, sheets)
    if strict:
        bad = rows.filter("error is not null").first()
        if bad is not None:
            raise ValueError(f"{bad['sheet']}:{bad['row_no']}: missing {bad['error']}")
    grouped = C.sentence_groups(rows.filter("error is null").drop("error"))
    if max_sentences is not None:
        grouped = C.max_sentences(grouped, max_sentences)
    decoded = materialize(C.decode_bioes(C.detokenize(grouped)))
    place = F.array_position(F.array(*[F.lit(s) for s in sheets]), F.col("sheet"))
    converted = C.convert_sentences(decoded).withColumn(
        "ord", F.struct(place.cast("string").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("run_no").alias("seq"))
    )
    converted, counted = corpus.observe_converted(converted)
    good = _require_good(materialize(converted), strict).drop("sheet", "run_no")
    manifest = _merge(spark, good, train_path, dev_path, output, overwrite, unique_hash=False, counted=counted)
    manifest = materialize(manifest.unionByName(C.tag_quality_counts(decoded)))
    write_report(manifest, f"{output}/merge_manifest", overwrite=overwrite)
    return manifest


def thin_corpus(
    spark: SparkSession,
    train_path: str,
    dev_path: str,
    output: str,
    *,
    drop_fraction: float = 0.75,
    seed: int = 42,
    prefixes: tuple[str, ...] = ADDED_PREFIXES,
    overwrite: bool = False,
) -> DataFrame:
    """Remove the fraction of empty added records from train, copy dev, return the audit."""

    train = read_records(spark, train_path, extra=True)
    marked, seen = corpus.observe_marked(corpus.mark_empty_added(train, drop_fraction, seed, prefixes), prefixes)
    # written before the sort, whose sampling would evaluate and count the marks again
    kept = materialize(marked.filter(~F.col("removed")).drop("source", "is_empty", "removed"))
    write_jsonl(kept, f"{output}/train", overwrite=overwrite, ordered=True)
    write_jsonl(read_records(spark, dev_path, extra=True), f"{output}/dev", overwrite=overwrite)
    manifest = corpus.filter_report(spark, seen, prefixes)
    changed = manifest.filter("org_before <> org_after or name_before <> name_after or geo_before <> geo_after")
    if changed.first() is not None:
        raise AssertionError("entity counts changed while removing empty records")
    write_report(manifest, f"{output}/filter_manifest", overwrite=overwrite)
    return manifest
