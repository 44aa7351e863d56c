"""Validation: record and span rules as violation tables.

The work is split by what it has to see.  Rules about one record are evaluated in
the row (no shuffle).  Rules about the dataset (unique hash, same hashes on both
sides) pre-aggregate per hash on the map side and meet again on ``ord``, which is
unique, so a hash carried by a third of all rows never lands in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.operators.rows import each
from spanloom.functions.arrays import let, neighbours
from spanloom.schema import LABELS

# mode -> (labels restricted, duplicates reported, overlaps reported)
MODES = {
    "contract": (True, True, True),
    "score": (True, True, False),
    "response": (True, True, False),
    "inspect": (False, False, True),
}


def label_ok(label: Column, mode: str = "contract") -> Column:
    """Whether a label is acceptable in the given mode (never NULL)."""

    allowed = label.isin(*LABELS) if MODES[mode][0] else label != ""
    return F.coalesce(allowed, F.lit(False))


def offsets_ok(start: Column, end: Column, length: Column) -> Column:
    """``0 <= start < end <= length`` (never NULL)."""

    return F.coalesce((start >= 0) & (start < end) & (end <= length), F.lit(False))


def entity_errors(entities: Column, length: Column, mode: str = "contract") -> Column:
    """Violations inside one record: ``array<struct<idx,error>>``."""

    return let(length, lambda n: _entity_errors(entities, n, mode))


def _entity_errors(entities: Column, length: Column, mode: str) -> Column:
    _, duplicates, overlaps = MODES[mode]
    checked = F.transform(
        entities,
        lambda e, i: F.struct(
            e["start"].alias("start"),
            e["end"].alias("end"),
            e["label"].alias("label"),
            i.cast("bigint").alias("idx"),
            F.when(~label_ok(e["label"], mode), "label")
            .when(~offsets_ok(e["start"], e["end"], length), "offsets")
            .alias("error"),
        ),
    )
    def pair(left: Column, right: Column) -> Column:
        same = (
            (left["start"] == right["start"])
            & (left["end"] == right["end"])
            & (left["label"] == right["label"])
        )
        error = F.when(same & F.lit(duplicates), "duplicate").when(
            (right["start"] < left["end"]) & F.lit(overlaps), "overlap"
        )
        return F.when(
            error.isNotNull(), F.struct(right["idx"].alias("idx"), error.alias("error"))
        )

    def collect(marked: Column) -> Column:
        single = F.transform(
            F.filter(marked, lambda e: e["error"].isNotNull()),
            lambda e: F.struct(e["idx"].alias("idx"), e["error"].alias("error")),
        )
        valid = F.sort_array(F.filter(marked, lambda e: e["error"].isNull()))
        return F.concat(single, neighbours(valid, pair))

    return let(checked, collect)


def validate_spans(records: DataFrame, mode: str = "contract") -> DataFrame:
    """``(hash, idx, error)`` for every offending entity of ``(hash, text, entities)``."""

    errors = entity_errors(F.col("entities"), F.length("text"), mode)
    return each(records, ["hash"], errors)


def canonical_array(entities: Column) -> Column:
    """Only label, start and end, sorted by ``(start, end, label)``."""

    keyed = F.transform(
        entities,
        lambda e: F.struct(
            e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")
        ),
    )
    return F.transform(
        F.sort_array(keyed),
        lambda e: F.struct(
            e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end")
        ),
    )


def canonical_entities(records: DataFrame) -> DataFrame:
    """Records with their entities in canonical order."""

    return records.withColumn("entities", canonical_array(F.col("entities")))


def duplicate_entity(records: DataFrame) -> DataFrame:
    """``(hash, label, start, end, idx)`` of entities repeating an earlier key."""

    keyed = F.transform(
        F.col("entities"),
        lambda e, i: F.struct(
            e["label"].alias("label"),
            e["start"].alias("start"),
            e["end"].alias("end"),
            i.cast("bigint").alias("idx"),
        ),
    )
    repeated = neighbours(
        F.sort_array(keyed),
        lambda left, right: F.when(
            left["label"].eqNullSafe(right["label"])
            & left["start"].eqNullSafe(right["start"])
            & left["end"].eqNullSafe(right["end"]),
            right,
        ),
    )
    return each(records, ["hash"], repeated)


def overlap_check(records: DataFrame) -> DataFrame:
    """Neighbouring entities (sorted by start, end, label) that overlap."""

    keyed = F.transform(
        F.col("entities"),
        lambda e: F.struct(
            e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")
        ),
    )
    clashes = neighbours(
        F.sort_array(keyed),
        lambda left, right: F.when(
            right["start"] < left["end"],
            F.struct(
                left["start"].alias("left_start"),
                left["end"].alias("left_end"),
                right["start"].alias("right_start"),
                right["end"].alias("right_end"),
            ),
        ),
    )
    return each(records, ["hash"], clashes)


def duplicate_hash(records: DataFrame) -> DataFrame:
    """``(ord, hash)`` of the rows after the first with a hash already seen."""

    first = records.groupBy("hash").agg(F.min("ord").alias("ord")).select("ord")
    return records.select("ord", "hash").join(first, "ord", "left_anti")


def validate_input_batch(batch: DataFrame) -> DataFrame:
    """``(ord, error)`` for a batch of ``(ord, hash, text)``; no row means valid.

    A batch without rows has the violation ``empty``, without ``ord``.
    """

    hash_ok = F.coalesce(F.col("hash") != "", F.lit(False))
    field = (
        F.when(~hash_ok, "hash").when(F.col("text").isNull(), "text")
    )
    fields = batch.select("ord", field.alias("error")).filter("error is not null")
    repeated = duplicate_hash(batch.filter(hash_ok)).select("ord", F.lit("duplicate_hash").alias("error"))
    none = batch.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(None).cast(batch.schema["ord"].dataType).alias("ord"), F.lit("empty").alias("error")
    )
    return fields.unionByName(repeated).unionByName(none)


def validate_predictions(predictions: DataFrame, inputs: DataFrame) -> DataFrame:
    """``(ord, idx, error)``: results must answer the inputs position by position."""

    left = inputs.select(
        "ord", F.col("hash").alias("want"), F.length("text").alias("length"), F.lit(1).alias("asked")
    )
    right = predictions.select("ord", F.col("hash").alias("got"), "entities", F.lit(1).alias("answered"))
    paired = left.join(right, "ord", "full_outer")
    whole = (
        F.when(F.col("answered").isNull() | F.col("asked").isNull(), "count")
        .when(~F.col("want").eqNullSafe(F.col("got")), "hash")
        .when(F.col("entities").isNull(), "entities")
    )
    errors = F.when(
        whole.isNotNull(),
        F.array(F.struct(F.lit(None).cast("bigint").alias("idx"), whole.alias("error"))),
    ).otherwise(entity_errors(F.col("entities"), F.col("length")))
    return each(paired, ["ord"], errors)


def hash_differences(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(side, hash)`` of hashes present on one side only."""

    sides = gold.select("hash", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        predictions.select("hash", F.lit(0).alias("g"), F.lit(1).alias("p"))
    )
    flags = sides.groupBy("hash").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return flags.filter("g <> p").select(
        F.when(F.col("g") == 1, "missing").otherwise("extra").alias("side"), "hash"
    )


def hash_set_equality(gold: DataFrame, predictions: DataFrame, examples: int = 5) -> DataFrame:
    """``(side, total, rank, hash)``: totals and the first few hashes of each side."""

    differing = hash_differences(gold, predictions)
    # a filter on the bare row number lets every task keep its first few rows only
    ranked = differing.withColumn(
        "rank", F.row_number().over(W.partitionBy("side").orderBy("hash"))
    ).filter(F.col("rank") <= examples)
    totals = differing.groupBy("side").agg(F.count("*").alias("total"))
    return ranked.join(F.broadcast(totals), "side").select(
        "side", "total", F.col("rank").cast("bigint").alias("rank"), "hash"
    )


def text_agreement(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Hashes whose prediction carries a text other than gold's (digests are compared)."""

    left = gold.select("hash", F.sha2("text", 256).alias("want"))
    right = predictions.filter("text is not null").select("hash", F.sha2("text", 256).alias("got"))
    return left.join(right, "hash").filter("want <> got").select("hash")


def nonempty_dataset(records: DataFrame, name: str) -> DataFrame:
    """One row ``(dataset, nonempty)``; reads at most one record."""

    return records.limit(1).agg(
        F.lit(name).alias("dataset"), (F.count("*") > 0).alias("nonempty")
    )


def prefix_source(record_hash: Column, prefixes: tuple[str, ...]) -> Column:
    """First listed prefix the hash starts with, NULL for an original record."""

    if not prefixes or not all(prefixes) or len(set(prefixes)) != len(prefixes):
        raise ValueError("prefixes must be non-empty and unique")
    return F.coalesce(*[F.when(record_hash.startswith(p), F.lit(p)) for p in prefixes])


def is_empty_record(entities: Column) -> Column:
    """Whether a record has no entities."""

    return F.size(entities) == 0
