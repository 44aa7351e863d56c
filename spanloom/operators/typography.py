"""Apostrophe unification and canonical names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.rows import each
from spanloom.functions.text import (
    apostrophe_matches,
    casefold_key,
    clean_value,
    cleaned_surface,
    normalize_apostrophes,
    with_surfaces,
)
from spanloom.operators.joins import lookup_join
from spanloom.schema import LABELS


def normalize_records(records: DataFrame) -> DataFrame:
    """Records with unified apostrophes; offsets stay valid."""

    return records.withColumn("text", normalize_apostrophes(F.col("text")))


def apostrophe_stats(records: DataFrame) -> DataFrame:
    """``(metric, key, value)``: records, changed records, replacements, per variant."""

    found = records.select(apostrophe_matches(F.col("text")).alias("found"))
    row = lambda metric, value: F.struct(
        F.lit(metric).alias("metric"), F.lit("").alias("key"), value.alias("value")
    )
    totals = found.agg(
        F.count("*").alias("records"),
        F.count_if(F.size("found") > 0).alias("changed"),
        F.coalesce(F.sum(F.size("found")), F.lit(0)).alias("replaced"),
    ).select(
        F.explode(
            F.array(
                row("records", F.col("records")),
                row("changed_records", F.col("changed")),
                row("replacements", F.col("replaced")),
            )
        ).alias("m")
    )
    variants = (
        each(found, [], "found", "key")
        .groupBy("key")
        .agg(F.count("*").alias("value"))
        .select(F.lit("by_variant").alias("metric"), "key", "value")
    )
    return totals.select("m.*").unionByName(variants)


def alias_index(aliases: DataFrame) -> DataFrame:
    """``(label, alias_key, canonical, error)`` from ``(label, alias, canonical)``.

    ``error`` is ``label``, ``empty`` or ``conflict``; usable rows have none.
    """

    cleaned = aliases.select(
        "label", casefold_key(F.col("alias")).alias("alias_key"),
        clean_value(F.col("canonical")).alias("canonical"),
    )
    index = cleaned.groupBy("label", "alias_key").agg(
        F.min("canonical").alias("canonical"),
        F.max("canonical").alias("other"),
        F.count_if(F.coalesce(F.col("canonical") == "", F.lit(True))).alias("empty"),
    )
    known = F.coalesce(F.col("label").isin(*LABELS), F.lit(False))
    has_key = F.coalesce(F.col("alias_key") != "", F.lit(False))
    return index.select(
        "label",
        "alias_key",
        "canonical",
        F.when(~known, "label")
        .when(~has_key | (F.col("empty") > 0), "empty")
        .when(F.col("canonical") != F.col("other"), "conflict")
        .alias("error"),
    )


def surfaces(records: DataFrame, *keep: str) -> DataFrame:
    """``(hash, *keep, label, start, end, surface)`` for every entity."""

    listed = with_surfaces(F.col("text"), F.col("entities"))
    return each(records, ["hash", *keep], listed)


def alias_join(spans: DataFrame, index: DataFrame) -> DataFrame:
    """Span rows with ``surface`` get ``normalized``: the canonical name or the cleaned surface."""

    named = spans.withColumn("named", cleaned_surface(F.col("surface")))
    keyed = named.withColumns({"cleaned": F.col("named.cleaned"), "alias_key": F.col("named.key")})
    usable = index.filter("error is null").select("label", "alias_key", "canonical")
    joined = lookup_join(keyed, usable, ["label", "alias_key"])
    return joined.select(
        *spans.columns, F.coalesce("canonical", "cleaned").alias("normalized")
    )
