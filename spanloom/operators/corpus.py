"""Merging, thinning and sampling of whole corpora, with their audit counts."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spanloom.operators.materialize import materialize
from spanloom.operators.rows import each
from spanloom.functions.text import mapped_label, seeded_key
from spanloom.operators.validate import is_empty_record, prefix_source
from spanloom.schema import ADDED_PREFIXES, ARRAY_LABELS, LABELS


def dedup_against(new: DataFrame, *existing: DataFrame) -> DataFrame:
    """New records whose exact text is in no existing dataset, first copy only.

    Texts meet as SHA-256 keys, new and existing ones in a single grouping that is combined
    on the map side, and the survivors are fetched by ``ord``, which is unique: a text that
    fills a third of the corpus causes no hot key.  (An anti join would be pushed below the
    grouping and meet all the copies.)
    """

    key = F.sha2("text", 256).alias("key")
    none = F.lit(None).cast(new.schema["ord"].dataType)
    keyed = new.select(key, "ord", F.lit(0).alias("known"))
    for other in existing:
        keyed = keyed.unionByName(other.select(key, none.alias("ord"), F.lit(1).alias("known")))
    first = keyed.groupBy("key").agg(F.min("ord").alias("ord"), F.max("known").alias("known"))
    return new.join(first.filter("known = 0").select("ord"), "ord", "left_semi")


def append_train(train: DataFrame, new: DataFrame) -> DataFrame:
    """Train followed by the new records.

    Columns that only one side has are kept.  A numeric ``ord`` of the new records is shifted
    past train's, if both are numeric; else both are put behind a part number, a numeric one in the
    form that file readers give.
    """

    kinds = [df.schema["ord"].dataType for df in (train, new)]
    if all(isinstance(k, T.LongType) for k in kinds):
        shift = train.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).scalar()
        return train.unionByName(
            new.withColumn("ord", F.col("ord") + shift), allowMissingColumns=True
        )
    if kinds[0] != kinds[1]:
        train, new = _file_order(train), _file_order(new)
    part = lambda df, n: df.withColumn(
        "ord", F.struct(F.lit(n).alias("part"), F.col("ord").alias("ord"))
    )
    return part(train, 0).unionByName(part(new, 1), allowMissingColumns=True)


def _file_order(rows: DataFrame) -> DataFrame:
    """A numeric ``ord``, or that of a merge, in the form ``struct<file,block,seq>``."""

    kind = rows.schema["ord"].dataType
    place = lambda file, block, seq: F.struct(
        file.alias("file"), block.cast("bigint").alias("block"), seq.cast("bigint").alias("seq")
    )
    zero = F.lit(0)
    if isinstance(kind, T.LongType):
        return rows.withColumn("ord", place(F.lit(""), zero, F.col("ord")))
    if "file" in kind.names:
        return rows
    inner = F.col("ord.ord")
    if isinstance(kind["ord"].dataType, T.LongType):
        return rows.withColumn("ord", place(F.format_string("%08d", "ord.part"), zero, inner))
    named = F.concat(F.format_string("%08d/", "ord.part"), inner["file"])
    return rows.withColumn("ord", place(named, inner["block"], inner["seq"]))


def _smallest(rows: DataFrame, key: str, count: Callable[[Column], Column]) -> Column:
    """Scalar ``struct(key, ord)`` of the row whose rank by seeded key is ``count(total)``.

    NULL if there is no such row.  Keys are uniform hex digests, so their first four digits
    give 65,536 even buckets.  Bucket sizes locate the one bucket that holds the answer and
    only that bucket is ranked; the result filters the wide records without any join.
    """

    narrow = rows.select(F.col(key), "ord", F.substring(key, 1, 4).alias("bucket"))
    sizes = narrow.groupBy("bucket").agg(F.count("*").alias("n"))
    # at most 65,536 rows reach these windows, whatever the size of the corpus
    running = sizes.select(
        "bucket",
        (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("before"),
        "n",
        count(F.sum("n").over(W.partitionBy())).alias("wanted"),
    ).filter("before < wanted and before + n >= wanted")
    place = running.agg(
        F.max(F.struct("bucket", (F.col("wanted") - F.col("before")).alias("rank")))
    ).scalar()
    ranked = narrow.filter(F.col("bucket") == place["bucket"]).withColumn(
        "rank", F.row_number().over(W.partitionBy("bucket").orderBy(key, "ord"))
    )
    chosen = ranked.filter(F.col("rank") == place["rank"])
    return chosen.agg(F.max(F.struct(F.col(key), F.col("ord")))).scalar()


def mark_empty_added(
    records: DataFrame,
    drop_fraction: float,
    seed: int,
    prefixes: tuple[str, ...] = ADDED_PREFIXES,
) -> DataFrame:
    """Records with ``source``, ``is_empty`` and ``removed``.

    Exactly ``floor(n * fraction)`` of the n empty records with an added prefix are
    marked, chosen by seeded digest of the hash.
    """

    if not 0.0 <= drop_fraction <= 1.0:
        raise ValueError("drop_fraction must be in [0, 1]")
    source = prefix_source(F.col("hash"), prefixes)
    flagged = records.withColumn("source", source).withColumn(
        "is_empty", is_empty_record(F.col("entities"))
    )
    eligible = F.col("is_empty") & F.col("source").isNotNull()
    key = F.when(eligible, seeded_key(seed, F.col("hash")))
    # written once, as the cut-off takes several passes; the records are read once more, to be marked
    narrow = materialize(flagged.filter(eligible).select("ord", key.alias("key")))
    cutoff = _smallest(narrow, "key", lambda n: F.floor(n * F.lit(drop_fraction)))
    at_most = F.struct(key.alias("key"), F.col("ord")) <= cutoff
    return flagged.withColumn("removed", F.coalesce(eligible & at_most, F.lit(False)))


def drop_empty_added(
    records: DataFrame,
    drop_fraction: float,
    seed: int,
    prefixes: tuple[str, ...] = ADDED_PREFIXES,
) -> DataFrame:
    """Records without the removed share of empty added ones."""

    marked = mark_empty_added(records, drop_fraction, seed, prefixes)
    return marked.filter(~F.col("removed")).drop("source", "is_empty", "removed")


def sample_n(records: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` records by seeded digest; fails if there are fewer."""

    if n <= 0:
        raise ValueError("number must be positive")
    keyed = records.withColumn("sample_key", seeded_key(seed, F.col("hash")))
    cutoff = _smallest(materialize(keyed.select("ord", "sample_key")), "sample_key", lambda _: F.lit(n))
    enough = F.when(
        cutoff.isNull(), F.raise_error(F.lit(f"number={n} exceeds the available records")).cast("boolean")
    ).otherwise(F.struct("sample_key", "ord") <= cutoff)
    return keyed.filter(enough).drop("sample_key")


def _long(df: DataFrame, metric: str, key: Column | str, value: str) -> DataFrame:
    key_column = F.lit(key) if isinstance(key, str) else key
    return df.select(
        F.lit(metric).alias("metric"), key_column.alias("key"), F.col(value).cast("bigint").alias("value")
    )


def merge_manifest(
    train: DataFrame, dev: DataFrame, converted: DataFrame, added: DataFrame
) -> DataFrame:
    """``(metric, key, value)`` audit of one merge.

    ``converted`` are the rows before deduplication, ``added`` those that survived.
    One narrow aggregate per dataset; the rest is arithmetic on single rows.
    """

    count = lambda df, name: df.agg(F.count("*").alias(name))
    n_train, n_dev = count(train, "n").scalar(), count(dev, "n").scalar()
    n_converted = count(converted, "n").scalar()
    totals = each(
        added.agg(F.count("*").alias("added")),
        [],
        F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), value.cast("bigint").alias("value"))
                    for name, value in (
                        ("original_train_records", n_train),
                        ("original_dev_records", n_dev),
                        ("added_records", F.col("added")),
                        ("merged_train_records", n_train + F.col("added")),
                        ("merged_dev_records", n_dev),
                        ("skipped_duplicate_text", n_converted - F.col("added")),
                    )
                ]
        ),
    )
    manifest = totals.select("metric", F.lit("").alias("key"), "value")
    labels = each(added, [], "entities").groupBy(F.col("label").alias("key")).agg(F.count("*").alias("value"))
    manifest = manifest.unionByName(
        _long(labels, "added_entities_by_target_label", F.col("key"), "value")
    )
    if "dropped_overlaps" in converted.columns:
        dropped = converted.agg(F.coalesce(F.sum("dropped_overlaps"), F.lit(0)).alias("value"))
        manifest = manifest.unionByName(_long(dropped, "dropped_overlapping_entity", "", "value"))
    if "source_labels" in converted.columns:
        manifest = manifest.unionByName(_source_labels(converted))
    return manifest


def observe_converted(converted: DataFrame) -> tuple[DataFrame, Observation]:
    """Converted rows that count themselves when they are written: good ``records`` and ``dropped``."""

    seen = Observation()
    good = F.col("error").isNull() if "error" in converted.columns else F.lit(True)
    dropped = F.col("dropped_overlaps") if "dropped_overlaps" in converted.columns else F.lit(0)
    return converted.observe(
        seen, F.count_if(good).alias("records"), F.coalesce(F.sum(F.when(good, dropped)), F.lit(0)).alias("dropped")
    ), seen


def observe_added(added: DataFrame) -> tuple[DataFrame, Observation]:
    """Added rows that count themselves when they are written: ``records`` and the entities of each label."""

    seen = Observation()
    n_label = lambda label: F.size(F.filter("entities", lambda e: e["label"] == label))
    sums = [F.coalesce(F.sum(n_label(label)), F.lit(0)).alias(label) for label in LABELS]
    return added.observe(seen, F.count("*").alias("records"), *sums), seen


def merge_report(train: DataFrame, dev: DataFrame, converted: DataFrame, seen_converted: Observation, seen_added: Observation) -> DataFrame:
    """The rows of ``merge_manifest`` from counters taken while the tables were written.

    Only the source labels, which may be any, are read again, and the numbers of train and dev
    come from a count without columns.
    """

    n_train, n_dev, all_ = train.count(), dev.count(), seen_converted.get
    added = dict(seen_added.get)
    n = added.pop("records")
    rows = [
        ("original_train_records", "", n_train),
        ("original_dev_records", "", n_dev),
        ("added_records", "", n),
        ("merged_train_records", "", n_train + n),
        ("merged_dev_records", "", n_dev),
        ("skipped_duplicate_text", "", all_["records"] - n),
        *(("added_entities_by_target_label", label, k) for label, k in added.items() if k),
    ]
    if "dropped_overlaps" in converted.columns:
        rows.append(("dropped_overlapping_entity", "", all_["dropped"]))
    report = train.sparkSession.createDataFrame(rows, "metric string, key string, value bigint")
    return report.unionByName(_source_labels(converted)) if "source_labels" in converted.columns else report


def _source_labels(converted: DataFrame) -> DataFrame:
    """Entities by source label, and again as ``dropped_label`` where it has no target."""

    names = each(converted, [], "source_labels", "key").groupBy("key").agg(F.count("*").alias("value"))
    unknown = mapped_label(F.col("key"), ARRAY_LABELS).isNull()
    kinds = F.when(unknown, F.array(F.lit("source_label"), F.lit("dropped_label"))).otherwise(F.array(F.lit("source_label")))
    return names.select(F.explode(kinds).alias("metric"), "key", "value")


_FILTER_COUNTS = ("input", "output", "removed", "input_empty", "output_empty", "eligible", "kept_eligible")


def observe_marked(marked: DataFrame, prefixes: tuple[str, ...] = ADDED_PREFIXES) -> tuple[DataFrame, Observation]:
    """Rows of ``mark_empty_added`` that count themselves when they are written, per prefix."""

    kept = ~F.col("removed")
    eligible = F.col("is_empty") & F.col("source").isNotNull()
    n_label = lambda label: F.size(F.filter("entities", lambda e: e["label"] == label))
    sums = []
    for i, prefix in enumerate((None, "original", *prefixes)):
        mine = F.lit(True) if prefix is None else F.coalesce("source", F.lit("original")) == prefix
        conditions = (F.lit(True), kept, F.col("removed"), F.col("is_empty"), F.col("is_empty") & kept, eligible, eligible & kept)
        sums += [F.count_if(mine & c).alias(f"{i}_{name}") for name, c in zip(_FILTER_COUNTS, conditions, strict=True)]
        for label in LABELS:
            sums.append(F.coalesce(F.sum(F.when(mine, n_label(label))), F.lit(0)).alias(f"{i}_{label}_before"))
            sums.append(F.coalesce(F.sum(F.when(mine & kept, n_label(label))), F.lit(0)).alias(f"{i}_{label}_after"))
    seen = Observation()
    return marked.observe(seen, *sums), seen


def filter_report(spark: SparkSession, seen: Observation, prefixes: tuple[str, ...] = ADDED_PREFIXES) -> DataFrame:
    """The rows of ``filter_manifest`` from counters taken while the kept records were written."""

    counts = seen.get
    rows = []
    for i, prefix in enumerate((None, "original", *prefixes)):
        n = {name: counts[f"{i}_{name}"] for name in _FILTER_COUNTS}
        if prefix is not None and not n["input"]:
            continue
        entities = [counts[f"{i}_{label}_{when}"] for label in ("ORG", "NAME", "GEO") for when in ("before", "after")]
        shares = [n["input_empty"] / n["input"] if n["input"] else 0.0, n["output_empty"] / n["output"] if n["output"] else 0.0]
        rows.append((prefix, *n.values(), *entities, *shares))
    names = [f"{c}_records bigint" for c in _FILTER_COUNTS]
    names += [f"{label.lower()}_{when} bigint" for label in ("ORG", "NAME", "GEO") for when in ("before", "after")]
    return spark.createDataFrame(rows, ", ".join(["prefix string", *names, "input_empty_share double", "output_empty_share double"]))


def filter_manifest(marked: DataFrame) -> DataFrame:
    """``(prefix, counts..., shares)`` of one thinning, from ``mark_empty_added`` rows.

    One pass with grouping sets: the total row has a NULL prefix, records without an
    added prefix form the row ``original``.
    """

    kept = ~F.col("removed")
    per_source = marked.withColumn("prefix", F.coalesce("source", F.lit("original")))
    n_label = lambda label: F.size(F.filter("entities", lambda e: e["label"] == label))
    entities = [
        column
        for label in ("ORG", "NAME", "GEO")
        for column in (
            F.sum(n_label(label)).alias(f"{label.lower()}_before"),
            F.sum(F.when(kept, n_label(label)).otherwise(0)).alias(f"{label.lower()}_after"),
        )
    ]
    eligible = F.col("is_empty") & F.col("source").isNotNull()
    sums = per_source.rollup("prefix").agg(
        F.grouping("prefix").alias("total"),
        F.count("*").alias("input_records"),
        F.count_if(kept).alias("output_records"),
        F.count_if("removed").alias("removed_records"),
        F.count_if("is_empty").alias("input_empty_records"),
        F.count_if(F.col("is_empty") & kept).alias("output_empty_records"),
        F.count_if(eligible).alias("eligible_records"),
        F.count_if(eligible & kept).alias("kept_eligible_records"),
        *entities,
    )
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    return sums.withColumn(
        "input_empty_share", share("input_empty_records", "input_records")
    ).withColumn("output_empty_share", share("output_empty_records", "output_records")).drop("total")
