"""JSON Lines records and predictions, read strictly.

The file is scanned as text and each line is parsed to a VARIANT, because the JSON data
source silently skips blank lines and turns numbers into strings.  Everything about one
line is decided in the row; only the uniqueness of ``hash`` needs a shuffle.

``ord`` is ``struct<file,block,seq>``: file path, start of the split, place in the
split.  It orders lines without a counting pass over the data.  What must not depend on how files are
split (an identifier) uses the line number of ``numbered_lines``.
"""

from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.arrays import let
from spanloom.operators.materialize import materialize
from spanloom.operators.validate import canonical_array, duplicate_hash, entity_errors
from spanloom.schema import ENTITIES

BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(ord, value)`` for every line below ``path``.

    Spark's line reader drops a byte order mark at the start of a file, and only there.
    """

    return spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("ord"),
        "value",
    )


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``(ord, value)`` of the first ``n`` lines in file order; later files are not opened.

    Files are taken in order, twice as many each time, until they hold ``n`` lines.  Of each split
    at most as many lines as are still missing are passed on, and a task with a split of its own stops
    reading there.  The driver sees file names and one count per round.
    """

    files = sorted(spark.read.text(path).inputFiles())
    found, missing, step = None, n, 1
    while files and missing > 0:
        some, files, step = files[:step], files[step:], 2 * step
        lines = read_lines(spark, [unquote(f) for f in some])
        kind = lines.schema["ord"].dataType.simpleString()
        part = materialize(lines.mapInArrow(_heads(missing, len(some) == 1), f"ord {kind}, value string"))
        found = part if found is None else found.unionByName(part)
        missing -= part.count()
    if found is None:
        return read_lines(spark, path).limit(0)
    return found.orderBy("ord").limit(n)


def _heads(n: int, alone: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first ``n`` rows of each split; with ``alone`` a task has one split and stops after them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            order = batch.column("ord")
            splits = list(zip(order.field("file").to_pylist(), order.field("block").to_pylist(), strict=True))
            start = 0
            for at in range(1, len(splits) + 1):  # the rows of a split follow each other
                if at < len(splits) and splits[at] == splits[start]:
                    continue
                room = n - seen.get(splits[start], 0)
                if room > 0:
                    yield batch.slice(start, min(room, at - start))
                seen[splits[start]] = n - room + at - start
                start = at
            if alone and splits and seen[splits[-1]] >= n:
                return

    return run


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, line, value)`` with the number of the line in its file, from 1.

    Lines are counted per split, and the counts of a file summed: one row per split comes
    together, never one per line.
    """

    lines = read_lines(spark, path)
    splits = lines.groupBy(F.col("ord.file").alias("file"), F.col("ord.block").alias("block")).agg(
        F.min("ord.seq").alias("first"), F.count("*").alias("n")
    )
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = lines.join(starts, (F.col("ord.file") == F.col("file")) & (F.col("ord.block") == F.col("block")))
    line = F.col("before") + F.col("ord.seq") - F.col("first") + 1
    return placed.select("ord", line.alias("line"), "value")


def _kind(variant: Column, path: str) -> Column:
    """JSON type at a path: STRING, BIGINT, BOOLEAN, ... or NULL when absent."""

    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def _entity(item: Column) -> Column:
    """A typed entity; a label or offset of another JSON type becomes NULL."""

    typed = lambda name, kind, target: F.when(
        _kind(item, f"$.{name}") == kind, F.try_variant_get(item, f"$.{name}", target)
    )
    return F.struct(
        typed("label", "STRING", "string").alias("label"),
        typed("start", "BIGINT", "bigint").alias("start"),
        typed("end", "BIGINT", "bigint").alias("end"),
    )


def parse_records(
    lines: DataFrame,
    mode: str = "contract",
    require_text: bool = True,
    require_entities: bool = True,
    require_hash: bool = True,
    extra: bool = False,
) -> DataFrame:
    """``(ord, value, hash, text, entities, error)``; ``error`` is the first broken rule.

    With ``extra`` there is also ``extra``, the JSON object of all other fields (NULL without any).

    Without a text (predictions) the offsets are only checked against each other; the
    bounds follow when the prediction meets its gold record.
    """

    v = F.col("v")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    hash_kind, text_kind, list_kind = (_kind(v, f"$.{n}") for n in ("hash", "text", "entities"))
    is_list = F.coalesce(F.startswith(list_kind, F.lit("ARRAY")), F.lit(False))
    items = F.try_variant_get(v, "$.entities", "array<variant>")
    fields = parsed.select(
        "ord",
        "value",
        F.schema_of_variant(v).alias("kind"),
        F.when(hash_kind == "STRING", F.try_variant_get(v, "$.hash", "string")).alias("hash"),
        F.when(text_kind == "STRING", F.try_variant_get(v, "$.text", "string")).alias("text"),
        text_kind.alias("text_kind"),
        F.when(is_list, F.transform(items, _entity)).cast(ENTITIES).alias("entities"),
        *([_other_fields(v).alias("extra")] if extra else []),
    )
    blank = F.col("value").rlike(BLANK)
    no_hash = F.coalesce(F.col("hash") == "", F.lit(True))
    no_text = F.col("text").isNull()
    whole = (
        F.when(blank, "blank")
        .when(F.col("kind").isNull(), "json")
        .when(~F.startswith("kind", F.lit("OBJECT")), "object")
        .when(no_hash & F.lit(require_hash), "hash")
        .when(no_text & (F.lit(require_text) | F.col("text_kind").isNotNull()), "text")
    )
    if require_entities:
        length = F.coalesce(F.length("text").cast("bigint"), F.lit(2**62))
        first = let(
            entity_errors(F.col("entities"), length, mode),
            lambda found: F.when(F.size(found) > 0, F.array_min(found)["error"]),
        )
        whole = whole.when(F.col("entities").isNull(), "entities").otherwise(first)
    more = ["extra"] if extra else []
    return fields.withColumn("error", whole).select("ord", "value", "hash", "text", "entities", *more, "error")


def _other_fields(variant: Column) -> Column:
    """JSON text of the fields that are not part of a record, or NULL."""

    fields = F.try_variant_get(variant, "$", "map<string,variant>")
    others = F.map_filter(fields, lambda k, _: ~k.isin("hash", "text", "entities"))
    return F.when(F.size(others) > 0, F.to_json(others))


def duplicates(parsed: DataFrame) -> DataFrame:
    """``(ord, error)`` of otherwise good rows repeating an earlier hash."""

    good = parsed.filter("error is null").select("ord", "hash")
    return duplicate_hash(good).select("ord", F.lit("duplicate_hash").alias("error"))


def violations(parsed: DataFrame, unique: bool = True) -> DataFrame:
    """``(ord, error)`` of every rejected line."""

    broken = parsed.filter("error is not null").select("ord", "error")
    return broken.unionByName(duplicates(parsed)) if unique else broken


def quarantine(parsed: DataFrame) -> DataFrame:
    """The rejected lines with their text, for a side table."""

    return parsed.select("ord", "value").join(violations(parsed), "ord")


def _census(parsed: DataFrame, unique: bool) -> tuple[int, int, int]:
    """Rows, rejected rows, and the most copies of one hash, in a single narrow pass."""

    good = F.col("error").isNull()
    key = F.when(good, F.col("hash") if unique else F.lit("all"))
    sizes = parsed.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    has_key = F.col("key").isNotNull()
    rows, bad, copies = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum(F.when(~has_key, F.col("n"))), F.lit(0)),
        F.coalesce(F.max(F.when(has_key, F.col("n"))), F.lit(0)),
    ).first()
    return rows, bad, copies if unique else 1


def checked(parsed: DataFrame, strict: bool = True, unique: bool = True, kind: str = "records", empty: bool = False) -> DataFrame:
    """The good rows.  Strict mode fails on the first violation in file order, ``empty`` allows none.

    The lines are parsed once: what was parsed is written to the shared folder, and the
    checks and all later readers read it from there.
    """

    parsed = materialize(parsed.drop("value"))
    rows, bad, copies = _census(parsed, unique)
    if strict and (bad or copies > 1):
        first = violations(parsed, unique).orderBy("ord").first()
        raise ValueError(f"{first['ord']['file']}: {first['error']} at {tuple(first['ord'])[1:]}")
    if rows == bad and not empty:
        raise ValueError(f"no {kind}")
    good = parsed.filter("error is null") if bad else parsed
    if copies > 1:
        good = good.join(duplicates(parsed).select("ord"), "ord", "left_anti")
    return good.drop("error")


def read_records(
    spark: SparkSession,
    path: str,
    *,
    require_entities: bool = True,
    mode: str = "contract",
    strict: bool = True,
    extra: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """``(ord, hash, text[, entities][, extra])`` from JSON Lines.

    ``extra`` keeps the fields that are not part of a record, as ``write_jsonl`` writes them back.
    With ``limit`` reading stops after that many records: what follows is neither read nor
    checked.  Lenient reading goes on past rejected lines until it has as many good ones.
    """

    # inspection accepts repeated and missing hashes
    inspecting = mode == "inspect"
    rules = {"require_entities": require_entities, "require_hash": not inspecting, "extra": extra}
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    if limit is None:
        good = checked(parse_records(read_lines(spark, path), mode, **rules), strict, unique=not inspecting)
    else:
        wanted, last = limit, False
        while True:
            lines = materialize(first_lines(spark, path, wanted))
            last = strict or lines.count() < wanted
            good = checked(parse_records(lines, mode, **rules), strict, unique=not inspecting, empty=not last)
            if last or good.count() >= limit:
                break
            wanted *= 2
        good = good if strict else good.orderBy("ord").limit(limit)
    if not require_entities:
        return good.drop("entities")
    return good.withColumn("entities", canonical_array(F.col("entities")))


def read_predictions(
    spark: SparkSession, path: str, *, mode: str = "score", strict: bool = True
) -> DataFrame:
    """``(ord, hash, text, entities)``; the text is optional."""

    parsed = parse_records(read_lines(spark, path), mode, require_text=False)
    return checked(parsed, strict, kind="prediction records")


def read_limit(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records in file order of a table that has been read; a reader's own limit is ``read_records(limit=n)``."""

    return records.orderBy("ord").limit(n)


def read_source_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Parallel-array rows ``(ord, line, id, text, surfaces, labels, error)`` from JSON Lines.

    ``error`` marks a blank line and one that is no object; rules about the arrays are
    checked by the converter.  An id of any JSON type is kept as written.
    """

    v = F.try_parse_json("value")
    lines = numbered_lines(spark, path).withColumn("v", v)
    text_list = lambda name: F.when(
        F.startswith(_kind(F.col("v"), f"$.{name}"), F.lit("ARRAY")),
        F.transform(
            F.try_variant_get("v", f"$.{name}", "array<variant>"),
            lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")),
        ),
    )
    bad = F.when(F.col("value").rlike(BLANK), "blank").when(
        ~F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)), "object"
    )
    return lines.select(
        "ord",
        "line",
        F.try_variant_get("v", "$.id", "string").alias("id"),
        F.when(_kind(F.col("v"), "$.text") == "STRING", F.try_variant_get("v", "$.text", "string")).alias("text"),
        text_list("entities").alias("surfaces"),
        text_list("entity_type").alias("labels"),
        bad.alias("error"),
    )
