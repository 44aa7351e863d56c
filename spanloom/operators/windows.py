"""Overlapping token windows, label alignment and span targets.

Tokens and entities of a record are matched once per record through per-character
indexes (linear), then sliced into windows.  Nothing here shuffles except the check
that every gold entity is represented.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.rows import each
from spanloom.functions.arrays import index_by_end, index_by_start, indexes, let
from spanloom.functions.text import space_tokens
from spanloom.schema import LABELS, TAGS

IGNORED = -100


def tokenize_offsets(records: DataFrame) -> DataFrame:
    """Records with ``tokens``: ``array<struct<pos,tok,start,end>>`` split on spaces."""

    return records.withColumn("tokens", space_tokens(F.col("text")))


def window_count(n_tokens: Column, content: int, stride: int) -> Column:
    """How many windows of ``content`` tokens sharing ``stride`` cover a text."""

    step = content - stride
    return F.when(n_tokens <= content, F.lit(1)).otherwise(
        F.lit(1) + F.ceil((n_tokens - content) / step).cast("int")
    )


def is_special(token: Column) -> Column:
    """Special tokens cover no characters."""

    return token["start"] == token["end"]


def tag_id(tag: Column) -> Column:
    """Index of a tag in the tag set."""

    return F.array_position(F.lit(list(TAGS)), tag) - 1


def bio_tags(tokens: Column, entities: Column) -> Column:
    """A tag id per token; entities are sorted and do not overlap."""

    def tag(spans: Column, by_end: Column, t: Column) -> Column:
        span = F.get(spans, F.get(by_end, t["start"].cast("int")))
        inside = span.isNotNull() & (span["start"] < t["end"])
        name = F.concat(
            F.when(span["start"] >= t["start"], "B-").otherwise("I-"), span["label"]
        )
        return F.when(is_special(t), F.lit(IGNORED)).otherwise(
            F.when(inside, tag_id(name)).otherwise(0)
        ).cast("bigint")

    return let(
        entities,
        lambda spans: let(
            index_by_end(spans),
            lambda by_end: F.transform(tokens, lambda t: tag(spans, by_end, t)),
        ),
    )


def align_bio(records: DataFrame) -> DataFrame:
    """``tokens`` of each record get a ``tag`` field (``-100`` on special tokens)."""

    tags = bio_tags(F.col("tokens"), F.col("entities"))
    tagged = let(
        tags,
        lambda ts: F.transform("tokens", lambda t, i: t.withField("tag", F.get(ts, i))),
    )
    return records.withColumn("tokens", tagged)


def entity_token_spans(tokens: Column, entities: Column, length: Column) -> Column:
    """Entities with ``first`` and ``last``: the tokens they touch, NULL if none.

    Tokens have non-decreasing starts and ends.
    """

    def locate(toks: Column, by_end: Column, by_start: Column, e: Column) -> Column:
        first = F.get(by_end, e["start"].cast("int"))
        last = F.get(by_start, (e["end"] - 1).cast("int"))
        touches = first <= last
        return F.struct(
            e["label"].alias("label"),
            e["start"].alias("start"),
            e["end"].alias("end"),
            F.when(touches, first).alias("first"),
            F.when(touches, last).alias("last"),
        )

    return let(
        tokens,
        lambda toks: let(
            index_by_end(toks),
            lambda ends: let(
                index_by_start(toks, length),
                lambda starts: F.transform(entities, lambda e: locate(toks, ends, starts, e)),
            ),
        ),
    )


def window_array(tokens: Column, special: Column, content: int, stride: int) -> Column:
    """``array<struct<window_id,first_token,tokens>>``; special tokens wrap the content."""

    step = content - stride

    def build(toks: Column) -> Column:
        edge = F.array(special)
        return F.transform(
            indexes(window_count(F.size(toks), content, stride)),
            lambda w: F.struct(
                w.cast("bigint").alias("window_id"),
                (w * step).cast("bigint").alias("first_token"),
                F.concat(edge, F.slice(toks, w * step + 1, F.lit(content)), edge).alias("tokens"),
            ),
        )

    return let(tokens, build)


def token_windows(
    records: DataFrame, max_length: int, stride: int
) -> DataFrame:
    """One row per window: ``hash, window_id, first_token, tokens, entities``.

    A window is wrapped by two special tokens.  ``tokens`` holds what the record's tokens hold.  ``entities`` are those touching the
    window, with the record-wide token range they cover.
    """

    content = max_length - 2
    if not 0 <= stride < content:
        raise ValueError(f"stride must be between 0 and {content - 1}")
    fields = records.schema["tokens"].dataType.elementType.fields
    special = F.struct(
        *[
            (F.lit(0) if f.name in ("start", "end") else F.lit(IGNORED) if f.name == "tag" else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in fields
        ]
    )
    windows = window_array(F.col("tokens"), special, content, stride)
    if "entities" not in records.columns:
        return each(records, ["hash"], windows)
    located = entity_token_spans(
        F.col("tokens"), F.col("entities"), F.length("text").cast("bigint")
    )
    touching = F.filter(located, lambda e: e["first"].isNotNull())

    def attach(spans: Column) -> Column:
        # entities are sorted, so those of a window form a slice; find it by token index
        ends = F.transform(spans, lambda e: F.struct((e["last"] + 1).alias("end")))
        starts = F.transform(spans, lambda e: F.struct(e["first"].alias("start")))
        return let(
            index_by_end(ends),
            lambda by_last: let(
                index_by_start(starts, F.size("tokens")),
                lambda by_first: F.transform(
                    windows, lambda w: with_entities(spans, by_last, by_first, w)
                ),
            ),
        )

    def with_entities(spans: Column, by_last: Column, by_first: Column, w: Column) -> Column:
        begin = w["first_token"].cast("int")
        stop = begin + F.size(w["tokens"]) - 2
        first = F.coalesce(F.get(by_last, begin), F.size(spans))
        last = F.coalesce(F.get(by_first, stop - 1), F.lit(-1))
        return w.withField(
            "entities", F.slice(spans, first + 1, F.greatest(last - first + 1, F.lit(0)))
        )

    return each(records, ["hash"], let(touching, attach))


def _bounds(tokens: Column) -> Column:
    real = F.filter(tokens, lambda t: ~is_special(t))
    return F.struct(
        F.array_min(F.transform(real, lambda t: t["start"])).alias("start"),
        F.array_max(F.transform(real, lambda t: t["end"])).alias("end"),
    )


def window_bounds(windows: DataFrame) -> DataFrame:
    """Windows with ``window_start`` / ``window_end``, NULL without real tokens."""

    return windows.withColumn("bounds", _bounds(F.col("tokens"))).select(
        *windows.columns,
        F.col("bounds.start").alias("window_start"),
        F.col("bounds.end").alias("window_end"),
    )


def partition_entities(bounded: DataFrame) -> DataFrame:
    """``window_bounds`` rows with ``complete`` and ``partial`` entity arrays."""

    def contained(b: Column, e: Column) -> Column:
        return (b["start"] <= e["start"]) & (e["end"] <= b["end"])

    def cut(b: Column, e: Column) -> Column:
        return ~contained(b, e) & (e["start"] < b["end"]) & (e["end"] > b["start"])

    bounds = F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end"))
    return bounded.withColumn(
        "complete", let(bounds, lambda b: F.filter("entities", lambda e: contained(b, e)))
    ).withColumn("partial", let(bounds, lambda b: F.filter("entities", lambda e: cut(b, e))))


def span_mask(parted: DataFrame) -> DataFrame:
    """Rows with ``mask``: a token is usable unless special or in a partial entity.

    Entities do not overlap, so at most two are cut by a window.
    """

    def free(partial: Column, t: Column) -> Column:
        return ~is_special(t) & ~F.exists(
            partial, lambda e: (t["start"] < e["end"]) & (t["end"] > e["start"])
        )

    mask = let(F.col("partial"), lambda cut: F.transform("tokens", lambda t: free(cut, t)))
    return parted.withColumn("mask", mask)


def entity_token_span(parted: DataFrame) -> DataFrame:
    """``(hash, window_id, label, start, end, token_start, token_end, exact)`` rows.

    Token indexes count inside the window (0 is the leading special token).  ``exact``
    tells whether the outer token boundaries coincide with the entity's.
    """

    def locate(toks: Column, e: Column) -> Column:
        first = F.greatest(e["first"] - F.col("first_token"), F.lit(0)) + 1
        last = F.least(e["last"] - F.col("first_token") + 1, F.size(toks) - 2)
        exact = (F.get(toks, first.cast("int"))["start"] == e["start"]) & (
            F.get(toks, last.cast("int"))["end"] == e["end"]
        )
        return F.struct(
            e["label"].alias("label"),
            e["start"].alias("start"),
            e["end"].alias("end"),
            first.cast("bigint").alias("token_start"),
            last.cast("bigint").alias("token_end"),
            exact.alias("exact"),
        )

    spans = let(
        F.col("tokens"), lambda toks: F.transform("complete", lambda e: locate(toks, e))
    )
    return each(parted, ["hash", "window_id"], spans)


def span_targets(parted: DataFrame, strict: bool = False) -> DataFrame:
    """Sparse targets ``(hash, window_id, label_id, token_start, token_end)`` with keys.

    Strict mode fails on an entity whose boundaries are not token boundaries.
    """

    spans = entity_token_span(parted)
    if strict:
        spans = spans.withColumn(
            "exact",
            F.when(F.col("exact"), True).otherwise(
                F.raise_error(F.lit("gold span is not exactly representable by tokens")).cast("boolean")
            ),
        ).filter("exact")
    label_id = F.array_position(F.lit(list(LABELS)), F.col("label")) - 1
    return spans.select(
        "hash", "window_id", label_id.alias("label_id"), "token_start", "token_end",
        "label", "start", "end",
    )


def usable(masked: DataFrame) -> DataFrame:
    """Windows with at least one usable token."""

    return masked.filter(F.exists("mask", lambda m: m))


def coverage_check(spans: DataFrame, targets: DataFrame) -> DataFrame:
    """Gold spans that no usable window represents completely."""

    keys = ["hash", "label", "start", "end"]
    return spans.select(*keys).join(targets.select(*keys), keys, "left_anti")


def trainable_windows(masked: DataFrame) -> DataFrame:
    """``(windows, trainable, with_partial)`` over the dataset."""

    return masked.agg(
        F.count("*").alias("windows"),
        F.count_if(F.exists("mask", lambda m: m)).alias("trainable"),
        F.count_if(F.size("partial") > 0).alias("with_partial"),
    )
