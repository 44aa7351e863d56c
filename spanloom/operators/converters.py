"""Outside corpora to span records.

Two sources are converted: rows with parallel arrays of surfaces and labels, and
BIOES token tables.  Both end as ``hash, text, entities``; rows that break a rule
carry an ``error`` and are quarantined by the caller instead of stopping the load.
"""

from collections import defaultdict

import pandas as pd
from ahocorasick import Automaton
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators.rows import each
from spanloom import schema as S
from spanloom.functions.arrays import let, positions, running_sum
from spanloom.functions.greedy import keep_disjoint, longest_first
from spanloom.functions.text import (
    expand_suffixes,
    mapped_label,
    occurrence_starts,
    sentence_hash,
    source_hash,
)
from spanloom.operators.ordered import BLOCK, contiguous_groups
from spanloom.operators.validate import entity_errors

SEVERAL = 8  # distinct words that are worth an automaton

# ---------------------------------------------------------------- parallel arrays


def find_occurrences(rows: DataFrame, needle: str = "surface") -> DataFrame:
    """``rows`` with ``starts``: every exact occurrence of ``needle`` in ``text``."""

    return rows.withColumn("starts", occurrence_starts(F.col("text"), F.col(needle)))


def source_array_error(text: Column, surfaces: Column, labels: Column) -> Column:
    """First rule a parallel-array row breaks, or NULL."""

    filled = lambda a: F.forall(a, lambda v: F.coalesce(v != "", F.lit(False)))
    return (
        F.when(text.isNull(), "text")
        .when(surfaces.isNull() | labels.isNull(), "arrays")
        .when(F.size(surfaces) != F.size(labels), "lengths")
        .when(~filled(surfaces), "surface")
        .when(~filled(labels), "label")
    )


def _occurrences(text: str, words: set[str]) -> dict[str, list[int]]:
    """Starts of every occurrence of each word, self-overlapping ones too, rising.

    Several words are found in one pass over the text by an automaton (goto and failure links).
    """

    found: dict[str, list[int]] = {word: [] for word in words}
    if len(words) < SEVERAL:
        for word, starts in found.items():
            at = text.find(word)
            while at >= 0:
                starts.append(at)
                at = text.find(word, at + 1)
        return found
    automaton = Automaton()
    for word in words:
        automaton.add_word(word, word)
    automaton.make_automaton()
    for end, word in automaton.iter(text):
        found[word].append(end - len(word) + 1)
    return found


def _place(text: str, surfaces: list[str]) -> list[int | None]:
    """Start for each surface, long ones first, on free characters while there are any.

    Covered characters never become free again, so each distinct surface keeps one
    cursor for free places and one for occupied ones, and neither ever moves back.
    """

    occurrences = _occurrences(text, {word for word in surfaces if word})
    covered = bytearray(len(text))
    used: dict[str, set[int]] = defaultdict(set)
    free_from: dict[str, int] = defaultdict(int)
    any_from: dict[str, int] = defaultdict(int)
    starts: list[int | None] = [None] * len(surfaces)
    for i in sorted(range(len(surfaces)), key=lambda k: -len(surfaces[k])):
        word = surfaces[i]
        size, places = len(word), occurrences.get(word, [])
        n = free_from[word]
        while n < len(places) and covered.find(1, places[n], places[n] + size) >= 0:
            n += 1
        free_from[word] = n
        if n == len(places):
            n = any_from[word]
            while n < len(places) and places[n] in used[word]:
                n += 1
            any_from[word] = n
        if n < len(places):
            at = places[n]
            used[word].add(at)
            covered[at : at + size] = b"\x01" * size
            starts[i] = at
    return starts


def _placed_batch(texts: pd.Series, surfaces: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if text is None or words is None else _place(text, list(words))
            for text, words in zip(texts, surfaces)
        ],
        dtype=object,
    )


# declared non-deterministic so that the optimizer never evaluates it twice
_placed = F.pandas_udf(_placed_batch, T.ArrayType(T.LongType())).asNondeterministic()


def assign_occurrences(rows: DataFrame) -> DataFrame:
    """``rows`` of ``(text, surfaces)`` with ``starts`` aligned to ``surfaces``.

    A NULL start means that no unused occurrence was left for that surface.
    """

    # mentioning the array twice keeps the optimizer from moving the expression that
    # computes it into the arguments of the Python function
    surfaces = F.when(F.col("surfaces").isNotNull(), F.col("surfaces"))
    return rows.withColumn("starts", _placed(F.col("text"), surfaces))


def convert_arrays(rows: DataFrame) -> DataFrame:
    """``(id, text, surfaces, labels)`` rows to records; a reader's ``error`` stays.

    Output: ``ord, hash, text, entities, source_labels, dropped_overlaps, error``.  All
    of it happens in the row, so conversion never shuffles.
    """

    text = F.col("text")
    bad = source_array_error(text, F.col("surfaces"), F.col("labels"))
    checked = rows.withColumn("error", F.coalesce("error", bad) if "error" in rows.columns else bad)
    ready = F.col("error").isNull()
    placed = checked.withColumn(
        "starts", _placed(F.when(ready, text), F.when(ready, F.col("surfaces")))
    ).withColumn(
        "error",
        F.coalesce("error", F.when(F.exists("starts", lambda s: s.isNull()), "occurrence")),
    )
    labelled = let(
        F.struct("labels", "starts"),
        lambda c: F.transform(
            F.col("surfaces"),
            lambda word, i: F.struct(
                F.upper(F.get(c["labels"], i)).alias("label"),
                F.get(c["starts"], i).alias("start"),
                (F.get(c["starts"], i) + F.length(word)).cast("bigint").alias("end"),
            ),
        ),
    )
    widened = placed.withColumn("labelled", labelled).withColumn(
        "spans", F.when(F.col("error").isNull(), expand_suffixes(text, F.col("labelled")))
    )
    mapped = F.filter(
        F.transform(
            F.col("spans"),
            lambda e, i: F.struct(
                mapped_label(e["label"], S.ARRAY_LABELS).alias("label"),
                e["start"].alias("start"),
                e["end"].alias("end"),
            ),
        ),
        lambda e: e["label"].isNotNull(),
    )
    kept = widened.withColumn("mapped", mapped).withColumn(
        "entities",
        F.transform(
            keep_disjoint(F.col("mapped"), longest_first),
            lambda e: F.struct(
                e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end")
            ),
        ),
    )
    broken = F.size(entity_errors(F.col("entities"), F.length(text))) > 0
    return kept.select(
        "ord",
        source_hash(F.col("id"), text, _position(rows)).alias("hash"),
        "text",
        "entities",
        F.transform("spans", lambda e: e["label"]).alias("source_labels"),
        (F.size("mapped") - F.size("entities")).cast("bigint").alias("dropped_overlaps"),
        F.coalesce("error", F.when(broken, "contract")).alias("error"),
    )


def _position(rows: DataFrame) -> Column:
    """Text that stands in for a missing id: where the row came from."""

    if "line" in rows.columns:
        return F.concat_ws(":", F.element_at(F.split("ord.file", "/"), -1), "line")
    if isinstance(rows.schema["ord"].dataType, T.StructType):
        return F.concat_ws(":", "ord.file", "ord.block", "ord.seq")
    return F.col("ord").cast("string")


def label_counts(labels: DataFrame, table: dict[str, str]) -> DataFrame:
    """``(source_label, target_label, n)`` of a table of source labels; unmapped keep NULL."""

    return labels.groupBy("source_label").agg(F.count("*").alias("n")).select(
        "source_label", mapped_label(F.col("source_label"), table).alias("target_label"), "n"
    )


# ------------------------------------------------------------------- token tables


def sentence_groups(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Token rows ``(sheet, row_no, sentence_id, ...)`` with ``run_start`` and ``run_no``."""

    return contiguous_groups(rows, "sheet", "row_no", "sentence_id", block)


def max_sentences(grouped: DataFrame, n: int) -> DataFrame:
    """The first ``n`` sentences of each sheet."""

    return grouped.filter(F.col("run_no") <= n)


def parse_tag(tag: Column) -> Column:
    """``struct<prefix,label>`` of a BIOES tag, NULL for an unsupported one."""

    def parse(clean: Column, prefix: Column, label: Column) -> Column:
        kept = F.regexp_replace(label, r"[^\p{L}\p{N}]", "")
        outside = F.struct(F.lit("O").alias("prefix"), F.lit(None).cast("string").alias("label"))
        return F.when(clean == "O", outside).when(
            prefix.isin("B", "I", "O", "E", "S") & (label != ""),
            F.struct(prefix.alias("prefix"), kept.alias("label")),
        )

    def split(clean: Column) -> Column:
        return let(
            F.substring_index(clean, "-", 1),
            lambda prefix: let(
                F.substring(clean, F.length(prefix) + 2, F.length(clean)),
                lambda label: parse(clean, prefix, label),
            ),
        )

    return let(F.replace(F.upper(tag), F.lit("_"), F.lit("-")), split)


def detokenize(grouped: DataFrame) -> DataFrame:
    """One row per sentence: ``sheet, run_no, sentence_id, text, tokens``.

    ``tokens`` is ``array<struct<row_no,word,tag,start,end>>`` in row order.
    """

    sentences = grouped.groupBy("sheet", "run_start").agg(
        F.min("run_no").alias("run_no"),
        F.min("sentence_id").alias("sentence_id"),
        F.sort_array(F.collect_list(F.struct("row_no", "word", "tag"))).alias("rows"),
    )
    tight_before = F.lit(S.NO_SPACE_BEFORE)
    tight_after = F.lit(S.NO_SPACE_AFTER)

    def separator(rows: Column, i: Column) -> Column:
        here = F.substring(F.get(rows, i)["word"], 1, 1)
        last = F.right(F.get(rows, i - 1)["word"], F.lit(1))
        joined = (i == 0) | F.contains(tight_before, here) | F.contains(tight_after, last)
        return F.when(joined, "").otherwise(" ")

    spaced = let(
        F.col("rows"),
        lambda rows: F.transform(
            rows,
            lambda r, i: F.struct(
                separator(rows, i).alias("sep"),
                r["row_no"].alias("row_no"),
                r["word"].alias("word"),
                r["tag"].alias("tag"),
            ),
        ),
    )
    with_spans = let(
        spaced,
        lambda items: F.struct(
            F.array_join(F.transform(items, lambda t: F.concat(t["sep"], t["word"])), "").alias("text"),
            let(
                running_sum(F.transform(items, lambda t: F.length(t["sep"]) + F.length(t["word"]))),
                lambda ends: F.transform(
                    items,
                    lambda t, i: F.struct(
                        t["row_no"].alias("row_no"),
                        t["word"].alias("word"),
                        t["tag"].alias("tag"),
                        (F.get(ends, i) - F.length(t["word"])).alias("start"),
                        F.get(ends, i).alias("end"),
                    ),
                ),
            ).alias("tokens"),
        ),
    )
    return sentences.select("sheet", "run_no", "sentence_id", with_spans.alias("s")).select(
        "sheet", "run_no", "sentence_id", "s.text", "s.tokens"
    )


def bioes_states(tokens: Column) -> Column:
    """Parsed tags with what each token does to the entity being built.

    ``array<struct<prefix,label,malformed,breaks>>``: ``breaks`` marks a token that does
    not continue the entity of the token before it.
    """

    parsed = F.transform(tokens, lambda t: parse_tag(t["tag"]))

    def state(tags: Column, t: Column, i: Column) -> Column:
        before = F.get(tags, i - 1)
        inside = t["prefix"].isin("I", "E")
        opened = F.when(i > 0, F.coalesce(before["prefix"].isin("B", "I"), F.lit(False))).otherwise(
            F.lit(False)
        )
        same = before["label"] == t["label"]
        malformed = (
            F.when(inside & ~opened & (t["prefix"] == "I"), "malformed_i_without_b")
            .when(inside & ~opened, "malformed_e_without_b")
            .when(inside & ~same, "malformed_label_transition")
        )
        return F.struct(
            t["prefix"].alias("prefix"),
            t["label"].alias("label"),
            malformed.alias("malformed"),
            (~inside | malformed.isNotNull()).alias("breaks"),
        )

    return let(
        parsed,
        lambda tags: F.transform(tags, lambda t, i: state(tags, t, i)),
    )


def bioes_entities(tokens: Column, states: Column) -> Column:
    """Source entities ``array<struct<label,start,end>>`` of one sentence."""

    def build(toks: Column, sts: Column, cuts: Column) -> Column:
        pieces = F.transform(
            cuts,
            lambda first, k: F.struct(
                F.get(sts, first)["prefix"].alias("prefix"),
                F.get(sts, first)["label"].alias("label"),
                F.get(toks, first)["start"].alias("start"),
                F.get(toks, F.coalesce(F.get(cuts, k + 1), F.size(toks)) - 1)["end"].alias("end"),
            ),
        )
        return F.transform(
            F.filter(pieces, lambda p: p["prefix"] != "O"),
            lambda p: F.struct(
                p["label"].alias("label"), p["start"].alias("start"), p["end"].alias("end")
            ),
        )

    return let(
        tokens,
        lambda toks: let(
            states,
            lambda sts: let(positions(sts, lambda s: s["breaks"]), lambda cuts: build(toks, sts, cuts)),
        ),
    )


def decode_bioes(sentences: DataFrame) -> DataFrame:
    """``detokenize`` rows with ``states`` and source ``spans``; a bad tag sets ``error``."""

    unsupported = F.exists("tokens", lambda t: parse_tag(t["tag"]).isNull())
    return (
        sentences.withColumn("error", F.when(unsupported, "tag"))
        .withColumn("states", bioes_states(F.col("tokens")))
        .withColumn(
            "spans",
            F.when(F.col("error").isNull(), bioes_entities(F.col("tokens"), F.col("states"))),
        )
    )


def convert_sentences(decoded: DataFrame) -> DataFrame:
    """Decoded sentences to records ``(sheet, run_no, hash, text, entities, error)``."""

    mapped = F.filter(
        F.transform(
            F.col("spans"),
            lambda e: F.struct(
                mapped_label(e["label"], S.TOKEN_LABELS).alias("label"),
                e["start"].alias("start"),
                e["end"].alias("end"),
            ),
        ),
        lambda e: e["label"].isNotNull(),
    )
    converted = decoded.withColumn("entities", mapped)
    broken = F.size(entity_errors(F.col("entities"), F.length("text"))) > 0
    return converted.select(
        "sheet",
        "run_no",
        sentence_hash(F.col("sheet"), F.col("sentence_id"), F.col("text")).alias("hash"),
        "text",
        "entities",
        F.coalesce("error", F.when(broken, "contract")).alias("error"),
    )


def tag_quality_counts(decoded: DataFrame) -> DataFrame:
    """``(metric, key, value)``: source and dropped entities, malformed tags, sentences."""

    label = lambda e: e["label"]
    events = F.flatten(
        F.array(
            F.transform(
                "spans",
                lambda e: F.struct(F.lit("source_entities").alias("metric"), label(e).alias("key")),
            ),
            F.transform(
                F.filter("spans", lambda e: mapped_label(e["label"], S.TOKEN_LABELS).isNull()),
                lambda e: F.struct(
                    F.lit("dropped_source_entities").alias("metric"), label(e).alias("key")
                ),
            ),
            F.transform(
                F.filter("states", lambda s: s["malformed"].isNotNull()),
                lambda s: F.struct(s["malformed"].alias("metric"), F.lit("").alias("key")),
            ),
            F.array(F.struct(F.lit("sentences").alias("metric"), F.col("sheet").alias("key"))),
        )
    )
    rows = each(decoded.filter("error is null"), [], events)
    return rows.groupBy("metric", "key").agg(F.count("*").alias("value"))
