"""Span views derived from the driver tables, and the same views as SQL text.

The tables hold texts but no spans, so spans are derived from the tokens by digest:
one digest of the token decides the gold tag, a second one where the prediction
deviates.  Both engines derive them from whole tables with the same expressions.
"""

import sys
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spanloom.operators.rows import each
from spanloom.functions.arrays import let
from spanloom.functions.runs import runs, tagged_runs
from spanloom.functions.text import space_tokens, with_surfaces
from spanloom.operators.augment import unit
from spanloom.operators.windows import token_windows
from spanloom.schema import ENTITIES

# the taggers travel to the Python workers by value, as the library's functions do
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = 4 * 1024 * 1024  # bytes of a table's files that one task works on


def file_bytes(df: DataFrame) -> int:
    """Size of the files a table is read from; their contents are not opened."""

    files = df.inputFiles()
    if not files:
        return 0
    lengths = df.sparkSession.read.format("binaryFile").load(files).select("length")
    return lengths.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table out by its key; one file of the driver tables is one split.

    Rows grow many times when they are cut into tokens, spans or scores, and later steps keep this
    dealing, so the number of parts follows the size of the files and a part never outgrows a task.
    """

    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-file_bytes(df) // SPLIT))
    return df.repartition(parts, key)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """``ord, hash, text`` of ``documents``."""

    raw = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("hash"),
        "text",
    )
    return spread(raw, "hash")


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ord"), F.concat(F.lit("b-"), F.col("item_id")).alias("hash"), "text"
    )


def tokenized(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", space_tokens(F.col("text")))


def hex_digit(*parts: Column) -> Column:
    """First hex digit of the MD5 of the parts joined by ``|``."""

    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 1)


def hex_number(*parts: Column) -> Column:
    """First two hex digits as a number 0..255."""

    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 2), 16, 10).cast(
        "bigint"
    )


def digest_digits(values: pa.Array) -> np.ndarray:
    """``hex_digit`` of joined texts, as numbers, in a Python worker."""

    return digest_bytes(values) >> 4


def digest_bytes(values: pa.Array) -> np.ndarray:
    """``hex_number`` of joined texts, in a Python worker."""

    raw = values.cast(pa.binary()).to_pylist()
    return np.fromiter((md5(v, usedforsecurity=False).digest()[0] for v in raw), np.uint8, len(raw))


GOLD_TAGS = np.array([1, 1, 2, 2, 3] + [0] * 11, np.uint8)  # of the digit of a word


def word_digits(words: pa.Array) -> np.ndarray:
    """The digit of each word; a word that returns is digested once."""

    coded = words.dictionary_encode()
    return digest_digits(pc.binary_join_element_wise(coded.dictionary, "g", "|"))[coded.indices.to_numpy()]


def gold_tags(words: pa.Array, row: np.ndarray, pos: np.ndarray, more: Sequence[pa.Array]) -> np.ndarray:
    return GOLD_TAGS[word_digits(words)]


def pred_tags(words: pa.Array, row: np.ndarray, pos: np.ndarray, more: Sequence[pa.Array]) -> np.ndarray:
    """Gold tags but where a second digest, of word, document and place, deviates."""

    a = word_digits(words)
    tags = GOLD_TAGS[a]
    near = np.flatnonzero(a < 6)  # all other words are outside whatever the second digit is
    at = pa.array(row[near])
    first, *rest = [m.take(at).cast(pa.string()) for m in more]
    places = pa.array(pos[near]).cast(pa.string())
    b = digest_digits(pc.binary_join_element_wise(words.take(pa.array(near)), first, places, *rest, "|", null_handling="skip"))
    own = a[near]
    put = np.where((own == 2) | (own == 3), np.where(b == 1, 1, 2), np.where((own == 5) & (b == 2), 3, tags[near]))
    tags[near] = np.where(b == 0, 0, put)
    return tags


_gold_runs = runs(("ORG", "NAME", "GEO"), gold_tags)
gold_entities = tagged_runs(("ORG", "NAME", "GEO"), gold_tags)
_pred_entities = tagged_runs(("ORG", "NAME", "GEO"), pred_tags)


def pred_entities(text: Column, *more: Column) -> Column:
    return _pred_entities(text, F.col("ord"), *more)


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """``ord, hash, text, entities``."""

    return docs(spark, sf).select("ord", "hash", "text", gold_entities(F.col("text")).alias("entities"))


def pred(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("ord", "hash", "text", pred_entities(F.col("text")).alias("entities"))


def by_hash(records: DataFrame, *columns: str) -> DataFrame:
    """Derived records (of them ``columns``, if any are named) dealt out by hash again, for what meets a text's spans.

    The derivation is a Python step, behind which Spark no longer knows how its input was dealt.
    """

    return spread(records.select(*columns) if columns else records, "hash")


def gold_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """``gold`` with the space tokens next to the entities."""

    return tokenized(docs(spark, sf)).select(
        "ord", "hash", "text", "tokens", gold_entities(F.col("text")).alias("entities")
    )


def noisy(spark: SparkSession, sf: str) -> DataFrame:
    """Gold records whose entities were damaged by digest; repeated entities included."""

    def damage(e: Column, i: Column) -> Column:
        return let(hex_digit(F.col("hash"), i, F.lit("e")), lambda d: damaged(e, d))

    def damaged(e: Column, d: Column) -> Column:
        broken = F.struct(
            F.when(d == "0", "PER").when(d == "5", F.lit(None)).otherwise(e["label"]).alias("label"),
            F.when(d == "2", F.lit(-1)).otherwise(e["start"]).cast("bigint").alias("start"),
            F.when(d == "1", e["end"] + 100000)
            .when(d == "3", e["start"])
            .when(d == "4", e["end"] + 3)
            .otherwise(e["end"])
            .alias("end"),
        )
        return F.when(d == "6", F.array(broken, broken)).otherwise(F.array(broken))

    return gold(spark, sf).withColumn("entities", F.flatten(F.transform("entities", damage)))


def widened(texts: pa.Array, hashes: pa.Array) -> pa.Array:
    """Gold spans, most followed by a widened copy, many with another label; ``idx`` is the place of a span."""

    entities = _gold_runs(texts)
    counts = pc.fill_null(pc.list_value_length(entities), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    label, start, end = entities.flatten().flatten()
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = pc.binary_join_element_wise(hashes.take(pa.array(row)), pa.array(place).cast(pa.string()), "w", "|", null_handling="skip")
    n = digest_bytes(keys).astype(np.int64)
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, end = start.to_numpy(), end.to_numpy()
    copied = n < 200
    wide = np.repeat(np.arange(len(row)), 1 + copied)  # the span each row is of
    copy = np.zeros(len(wide), bool)
    copy[1:] = wide[1:] == wide[:-1]
    per_text = counts + np.bincount(row[copied], minlength=len(counts))
    ends = np.concatenate([[0], np.cumsum(per_text)])
    by = n[wide]
    spans = pa.StructArray.from_arrays(
        [
            pc.if_else(pa.array(copy & (by < 128)), "GEO", label.take(pa.array(wide))),
            pa.array(np.where(copy, np.maximum(start[wide] - by % 7, 0), start[wide])),
            pa.array(np.where(copy, np.minimum(end[wide] + by % 11, length[row[wide]]), end[wide])),
            pa.array(np.arange(len(wide)) - np.repeat(ends[:-1], per_text)),
        ],
        ["label", "start", "end", "idx"],
    )
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans, mask=pc.is_null(texts))


WIDENED = T.ArrayType(T.StructType([*ENTITIES.elementType.fields, T.StructField("idx", T.LongType())]))
_widened = F.arrow_udf(widened, WIDENED).asNondeterministic()


def nested(spark: SparkSession, sf: str) -> DataFrame:
    """Span table of overlapping spans: gold spans next to widened copies with other labels."""

    wide = docs(spark, sf).select("hash", _widened(F.col("text"), F.col("hash")).alias("wide"))
    return each(by_hash(wide), ["hash"], "wide")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Scored candidates: the nested spans, each distinct key with a score in 1/256 steps."""

    return (
        nested(spark, sf)
        .select("hash", "label", "start", "end")
        .distinct()
        .withColumn(
            "score",
            hex_number(F.col("hash"), F.col("label"), F.col("start"), F.col("end")) / F.lit(256.0),
        )
    )


def apostrophes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with apostrophe variants set into o/g contexts."""

    text = F.col("text")
    for found, put in APOSTROPHE_EDITS:
        text = F.replace(text, F.lit(found), F.lit(put))
    return docs(spark, sf).withColumn("text", text)


APOSTROPHE_EDITS = (
    ("gr", "g'r"),
    ("ou", "o‘u"),
    ("os", "o's"),
    ("ge", "g`e"),
    ("on", "oʼn"),
    ("gi", "g’i"),
)


def gold_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """``ord, hash, label, start, end, surface`` of gold spans."""

    listed = with_surfaces(F.col("text"), F.col("entities"))
    return each(gold(spark, sf), ["ord", "hash"], listed)


def aliases(found: DataFrame) -> DataFrame:
    """``label, alias, canonical`` for some of the ``gold_surfaces``; a few conflict."""

    d = hex_number(F.col("surface"), F.lit("alias"))
    named = found.select("label", "surface").distinct().withColumn("d", d).filter("d < 64")
    return named.select(
        F.when(F.col("d") == 0, "PER").otherwise(F.col("label")).alias("label"),
        F.col("surface").alias("alias"),
        F.when(F.col("d") == 1, "...").otherwise(F.concat(F.lit("~"), "surface", F.lit("."))).alias("canonical"),
    )


def array_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel-array source rows: ``ord, id, text, surfaces, labels``."""

    spans = with_surfaces(F.col("text"), F.col("entities"))

    def source_label(e: Column, i: Column) -> Column:
        return let(hex_digit(F.col("ord"), i, F.lit("l")), lambda d: renamed(e, d))

    def renamed(e: Column, d: Column) -> Column:
        return F.when(d == "0", "DATE").when(d == "1", "per").otherwise(
            F.when(e["label"] == "NAME", "PER").when(e["label"] == "GEO", "LOC").otherwise("ORG")
        )

    return (
        gold(spark, sf)
        .withColumn("spans", spans)
        .select(
            "ord",
            F.when(F.col("ord") % 5 > 0, F.col("ord").cast("string")).alias("id"),
            "text",
            F.transform("spans", lambda e: e["surface"]).alias("surfaces"),
            F.transform("spans", source_label).alias("labels"),
        )
    )


def token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Token table out of ``conversations``: ``sheet, row_no, sentence_id, word, tag``.

    The speaker is the sentence id, so ids return and consecutive turns of one
    speaker fuse; both sheets are one long run of rows.
    """

    raw = spread(table(spark, sf, "conversations"), "conv_id")
    words = raw.select(
        F.when(F.col("conv_id") % 2 == 0, "Dataset_1").otherwise("Dataset_2").alias("sheet"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("turn_no"),
        F.col("role").alias("sentence_id"),
        F.explode(F.filter(space_tokens(F.col("text")), lambda t: F.btrim(t["tok"], F.lit(" \n")) != "")).alias("t"),
    )
    d = hex_number(F.col("t.tok"), F.col("turn_no"), F.col("t.pos"))
    names = F.lit(["PER", "loc", "ORG", "geo_political-entity", "DATE", "person", "GPE", "Organization"])
    prefixes = F.lit(["B", "I", "E", "S", "I", "E", "O", "b"])
    tag = F.when(d < 128, "O").otherwise(
        F.concat(
            F.get(prefixes, ((d / 8).cast("int") % 8).cast("int")),
            F.lit("-"),
            F.get(names, (d % 8).cast("int")),
        )
    )
    return words.select(
        "sheet",
        (F.col("turn_no") * 100000 + F.col("t.pos")).alias("row_no"),
        "sentence_id",
        F.btrim(F.col("t.tok"), F.lit(" \n")).alias("word"),
        tag.alias("tag"),
    )


def ragged(spark: SparkSession, sf: str) -> DataFrame:
    """``gold_tokens`` with some entities starting or ending inside a token."""

    def shift(e: Column, i: Column) -> Column:
        return let(hex_digit(F.col("hash"), i, F.lit("r")), lambda d: shifted(e, d))

    def shifted(e: Column, d: Column) -> Column:
        long = e["end"] - e["start"] > 2
        return F.struct(
            e["label"].alias("label"),
            F.when(long & (d == "0"), e["start"] + 1).otherwise(e["start"]).alias("start"),
            F.when(long & (d == "1"), e["end"] - 1).otherwise(e["end"]).alias("end"),
        )

    return gold_tokens(spark, sf).withColumn("entities", F.transform("entities", shift))


MAX_LENGTH, STRIDE = 128, 32


def span_score(tok: Column, first: Column, last_index: Column) -> Column:
    """Candidate span starting at a token, from the digest of the token."""

    return let(F.md5(tok), lambda digest: _span_score(digest, first, last_index))


def _span_score(digest: Column, first: Column, last_index: Column) -> Column:
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("bigint")
    return F.struct(
        (number(1, 1) % 3).alias("label_id"),
        first.cast("bigint").alias("token_start"),
        F.least(first + number(2, 1) % 2, last_index).cast("bigint").alias("token_end"),
        (number(3, 2) / F.lit(128.0) - 1.0).alias("score"),
    )


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Plain token windows of the documents."""

    records = tokenized(docs(spark, sf)).select("hash", "tokens")
    return token_windows(records, MAX_LENGTH, STRIDE)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with the span scores the example scorer gives."""

    scores = let(
        F.col("tokens"),
        lambda ts: F.filter(
            F.transform(ts, lambda t, i: F.when(t["tok"].isNotNull(), span_score(t["tok"], i, F.size(ts) - 2))),
            lambda s: s.isNotNull(),
        ),
    )
    return windows(spark, sf).withColumn("scores", scores)


def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with seven class probabilities per token, differing from window to window."""

    def probabilities(t: Column) -> Column:
        # the first seven bytes of the digest as one number
        digest = F.md5(F.concat_ws("|", t["tok"], F.col("window_id").cast("string")))
        return let(
            F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint"),
            lambda n: F.array(*[F.shiftright(n, 48 - 8 * c).bitwiseAND(F.lit(255)) / F.lit(256.0) for c in range(7)]),
        )

    return windows(spark, sf).withColumn("scores", F.transform("tokens", probabilities))


def options(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates ``(label, surface, rank, candidate)``: the next surfaces of a digest group."""

    group = F.substring(F.md5("surface"), 1, 3)
    distinct = gold_surfaces(spark, sf).select("label", "surface").distinct().withColumn("g", group)
    order = W.partitionBy("label", "g").orderBy("surface")
    ahead = F.array(*[F.lead("surface", k).over(order) for k in (1, 2, 3)])
    rows = distinct.withColumn("ahead", ahead).select("label", "surface", F.posexplode("ahead").alias("p", "candidate"))
    return rows.filter("candidate is not null").select(
        "label", "surface", (F.col("p") + 1).cast("bigint").alias("rank"), "candidate"
    )


def unit_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """``vec_id, label, vector`` with vectors of length 1."""

    rows = spread(table(spark, sf, "embeddings"), "vec_id")
    return rows.select("vec_id", "label", unit(F.col("embedding").cast("array<double>")).alias("vector"))


# --------------------------------------------------------------------------- SQL text

_TOK = """
 docs AS (SELECT doc_id AS ord, source || '-' || doc_id AS hash, text FROM documents),
 pieces AS (
  SELECT ord, hash, unnest(string_split(text, ' ')) AS tok,
         CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS BIGINT) AS pos FROM docs),
 tok AS (
  SELECT ord, hash, pos, tok, start, start + length(tok) AS "end" FROM (
   SELECT ord, hash, pos, tok,
          CAST(sum(length(tok) + 1) OVER (PARTITION BY hash ORDER BY pos) AS BIGINT)
            - length(tok) - 1 AS start
   FROM pieces)
  WHERE tok <> '')"""

_TAGS = _TOK + """,
 digits AS (
  SELECT *, substr(md5(tok || '|g'), 1, 1) AS a, substr(md5(tok || '|' || ord || '|' || pos), 1, 1) AS b
  FROM tok),
 tags AS (
  SELECT *,
   CASE WHEN a IN ('0','1') THEN 'ORG' WHEN a IN ('2','3') THEN 'NAME' WHEN a = '4' THEN 'GEO' ELSE 'O' END AS g,
   CASE WHEN b = '0' THEN 'O' WHEN a IN ('0','1') THEN 'ORG' WHEN a IN ('2','3') AND b = '1' THEN 'ORG'
        WHEN a IN ('2','3') THEN 'NAME' WHEN a = '4' THEN 'GEO' WHEN a = '5' AND b = '2' THEN 'GEO'
        ELSE 'O' END AS p
  FROM digits)"""


def _runs(name: str, tag: str) -> str:
    return f""",
 {name} AS (
  SELECT ord, hash, label, start, "end", row_number() OVER (PARTITION BY hash ORDER BY start) - 1 AS idx FROM (
   SELECT ord, hash, {tag} AS label, min(start) AS start, max("end") AS "end" FROM (
    SELECT *, sum(flip) OVER (PARTITION BY hash ORDER BY pos) AS run FROM (
     SELECT *, CASE WHEN {tag} IS DISTINCT FROM lag({tag}) OVER (PARTITION BY hash ORDER BY pos)
       THEN 1 ELSE 0 END AS flip FROM tags))
   WHERE {tag} <> 'O' GROUP BY ord, hash, run, {tag}))"""


SQL_TOK = "WITH RECURSIVE" + _TOK
SQL_TAGS = "WITH RECURSIVE" + _TAGS
SQL_GOLD = SQL_TAGS + _runs("gold", "g")
SQL_SPANS = SQL_GOLD + _runs("pred", "p")

SQL_NOISY = SQL_GOLD + """,
 damaged AS (
  SELECT g.hash, g.idx AS gidx, length(d.text) AS len, c.k,
   CASE WHEN x = '0' THEN 'PER' WHEN x = '5' THEN NULL ELSE label END AS label,
   CASE WHEN x = '2' THEN -1 ELSE start END AS start,
   CASE WHEN x = '1' THEN "end" + 100000 WHEN x = '3' THEN start WHEN x = '4' THEN "end" + 3 ELSE "end" END AS "end"
  FROM (SELECT *, substr(md5(hash || '|' || idx || '|e'), 1, 1) AS x FROM gold) g
  JOIN docs d USING (hash) JOIN (VALUES (1), (2)) c(k) ON c.k = 1 OR x = '6'),
 noisy AS (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY gidx, k) - 1 AS idx FROM damaged)"""

SQL_NESTED = SQL_GOLD + """,
 numbered AS (
  SELECT g.*, length(d.text) AS len, ('0x' || substr(md5(g.hash || '|' || g.idx || '|w'), 1, 2))::BIGINT AS n
  FROM gold g JOIN docs d USING (hash)),
 nested AS (
  SELECT hash, label, start, "end", row_number() OVER (PARTITION BY hash ORDER BY gidx, k) - 1 AS idx FROM (
   SELECT hash, label, start, "end", idx AS gidx, 0 AS k FROM numbered
   UNION ALL
   SELECT hash, CASE WHEN n < 128 THEN 'GEO' ELSE label END, greatest(start - n % 7, 0),
          least("end" + n % 11, len), idx, 1 FROM numbered WHERE n < 200)),
 candidates AS (
  SELECT *, ('0x' || substr(md5(hash || '|' || label || '|' || start || '|' || "end"), 1, 2))::BIGINT / 256.0::DOUBLE
    AS score
  FROM (SELECT DISTINCT hash, label, start, "end" FROM nested))"""



def greedy_sql(source: str, order: str) -> str:
    """Greedy choice folded over each island of overlapping spans."""

    return f""",
 reach AS (
  SELECT *, max("end") OVER (PARTITION BY hash ORDER BY start, "end", {order}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}),
 isles AS (
  SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY hash
    ORDER BY start, "end", {order} ROWS UNBOUNDED PRECEDING) AS isle FROM reach),
 lists AS (
  SELECT hash, isle, list([{{'label': label, 's': start, 'e': "end"}}] ORDER BY {order}) AS spans
  FROM isles GROUP BY hash, isle),
 greedy AS (
  SELECT hash, unnest(list_reduce(spans, lambda kept, c:
    CASE WHEN len(list_filter(kept, lambda k: k.s < c[1].e AND c[1].s < k.e)) > 0 THEN kept
         ELSE list_concat(kept, c) END)) AS z FROM lists),
 kept AS (SELECT hash, z.label AS label, z.s AS start, z.e AS "end" FROM greedy)
""" + 'SELECT hash, label, start, "end" FROM kept'


SQL_RAGGED = SQL_GOLD + """,
 ragged AS (
  SELECT hash, label, CASE WHEN "end" - start > 2 AND x = '0' THEN start + 1 ELSE start END AS start,
         CASE WHEN "end" - start > 2 AND x = '1' THEN "end" - 1 ELSE "end" END AS "end"
  FROM (SELECT *, substr(md5(hash || '|' || idx || '|r'), 1, 1) AS x FROM gold))"""


def windows_sql(stride: int = STRIDE, max_length: int = MAX_LENGTH) -> str:
    """Windows and their tokens; ``i`` counts inside the window, 0 is the special token."""

    content = max_length - 2
    step = content - stride
    return f""",
 indexed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY pos) - 1 AS idx FROM tok),
 sizes AS (SELECT d.hash, count(t.hash) AS n FROM docs d LEFT JOIN tok t ON t.hash = d.hash GROUP BY d.hash),
 wins AS (
  SELECT hash, n, unnest(range(CASE WHEN n <= {content} THEN 1
    ELSE 1 + CAST(ceil((n - {content}) / {step}.0) AS BIGINT) END)) AS window_id FROM sizes),
 wtok AS MATERIALIZED (
  SELECT w.hash, window_id, window_id * {step} AS first_token, idx - window_id * {step} + 1 AS i, tok, start, "end",
         least({content}, n - window_id * {step}) AS size
  FROM wins w JOIN indexed t ON t.hash = w.hash AND idx >= window_id * {step} AND idx < window_id * {step} + {content}),
 wbounds AS MATERIALIZED (
  SELECT hash, window_id, min(start) AS window_start, max("end") AS window_end FROM wtok GROUP BY hash, window_id),
 wparts AS MATERIALIZED (
  SELECT e.hash, window_id, label, e.start, e."end",
   CASE WHEN window_start <= e.start AND e."end" <= window_end THEN 'complete' ELSE 'partial' END AS part
  FROM ragged e JOIN wbounds b ON b.hash = e.hash AND e.start < window_end AND e."end" > window_start),
 wmask AS (
  SELECT t.hash, t.window_id, t.i, t.start, t."end", count(p.hash) = 0 AS usable
  FROM wtok t LEFT JOIN wparts p ON p.hash = t.hash AND p.window_id = t.window_id AND p.part = 'partial'
    AND t.start < p."end" AND t."end" > p.start GROUP BY ALL),
 wspans AS (
  SELECT p.hash, p.window_id, p.label, p.start, p."end", min(i) AS token_start, max(i) AS token_end,
         min(t.start) = p.start AND max(t."end") = p."end" AS exact
  FROM wparts p JOIN wtok t ON t.hash = p.hash AND t.window_id = p.window_id AND t.start < p."end" AND t."end" > p.start
  WHERE part = 'complete' GROUP BY p.hash, p.window_id, p.label, p.start, p."end")"""


SQL_SCORED = windows_sql() + """,
 wscores AS (
  SELECT hash, window_id, ('0x' || substr(m, 1, 1))::BIGINT % 3 AS label_id, i AS token_start,
         least(i + ('0x' || substr(m, 2, 1))::BIGINT % 2, size) AS token_end,
         ('0x' || substr(m, 3, 2))::BIGINT / 128.0::DOUBLE - 1.0::DOUBLE AS score, start, "end", next_end
  FROM (SELECT *, md5(tok) AS m, lead("end") OVER (PARTITION BY hash, window_id ORDER BY i) AS next_end FROM wtok)),
 wcands AS (
  SELECT hash, window_id, (['ORG', 'NAME', 'GEO'])[label_id + 1] AS label, start,
         CASE WHEN token_end > token_start THEN next_end ELSE "end" END AS "end", score
  FROM wscores WHERE score > 0),
 merged AS (
  SELECT hash, label, start, "end", max(score) AS score FROM wcands GROUP BY hash, label, start, "end")"""

SQL_CLASSES = windows_sql() + """,
 wclass AS (
  SELECT hash, window_id, start, "end", c AS class_id,
         ('0x' || substr(md5(tok || '|' || window_id), c * 2 + 1, 2))::BIGINT / 256.0::DOUBLE AS p
  FROM wtok CROSS JOIN (SELECT unnest(range(7)) AS c)),
 means AS (SELECT hash, start, "end", class_id, avg(p) AS p FROM wclass GROUP BY hash, start, "end", class_id),
 best AS (
  SELECT hash, start, "end", (['O','B-ORG','I-ORG','B-NAME','I-NAME','B-GEO','I-GEO'])[class_id + 1] AS tag FROM (
   SELECT *, row_number() OVER (PARTITION BY hash, start, "end" ORDER BY p DESC, class_id) AS r FROM means) WHERE r = 1),
 bio AS (
  SELECT hash, label, min(start) AS start, max("end") AS "end" FROM (
   SELECT *, sum(opens) OVER (PARTITION BY hash ORDER BY start, "end") AS run FROM (
    SELECT *, CASE WHEN starts_with(tag, 'B') OR lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS opens
    FROM (SELECT *, nullif(substr(tag, 3), '') AS label FROM best)
    WINDOW w AS (PARTITION BY hash ORDER BY start, "end")))
  WHERE label IS NOT NULL GROUP BY hash, run, label)"""

SQL_SURFACES = SQL_GOLD + """,
 surfaces AS (
  SELECT g.ord, g.hash, g.idx, label, start, "end", substring(d.text, start + 1, "end" - start) AS surface
  FROM gold g JOIN docs d USING (hash))"""

# NFKC equals NFC on the alphabets of the driver tables, and lower() with the sharp s
# spelled out equals full case folding there.
SQL_CLEAN = (
    "trim(regexp_replace(translate(nfc_normalize({0}), '`´‘’ʼʻʹ', ''''''''''''''''), '[\\s\\x1c-\\x1f]+', ' ', 'g'), "
    "' ' || chr(9) || chr(13) || chr(10) || '.,;:!?()[]{{}}\"«»“”')"
)


def sql_clean(expression: str) -> str:
    return SQL_CLEAN.format(expression)


def sql_key(expression: str) -> str:
    return f"replace(lower({sql_clean(expression)}), 'ß', 'ss')"


SQL_OPTIONS = SQL_SURFACES + """,
 distinct_surfaces AS (SELECT DISTINCT label, surface, substr(md5(surface), 1, 3) AS g FROM surfaces),
 ahead AS (
  SELECT label, surface, unnest([1, 2, 3]) AS rank, unnest([lead(surface, 1) OVER w, lead(surface, 2) OVER w,
   lead(surface, 3) OVER w]) AS candidate
  FROM distinct_surfaces WINDOW w AS (PARTITION BY label, g ORDER BY surface)),
 options AS (SELECT * FROM ahead WHERE candidate IS NOT NULL),
 chosen_docs AS (
  SELECT * FROM docs WHERE ('0x' || substr(md5('42|select|' || hash), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.15),
 picked AS (
  SELECT hash, label, start, "end", surface, candidate AS replacement FROM (
   SELECT s.*, n, ('0x' || substr(md5('42|' || s.hash || '|' || s.label || '|' || s.start || '|' || s."end"), 1, 8))::BIGINT
     AS number
   FROM surfaces s JOIN chosen_docs USING (hash)
   JOIN (SELECT label, surface, count(*) AS n FROM options GROUP BY label, surface) c USING (label, surface)) x
  JOIN options o USING (label, surface) WHERE o.rank = number % n + 1),
 rewritten_spans AS (
  SELECT s.ord, s.hash, s.label, s.start, s."end", coalesce(p.replacement, s.surface) AS put,
         CASE WHEN p.hash IS NULL THEN 0 ELSE 1 END AS hit,
         coalesce(lag(s."end") OVER (PARTITION BY s.hash ORDER BY s.start), 0) AS before
  FROM surfaces s LEFT JOIN picked p USING (hash, label, start, "end")
  WHERE s.hash IN (SELECT hash FROM picked)),
 moved AS (
  SELECT *, CAST(sum(start - before + length(put)) OVER (PARTITION BY hash ORDER BY start) AS BIGINT) AS new_end
  FROM rewritten_spans),
 rewritten AS (
  SELECT m.ord, m.hash AS source_hash,
   string_agg(substring(d.text, before + 1, start - before) || put, '' ORDER BY start)
     || substring(any_value(d.text), max("end") + 1) AS text,
   sum(hit)::BIGINT AS replaced, sum(new_end - length(put))::BIGINT AS starts, sum(new_end)::BIGINT AS ends
  FROM moved m JOIN docs d USING (hash) GROUP BY m.ord, m.hash)"""

SQL_ALIASES = SQL_SURFACES + f""",
 aliases AS (
  SELECT CASE WHEN d = 0 THEN 'PER' ELSE label END AS label, surface AS alias,
         CASE WHEN d = 1 THEN '...' ELSE '~' || surface || '.' END AS canonical
  FROM (SELECT DISTINCT label, surface, ('0x' || substr(md5(surface || '|alias'), 1, 2))::BIGINT AS d FROM surfaces)
  WHERE d < 64),
 alias_clean AS (
  SELECT label, {sql_key('alias')} AS alias_key, {sql_clean('canonical')} AS canonical FROM aliases),
 alias_index AS (
  SELECT label, alias_key, min(canonical) AS canonical,
   CASE WHEN label NOT IN ('ORG', 'NAME', 'GEO') THEN 'label'
        WHEN alias_key = '' OR count(*) FILTER (WHERE canonical = '') > 0 THEN 'empty'
        WHEN min(canonical) <> max(canonical) THEN 'conflict' END AS error
  FROM alias_clean GROUP BY label, alias_key)"""

SQL_ROWS = """WITH RECURSIVE
 words AS (
  SELECT sheet, turn_no, sentence_id, pos, tok FROM (
   SELECT CASE WHEN conv_id % 2 = 0 THEN 'Dataset_1' ELSE 'Dataset_2' END AS sheet,
          conv_id * 100 + turn AS turn_no, role AS sentence_id,
          unnest(string_split(text, ' ')) AS tok,
          CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS BIGINT) AS pos
   FROM conversations)
  WHERE trim(tok, ' ' || chr(10)) <> ''),
 numbers AS (
  SELECT *, ('0x' || substr(md5(tok || '|' || turn_no || '|' || pos), 1, 2))::BIGINT AS d FROM words),
 rows_ AS (
  SELECT sheet, turn_no * 100000 + pos AS row_no, sentence_id, trim(tok, ' ' || chr(10)) AS word,
   CASE WHEN d < 128 THEN 'O' ELSE
     (['B','I','E','S','I','E','O','b'])[(d // 8) % 8 + 1] || '-' ||
     (['PER','loc','ORG','geo_political-entity','DATE','person','GPE','Organization'])[d % 8 + 1] END AS tag
  FROM numbers),
 flagged AS (
  SELECT *, CASE WHEN sentence_id IS DISTINCT FROM lag(sentence_id) OVER w THEN 1 ELSE 0 END AS opens
  FROM rows_ WINDOW w AS (PARTITION BY sheet ORDER BY row_no)),
 grouped AS (
  SELECT *, max(CASE WHEN opens = 1 THEN row_no END) OVER w AS run_start,
         CAST(sum(opens) OVER w AS BIGINT) AS run_no
  FROM flagged WINDOW w AS (PARTITION BY sheet ORDER BY row_no ROWS UNBOUNDED PRECEDING)),
 separated AS (
  SELECT *, CASE WHEN lag(word) OVER w IS NULL OR contains(',.!?;:%)]}»”’', left(word, 1))
      OR contains('([{«“', right(lag(word) OVER w, 1)) THEN '' ELSE ' ' END AS sep
  FROM grouped WINDOW w AS (PARTITION BY sheet, run_no ORDER BY row_no)),
 placed AS (
  SELECT *, CAST(sum(length(sep) + length(word)) OVER (PARTITION BY sheet, run_no ORDER BY row_no) AS BIGINT)
      AS "end" FROM separated),
 tagged AS (
  SELECT sheet, run_no, sentence_id, row_no, word, sep, "end" - length(word) AS start, "end",
         replace(upper(tag), '_', '-') AS t FROM placed),
 parsed AS (
  SELECT *, split_part(t, '-', 1) AS prefix,
    CASE WHEN t = 'O' THEN NULL ELSE regexp_replace(substr(t, 3), '[^\\p{L}\\p{N}]', '', 'g') END AS name
  FROM tagged),
 context AS (
  SELECT *, coalesce(lag(prefix) OVER w IN ('B', 'I'), false) AS opened, lag(name) OVER w AS before
  FROM parsed WINDOW w AS (PARTITION BY sheet, run_no ORDER BY row_no)),
 judged AS (
  SELECT *, CASE WHEN prefix IN ('I', 'E') THEN
     CASE WHEN NOT opened AND prefix = 'I' THEN 'malformed_i_without_b'
          WHEN NOT opened THEN 'malformed_e_without_b'
          WHEN before <> name THEN 'malformed_label_transition' END END AS malformed
  FROM context),
 islands AS (
  SELECT *, sum(CASE WHEN prefix NOT IN ('I', 'E') OR malformed IS NOT NULL THEN 1 ELSE 0 END)
     OVER (PARTITION BY sheet, run_no ORDER BY row_no) AS island FROM judged),
 source_entities AS (
  SELECT sheet, run_no, min(name) AS name, min(start) AS start, max("end") AS "end"
  FROM islands WHERE prefix <> 'O' GROUP BY sheet, run_no, island),
 label_map(name, label) AS (VALUES ('PER','NAME'), ('PERSON','NAME'), ('LOC','GEO'), ('LOCATION','GEO'),
   ('GPE','GEO'), ('GEOPOLITICALENTITY','GEO'), ('ORG','ORG'), ('ORGANIZATION','ORG')),
 sentences AS (
  SELECT sheet, run_no, min(sentence_id) AS sentence_id, string_agg(sep || word, '' ORDER BY row_no) AS text
  FROM tagged GROUP BY sheet, run_no)"""
