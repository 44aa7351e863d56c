"""Validation, predicates and text functions."""

from pyspark.sql import functions as F

from spanloom import schema as S
from spanloom.functions import text as X
from spanloom.operators import report, scoring, typography, validate
from spanloom.operators.overlap import overlap_join
from spanloom.operators.rows import each
from workload import views as V
from workload.registry import query

MODE_SQL = V.SQL_NOISY + """,
 checked AS (
  SELECT hash, idx, label, start, "end",
   CASE WHEN NOT coalesce({label_ok}, false) THEN 'label'
        WHEN NOT coalesce(start >= 0 AND start < "end" AND "end" <= len, false) THEN 'offsets' END AS error
  FROM noisy),
 pairs AS (
  SELECT hash, idx, label, start, lag(label) OVER w AS l, lag(start) OVER w AS s, lag("end") OVER w AS e, "end"
  FROM checked WHERE error IS NULL WINDOW w AS (PARTITION BY hash ORDER BY start, "end", label, idx))
SELECT hash, idx, error FROM checked WHERE error IS NOT NULL
UNION ALL
SELECT hash, idx, error FROM (
 SELECT hash, idx, CASE WHEN {dup} AND l = label AND s = start AND e = "end" THEN 'duplicate'
                        WHEN {over} AND start < e THEN 'overlap' END AS error FROM pairs)
WHERE error IS NOT NULL"""
FIXED = "label IN ('ORG', 'NAME', 'GEO')"


@query("validate_spans", MODE_SQL.format(label_ok=FIXED, dup="true", over="true"))
def _(spark, sf):
    return validate.validate_spans(V.noisy(spark, sf), "contract")


@query("validate_spans_score", MODE_SQL.format(label_ok=FIXED, dup="true", over="false"))
def _(spark, sf):
    return validate.validate_spans(V.noisy(spark, sf), "score")


@query("validate_spans_inspect", MODE_SQL.format(label_ok="label <> ''", dup="false", over="true"))
def _(spark, sf):
    return validate.validate_spans(V.noisy(spark, sf), "inspect")


@query(
    "duplicate_entity",
    V.SQL_NOISY
    + """
SELECT hash, label, start, "end", idx FROM (
 SELECT *, row_number() OVER (PARTITION BY hash, label, start, "end" ORDER BY idx) AS n FROM noisy) WHERE n > 1""",
)
def _(spark, sf):
    return validate.duplicate_entity(V.noisy(spark, sf))


@query(
    "overlap_check",
    V.SQL_NESTED
    + """
SELECT hash, left_start, left_end, right_start, right_end FROM (
 SELECT hash, lag(start) OVER w AS left_start, lag("end") OVER w AS left_end,
        start AS right_start, "end" AS right_end
 FROM nested WINDOW w AS (PARTITION BY hash ORDER BY start, "end", label)) WHERE right_start < left_end""",
)
def _(spark, sf):
    spans = F.collect_list(F.struct("label", "start", "end")).alias("entities")
    return validate.overlap_check(V.nested(spark, sf).groupBy("hash").agg(spans))


@query(
    "canonical_entities",
    V.SQL_NOISY
    + """
SELECT hash, row_number() OVER (PARTITION BY hash ORDER BY start NULLS FIRST, "end", label NULLS FIRST, idx) - 1 AS pos,
       label, start, "end" FROM noisy""",
)
def _(spark, sf):
    rows = validate.canonical_entities(V.noisy(spark, sf))
    placed = F.transform("entities", lambda e, i: e.withField("pos", i.cast("bigint")))
    return each(rows, ["hash"], placed)


BATCH_SQL = V.SQL_TOK + """,
 batch AS (
  SELECT ord,
   CASE WHEN x = '0' THEN '' WHEN x = '1' THEN NULL WHEN x IN ('2', '3') THEN 'again' ELSE hash END AS hash,
   CASE WHEN x = '4' THEN NULL ELSE text END AS text
  FROM (SELECT *, substr(md5(hash || '|batch'), 1, 1) AS x FROM docs))"""


def _batch(spark, sf):
    d = V.hex_digit(F.col("hash"), F.lit("batch"))
    record_hash = F.when(d == "0", "").when(d == "1", F.lit(None)).when(d.isin("2", "3"), "again").otherwise(F.col("hash"))
    return V.docs(spark, sf).select(
        "ord", record_hash.alias("hash"), F.when(d != "4", F.col("text")).alias("text")
    )


@query(
    "validate_input_batch",
    BATCH_SQL
    + """
SELECT ord, CASE WHEN coalesce(hash, '') = '' THEN 'hash' ELSE 'text' END AS error FROM batch
WHERE coalesce(hash, '') = '' OR text IS NULL
UNION ALL
SELECT ord, 'duplicate_hash' FROM (
 SELECT ord, row_number() OVER (PARTITION BY hash ORDER BY ord) AS n FROM batch WHERE hash <> '') WHERE n > 1""",
)
def _(spark, sf):
    return validate.validate_input_batch(_batch(spark, sf))


@query(
    "duplicate_hash",
    BATCH_SQL
    + """
SELECT ord, hash FROM (
 SELECT ord, hash, row_number() OVER (PARTITION BY hash ORDER BY ord) AS n FROM batch) WHERE n > 1""",
)
def _(spark, sf):
    return validate.duplicate_hash(_batch(spark, sf))


@query(
    "validate_predictions",
    V.SQL_NOISY
    + """,
 answers AS (
  SELECT ord, CASE WHEN x = '1' THEN 'other' ELSE hash END AS got
  FROM (SELECT ord, hash, substr(md5(hash || '|answer'), 1, 1) AS x FROM docs) WHERE x <> '0'),
 whole AS (
  SELECT ord, d.hash, CASE WHEN a.ord IS NULL THEN 'count' WHEN d.hash <> a.got THEN 'hash' END AS error
  FROM docs d LEFT JOIN answers a USING (ord)),
 checked AS (
  SELECT n.*, w.ord, CASE WHEN NOT coalesce(label IN ('ORG', 'NAME', 'GEO'), false) THEN 'label'
   WHEN NOT (start >= 0 AND start < "end" AND "end" <= len) THEN 'offsets' END AS error
  FROM noisy n JOIN whole w USING (hash) WHERE w.error IS NULL),
 pairs AS (
  SELECT ord, idx, label, start, "end", lag(label) OVER w AS l, lag(start) OVER w AS s, lag("end") OVER w AS e
  FROM checked WHERE error IS NULL WINDOW w AS (PARTITION BY hash ORDER BY start, "end", label, idx))
SELECT ord, -1::BIGINT AS idx, error FROM whole WHERE error IS NOT NULL
UNION ALL SELECT ord, idx, error FROM checked WHERE error IS NOT NULL
UNION ALL SELECT ord, idx, CASE WHEN l = label AND s = start AND e = "end" THEN 'duplicate' ELSE 'overlap' END
FROM pairs WHERE start < e""",
)
def _(spark, sf):
    d = V.hex_digit(F.col("hash"), F.lit("answer"))
    answers = V.noisy(spark, sf).filter(d != "0").select(
        "ord", F.when(d == "1", "other").otherwise(F.col("hash")).alias("hash"), "entities"
    )
    violations = validate.validate_predictions(answers, V.docs(spark, sf))
    return violations.withColumn("idx", F.coalesce("idx", F.lit(-1)))


SIDES_SQL = V.SQL_TOK + """,
 answered AS (
  SELECT hash FROM docs WHERE substr(md5(hash || '|side'), 1, 1) <> '0'
  UNION ALL SELECT 'b-' || item_id FROM benchmark),
 one_sided AS (
  SELECT 'missing' AS side, hash FROM docs WHERE hash NOT IN (SELECT hash FROM answered)
  UNION ALL SELECT 'extra', hash FROM answered WHERE hash NOT IN (SELECT hash FROM docs))"""


@query(
    "hash_set_equality",
    SIDES_SQL
    + """
SELECT side, total, rank, hash FROM (
 SELECT side, hash, count(*) OVER (PARTITION BY side) AS total,
        row_number() OVER (PARTITION BY side ORDER BY hash) AS rank FROM one_sided) WHERE rank <= 5""",
)
def _(spark, sf):
    kept = V.hex_digit(F.col("hash"), F.lit("side")) != "0"
    answered = V.docs(spark, sf).filter(kept).select("hash").unionByName(V.benchmark(spark, sf).select("hash"))
    return validate.hash_set_equality(V.docs(spark, sf), answered)


@query(
    "text_agreement",
    V.SQL_TOK + " SELECT hash FROM docs WHERE substr(md5(hash || '|text'), 1, 1) = '0'",
)
def _(spark, sf):
    d = V.hex_digit(F.col("hash"), F.lit("text"))
    changed = V.docs(spark, sf).select(
        "hash",
        F.when(d == "0", F.concat("text", F.lit("."))).when(d != "1", F.col("text")).alias("text"),
    )
    return validate.text_agreement(V.docs(spark, sf), changed)


@query("nonempty_dataset", "SELECT 'documents' AS dataset, count(*) > 0 AS nonempty FROM documents")
def _(spark, sf):
    return validate.nonempty_dataset(V.table(spark, sf, "documents"), "documents")


@query(
    "spans_overlap",
    V.SQL_SPANS
    + """
SELECT g.hash, g.label, g.start, g."end", p.label AS other_label, p.start AS other_start, p."end" AS other_end
FROM gold g JOIN pred p ON g.hash = p.hash AND g.start < p."end" AND p.start < g."end" """,
)
def _(spark, sf):
    return overlap_join(
        scoring.explode_spans(V.gold(spark, sf)), scoring.explode_spans(V.pred(spark, sf))
    )


PREFIXES = ("src1-", "src1", "src2-")


@query(
    "prefix_source",
    V.SQL_TOK
    + """
SELECT hash, CASE WHEN starts_with(hash, 'src1-') THEN 'src1-' WHEN starts_with(hash, 'src1') THEN 'src1'
  WHEN starts_with(hash, 'src2-') THEN 'src2-' END AS prefix FROM docs""",
)
def _(spark, sf):
    return V.docs(spark, sf).select("hash", validate.prefix_source(F.col("hash"), PREFIXES).alias("prefix"))


@query(
    "is_empty_record",
    V.SQL_GOLD + " SELECT hash, hash NOT IN (SELECT hash FROM gold) AS is_empty FROM docs",
)
def _(spark, sf):
    return V.gold(spark, sf).select("hash", validate.is_empty_record(F.col("entities")).alias("is_empty"))


# -------------------------------------------------------------------- text functions


@query("surface", V.SQL_SURFACES + ' SELECT hash, label, start, "end", surface FROM surfaces')
def _(spark, sf):
    return V.gold_surfaces(spark, sf).drop("ord")


EDITED = "text"
for _found, _put in V.APOSTROPHE_EDITS:
    EDITED = f"replace({EDITED}, '{_found}', '{_put.replace(chr(39), chr(39) * 2)}')"
SQL_CHARS = V.SQL_TOK + f""",
 edited AS (SELECT hash, {EDITED} AS text FROM docs),
 letters AS (
  SELECT hash, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM edited),
 near AS (
  SELECT *, lag(c) OVER w AS before, lead(c) OVER w AS after, lead(c, 2) OVER w AS later
  FROM letters WINDOW w AS (PARTITION BY hash ORDER BY i)),
 found AS (
  SELECT *, coalesce(contains('''‘’ʼ`', c) AND c <> '' AND before IN ('o', 'O', 'g', 'G')
   AND regexp_full_match(after, '[A-Za-z]')
   AND NOT (after IN ('s', 'S') AND (later IS NULL OR NOT regexp_full_match(later, '\\p{{L}}'))), false) AS hit
  FROM near)"""


@query(
    "normalize_apostrophes",
    SQL_CHARS
    + """
SELECT hash, md5(string_agg(CASE WHEN hit THEN 'ʻ' ELSE c END, '' ORDER BY i)) AS text_md5,
       count(*) FILTER (WHERE hit) AS replaced FROM found GROUP BY hash""",
)
def _(spark, sf):
    text = F.col("text")
    return V.apostrophes(spark, sf).select(
        "hash",
        F.md5(X.normalize_apostrophes(text)).alias("text_md5"),
        F.size(X.apostrophe_matches(text)).cast("bigint").alias("replaced"),
    )


@query(
    "apostrophe_stats",
    SQL_CHARS
    + """
SELECT 'records' AS metric, '' AS key, count(DISTINCT hash) AS value FROM found
UNION ALL SELECT 'changed_records', '', count(DISTINCT hash) FROM found WHERE hit
UNION ALL SELECT 'replacements', '', count(*) FROM found WHERE hit
UNION ALL SELECT 'by_variant', c, count(*) FROM found WHERE hit GROUP BY c""",
)
def _(spark, sf):
    return typography.apostrophe_stats(V.apostrophes(spark, sf))


@query(
    "clean_value",
    V.SQL_SURFACES + f" SELECT DISTINCT surface, {V.sql_clean('surface')} AS cleaned FROM surfaces",
)
def _(spark, sf):
    distinct = V.gold_surfaces(spark, sf).select("surface").distinct()
    return distinct.select("surface", X.clean_value(F.col("surface")).alias("cleaned"))


@query(
    "casefold_key",
    V.SQL_SURFACES + f" SELECT DISTINCT surface, {V.sql_key('surface')} AS key FROM surfaces",
)
def _(spark, sf):
    distinct = V.gold_surfaces(spark, sf).select("surface").distinct()
    return distinct.select("surface", X.casefold_key(F.col("surface")).alias("key"))


@query(
    "source_hash",
    """SELECT doc_id, 'mendeley-' || sha256(CASE WHEN doc_id % 5 > 0 THEN doc_id::VARCHAR ELSE 'row:' || doc_id END
  || chr(0) || text) AS hash FROM documents""",
)
def _(spark, sf):
    row_id = F.when(F.col("ord") % 5 > 0, F.col("ord").cast("string"))
    position = F.concat(F.lit("row:"), F.col("ord"))
    return V.docs(spark, sf).select(
        F.col("ord").alias("doc_id"), X.source_hash(row_id, F.col("text"), position).alias("hash")
    )


@query(
    "sentence_hash",
    """SELECT conv_id, turn, 'uzner-v2-' || sha256(role || chr(0) || turn || chr(0) || text) AS hash
FROM conversations""",
)
def _(spark, sf):
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn", X.sentence_hash(F.col("role"), F.col("turn").cast("string"), F.col("text")).alias("hash")
    )


@query(
    "augmented_hash",
    V.SQL_TOK
    + """ SELECT hash AS source_hash,
 'cluster-' || sha256(hash || chr(0) || 'cluster' || chr(0) || ord || chr(0) || text) AS hash FROM docs""",
)
def _(spark, sf):
    return V.docs(spark, sf).select(
        F.col("hash").alias("source_hash"),
        X.augmented_hash(F.col("hash"), F.col("ord"), F.col("text")).alias("hash"),
    )


@query(
    "mark_text",
    V.SQL_SURFACES
    + """,
 marks AS (
  SELECT s.hash, start, substring(d.text, coalesce(lag("end") OVER w, 0) + 1, start - coalesce(lag("end") OVER w, 0))
    || '[' || label || ':' || surface || ']' AS piece, "end"
  FROM surfaces s JOIN docs d USING (hash) WINDOW w AS (PARTITION BY s.hash ORDER BY start)),
 joined AS (
  SELECT hash, string_agg(piece, '' ORDER BY start) AS body, max("end") AS last FROM marks GROUP BY hash)
SELECT d.hash, md5(coalesce(body, '') || substring(d.text, coalesce(last, 0) + 1)) AS marked_md5
FROM docs d LEFT JOIN joined USING (hash)""",
)
def _(spark, sf):
    return V.gold(spark, sf).select(
        "hash", F.md5(scoring.mark_text(F.col("text"), F.col("entities"))).alias("marked_md5")
    )


@query(
    "entity_lines",
    V.SQL_SURFACES
    + """
SELECT hash, label, start, "end", surface,
 '  - ' || label || ': [' || start || ':' || "end" || '] ' ||
 CASE WHEN contains(surface, '''') AND NOT contains(surface, '"') THEN '"' || e || '"'
      ELSE '''' || replace(e, '''', '\\''') || '''' END AS line
FROM (SELECT *, replace(replace(surface, '\\', '\\\\'), chr(10), '\\n') AS e FROM surfaces)""",
)
def _(spark, sf):
    return report.entity_lines(V.gold(spark, sf))
