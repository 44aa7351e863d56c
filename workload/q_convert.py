"""Converters, corpus merging and thinning."""

import uuid

from pyspark.sql import functions as F

from spanloom.operators.rows import each
from spanloom import schema as S
from spanloom.functions import text as X
from spanloom.functions.arrays import let
from spanloom.operators import converters as C
from spanloom.operators import corpus, scoring, typography
from spanloom.operators.materialize import checkpoint_dir, materialize
from spanloom.operators.overlap import drop_overlaps_longest
from spanloom.sources.records import read_records, read_source_arrays
from spanloom.sources.token_rows import read_token_rows
from workload import views as V
from workload.registry import query

SQL_ARRAYS = V.SQL_SURFACES + """,
 source_rows AS (
  SELECT ord, hash, idx, start, "end", surface,
   CASE WHEN x = '0' THEN 'DATE' WHEN x = '1' THEN 'per'
        WHEN label = 'NAME' THEN 'PER' WHEN label = 'GEO' THEN 'LOC' ELSE 'ORG' END AS source_label
  FROM (SELECT *, substr(md5(ord || '|' || idx || '|l'), 1, 1) AS x FROM surfaces))"""


@query(
    "read_source_arrays",
    SQL_ARRAYS
    + """,
 counted AS (
  SELECT d.ord, substr(md5(d.ord || '|bad'), 1, 1) AS x, count(s.hash) AS n FROM docs d LEFT JOIN source_rows s USING (hash) GROUP BY d.ord)
SELECT CASE WHEN x IN ('3', '4') THEN -1 ELSE ord END AS ord,
 CASE WHEN x = '1' AND n > 0 THEN 'lengths' WHEN x = '0' THEN 'arrays' WHEN x = '2' AND n > 0 THEN 'surface'
      WHEN x = '3' THEN 'object' WHEN x = '4' THEN 'blank' ELSE 'none' END AS error,
 CASE WHEN x IN ('3', '4') THEN -1 ELSE n END AS n FROM counted""",
)
def _(spark, sf):
    """Array rows, some of them spoilt, written as lines and read back."""

    d = V.hex_digit(F.col("ord"), F.lit("bad"))
    labels = F.when(d == "1", F.slice("labels", 2, F.size("labels"))).when(d != "0", F.col("labels"))
    surfaces = F.when(
        d == "2", F.transform("surfaces", lambda s, i: F.when(i == 0, "").otherwise(s))
    ).otherwise(F.col("surfaces"))
    fields = F.struct(F.col("ord").alias("id"), "text", surfaces.alias("entities"), labels.alias("entity_type"))
    line = F.when(d == "3", "[1]").when(d == "4", " ").otherwise(F.to_json(fields))
    path = f"{checkpoint_dir(spark)}/workload-{uuid.uuid4().hex}"
    V.array_rows(spark, sf).select(line.alias("value")).write.text(path)
    rows = read_source_arrays(spark, path)
    error = F.coalesce("error", C.source_array_error(F.col("text"), F.col("surfaces"), F.col("labels")), F.lit("none"))
    number = lambda c: F.coalesce(c.cast("bigint"), F.lit(-1).cast("bigint"))
    return rows.select(number(F.col("id")).alias("ord"), error.alias("error"), number(F.size("surfaces")).alias("n"))


@query(
    "find_occurrences",
    """WITH needles AS (SELECT page_id, html, substr(html, length(html) // 2, 2) AS needle FROM pages),
 chars AS (
  SELECT page_id, needle, unnest(string_split(html, '')) AS c, generate_subscripts(string_split(html, ''), 1) AS i
  FROM needles)
SELECT page_id, i - 1 AS start FROM (
 SELECT page_id, needle, i, c || lead(c) OVER (PARTITION BY page_id ORDER BY i) AS two FROM chars) WHERE two = needle""",
)
def _(spark, sf):
    html = F.col("html")
    pages = V.spread(V.table(spark, sf, "pages"), "page_id").select(
        "page_id",
        html.alias("text"),
        F.substring(html, F.floor(F.length(html) / 2).cast("int"), F.lit(2)).alias("surface"),
    )
    found = C.find_occurrences(pages)
    return each(found, ["page_id"], "starts", "start").withColumn(
        "start", F.col("start").cast("bigint")
    )


@query("assign_occurrences")
def _(spark, sf):
    placed = C.assign_occurrences(V.array_rows(spark, sf))
    numbered = F.transform("starts", lambda s, i: F.struct(i.cast("bigint").alias("idx"), s.alias("start")))
    return each(placed, ["ord"], numbered)


@query(
    "expand_suffix",
    V.SQL_GOLD
    + """
SELECT g.hash, start, "end", "end" + length(regexp_extract(substring(d.text, "end" + 1),
  '^[\\p{L}\\p{N}''’ʻʼ_-]*')) AS expanded
FROM (SELECT hash, start, "end" - ("end" - start) // 2 AS "end" FROM gold) g JOIN docs d USING (hash)""",
)
def _(spark, sf):
    halved = F.transform(
        "entities", lambda e: e.withField("end", e["end"] - F.floor((e["end"] - e["start"]) / 2))
    )
    records = V.gold(spark, sf).withColumn("halved", halved)
    records = records.withColumn("expanded", X.expand_suffixes(F.col("text"), F.col("halved")))
    both = F.arrays_zip(F.col("halved").alias("e"), F.col("expanded").alias("x"))
    return each(records, ["hash"], both).select(
        "hash",
        F.col("e.start").alias("start"),
        F.col("e.end").alias("end"),
        F.col("x.end").alias("expanded"),
    )


@query(
    "map_labels",
    SQL_ARRAYS
    + """
SELECT upper(source_label) AS source_label, CASE upper(source_label) WHEN 'PER' THEN 'NAME' WHEN 'LOC' THEN 'GEO'
  WHEN 'ORG' THEN 'ORG' END AS target_label, count(*) AS n FROM source_rows GROUP BY ALL""",
)
def _(spark, sf):
    labels = each(V.array_rows(spark, sf), [], "labels", "l").select(F.upper("l").alias("source_label"))
    return C.label_counts(labels, S.ARRAY_LABELS)


@query(
    "drop_overlaps_longest",
    V.SQL_NESTED + V.greedy_sql("nested", 'start - "end", start, "end", idx'),
)
def _(spark, sf):
    return drop_overlaps_longest(V.nested(spark, sf))


@query("convert_array_record")
def _(spark, sf):
    done = C.convert_arrays(V.array_rows(spark, sf))
    return done.select(
        "hash",
        F.size("entities").cast("bigint").alias("entities"),
        "dropped_overlaps",
        F.md5(F.to_json("entities")).alias("entities_md5"),
        F.coalesce("error", F.lit("none")).alias("error"),
    )


# ------------------------------------------------------------------- token tables


@query("read_token_rows", V.SQL_ROWS + " SELECT * FROM rows_ WHERE sheet = 'Dataset_1'")
def _(spark, sf):
    path = f"{checkpoint_dir(spark)}/workload-{uuid.uuid4().hex}"
    V.token_rows(spark, sf).write.parquet(path)
    return read_token_rows(spark, path, ("Dataset_1",)).drop("error")


@query(
    "sentence_groups",
    V.SQL_ROWS + " SELECT sheet, row_no, sentence_id, run_start, run_no FROM grouped",
)
def _(spark, sf):
    rows = V.token_rows(spark, sf).select("sheet", "row_no", "sentence_id")
    return C.sentence_groups(rows, block=50_000_000)


@query("max_sentences", V.SQL_ROWS + " SELECT sheet, row_no, run_no FROM grouped WHERE run_no <= 20")
def _(spark, sf):
    rows = V.token_rows(spark, sf).select("sheet", "row_no", "sentence_id")
    return C.max_sentences(C.sentence_groups(rows), 20).select("sheet", "row_no", "run_no")


def sentences(spark, sf):
    return C.detokenize(C.sentence_groups(V.token_rows(spark, sf)))


@query("detokenize", V.SQL_ROWS + " SELECT sheet, run_no, sentence_id, text FROM sentences")
def _(spark, sf):
    return sentences(spark, sf).drop("tokens")


@query("detokenize_spans", V.SQL_ROWS + ' SELECT sheet, row_no, start, "end" FROM tagged')
def _(spark, sf):
    return each(sentences(spark, sf), ["sheet"], "tokens").select("sheet", "row_no", "start", "end")


@query("parse_tag", V.SQL_ROWS + " SELECT sheet, row_no, prefix, name AS label FROM parsed")
def _(spark, sf):
    return V.token_rows(spark, sf).select("sheet", "row_no", C.parse_tag(F.col("tag")).alias("p")).select(
        "sheet", "row_no", "p.prefix", "p.label"
    )


@query("decode_bioes", V.SQL_ROWS + ' SELECT sheet, run_no, name AS label, start, "end" FROM source_entities')
def _(spark, sf):
    decoded = C.decode_bioes(sentences(spark, sf))
    return each(decoded, ["sheet", "run_no"], "spans")


@query(
    "tag_quality_counts",
    V.SQL_ROWS
    + """
SELECT 'source_entities' AS metric, name AS key, count(*) AS value FROM source_entities GROUP BY name
UNION ALL SELECT 'dropped_source_entities', name, count(*) FROM source_entities
  WHERE name NOT IN (SELECT name FROM label_map) GROUP BY name
UNION ALL SELECT malformed, '', count(*) FROM judged WHERE malformed IS NOT NULL GROUP BY malformed
UNION ALL SELECT 'sentences', sheet, count(*) FROM sentences GROUP BY sheet""",
)
def _(spark, sf):
    return C.tag_quality_counts(C.decode_bioes(sentences(spark, sf)))


@query(
    "convert_sentence",
    V.SQL_ROWS
    + """
SELECT 'uzner-v2-' || sha256(s.sheet || chr(0) || sentence_id || chr(0) || text) AS hash, s.sheet, s.run_no, text,
 count(label) AS entities, coalesce(sum(start) FILTER (WHERE label IS NOT NULL), 0)::BIGINT AS starts,
 coalesce(sum("end") FILTER (WHERE label IS NOT NULL), 0)::BIGINT AS ends
FROM sentences s LEFT JOIN source_entities e ON e.sheet = s.sheet AND e.run_no = s.run_no LEFT JOIN label_map USING (name)
GROUP BY s.sheet, s.run_no, sentence_id, text""",
)
def _(spark, sf):
    total = lambda field: F.aggregate(
        F.transform("entities", lambda e: e[field]), F.lit(0).cast("bigint"), lambda s, x: s + x
    )
    done = C.convert_sentences(C.decode_bioes(sentences(spark, sf))).filter("error is null")
    return done.select(
        "hash", "sheet", "run_no", "text", F.size("entities").cast("bigint").alias("entities"),
        total("start").alias("starts"), total("end").alias("ends"),
    )


# ------------------------------------------------------------------------- corpora


@query("read_limit", V.SQL_TOK + " SELECT ord, hash, text FROM docs ORDER BY ord LIMIT 25")
def _(spark, sf):
    """Files of records in order, with broken lines behind the limit that a reader must not look at."""

    docs = V.docs(spark, sf)
    last = docs.orderBy("ord").limit(25).agg(F.max("ord")).first()[0]
    broken = (F.col("ord") > last) & (V.hex_digit(F.col("hash"), F.lit("broken")) < "4")
    line = F.when(broken, "{broken").otherwise(F.to_json(F.struct("hash", "text", "ord")))
    path = f"{checkpoint_dir(spark)}/workload-{uuid.uuid4().hex}"
    docs.repartitionByRange(6, "ord").sortWithinPartitions("ord").select(line.alias("value")).write.text(path)
    first = read_records(spark, path, require_entities=False, extra=True, limit=25)
    return first.select(F.get_json_object("extra", "$.ord").cast("bigint").alias("ord"), "hash", "text")


def added(spark, sf):
    """Conversation turns and documents' copies as new records against ``benchmark``."""

    d = V.hex_digit(F.col("hash"), F.lit("new"))
    return V.docs(spark, sf).withColumn("hash", F.concat(F.lit("new-"), F.col("hash"))).withColumn("d", d)


SQL_NEW = V.SQL_TOK + """,
 train AS (SELECT ord, hash, text FROM docs WHERE substr(md5(hash || '|part'), 1, 1) < '8'),
 incoming AS (SELECT ord, 'n-' || hash AS hash, text FROM docs WHERE substr(md5(hash || '|part'), 1, 1) >= '4'),
 fresh AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ord) AS n FROM incoming)
  WHERE n = 1 AND text NOT IN (SELECT text FROM train) AND text NOT IN (SELECT text FROM benchmark))"""


def parts(spark, sf):
    digit = V.hex_digit(F.col("hash"), F.lit("part"))
    base = V.gold(spark, sf)
    train = base.filter(digit < "8")
    incoming = base.filter(digit >= "4").withColumn("hash", F.concat(F.lit("n-"), F.col("hash")))
    return train, incoming


@query("dedup_against", SQL_NEW + " SELECT ord, hash FROM fresh")
def _(spark, sf):
    train, incoming = parts(spark, sf)
    return corpus.dedup_against(incoming, train, V.benchmark(spark, sf)).select("ord", "hash")


@query(
    "append_train",
    SQL_NEW
    + """
SELECT ord, hash FROM train
UNION ALL SELECT ord + (SELECT max(ord) + 1 FROM train), hash FROM fresh""",
)
def _(spark, sf):
    train, incoming = parts(spark, sf)
    fresh = corpus.dedup_against(incoming, train, V.benchmark(spark, sf))
    return corpus.append_train(train, fresh).select("ord", "hash")


SQL_THIN = V.SQL_GOLD + """,
 records AS (
  SELECT d.ord, d.hash, CASE WHEN starts_with(d.hash, 'src1-') THEN 'src1-' WHEN starts_with(d.hash, 'src2-') THEN 'src2-'
    WHEN starts_with(d.hash, 'src3') THEN 'src3' END AS source,
   count(g.hash) FILTER (WHERE keep) = 0 AS is_empty,
   count(g.hash) FILTER (WHERE keep AND label = 'ORG') AS org, count(g.hash) FILTER (WHERE keep AND label = 'NAME') AS name,
   count(g.hash) FILTER (WHERE keep AND label = 'GEO') AS geo
  FROM (SELECT *, substr(md5(hash || '|hollow'), 1, 1) >= '8' AS keep FROM docs) d LEFT JOIN gold g ON g.hash = d.hash
  GROUP BY d.ord, d.hash),
 eligible AS (
  SELECT ord, row_number() OVER (ORDER BY md5('42|' || hash), ord) AS r, count(*) OVER () AS n
  FROM records WHERE is_empty AND source IS NOT NULL),
 marked AS (
  SELECT r.*, coalesce(e.r <= floor(e.n * 0.75::DOUBLE), false) AS removed FROM records r LEFT JOIN eligible e USING (ord))"""
THIN_PREFIXES = ("src1-", "src2-", "src3")


def hollow(spark, sf):
    """Gold records without their texts, half of them emptied by digest; derived once, as thinning reads them several times."""

    keep = V.hex_digit(F.col("hash"), F.lit("hollow")) >= "8"
    emptied = F.when(keep, F.col("entities")).otherwise(F.filter("entities", lambda e: F.lit(False)))
    return materialize(V.gold(spark, sf).select("ord", "hash", "entities").withColumn("entities", emptied))


@query("drop_empty_added", SQL_THIN + " SELECT ord, hash FROM marked WHERE NOT removed")
def _(spark, sf):
    return corpus.drop_empty_added(hollow(spark, sf), 0.75, 42, THIN_PREFIXES).select("ord", "hash")


@query(
    "filter_manifest",
    SQL_THIN
    + """
SELECT coalesce(prefix, 'all') AS prefix, input_records, output_records, removed_records, input_empty_records,
 output_empty_records, eligible_records, kept_eligible_records, org_before, org_after, name_before, name_after,
 geo_before, geo_after,
 round(CASE WHEN input_records = 0 THEN 0 ELSE input_empty_records / input_records::DOUBLE END, 12) AS input_empty_share,
 round(CASE WHEN output_records = 0 THEN 0 ELSE output_empty_records / output_records::DOUBLE END, 12) AS output_empty_share
FROM (
 SELECT coalesce(source, 'original') AS prefix, count(*) AS input_records, count(*) FILTER (WHERE NOT removed) AS output_records,
  count(*) FILTER (WHERE removed) AS removed_records, count(*) FILTER (WHERE is_empty) AS input_empty_records,
  count(*) FILTER (WHERE is_empty AND NOT removed) AS output_empty_records,
  count(*) FILTER (WHERE is_empty AND source IS NOT NULL) AS eligible_records,
  count(*) FILTER (WHERE is_empty AND source IS NOT NULL AND NOT removed) AS kept_eligible_records,
  sum(org)::BIGINT AS org_before, coalesce(sum(org) FILTER (WHERE NOT removed), 0)::BIGINT AS org_after,
  sum(name)::BIGINT AS name_before, coalesce(sum(name) FILTER (WHERE NOT removed), 0)::BIGINT AS name_after,
  sum(geo)::BIGINT AS geo_before, coalesce(sum(geo) FILTER (WHERE NOT removed), 0)::BIGINT AS geo_after
 FROM marked GROUP BY ROLLUP (coalesce(source, 'original')))""",
)
def _(spark, sf):
    marked = corpus.mark_empty_added(hollow(spark, sf), 0.75, 42, THIN_PREFIXES)
    manifest = corpus.filter_manifest(marked)
    return manifest.select(
        *[
            F.coalesce("prefix", F.lit("all")).alias(c)
            if c == "prefix"
            else F.round(c, 12).alias(c)
            if c.endswith("share")
            else F.col(c)
            for c in manifest.columns
        ]
    )


@query(
    "entities_unchanged",
    SQL_THIN
    + """
SELECT label, sum(n)::BIGINT AS before, sum(CASE WHEN removed THEN 0 ELSE n END)::BIGINT AS after,
       sum(n) = sum(CASE WHEN removed THEN 0 ELSE n END) AS unchanged
FROM (SELECT removed, unnest(['ORG', 'NAME', 'GEO']) AS label, unnest([org, name, geo]) AS n FROM marked) GROUP BY label""",
)
def _(spark, sf):
    before = hollow(spark, sf)
    return scoring.entities_unchanged(before, corpus.drop_empty_added(before, 0.75, 42, THIN_PREFIXES))


@query("sample_n", V.SQL_TOK + " SELECT ord, hash FROM docs ORDER BY md5('7|' || hash), ord LIMIT 60")
def _(spark, sf):
    return corpus.sample_n(V.docs(spark, sf), 60, 7).select("ord", "hash")


@query(
    "merge_manifest",
    SQL_NEW.replace("WITH RECURSIVE" + V._TOK, V.SQL_GOLD)
    + """,
 dev AS (SELECT * FROM benchmark)
SELECT 'original_train_records' AS metric, '' AS key, count(*) AS value FROM train
UNION ALL SELECT 'original_dev_records', '', count(*) FROM dev
UNION ALL SELECT 'added_records', '', count(*) FROM fresh
UNION ALL SELECT 'merged_train_records', '', (SELECT count(*) FROM train) + count(*) FROM fresh
UNION ALL SELECT 'merged_dev_records', '', count(*) FROM dev
UNION ALL SELECT 'skipped_duplicate_text', '', (SELECT count(*) FROM incoming) - count(*) FROM fresh
UNION ALL SELECT 'added_entities_by_target_label', label, count(*) FROM gold
  WHERE 'n-' || hash IN (SELECT hash FROM fresh) GROUP BY label""",
)
def _(spark, sf):
    train, incoming = parts(spark, sf)
    dev = V.benchmark(spark, sf)
    fresh = corpus.dedup_against(incoming, train, dev)
    return corpus.merge_manifest(train, dev, incoming, fresh)


@query("alias_index", V.SQL_ALIASES + " SELECT label, alias_key, canonical, error FROM alias_index")
def _(spark, sf):
    return typography.alias_index(V.aliases(V.gold_surfaces(spark, sf)))


@query(
    "alias_join",
    V.SQL_ALIASES
    + f"""
SELECT s.hash, s.label, s.start, s."end", s.surface, coalesce(a.canonical, {V.sql_clean('s.surface')}) AS normalized
FROM surfaces s LEFT JOIN alias_index a
  ON a.error IS NULL AND a.label = s.label AND a.alias_key = {V.sql_key('s.surface')}""",
)
def _(spark, sf):
    spans = materialize(V.gold_surfaces(spark, sf).drop("ord"))  # derived once for the aliases and the join
    index = materialize(typography.alias_index(V.aliases(spans)))
    return typography.alias_join(spans, index)
