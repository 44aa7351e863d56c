"""Sources, sinks and streams, fed from the driver tables."""

import uuid

from pyspark.sql import functions as F

from spanloom.operators import scoring
from spanloom.operators.materialize import checkpoint_dir, materialize
from spanloom.operators.typography import alias_index
from spanloom.sources.fingerprint import file_digests, table_fingerprint
from spanloom.sources.records import parse_records, read_predictions, read_records, violations
from spanloom.sources.sinks import write_jsonl, write_report
from spanloom.streaming import intake
from workload import views as V
from workload.q_scoring import REPORT, gold_spans, long, long_sql, pred_spans
from workload.q_windows import totals
from workload.registry import query


def scratch(spark) -> str:
    """A new path in the shared folder."""

    return f"{checkpoint_dir(spark)}/workload-{uuid.uuid4().hex}"


COUNTS = """
SELECT d.hash, count(k.hash) AS entities, coalesce(sum(k.start), 0)::BIGINT AS starts, coalesce(sum(k."end"), 0)::BIGINT AS ends
FROM docs d LEFT JOIN {0} k ON k.hash = d.hash GROUP BY d.hash"""


@query("read_records", V.SQL_GOLD + COUNTS.format("gold"))
def _(spark, sf):
    path = scratch(spark)
    write_jsonl(V.gold(spark, sf), path)
    return totals(read_records(spark, path))


@query("read_predictions", V.SQL_SPANS + COUNTS.format("pred"))
def _(spark, sf):
    path = scratch(spark)
    write_jsonl(V.pred(spark, sf).drop("text"), path)
    return totals(read_predictions(spark, path))


@query(
    "read_violations",
    V.SQL_NOISY
    + """,
 kinds AS (SELECT hash, ord, substr(md5(hash || '|line'), 1, 1) AS x FROM docs),
 broken AS (
  SELECT hash, CASE x WHEN '0' THEN 'blank' WHEN '1' THEN 'json' WHEN '2' THEN 'object' WHEN '3' THEN 'hash'
    WHEN '4' THEN 'text' WHEN '5' THEN 'entities' END AS error FROM kinds),
 checked AS (
  SELECT hash, idx, label, start, "end", CASE WHEN NOT coalesce(label IN ('ORG', 'NAME', 'GEO'), false) THEN 'label'
   WHEN NOT (start >= 0 AND start < "end" AND "end" <= len) THEN 'offsets' END AS error FROM noisy),
 pairs AS (
  SELECT hash, idx, label, start, "end", lag(label) OVER w AS l, lag(start) OVER w AS s, lag("end") OVER w AS e
  FROM checked WHERE error IS NULL WINDOW w AS (PARTITION BY hash ORDER BY start, "end", label, idx)),
 spans AS (
  SELECT hash, idx, error FROM checked WHERE error IS NOT NULL
  UNION ALL SELECT hash, idx, CASE WHEN l = label AND s = start AND e = "end" THEN 'duplicate' ELSE 'overlap' END
  FROM pairs WHERE start < e),
 first_span AS (SELECT hash, arg_min(error, idx) AS error FROM spans GROUP BY hash),
 outcome AS (
  SELECT k.hash, coalesce(b.error, f.error) AS error FROM kinds k JOIN broken b USING (hash) LEFT JOIN first_span f USING (hash))
SELECT error, count(*) AS n FROM outcome WHERE error IS NOT NULL GROUP BY error""",
)
def _(spark, sf):
    """Lines damaged by digest, written and read back; the reader names the first broken rule."""

    d = V.hex_digit(F.col("hash"), F.lit("line"))
    fields = lambda **change: F.to_json(
        F.struct(*[change.get(n, F.col(n)).alias(n) for n in ("hash", "text", "entities")])
    )
    line = (
        F.when(d == "0", "  ")
        .when(d == "1", "{not json")
        .when(d == "2", "[1]")
        .when(d == "3", fields(hash=F.lit(5)))
        .when(d == "4", fields(text=F.lit(True)))
        .when(d == "5", fields(entities=F.lit("none")))
        .otherwise(fields())
    )
    path = scratch(spark)
    V.noisy(spark, sf).select(line.alias("value")).write.text(path)
    from spanloom.sources.records import read_lines

    found = violations(parse_records(read_lines(spark, path)))
    return found.groupBy("error").agg(F.count("*").alias("n"))


@query(
    "write_jsonl",
    V.SQL_GOLD
    + """,
 lists AS (
  SELECT hash, string_agg('{"label":"' || label || '","start":' || start || ',"end":' || "end" || '}', ',' ORDER BY start)
    AS body FROM gold GROUP BY hash)
SELECT d.hash, md5('{"hash":"' || d.hash || '","text":"' || replace(replace(replace(d.text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n')
  || '","entities":[' || coalesce(body, '') || ']}') AS line_md5
FROM docs d LEFT JOIN lists USING (hash)""",
)
def _(spark, sf):
    path = scratch(spark)
    write_jsonl(V.gold(spark, sf), path)
    return spark.read.text(path).select(
        F.get_json_object("value", "$.hash").alias("hash"), F.md5("value").alias("line_md5")
    )


@query("write_report", REPORT + long_sql("report", "scope", ("records",)))
def _(spark, sf):
    path = scratch(spark)
    report = scoring.metric_report(gold_spans(spark, sf), pred_spans(spark, sf), V.docs(spark, sf))
    write_report(report, path)
    return long(spark.read.schema(report.schema).json(path), "scope")


@query(
    "dataset_fingerprint",
    """SELECT 'documents' AS dataset, count(*) AS rows, sum(('0x' || substr(sha256(
 """ + " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'N')" for c in ("doc_id", "text", "lang", "source", "n_chars"))
    + """), 1, 12))::BIGINT)::VARCHAR AS digest
FROM documents""",
)
def _(spark, sf):
    return table_fingerprint(V.table(spark, sf, "documents"), "documents")


@query(
    "file_digests",
    """SELECT count(*)::BIGINT * 33 AS length, sha256(string_agg(md5(coalesce(text, '')), chr(10) ORDER BY doc_id) || chr(10)) AS sha256
FROM documents GROUP BY lang""",
)
def _(spark, sf):
    """A file per language, of one line per document, digested in chunks that cut lines."""

    path = scratch(spark)
    lines = V.table(spark, sf, "documents").select("lang", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("value"))
    dealt = lines.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", "value")
    dealt.write.partitionBy("lang").text(path)
    digests = file_digests(spark, [path, f"{path}-absent"], whole=1000, chunk=1021)
    return digests.select("length", "sha256")


def _arrivals(spark, sf, folder):
    """Conversation turns written as request lines; every fourth digest repeats a line."""

    d = V.hex_digit(F.col("text"), F.col("turn"))
    record = F.to_json(F.struct(F.sha2("text", 256).alias("hash"), "text"))
    line = F.when(d == "0", F.lit("{broken")).when(d == "1", F.lit('{"hash":"x"}')).otherwise(record)
    lines = F.when(d.isin("2", "3", "4", "5"), F.array(line, line)).otherwise(F.array(line))
    turns = V.table(spark, sf, "conversations")
    turns.select(F.explode(lines).alias("value")).repartition(4, "value").write.text(folder)


def _drain(stream, spark, path):
    """Run a stream over everything that has arrived and read its sink."""

    schema = stream.schema
    run = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}-state")
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def batch_bytes(index_bytes: int) -> int:
    """Bytes of a batch that joins an index of ``index_bytes``: passes over the index stay a small part of the work."""

    return max(4 * 1024**3, 64 * index_bytes)


def _checked(spark, sf):
    """The table of all arrived lines, each accepted or rejected."""

    folder, table = scratch(spark), scratch(spark)
    _arrivals(spark, sf, folder)
    intake.use_state_store(spark)
    checked = intake.stream_checked(intake.parse_stream(intake.read_stream(spark, folder)))
    intake.write_checked(checked, table, f"{table}-state").awaitTermination()
    return spark.read.schema(checked.schema).parquet(table)


@query(
    "stream_intake",
    """SELECT DISTINCT sha256(text) AS hash, md5(text) AS text_md5 FROM conversations
WHERE substr(md5(text || '|' || turn), 1, 1) NOT IN ('0', '1')""",
)
def _(spark, sf):
    return intake.stream_intake(_checked(spark, sf)).select("hash", F.md5("text").alias("text_md5"))


@query(
    "stream_quarantine",
    """WITH turns AS (SELECT text, substr(md5(text || '|' || turn), 1, 1) AS d FROM conversations)
SELECT CASE d WHEN '0' THEN 'json' ELSE 'text' END AS error, count(*) AS n FROM turns WHERE d IN ('0', '1') GROUP BY d
UNION ALL SELECT 'duplicate_hash', (sum(CASE WHEN d IN ('2', '3', '4', '5') THEN 2 ELSE 1 END) - count(DISTINCT text))::BIGINT
FROM turns WHERE d NOT IN ('0', '1')""",
)
def _(spark, sf):
    bad = intake.stream_quarantine(_checked(spark, sf))
    return bad.groupBy("error").agg(F.count("*").alias("n"))


@query(
    "stream_normalize",
    V.SQL_ALIASES
    + f"""
SELECT s.hash, s.label, s.start, s."end", s.surface, coalesce(a.canonical, {V.sql_clean('s.surface')}) AS normalized
FROM surfaces s LEFT JOIN alias_index a
  ON a.error IS NULL AND a.label = s.label AND a.alias_key = {V.sql_key('s.surface')}""",
)
def _(spark, sf):
    folder = scratch(spark)
    write_jsonl(V.gold(spark, sf), folder)
    # the index is read in every batch, so it is computed once, and a batch is many times its size
    index = materialize(alias_index(V.aliases(V.gold_surfaces(spark, sf))))
    lines = intake.read_stream(spark, folder, bytes_per_trigger=batch_bytes(V.file_bytes(index)))
    parsed = intake.parse_stream(lines, require_entities=True)
    named = intake.stream_normalize(parsed.filter("error is null"), index)
    return _drain(named, spark, scratch(spark))
