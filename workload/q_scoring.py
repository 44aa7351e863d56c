"""Scoring and comparison."""

from pyspark.sql import functions as F

from spanloom.operators import scoring
from workload import views as V
from workload.registry import query

COUNTS = V.SQL_SPANS + """,
 keyed AS (
  SELECT coalesce(g.label, p.label) AS label, g.hash IS NOT NULL AS in_gold, p.hash IS NOT NULL AS in_pred
  FROM gold g FULL JOIN pred p
    ON g.hash = p.hash AND g.label = p.label AND g.start = p.start AND g."end" = p."end"),
 names(label, place) AS (VALUES ('ORG', 1), ('NAME', 2), ('GEO', 3)),
 counts AS (
  SELECT n.label, place, count(*) FILTER (WHERE in_gold AND in_pred) AS tp,
   count(*) FILTER (WHERE in_pred AND NOT in_gold) AS fp, count(*) FILTER (WHERE in_gold AND NOT in_pred) AS fn
  FROM names n LEFT JOIN keyed k ON k.label = n.label GROUP BY n.label, place)"""


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE ({part})::DOUBLE / ({whole}) END"


def metrics_sql(source: str, keys: str) -> str:
    return f"""SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE
      ELSE 2.0::DOUBLE * precision * recall / (precision + recall) END AS f1 FROM (
   SELECT {keys}, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall,
          tp, fp, fn, tp + fn AS gold, tp + fp AS predicted FROM {source})"""


BY_LABEL = COUNTS + f""",
 by_label AS ({metrics_sql('counts', 'label, place')}),
 summed AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM counts),
 micro AS ({metrics_sql('summed', "'micro' AS label, 4 AS place")}),
 macro AS (
  SELECT 'macro' AS label, sum(precision ORDER BY place) / 3 AS precision, sum(recall ORDER BY place) / 3 AS recall,
         sum(f1 ORDER BY place) / 3 AS f1 FROM by_label)"""

COLUMNS = "round(precision, 12) AS precision, round(recall, 12) AS recall, round(f1, 12) AS f1"
NUMBERS = "tp, fp, fn, gold, predicted"


METRICS = ("precision", "recall", "f1", "tp", "fp", "fn", "gold", "predicted")


def long_sql(source: str, keys: str, more: tuple[str, ...] = ()) -> str:
    """One row per metric, so that macro rows need no NULL counts."""

    return " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, round({m}::DOUBLE, 12) AS value FROM {source} WHERE {m} IS NOT NULL"
        for m in (*METRICS, *more)
    )


def long(df, *keys):
    """The wide report as ``(keys, metric, value)``."""

    names = [c for c in df.columns if c not in keys]
    values = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return values.unpivot(list(keys), names, "metric", "value").filter("value is not null").withColumn(
        "value", F.round("value", 12)
    )


def rounded(df):
    return df.select(
        *[F.round(c, 12).alias(c) if c in ("precision", "recall", "f1") else F.col(c) for c in df.columns]
    )


def gold_spans(spark, sf):
    return scoring.explode_spans(V.by_hash(V.gold(spark, sf), "hash", "entities"))


def pred_spans(spark, sf):
    return scoring.explode_spans(V.by_hash(V.pred(spark, sf), "hash", "entities"))


def compared(spark, sf):
    """Both sides of a comparison, dealt alike, so that their join shuffles nothing."""

    return V.by_hash(V.gold(spark, sf), "hash", "text", "entities"), V.by_hash(V.pred(spark, sf), "hash", "entities")


@query("exact_span_counts", COUNTS + " SELECT label, tp, fp, fn FROM counts")
def _(spark, sf):
    return scoring.exact_span_counts(gold_spans(spark, sf), pred_spans(spark, sf))


@query("prf_by_label", BY_LABEL + f" SELECT label, {COLUMNS}, {NUMBERS} FROM by_label")
def _(spark, sf):
    counts = scoring.exact_span_counts(gold_spans(spark, sf), pred_spans(spark, sf))
    return rounded(scoring.prf_by_label(counts))


@query("micro_metrics", BY_LABEL + f" SELECT {COLUMNS}, {NUMBERS} FROM micro")
def _(spark, sf):
    return rounded(
        scoring.micro_metrics(scoring.exact_span_counts(gold_spans(spark, sf), pred_spans(spark, sf)))
    )


@query("macro_metrics", BY_LABEL + f" SELECT {COLUMNS} FROM macro")
def _(spark, sf):
    counts = scoring.exact_span_counts(gold_spans(spark, sf), pred_spans(spark, sf))
    return rounded(scoring.macro_metrics(scoring.prf_by_label(counts)))


REPORT = BY_LABEL + f""",
 report AS (
  SELECT *, (SELECT count(*) FROM docs) AS records FROM (
   SELECT label AS scope, precision, recall, f1, {NUMBERS} FROM by_label
   UNION ALL SELECT label, precision, recall, f1, {NUMBERS} FROM micro
   UNION ALL SELECT label, precision, recall, f1, NULL, NULL, NULL, NULL, NULL FROM macro))"""


@query("metric_report", REPORT + long_sql("report", "scope", ("records",)))
def metric_report(spark, sf):
    report = scoring.metric_report(gold_spans(spark, sf), pred_spans(spark, sf), V.docs(spark, sf))
    return long(report, "scope")


SPLITS = V.SQL_GOLD + "".join(
    f""",
 tags{epoch} AS (
  SELECT *, CASE WHEN b = '0' THEN 'O' WHEN a IN ('0','1') THEN 'ORG' WHEN a IN ('2','3') AND b = '1' THEN 'ORG'
        WHEN a IN ('2','3') THEN 'NAME' WHEN a = '4' THEN 'GEO' WHEN a = '5' AND b = '2' THEN 'GEO'
        ELSE 'O' END AS p
  FROM (SELECT * EXCLUDE (b), substr(md5(tok || '|' || ord || '|' || pos || '|{epoch}'), 1, 1) AS b FROM digits))"""
    + V._runs(f"pred{epoch}", "p").replace("FROM tags", f"FROM tags{epoch}")
    for epoch in (1, 2, 3)
) + """,
 splits AS (
  SELECT o.ord, coalesce('q' || quality, 'none') AS split FROM docs o LEFT JOIN labels l ON l.doc_id = o.ord
  UNION ALL SELECT doc_id, 'again' FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'silent' FROM labels WHERE quality = 0),
 sizes AS (SELECT split, count(*) AS records FROM splits GROUP BY split),
 preds AS (SELECT 1 AS epoch, * FROM pred1 UNION ALL SELECT 2, * FROM pred2 UNION ALL SELECT 3, * FROM pred3),
 hits AS (
  SELECT split, epoch, p.label, count(g.hash) AS tp, count(*) AS n
  FROM preds p JOIN splits USING (ord) LEFT JOIN gold g
    ON g.hash = p.hash AND g.label = p.label AND g.start = p.start AND g."end" = p."end"
  WHERE split <> 'silent' GROUP BY split, epoch, p.label),
 totals AS (SELECT split, label, count(*) AS n FROM gold JOIN splits USING (ord) GROUP BY split, label),
 names(label, place) AS (VALUES ('ORG', 1), ('NAME', 2), ('GEO', 3)),
 counts AS (
  SELECT s.split, s.epoch, names.label, place, coalesce(h.tp, 0) AS tp, coalesce(h.n, 0) - coalesce(h.tp, 0) AS fp,
         coalesce(t.n, 0) - coalesce(h.tp, 0) AS fn
  FROM (SELECT split, unnest([1, 2, 3]) AS epoch FROM sizes) s CROSS JOIN names
  LEFT JOIN hits h ON h.split = s.split AND h.epoch = s.epoch AND h.label = names.label
  LEFT JOIN totals t ON t.split = s.split AND t.label = names.label)""" + f""",
 by_label AS ({metrics_sql('counts', 'split, epoch, label AS scope, place')}),
 summed AS (SELECT split, epoch, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn
   FROM counts GROUP BY split, epoch),
 micro AS ({metrics_sql('summed', "split, epoch, 'micro' AS scope")}),
 macro AS (
  SELECT split, epoch, 'macro' AS scope, sum(precision ORDER BY place) / 3 AS precision,
   sum(recall ORDER BY place) / 3 AS recall, sum(f1 ORDER BY place) / 3 AS f1 FROM by_label GROUP BY split, epoch),
 report AS (
  SELECT split, epoch, scope, precision, recall, f1, {NUMBERS} FROM by_label
  UNION ALL SELECT split, epoch, scope, precision, recall, f1, {NUMBERS} FROM micro
  UNION ALL SELECT split, epoch, scope, precision, recall, f1, NULL, NULL, NULL, NULL, NULL FROM macro)"""


def _split_report(spark, sf):
    """Splits by quality, one for unlabelled texts, one of texts that are in another one as
    well, and one without predictions."""

    labels = V.table(spark, sf, "labels").withColumnRenamed("doc_id", "ord")
    docs = V.docs(spark, sf)
    by_quality = docs.join(labels, "ord", "left").withColumn(
        "split", F.coalesce(F.concat(F.lit("q"), F.col("quality")), F.lit("none"))
    )
    more = labels.select(
        "ord",
        F.explode(
            F.array_compact(
                F.array(F.when(F.col("toxic") == 1, F.lit("again")), F.when(F.col("quality") == 0, F.lit("silent")))
            )
        ).alias("split"),
    )
    columns = ["ord", "hash", "text", "split"]
    # the spans of both sides are met by hash, so the records are dealt by it and not the many spans
    base = V.spread(by_quality.select(columns).union(docs.join(more, "ord").select(columns)), "hash")
    gold = V.by_hash(base.select("hash", "split", V.gold_entities(F.col("text")).alias("entities")))
    epochs = base.filter("split <> 'silent'").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(3))))
    preds = V.by_hash(
        epochs.select("hash", "split", "epoch", V.pred_entities(F.col("text"), F.col("epoch")).alias("entities"))
    )
    return scoring.metrics_by_split(
        scoring.explode_spans(gold, "split"), scoring.explode_spans(preds, "split", "epoch"), base.select("hash", "split")
    )


@query("metrics_by_split", SPLITS + ", sized AS (SELECT * FROM report JOIN sizes USING (split))" + long_sql("sized", "split, epoch, records, scope"))
def _(spark, sf):
    return long(_split_report(spark, sf), "split", "epoch", "records", "scope")


@query(
    "best_epoch",
    SPLITS
    + """ SELECT run, epoch, round(f1, 12) AS f1 FROM (
 SELECT split AS run, epoch, f1, row_number() OVER (PARTITION BY split ORDER BY f1 DESC, epoch) AS n
 FROM report WHERE scope = 'micro') WHERE n = 1""",
)
def _(spark, sf):
    history = _split_report(spark, sf).filter("scope = 'micro'").select(
        F.col("split").alias("run"), "epoch", "f1"
    )
    return rounded(scoring.best_epoch(history))


@query(
    "weighted_mean",
    V.SQL_TOK
    + """
SELECT lang, round(sum(v * w) / sum(w), 9) AS mean, sum(w)::BIGINT AS weight FROM (
 SELECT d.lang, ('0x' || substr(md5(o.hash || '|loss'), 1, 2))::BIGINT / 256.0::DOUBLE AS v, d.n_chars AS w
 FROM docs o JOIN documents d ON d.doc_id = o.ord) GROUP BY lang""",
)
def _(spark, sf):
    losses = V.table(spark, sf, "documents").select(
        "lang",
        F.col("n_chars").alias("w"),
        (V.hex_number(F.concat_ws("-", "source", "doc_id"), F.lit("loss")) / F.lit(256.0)).alias("v"),
    )
    return scoring.weighted_mean(losses, "v", "w", "lang").withColumn("mean", F.round("mean", 9))


STATUS = V.SQL_SPANS + """,
 both_sides AS (
  SELECT 'gold' AS side, hash, label, start, "end" FROM gold
  UNION ALL SELECT 'pred', hash, label, start, "end" FROM pred),
 near AS (
  SELECT a.side, a.hash, a.label, a.start, a."end",
   bool_or(b.label = a.label AND b.start = a.start AND b."end" = a."end") AS same, count(b.hash) AS touching
  FROM both_sides a LEFT JOIN both_sides b
    ON b.hash = a.hash AND b.side <> a.side AND b.start < a."end" AND a.start < b."end"
  GROUP BY ALL),
 statuses AS (
  SELECT side, hash, label, start, "end", CASE WHEN same THEN 'correct' WHEN touching > 0 THEN 'boundary_error'
   WHEN side = 'gold' THEN 'missed' ELSE 'false_positive' END AS status FROM near)"""


@query("entity_status", STATUS + " SELECT * FROM statuses")
def _(spark, sf):
    return scoring.entity_status(gold_spans(spark, sf), pred_spans(spark, sf))


@query(
    "status_counts",
    STATUS
    + """ SELECT side, label, count(*) FILTER (WHERE status = 'correct') AS correct,
 count(*) FILTER (WHERE status = 'boundary_error') AS boundary_error,
 count(*) FILTER (WHERE status = 'missed') AS missed,
 count(*) FILTER (WHERE status = 'false_positive') AS false_positive FROM statuses GROUP BY side, label""",
)
def _(spark, sf):
    return scoring.status_counts(scoring.entity_status(gold_spans(spark, sf), pred_spans(spark, sf)))


@query(
    "status_lines",
    STATUS
    + """
SELECT side, s.hash, label, start, "end", surface, status,
 '  - ' || label || ': [' || start || ':' || "end" || '] ' ||
 CASE WHEN contains(surface, '''') AND NOT contains(surface, '"') THEN '"' || e || '"'
      ELSE '''' || replace(e, '''', '\\''') || '''' END || ' (' || status || ')' AS line
FROM (SELECT *, replace(replace(surface, '\\', '\\\\'), chr(10), '\\n') AS e FROM (
  SELECT s.*, substring(d.text, start + 1, "end" - start) AS surface FROM statuses s JOIN docs d USING (hash))) s""",
)
def _(spark, sf):
    from spanloom.operators import report

    gold, pred = V.gold(spark, sf), V.pred(spark, sf)
    lines = (
        report.entity_lines(gold)
        .withColumn("side", F.lit("gold"))
        .unionByName(report.entity_lines(pred).withColumn("side", F.lit("pred")))
    )
    # the lines are shuffled as rows, so only what the statuses need is dealt by hash
    spans = [scoring.explode_spans(V.by_hash(records, "hash", "entities")) for records in (gold, pred)]
    return report.status_lines(*spans, lines)


@query(
    "compare_join",
    V.SQL_SPANS
    + """
SELECT d.hash, length(d.text) AS n_chars, count(g.hash) AS gold_entities,
 (SELECT count(*) FROM pred p WHERE p.hash = d.hash) AS pred_entities
FROM docs d LEFT JOIN gold g ON g.hash = d.hash GROUP BY d.hash, d.text""",
)
def _(spark, sf):
    return scoring.compare_join(*compared(spark, sf)).select(
        "hash",
        F.length("text").cast("bigint").alias("n_chars"),
        F.size("gold_entities").cast("bigint").alias("gold_entities"),
        F.size("pred_entities").cast("bigint").alias("pred_entities"),
    )


SEGMENTS = V.SQL_SPANS + """,
 bounds AS (
  SELECT hash, 0 AS here FROM docs UNION SELECT hash, length(text) FROM docs
  UNION SELECT hash, start FROM gold UNION SELECT hash, "end" FROM gold
  UNION SELECT hash, start FROM pred UNION SELECT hash, "end" FROM pred),
 parts AS (
  SELECT * FROM (SELECT hash, here, lead(here) OVER (PARTITION BY hash ORDER BY here) AS upto FROM bounds)
  WHERE upto IS NOT NULL),
 judged AS (
  SELECT s.hash, s.here, s.upto, CASE
    WHEN g.hash IS NOT NULL AND p.hash IS NOT NULL THEN
      CASE WHEN g.label = p.label AND g.start = p.start AND g."end" = p."end" THEN 'correct' ELSE 'boundary_error' END
    WHEN g.hash IS NOT NULL THEN 'missed' WHEN p.hash IS NOT NULL THEN 'false_positive' END AS status
  FROM parts s LEFT JOIN gold g ON g.hash = s.hash AND g.start <= s.here AND s.here < g."end"
  LEFT JOIN pred p ON p.hash = s.hash AND p.start <= s.here AND s.here < p."end"),
 merged AS (
  SELECT hash, min(here) AS start, max(upto) AS "end", any_value(status) AS status FROM (
   SELECT *, sum(flip) OVER (PARTITION BY hash ORDER BY here) AS run FROM (
    SELECT *, CASE WHEN row_number() OVER w = 1 OR status IS DISTINCT FROM lag(status) OVER w THEN 1 ELSE 0 END AS flip
    FROM judged WINDOW w AS (PARTITION BY hash ORDER BY here)))
  GROUP BY hash, run)"""


@query(
    "comparison_segments",
    SEGMENTS
    + """ SELECT m.hash, start, "end", status, substring(d.text, start + 1, "end" - start) AS piece
FROM merged m JOIN docs d USING (hash)""",
)
def _(spark, sf):
    return scoring.comparison_segments(scoring.compare_join(*compared(spark, sf)))


@query(
    "mark_comparison",
    SEGMENTS
    + """ SELECT hash, md5(string_agg(CASE WHEN status IS NULL THEN piece ELSE '[' || status || ':' || piece || ']' END,
  '' ORDER BY start)) AS marked_md5 FROM (
 SELECT m.hash, start, status, substring(d.text, start + 1, "end" - start) AS piece
 FROM merged m JOIN docs d USING (hash)) GROUP BY hash""",
)
def _(spark, sf):
    pairs = scoring.compare_join(*compared(spark, sf))
    marked = scoring.mark_comparison(F.col("text"), F.col("gold_entities"), F.col("pred_entities"))
    return pairs.select("hash", F.md5(marked).alias("marked_md5"))


@query(
    "label_segments",
    V.SQL_GOLD
    + """,
 parts AS (
  SELECT hash, start, "end", label FROM gold
  UNION ALL
  SELECT hash, coalesce(lag("end") OVER (PARTITION BY hash ORDER BY start), 0), start, NULL FROM gold
  UNION ALL
  SELECT d.hash, coalesce(max(g."end"), 0), length(d.text), NULL FROM docs d LEFT JOIN gold g ON g.hash = d.hash
  GROUP BY d.hash, d.text)
SELECT p.hash, start, "end", label, substring(d.text, start + 1, "end" - start) AS piece
FROM parts p JOIN docs d USING (hash) WHERE start < "end" """,
)
def _(spark, sf):
    return scoring.label_segments(V.gold(spark, sf))


@query("entity_counts", V.SQL_GOLD + " SELECT label, count(*) AS entities FROM gold GROUP BY label")
def _(spark, sf):
    return scoring.entity_counts(V.gold(spark, sf))
