"""Token windows, alignment, scoring and decoding."""

from pyspark.sql import functions as F

from spanloom.operators.rows import each
from spanloom.functions.scorers import load_digest_scorer
from spanloom.operators import decode as D
from spanloom.operators import windows as N
from spanloom.operators.overlap import select_non_overlapping
from spanloom.operators.scoring import explode_spans
from workload import views as V
from workload.registry import query

RAGGED = V.SQL_RAGGED + V.windows_sql()


def ragged_windows(spark, sf, stride=V.STRIDE):
    return N.token_windows(V.ragged(spark, sf), V.MAX_LENGTH, stride)


def parted(spark, sf, stride=V.STRIDE):
    return N.partition_entities(N.window_bounds(ragged_windows(spark, sf, stride)))


@query("tokenize_offsets", V.SQL_TOK + ' SELECT hash, pos, tok, start, "end" FROM tok')
def _(spark, sf):
    return each(N.tokenize_offsets(V.docs(spark, sf)), ["hash"], "tokens")


@query(
    "token_windows",
    RAGGED
    + """
SELECT hash, window_id, i, start, "end" FROM wtok
UNION ALL SELECT hash, window_id, 0, 0, 0 FROM wins
UNION ALL SELECT hash, window_id, max(i) + 1, 0, 0 FROM wtok GROUP BY hash, window_id""",
)
def _(spark, sf):
    rows = V.windows(spark, sf).select("hash", "window_id", F.posexplode("tokens").alias("i", "t"))
    return rows.select("hash", "window_id", F.col("i").cast("bigint").alias("i"), "t.start", "t.end")


@query(
    "align_bio",
    V.SQL_RAGGED
    + """,
 first_span AS (
  SELECT t.hash, t.pos, t.start AS ts, t."end" AS te, e.label, e.start, e."end",
         row_number() OVER (PARTITION BY t.hash, t.pos ORDER BY e.start) AS n
  FROM tok t LEFT JOIN ragged e ON e.hash = t.hash AND e."end" > t.start AND e.start < t."end")
SELECT hash, pos, CASE WHEN label IS NULL THEN 'O' WHEN start >= ts THEN 'B-' || label ELSE 'I-' || label END AS tag
FROM first_span WHERE n = 1""",
)
def _(spark, sf):
    from spanloom.schema import TAGS

    rows = each(N.align_bio(V.ragged(spark, sf)), ["hash"], "tokens")
    return rows.select("hash", "pos", F.get(F.lit(list(TAGS)), F.col("tag").cast("int")).alias("tag"))


@query("window_bounds", RAGGED + " SELECT * FROM wbounds")
def _(spark, sf):
    return N.window_bounds(V.windows(spark, sf)).select("hash", "window_id", "window_start", "window_end")


@query("partition_entities", RAGGED + ' SELECT hash, window_id, label, start, "end", part FROM wparts')
def _(spark, sf):
    rows = parted(spark, sf)
    both = F.concat(
        F.transform("complete", lambda e: e.withField("part", F.lit("complete"))),
        F.transform("partial", lambda e: e.withField("part", F.lit("partial"))),
    )
    return each(rows, ["hash", "window_id"], both).select("hash", "window_id", "label", "start", "end", "part")


@query("span_mask", RAGGED + " SELECT hash, window_id, i, usable FROM wmask")
def _(spark, sf):
    rows = N.span_mask(parted(spark, sf))
    inner = F.slice("mask", F.lit(2), F.size("mask") - 2)
    return rows.select("hash", "window_id", F.posexplode(inner).alias("i", "usable")).withColumn(
        "i", (F.col("i") + 1).cast("bigint")
    )


@query("entity_token_span", RAGGED + " SELECT * FROM wspans")
def _(spark, sf):
    return N.entity_token_span(parted(spark, sf))


@query(
    "span_targets",
    RAGGED
    + """ SELECT hash, window_id, CASE label WHEN 'ORG' THEN 0 WHEN 'NAME' THEN 1 ELSE 2 END::BIGINT AS label_id,
 token_start, token_end FROM wspans""",
)
def _(spark, sf):
    targets = N.span_targets(parted(spark, sf))
    return targets.select("hash", "window_id", F.col("label_id").cast("bigint").alias("label_id"), "token_start", "token_end")


@query(
    "coverage_check",
    V.SQL_RAGGED
    + V.windows_sql(stride=0)
    + """
SELECT hash, label, start, "end" FROM ragged ANTI JOIN (
 SELECT s.* FROM wspans s JOIN (
  SELECT hash, window_id FROM wmask GROUP BY hash, window_id HAVING bool_or(usable)) u USING (hash, window_id)) t
USING (hash, label, start, "end")""",
)
def _(spark, sf):
    masked = N.span_mask(parted(spark, sf, stride=0))
    return N.coverage_check(explode_spans(V.ragged(spark, sf)), N.span_targets(N.usable(masked)))


@query(
    "trainable_windows",
    RAGGED
    + """
SELECT count(*) AS windows, count(*) FILTER (WHERE ok) AS trainable, count(*) FILTER (WHERE cut > 0) AS with_partial
FROM (SELECT w.hash, w.window_id, coalesce(bool_or(m.usable), false) AS ok,
  (SELECT count(*) FROM wparts p WHERE p.hash = w.hash AND p.window_id = w.window_id AND part = 'partial') AS cut
 FROM wins w LEFT JOIN wmask m ON m.hash = w.hash AND m.window_id = w.window_id GROUP BY w.hash, w.window_id)""",
)
def _(spark, sf):
    return N.trainable_windows(N.span_mask(parted(spark, sf)))


SCORED = V.SQL_RAGGED + V.SQL_SCORED


@query("score_windows", SCORED + " SELECT hash, window_id, label_id, token_start, token_end, score FROM wscores")
def _(spark, sf):
    scored = D.score_windows(V.windows(spark, sf), load_digest_scorer)
    return each(scored, ["hash", "window_id"], "scores")


@query("threshold_spans", SCORED + ' SELECT hash, window_id, label, start, "end", score FROM wcands')
def _(spark, sf):
    return D.threshold_spans(V.scored(spark, sf), 0.0)


@query("max_merge_spans", SCORED + ' SELECT hash, label, start, "end", score FROM merged')
def _(spark, sf):
    return D.max_merge_spans(D.threshold_spans(V.scored(spark, sf), 0.0))


@query(
    "select_non_overlapping",
    V.SQL_NESTED + V.greedy_sql("candidates", '-score, start, start - "end", label'),
)
def _(spark, sf):
    return select_non_overlapping(V.candidates(spark, sf))


@query(
    "decode_span_records",
    (SCORED + V.greedy_sql("merged", '-score, start, start - "end", label')).rsplit("SELECT", 1)[0]
    + """
SELECT d.hash, count(k.hash) AS entities, coalesce(sum(k.start), 0)::BIGINT AS starts, coalesce(sum(k."end"), 0)::BIGINT AS ends
FROM docs d LEFT JOIN kept k ON k.hash = d.hash GROUP BY d.hash""",
)
def decode_span_records(spark, sf):
    return totals(D.decode_span_records(V.scored(spark, sf), V.docs(spark, sf), 0.0))


def totals(predictions):
    """Entity count and offset sums of each prediction."""

    total = lambda field: F.aggregate(
        F.transform("entities", lambda e: e[field]), F.lit(0).cast("bigint"), lambda s, x: s + x
    )
    return predictions.select(
        "hash",
        F.size("entities").cast("bigint").alias("entities"),
        total("start").alias("starts"),
        total("end").alias("ends"),
    )


CLASSES = V.SQL_RAGGED + V.SQL_CLASSES


@query(
    "mean_token_scores",
    CLASSES
    + """ SELECT hash, class_id, count(*) AS tokens, round(sum(p), 6) AS p, sum(start)::BIGINT AS starts FROM means
GROUP BY hash, class_id""",
)
def _(spark, sf):
    means = D.mean_token_scores(D.token_scores(V.class_scores(spark, sf)))
    return means.groupBy("hash", "class_id").agg(
        F.count("*").alias("tokens"), F.round(F.sum("p"), 6).alias("p"), F.sum("start").alias("starts")
    )


@query("argmax_tag", CLASSES + ' SELECT hash, start, "end", tag FROM best')
def _(spark, sf):
    return D.argmax_tag(D.mean_token_scores(D.token_scores(V.class_scores(spark, sf))))


@query("decode_bio", CLASSES + ' SELECT hash, label, start, "end" FROM bio')
def _(spark, sf):
    return D.decode_bio(D.argmax_tag(D.mean_token_scores(D.token_scores(V.class_scores(spark, sf)))))


@query(
    "decode_tag_records",
    CLASSES
    + """
SELECT d.hash, count(k.hash) AS entities, coalesce(sum(k.start), 0)::BIGINT AS starts, coalesce(sum(k."end"), 0)::BIGINT AS ends
FROM docs d LEFT JOIN bio k ON k.hash = d.hash GROUP BY d.hash""",
)
def decode_tag_records(spark, sf):
    return totals(D.decode_tag_records(D.token_scores(V.class_scores(spark, sf)), V.docs(spark, sf)))
