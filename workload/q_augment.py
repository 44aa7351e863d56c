"""Augmentation: surfaces, vectors, clusters, neighbours, rewriting."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from spanloom.operators import augment as A
from spanloom.operators.materialize import materialize
from spanloom.operators.scoring import explode_spans
from workload import views as V
from workload.registry import query


@query(
    "entity_surfaces",
    V.SQL_SURFACES + " SELECT DISTINCT label, surface FROM surfaces WHERE trim(surface, ' ' || chr(10)) <> ''",
)
def _(spark, sf):
    return A.entity_surfaces(V.gold(spark, sf))


def token_vectors(spark, sf):
    return V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("vector")
    )


def surface_tokens(spark, sf):
    """Distinct surfaces with token ids into ``embeddings``."""

    vocabulary = V.table(spark, sf, "embeddings").agg(F.count("*").alias("n")).scalar()
    surfaces = A.entity_surfaces(V.gold(spark, sf)).withColumn("n", vocabulary)
    number = lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("bigint")
    return surfaces.select(
        "label", "surface", F.transform(F.split("surface", " "), lambda t: F.pmod(number(t), F.col("n"))).alias("tokens")
    )


@query(
    "surface_vectors",
    V.SQL_SURFACES
    + """,
 names AS (SELECT DISTINCT label, surface FROM surfaces WHERE trim(surface, ' ' || chr(10)) <> ''),
 ids AS (
  SELECT label, surface, unnest(string_split(surface, ' ')) AS t FROM names),
 coords AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
 means AS (
  SELECT label, surface, dim, avg(v) AS v FROM ids
  JOIN coords ON vec_id = ('0x' || substr(md5(t), 1, 6))::BIGINT % (SELECT count(*) FROM embeddings)
  GROUP BY label, surface, dim)
SELECT label, surface, round(first(v ORDER BY dim) / sqrt(sum(v * v)), 6) AS first_value,
       round(last(v ORDER BY dim) / sqrt(sum(v * v)), 6) AS last_value, round(sum(abs(v)) / sqrt(sum(v * v)), 5) AS norm1
FROM means GROUP BY label, surface""",
)
def _(spark, sf):
    vectors = A.surface_vectors(surface_tokens(spark, sf), token_vectors(spark, sf))
    norm1 = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x))
    return vectors.select(
        "label",
        "surface",
        F.round(F.get("vector", F.lit(0)), 6).alias("first_value"),
        F.round(F.element_at("vector", -1), 6).alias("last_value"),
        F.round(norm1, 5).alias("norm1"),
    )


def clustered(spark, sf):
    vectors = A.surface_vectors(surface_tokens(spark, sf), token_vectors(spark, sf))
    return A.cluster_surfaces(vectors, num_clusters=16, seed=42)


@query(
    "cluster_surfaces",
    V.SQL_SURFACES
    + """,
 names AS (SELECT DISTINCT label, surface FROM surfaces WHERE trim(surface, ' ' || chr(10)) <> '')
SELECT label, surface, least(16, greatest(1, count(*) OVER (PARTITION BY label) // 2))::BIGINT AS clusters, true AS at_home FROM names""",
)
def _(spark, sf):
    """Every surface lies in one of its label's clusters and, at the fixed point, nowhere nearer than to its own mean."""

    found = materialize(clustered(spark, sf))
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("vector"))))
    centroids = found.groupBy("label", "cluster").agg(A.unit(mean).alias("centroid"))
    # at most labels x 16 rows
    listed = centroids.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("all"))
    nearness = F.transform("all", lambda c: F.struct(c["cluster"].alias("cluster"), A.dot(F.col("vector"), c["centroid"]).alias("dot")))
    judged = found.join(F.broadcast(listed), "label").withColumn("near", nearness)
    own = F.array_max(F.transform("near", lambda c: F.when(c["cluster"] == F.col("cluster"), c["dot"])))
    best = F.array_max(F.transform("near", lambda c: c["dot"]))
    sizes = found.groupBy("label").agg(F.least(F.lit(16), F.greatest(F.lit(1), F.floor(F.count("*") / 2))).cast("bigint").alias("clusters"))
    return judged.join(F.broadcast(sizes), "label").select(
        "label", "surface", "clusters", ((own >= best - 1e-9) & (F.col("cluster") < F.col("clusters"))).alias("at_home")
    )


UNIT = """WITH
 units AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding,
    lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"""


@query(
    "assign_centroid",
    UNIT
    + """,
 dims AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM units),
 means AS (SELECT label, dim, avg(x) AS x FROM dims GROUP BY label, dim),
 centroids AS (SELECT label AS cluster, list(x ORDER BY dim) AS c FROM means GROUP BY label)
SELECT vec_id, cluster, round(s, 6) AS similarity FROM (
 SELECT vec_id, cluster, list_inner_product(v, c) AS s,
        row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(v, c) DESC, cluster) AS n
 FROM units, centroids) WHERE n = 1""",
)
def _(spark, sf):
    units = V.unit_embeddings(spark, sf)
    dims = units.select("label", F.posexplode("vector").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    means = F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"])
    centroids = dims.groupBy(F.col("label").alias("cluster")).agg(means.alias("centroid"))
    assigned = A.assign_centroid(units.select("vec_id", "vector"), centroids)
    return assigned.select("vec_id", "cluster", F.round("similarity", 6).alias("similarity"))


@query(
    "cluster_neighbours",
    UNIT
    + """
SELECT label, surface, rank, candidate, round(s, 6) AS similarity FROM (
 SELECT 'L' || a.label AS label, 'v' || a.vec_id AS surface, 'v' || b.vec_id AS candidate, list_inner_product(a.v, b.v) AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, 'v' || b.vec_id) AS rank
 FROM units a JOIN units b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 3""",
)
def cluster_neighbours(spark, sf):
    vectors = V.unit_embeddings(spark, sf).select(
        F.concat(F.lit("L"), "label").alias("label"),
        F.col("label").alias("cluster"),
        F.concat(F.lit("v"), "vec_id").alias("surface"),
        "vector",
    )
    found = A.cluster_neighbours(vectors, max_candidates=3)
    return found.withColumn("similarity", F.round("similarity", 6))


SEED, PROBABILITY = 42, 0.15


def picked(spark, sf):
    chosen = A.select_for_augmentation(V.gold(spark, sf), PROBABILITY, SEED)
    from spanloom.operators.typography import surfaces

    return A.pick_replacement(surfaces(chosen), V.options(spark, sf), SEED)


@query("select_for_augmentation", V.SQL_OPTIONS + " SELECT ord, hash FROM chosen_docs")
def _(spark, sf):
    return A.select_for_augmentation(V.docs(spark, sf), PROBABILITY, SEED).select("ord", "hash")


@query("pick_replacement", V.SQL_OPTIONS + ' SELECT hash, label, start, "end", surface, replacement FROM picked')
def _(spark, sf):
    return picked(spark, sf)


def rewritten(spark, sf):
    return A.rewrite_record(V.by_hash(V.gold(spark, sf)), picked(spark, sf))


@query(
    "rewrite_record",
    V.SQL_OPTIONS + " SELECT ord, source_hash, md5(text) AS text_md5, starts, ends, replaced FROM rewritten",
)
def _(spark, sf):
    total = lambda field: F.aggregate(
        F.transform("entities", lambda e: e[field]), F.lit(0).cast("bigint"), lambda s, x: s + x
    )
    return rewritten(spark, sf).select(
        "ord", "source_hash", F.md5("text").alias("text_md5"), total("start").alias("starts"),
        total("end").alias("ends"), "replaced",
    )


@query(
    "augment_append",
    V.SQL_OPTIONS
    + """,
 numbered AS (SELECT *, row_number() OVER (ORDER BY ord) AS variant FROM rewritten)
SELECT ord, hash, 'none' AS source_hash, 0 AS variant FROM docs
UNION ALL
SELECT (SELECT max(ord) FROM docs) + variant, 'cluster-' || sha256(source_hash || chr(0) || 'cluster' || chr(0) || variant
  || chr(0) || text), source_hash, variant FROM numbered""",
)
def _(spark, sf):
    both = A.augment_append(V.gold(spark, sf), rewritten(spark, sf), block=1000)
    return both.select(
        "ord",
        "hash",
        F.coalesce("augmentation.source_hash", F.lit("none")).alias("source_hash"),
        F.coalesce("augmentation.variant", F.lit(0)).cast("bigint").alias("variant"),
    )


@query("augment_records")
def _(spark, sf):
    """Select, embed, cluster, find neighbours, replace, rewrite and append in one go."""

    from spanloom.plans.augment import augment_records

    both, _ = augment_records(
        V.gold(spark, sf),
        surface_tokens(spark, sf),
        token_vectors(spark, sf),
        probability=PROBABILITY,
        num_clusters=16,
        max_candidates=3,
        seed=SEED,
    )
    return both.select("ord", "hash", F.md5("text").alias("text_md5"), F.size("entities").alias("entities"))
