"""The whole augmentation of a training set."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import augment as A
from spanloom.operators.typography import surfaces


def augment_records(
    records: DataFrame,
    surface_tokens: DataFrame,
    token_vectors: DataFrame,
    *,
    enabled: bool = True,
    probability: float,
    num_clusters: int,
    max_candidates: int,
    seed: int,
) -> tuple[DataFrame, DataFrame]:
    """Originals plus one variant of each selected record, and the statistics.

    Switched off (or with probability 0) the input comes back, and the statistics say that
    nothing was added and, as ``skipped``, why.
    """

    if not 0.0 <= probability <= 1.0:
        raise ValueError("augmentation probability must be in [0, 1]")
    if num_clusters < 1 or max_candidates < 1:
        raise ValueError("num_clusters and max_candidates must be positive")
    if not enabled or probability == 0.0:
        reason = "disabled" if not enabled else "probability is 0"
        n = records.agg(F.count("*").alias("n")).select(
            F.col("n").alias("input_records"), F.lit(0).cast("bigint").alias("added_records"),
            F.lit(0).cast("bigint").alias("replaced_entities"), F.col("n").alias("output_records"),
            F.lit(0).cast("bigint").alias("cluster_count"),
        )
        stats = n.unpivot([], list(n.columns), "metric", "value").withColumn("skipped", F.lit(reason))
        return records, stats
    vectors = A.surface_vectors(surface_tokens, token_vectors)
    clustered = A.cluster_surfaces(vectors, num_clusters, seed)
    neighbours = A.cluster_neighbours(clustered, max_candidates)
    chosen = A.select_for_augmentation(records, probability, seed)
    replacements = A.pick_replacement(surfaces(chosen), neighbours, seed)
    rewritten = A.rewrite_record(records, replacements)
    stats = A.augmentation_stats(records, rewritten, clustered)
    return A.augment_append(records, rewritten), stats
