"""Augmentation: similar same-label surfaces and rewritten records."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spanloom.operators.rows import each
from spanloom.functions.arrays import index_by_end, last_end, let, running_sum
from spanloom.functions.text import augmented_hash, characters, cut, seeded_key, seeded_number
from spanloom.operators.joins import is_small, lookup_join
from spanloom.operators.materialize import materialize
from spanloom.operators.ordered import number_rows
from spanloom.operators.typography import surfaces
from spanloom.schema import LABELS

NEIGHBOUR_BLOCK = 2048
HELD = 64 * 1024 * 1024  # bytes of a block's vectors; a task holds two blocks
CELLS = 4096  # per unit of distance
CELL_ROWS = 1_000_000  # cells of all clusters that are copied to every executor
SLACK = 1e-6  # rounding of similarities


def entity_surfaces(records: DataFrame) -> DataFrame:
    """Distinct non-blank ``(label, surface)``."""

    blank = F.col("surface").rlike(r"(?U)^[\s\x1c-\x1f]*$")
    return surfaces(records).filter(~blank).select("label", "surface").distinct()


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of doubles."""

    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """Vector scaled to length 1."""

    return let(
        vector,
        lambda v: let(
            F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n)
        ),
    )


def surface_vectors(surface_tokens: DataFrame, token_vectors: DataFrame) -> DataFrame:
    """``(label, surface, vector)``: normalized mean of the token vectors of a surface.

    ``surface_tokens`` is ``(label, surface, tokens)``, all tokens of which count;
    ``token_vectors`` is ``(token, vector)``.  Frequent tokens would make hot join
    keys, hence ``lookup_join``; the mean is combined on the map side.
    """

    rows = each(surface_tokens, ["label", "surface"], "tokens", "token")
    joined = lookup_join(rows, token_vectors, ["token"], "inner")
    mean = joined.groupBy("label", "surface").agg(
        Summarizer.mean(array_to_vector(F.col("vector"))).alias("mean")
    )
    return mean.select("label", "surface", unit(vector_to_array("mean")).alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as the rows of a matrix."""

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _start_centroids(vectors: DataFrame, num_clusters: int, seed: int) -> dict[str, np.ndarray]:
    """For each label the vectors of its first surfaces by seeded digest, ``min(num_clusters, n // 2)`` of them."""

    sizes = {r["label"]: r["n"] for r in vectors.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = W.partitionBy("label").orderBy(seeded_key(seed, F.concat_ws("|", "label", "surface")), "surface")
    # each task passes on its own first ones, so labels may have any size
    first = vectors.withColumn("draw", F.row_number().over(drawn)).filter(F.col("draw") <= num_clusters)
    rows = first.select("label", "draw", "vector").orderBy("label", "draw").collect()
    found: dict[str, list] = {}
    for r in rows:
        if r["draw"] <= max(1, sizes[r["label"]] // 2):
            found.setdefault(r["label"], []).append(r["vector"])
    return {label: np.array(own) for label, own in found.items()}


def _cluster_sums(vectors: DataFrame, now: dict[str, np.ndarray], before: dict[str, np.ndarray]) -> list:
    """``label, cluster, n, sum`` of the members of each cluster, and as cluster -1 how many changed theirs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {label: np.zeros(own.shape) for label, own in now.items()}
        members = {label: np.zeros(len(own), np.int64) for label, own in now.items()}
        moved = dict.fromkeys(now, 0)
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            rows = _matrix(batch.column("vector"))
            for label, own in now.items():
                part = rows[labels == label]
                if not len(part):
                    continue
                nearest = (part @ own.T).argmax(axis=1)
                moved[label] += int((nearest != (part @ before[label].T).argmax(axis=1)).sum()) if before else len(part)
                members[label] += np.bincount(nearest, minlength=len(own))
                np.add.at(sums[label], nearest, part)
        out = [(label, c, int(members[label][c]), sums[label][c].tolist()) for label in now for c in np.flatnonzero(members[label])]
        out += [(label, -1, n, [0.0] * now[label].shape[1]) for label, n in moved.items()]
        names, clusters, n, total = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(clusters, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.list_(pa.float64()))],
            ["label", "cluster", "n", "total"],
        )

    parts = vectors.select("label", "vector").mapInArrow(add, "label string, cluster int, n long, total array<double>")
    total = Summarizer.sum(array_to_vector(F.col("total")))
    return parts.groupBy("label", "cluster").agg(F.sum("n").alias("n"), vector_to_array(total).alias("total")).collect()


def cluster_surfaces(vectors: DataFrame, num_clusters: int, seed: int, rounds: int = 25) -> DataFrame:
    """``(label, surface, vector, cluster)`` by cosine k-means within each label.

    All labels share one pass over the vectors per round: tasks add up the members of each cluster, Spark the
    tasks' sums, and at most ``labels x num_clusters`` rows reach the driver.  The start is drawn by
    seeded digest, an empty cluster keeps its centroid, of equal similarities the lowest
    cluster wins, and a label is done when no surface changes its cluster.
    """

    vectors = materialize(vectors.filter(F.col("label").isin(list(LABELS))))
    centroids = _start_centroids(vectors, num_clusters, seed)
    before: dict[str, np.ndarray] = {}
    going = set(centroids)
    for _ in range(rounds + 1):
        if not going:
            break
        sums = _cluster_sums(vectors.filter(F.col("label").isin(sorted(going))), {k: centroids[k] for k in sorted(going)}, before)
        before = dict(centroids)
        centroids = {k: own.copy() for k, own in centroids.items()}
        for r in sums:
            if r["cluster"] >= 0:
                mean = np.array(r["total"]) / r["n"]
                centroids[r["label"]][r["cluster"]] = mean / max(np.sqrt(mean @ mean), 1e-12)
        done = {r["label"] for r in sums if r["cluster"] == -1 and r["n"] == 0}
        for label in done:  # the centroids that changed nothing are final
            centroids[label] = before[label]
        going -= done
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            rows = _matrix(batch.column("vector"))
            cluster = np.zeros(len(labels), np.int32)
            for label, own in centroids.items():
                chosen = labels == label
                if chosen.any():
                    cluster[chosen] = (rows[chosen] @ own.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], [*batch.schema.names, "cluster"])

    return vectors.mapInArrow(assign, f"{kind}, cluster int")


def assign_centroid(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Vectors with the ``cluster`` of the nearest centroid by dot product.

    There are ``num_clusters`` centroids whatever the data size, so they travel as one
    scalar array; the lowest cluster wins ties.
    """

    listed = F.sort_array(F.collect_list(F.struct("cluster", "centroid")))
    rows = vectors.withColumn("centroids", centroids.agg(listed.alias("c")).scalar())
    best = let(
        F.struct("vector", "centroids"),
        lambda v: F.array_max(
            F.transform(
                v["centroids"],
                lambda c: F.struct(
                    dot(v["vector"], c["centroid"]).alias("similarity"), (-c["cluster"]).alias("low")
                ),
            )
        ),
    )
    return rows.withColumn("best", best).select(
        *vectors.columns, (-F.col("best.low")).alias("cluster"), F.col("best.similarity").alias("similarity")
    )


def _tiles(rows: pd.DataFrame, codes: np.ndarray, tile: int) -> list[dict]:
    """A block cut by radius into tiles, each in the order of its names."""

    names = rows["surface"].to_numpy()
    place = np.empty(len(rows), np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(rows))
    by_radius = np.argsort(rows["radius"].to_numpy(), kind="stable")
    out = []
    for at in range(0, len(rows), tile):
        part = by_radius[at : at + tile]
        part = part[np.argsort(place[part])]
        radius = rows["radius"].to_numpy()[part]
        vectors = np.vstack(rows["vector"].to_numpy()[part])
        out.append(
            {
                "rows": part,
                "codes": codes[part],
                "vectors": vectors,
                "finite": bool(np.isfinite(vectors).all()),
                "low": radius.min(),
                "high": radius.max(),
                "norm2": rows["norm2"].to_numpy()[part].max(),
            }
        )
    return out


def _best(similarity: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``k`` best of each row, the first column of equal ones; the matrix is used up."""

    if k > 16:
        columns = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
        return columns, np.take_along_axis(similarity, columns, axis=1)
    every = np.arange(len(similarity))
    columns = np.empty((len(similarity), k), np.int64)
    values = np.empty((len(similarity), k))
    for n in range(k):
        columns[:, n] = similarity.argmax(axis=1)
        values[:, n] = similarity[every, columns[:, n]]
        similarity[every, columns[:, n]] = -np.inf
    return columns, values


def _first(found: list[np.ndarray], last: np.ndarray, place: np.ndarray, k: int) -> list[np.ndarray]:
    """Of the found ``source, candidate, similarity`` the ``k`` best of each source, by name where equal."""

    source, candidate, value = (np.concatenate(c) for c in zip(*found, strict=True))
    good = value >= last[source]
    source, candidate, value = source[good], candidate[good], value[good]
    order = np.lexsort((place[candidate], -value, source))
    source, candidate, value = source[order], candidate[order], value[order]
    starts = np.flatnonzero(np.r_[True, source[1:] != source[:-1]]) if len(source) else np.zeros(0, np.int64)
    rank = np.arange(len(source)) - np.repeat(starts, np.diff(np.r_[starts, len(source)]))
    return [source[rank < k], candidate[rank < k], value[rank < k]]


class _Side:
    """One direction of a search: the rows of ``own`` look for candidates among those of ``other``."""

    def __init__(self, own: pd.DataFrame, other: pd.DataFrame, k: int) -> None:
        self.own, self.other, self.k = own, other, k
        self.top = np.full((len(own), k), -np.inf)
        self.last = own["last"].to_numpy().copy()
        names = other["surface"].to_numpy()
        self.place = np.empty(len(other), np.int64)
        self.place[np.argsort(names, kind="stable")] = np.arange(len(other))
        self.found: list[list[np.ndarray]] = []
        self.held = 0

    def add(self, rows: np.ndarray, candidates: np.ndarray, similarity: np.ndarray) -> None:
        """``similarity`` of ``rows`` with ``candidates``, which are in the order of their names."""

        good = np.flatnonzero(similarity.max(axis=1) >= self.last[rows])
        if not len(good):
            return
        columns, values = _best(similarity[good].copy(), min(self.k, similarity.shape[1]))
        rows = rows[good]
        self.top[rows] = -np.sort(-np.hstack([self.top[rows], values]), axis=1)[:, : self.k]
        self.last[rows] = np.maximum(self.last[rows], self.top[rows, -1])
        keep = (values > -np.inf) & (values >= self.last[rows][:, None])
        source = np.repeat(rows, keep.sum(axis=1))
        self.found.append([source, candidates[columns[keep]], values[keep]])
        self.held += len(source)
        if self.held > 4 * self.k * len(self.own) + 1_000_000:
            self.found = [_first(self.found, self.last, self.place, self.k)]
            self.held = len(self.found[0][0])

    def result(self) -> pd.DataFrame:
        columns = ["label", "surface", "candidate", "similarity"]
        if not self.found:
            return pd.DataFrame(columns=columns)
        source, candidate, value = _first(self.found, self.last, self.place, self.k)
        label, surface = (self.own[c].to_numpy()[source] for c in ("label", "surface"))
        return pd.DataFrame(dict(zip(columns, (label, surface, self.other["surface"].to_numpy()[candidate], value), strict=True)))


def _top_pairs(max_candidates: int, tile: int = NEIGHBOUR_BLOCK):
    """Best candidates of the rows of two blocks in the other block, or of one block in itself.

    Every product of two tiles serves both directions.  A pair of tiles is left out if by their radii none of
    its pairs can be as similar as the last candidate of a row.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame | None = None) -> pd.DataFrame:
        inside = right is None
        right = left if inside else right
        if left.empty or right.empty:
            return pd.DataFrame(columns=["label", "surface", "candidate", "similarity"])
        codes = pd.factorize(np.concatenate([left["surface"].to_numpy(), right["surface"].to_numpy()]))[0]
        shared = inside or bool(np.isin(codes[: len(left)], codes[len(left) :]).any())
        ours = _tiles(left, codes[: len(left)], tile)
        theirs = ours if inside else _tiles(right, codes[len(left) :], tile)
        there = _Side(left, right, max_candidates)
        back = there if inside else _Side(right, left, max_candidates)
        for i, a in enumerate(ours):
            # neighbouring tiles first, which raises the bound
            for j in sorted(range(i if inside else 0, len(theirs)), key=lambda j: abs(theirs[j]["low"] - a["low"])):
                b = theirs[j]
                gap = max(b["low"] - a["high"], a["low"] - b["high"], 0.0)
                most = (a["norm2"] + b["norm2"] - gap * gap) / 2 + SLACK
                if most < there.last[a["rows"]].min() and most < back.last[b["rows"]].min():
                    continue
                similarity = a["vectors"] @ b["vectors"].T
                if not (a["finite"] and b["finite"]):
                    similarity[np.isnan(similarity)] = -np.inf
                if shared:
                    similarity[a["codes"][:, None] == b["codes"][None, :]] = -np.inf
                there.add(a["rows"], b["rows"], similarity)
                if not (inside and i == j):
                    back.add(b["rows"], a["rows"], similarity.T)
        return there.result() if inside else pd.concat([s.result() for s in (there, back)])

    return run


def _by_radius(clustered: DataFrame, block: int | None) -> DataFrame:
    """Vectors with ``norm2``, their distance ``radius`` to the mean of the cluster, and the block ``own`` they fall in.

    Blocks of about ``block`` vectors (if not given, of ``HELD`` bytes) follow each other by radius.  Radii are counted in cells, and a
    vector takes a place among those of its cell by digest, so nothing is sorted.
    """

    keys = ["label", "cluster"]
    mean = Summarizer.mean(array_to_vector(F.col("vector")))
    # one row per cluster (labels x num_clusters), so broadcasting it is safe
    means = clustered.groupBy(*keys).agg(vector_to_array(mean).alias("mean"), F.count("*").alias("members"))
    held = F.greatest(F.lit(NEIGHBOUR_BLOCK), F.floor(HELD / (8 * F.size("mean")))) if block is None else F.lit(block)
    means = means.withColumn("block", held.cast("bigint")).withColumn("blocks", F.ceil(F.col("members") / F.col("block")).cast("int"))
    far = F.sqrt(F.aggregate(F.zip_with("vector", "mean", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x))
    rows = clustered.select(*keys, "surface", "vector").join(F.broadcast(means), keys)
    rows = materialize(rows.select(*keys, "surface", "vector", "block", "blocks", far.alias("radius")).withColumn("cell", F.floor(F.col("radius") * CELLS)))
    counts = rows.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    # at most 2 x CELLS rows per cluster
    start = F.sum("n").over(W.partitionBy(*keys).orderBy("cell")) - F.col("n")
    counts = materialize(counts.select(*keys, "cell", "n", start.alias("start")))
    place = F.col("start") + F.pmod(F.xxhash64("surface"), F.col("n"))
    own = F.least(F.floor(place / F.col("block")).cast("int"), F.col("blocks") - 1)
    # joined without a shuffle of the vectors unless there are very many clusters
    return lookup_join(rows, counts, [*keys, "cell"], "inner", CELL_ROWS).select(
        *keys, "surface", "vector", "radius", dot(F.col("vector"), F.col("vector")).alias("norm2"), own.alias("own")
    )


def neighbour_cells(placed: DataFrame, reached: DataFrame) -> DataFrame:
    """``label, cluster, a, b``: which other blocks ``b`` may hold a more similar neighbour for the block ``a``.

    ``reached`` has ``label, surface, last``, the similarity of the last candidate so far.  By the triangle
    inequality two vectors are at least as far apart as their distances to a third one differ, and
    ``2 x y = x x + y y - (x - y)(x - y)`` turns that into a bound on their similarity.
    """

    keys = ["label", "cluster"]
    known = placed.select(*keys, "surface", "own", "radius", "norm2").join(reached, ["label", "surface"], "left")
    blocks = known.groupBy(*keys, "own").agg(
        F.min("radius").alias("low"),
        F.max("radius").alias("high"),
        F.max("norm2").alias("norm2"),
        F.min(F.coalesce("last", F.lit(float("-inf")))).alias("last"),
    )
    other = blocks.select(*keys, *[F.col(c).alias(n) for c, n in (("own", "b"), ("low", "b_low"), ("high", "b_high"), ("norm2", "b_norm2"))])
    gap = F.greatest(F.col("b_low") - F.col("high"), F.col("low") - F.col("b_high"), F.lit(0.0))
    # rows are blocks, not vectors
    pairs = blocks.withColumnRenamed("own", "a").join(other, keys).filter(F.col("a") != F.col("b"))
    most = (F.col("norm2") + F.col("b_norm2") - gap * gap) / 2
    return pairs.filter(most >= F.col("last") - SLACK).select(*keys, "a", "b")


def cluster_neighbours(
    clustered: DataFrame, max_candidates: int, block: int | None = None
) -> DataFrame:
    """``(label, surface, rank, candidate, similarity)``: nearest others of the cluster.

    Exact top-k by dot product without emitting pairs.  A cluster is dealt into blocks by distance to
    its mean, of ``block`` vectors or of as many as fill ``HELD`` bytes.  Each block first searches itself, tile by tile; the
    similarity of the last candidate then rules out, by the triangle inequality, pairs of blocks that cannot improve on it.
    A pair of blocks meets in one task, which searches both directions and yields at most k rows per
    source.  So a cluster of B blocks is shuffled at most B times: once for the blocks and B - 1 times for their pairs.
    """

    keys = ["label", "cluster"]
    placed = materialize(_by_radius(clustered, block))
    schema = "label string, surface string, candidate string, similarity double"
    best = W.partitionBy("label", "surface").orderBy(F.desc("similarity"), "candidate")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_candidates)
    search = _top_pairs(max_candidates)
    nothing = F.lit(float("-inf"))
    inside = materialize(
        placed.withColumn("last", nothing).groupBy(*keys, "own").applyInPandas(lambda rows: search(rows), schema)
    )
    reached = inside.groupBy("label", "surface").agg(
        F.when(F.count("*") >= max_candidates, F.min("similarity")).otherwise(nothing).alias("last")
    )
    cells = neighbour_cells(placed, materialize(reached))
    cells = materialize(cells.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    few = is_small(cells)
    cell = [*keys, "a", "b"]

    def side(own: str) -> DataFrame:
        rows = placed.select(*[F.col(c).alias(own if c == "own" else c) for c in placed.columns]).withColumn("last", nothing)
        return rows.join(F.broadcast(cells) if few else cells, [*keys, own]).groupBy(*cell)

    across = side("a").cogroup(side("b")).applyInPandas(lambda left, right: search(left, right), schema)
    return top(inside.unionByName(across)).select(
        "label", "surface", F.col("rank").cast("bigint").alias("rank"), "candidate", "similarity"
    )


def pick_replacement(spans: DataFrame, neighbours: DataFrame, seed: int) -> DataFrame:
    """Spans ``(hash, label, start, end, surface)`` with a ``replacement``.

    The choice among the (at most ``max_candidates``) candidates is a digest of seed,
    record and entity; spans without a candidate are left out.  The candidates come out of
    the neighbour search and are read twice (measured, then joined), so they are materialized.
    """

    options = neighbours.groupBy("label", "surface").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "candidate"))), lambda c: c["candidate"]
        ).alias("options")
    )
    joined = lookup_join(spans, materialize(options), ["label", "surface"], "inner")
    number = seeded_number(seed, F.col("hash"), F.col("label"), F.col("start"), F.col("end"))
    choice = F.pmod(number, F.size("options")).cast("int")
    return joined.select(*spans.columns, F.get("options", choice).alias("replacement"))


def select_for_augmentation(records: DataFrame, probability: float, seed: int) -> DataFrame:
    """Each record independently with the given probability, by seeded digest."""

    if not 0.0 <= probability <= 1.0:
        raise ValueError("augmentation probability must be in [0, 1]")
    uniform = seeded_number(seed, F.lit("select"), F.col("hash")) / F.lit(float(2**32))
    return records.filter(uniform < probability)


def rewrite_record(records: DataFrame, replacements: DataFrame) -> DataFrame:
    """Records having replacements, rewritten: new ``text``, shifted ``entities``, ``replaced``.

    All spans are kept; only those with a replacement change their surface.
    """

    chosen = F.sort_array(F.collect_list(F.struct("start", "end", "label", "replacement")))
    listed = replacements.groupBy("hash").agg(chosen.alias("chosen"))

    def new_surface(chars: Column, picks: Column, by_end: Column, e: Column) -> Column:
        pick = F.get(picks, F.get(by_end, e["start"].cast("int")))
        hit = (pick["start"] == e["start"]) & (pick["end"] == e["end"]) & (pick["label"] == e["label"])
        return F.when(hit, pick["replacement"]).otherwise(cut(chars, e["start"], e["end"]))

    def pieces(chars: Column, picks: Column, by_end: Column, spans: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        inner = F.flatten(
            F.transform(
                spans,
                lambda e, i: F.array(
                    cut(chars, F.coalesce(F.get(spans, i - 1)["end"], zero), e["start"]),
                    new_surface(chars, picks, by_end, e),
                ),
            )
        )
        tail = cut(chars, last_end(spans), F.length("text").cast("bigint"))
        return F.concat(inner, F.array(tail))

    def rebuilt(parts: Column) -> Column:
        return let(
            running_sum(F.transform(parts, lambda p: F.length(p))),
            lambda ends: F.struct(
                F.array_join(parts, "").alias("text"),
                F.transform(
                    "entities",
                    lambda e, i: F.struct(
                        e["label"].alias("label"),
                        F.get(ends, i * 2).alias("start"),
                        F.get(ends, i * 2 + 1).alias("end"),
                    ),
                ).alias("entities"),
            ),
        )

    new = let(
        characters(F.col("text")),
        lambda chars: let(
            F.col("chosen"),
            lambda picks: let(
                index_by_end(picks),
                lambda by_end: let(
                    F.col("entities"),
                    lambda spans: let(pieces(chars, picks, by_end, spans), rebuilt),
                ),
            ),
        ),
    )
    return (
        records.join(listed, "hash")
        .withColumn("new", new)
        .select(
            "ord",
            F.col("hash").alias("source_hash"),
            F.col("new.text").alias("text"),
            F.col("new.entities").alias("entities"),
            F.size("chosen").cast("bigint").alias("replaced"),
        )
    )


def augment_append(records: DataFrame, rewritten: DataFrame, block: int = 100_000) -> DataFrame:
    """Originals, with all their columns, followed by the variants, numbered in record order."""

    numbered = number_rows(rewritten, "ord", "variant", block)
    if isinstance(records.schema["ord"].dataType, T.LongType):
        originals = records
        shift = records.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).scalar()
        place = shift + F.col("variant") - 1
    else:
        part = lambda n: F.struct(F.lit(n).alias("part"), F.col("ord").alias("ord"))
        originals, place = records.withColumn("ord", part(0)), part(1)
    variants = numbered.select(
        place.alias("ord"),
        augmented_hash(F.col("source_hash"), F.col("variant"), F.col("text")).alias("hash"),
        "text",
        "entities",
        F.struct(
            F.lit("cluster_based").alias("method"),
            F.col("source_hash").alias("source_hash"),
            F.col("variant").alias("variant"),
        ).alias("augmentation"),
    )
    return originals.unionByName(variants, allowMissingColumns=True)


def augmentation_stats(records: DataFrame, rewritten: DataFrame, clustered: DataFrame) -> DataFrame:
    """``(metric, value)``: input, added, replaced, output records and clusters."""

    n = records.agg(F.count("*").alias("n")).scalar()
    clusters = clustered.select("label", "cluster").distinct().agg(F.count("*").alias("n")).scalar()
    totals = rewritten.agg(
        F.count("*").alias("added"), F.coalesce(F.sum("replaced"), F.lit(0)).alias("replaced")
    ).select(
        n.alias("input_records"),
        F.col("added").alias("added_records"),
        F.col("replaced").alias("replaced_entities"),
        (n + F.col("added")).alias("output_records"),
        clusters.alias("cluster_count"),
    )
    return totals.unpivot([], list(totals.columns), "metric", "value")
