import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.operators import augment as A
from spanloom.plans.augment import augment_records
from tests_support import random_records


def test_rewrite_example(make, spark):
    records = make(("one", "Bugun Oybek Termizga", [("NAME", 6, 11), ("GEO", 12, 20)]))
    swap = spark.createDataFrame([("one", "NAME", 6, 11, "Jamshid")], "hash string, label string, start bigint, end bigint, replacement string")
    row = A.rewrite_record(records, swap).first()
    assert row["text"] == "Bugun Jamshid Termizga" and row["replaced"] == 1
    assert [tuple(e) for e in row["entities"]] == [("NAME", 6, 13), ("GEO", 14, 22)]


def test_rewriting_keeps_everything_else(make, spark):
    rng = random.Random(12)
    rows = random_records(rng, 60)
    swaps = [
        (h, *e, rng.choice(["", "X", "longer 😀 name"]))
        for h, _, entities in rows for e in entities if rng.random() < 0.5
    ]
    swap = spark.createDataFrame(swaps, "hash string, label string, start bigint, end bigint, replacement string")
    put = {s[:4]: s[4] for s in swaps}
    done = {r["source_hash"]: r for r in A.rewrite_record(make(*rows), swap).collect()}
    assert set(done) == {s[0] for s in swaps}
    for h, text, entities in rows:
        if h not in done:
            continue
        out, spans, at = "", [], 0
        for label, start, end in entities:
            out += text[at:start]
            surface = put.get((h, label, start, end), text[start:end])
            spans.append((label, len(out), len(out) + len(surface)))
            out, at = out + surface, end
        assert done[h]["text"] == out + text[at:]
        assert [tuple(e) for e in done[h]["entities"]] == spans


def test_neighbours_match_brute_force_across_blocks(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(90):
        v = np.round(rng.normal(size=4), 1)
        rows.append(("ORG", i % 2 if i < 60 else 0, f"s{i:02d}", [float(x) for x in v]))
    rows += [("NAME", 0, "alone", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "label string, cluster int, surface string, vector array<double>")
    want = {}
    for label, cluster, surface, v in rows:
        others = [(-float(np.dot(v, w)), s) for l, c, s, w in rows if (l, c) == (label, cluster) and s != surface]
        want[surface] = [round(-d, 9) for d, _ in sorted(others)[:3]]
    for block in (7, 1000):
        got = {}
        for r in A.cluster_neighbours(df, 3, block).orderBy("surface", "rank").collect():
            got.setdefault(r["surface"], []).append(round(r["similarity"], 9))
        assert got == {k: v for k, v in want.items() if v}


def test_neighbours_leave_out_cells_that_cannot_improve(spark):
    # three rings around the centre: a neighbour on another ring is farther than those on the own one
    rows = []
    for ring, tilt in enumerate((0.05, 0.7, 1.4)):
        for i in range(120):
            turn = 2 * np.pi * i / 120
            rows.append(("ORG", 0, f"r{ring}-{i:03d}", [float(np.sin(tilt) * np.cos(turn)), float(np.sin(tilt) * np.sin(turn)), float(np.cos(tilt))]))
    df = spark.createDataFrame(rows, "label string, cluster int, surface string, vector array<double>")
    placed = A._by_radius(df, 40)
    blocks = placed.groupBy("own").count().collect()
    assert len(blocks) == 9 and max(r["count"] for r in blocks) < 120
    inside = {}
    points = {s: np.array(v) for *_, s, v in rows}
    own = {r.surface: r.own for r in placed.collect()}
    for s, v in points.items():
        near = sorted((float(v @ w) for t, w in points.items() if t != s and own[t] == own[s]), reverse=True)
        inside[s] = near[1]
    reached = spark.createDataFrame([("ORG", s, x) for s, x in inside.items()], "label string, surface string, last double")
    visited = A.neighbour_cells(placed, reached).count()
    assert 0 < visited < 9 * 8
    want = {s: sorted((round(float(v @ w), 9) for t, w in points.items() if t != s), reverse=True)[:2] for s, v in points.items()}
    got = {}
    for r in A.cluster_neighbours(df, 2, 40).orderBy("surface", "rank").collect():
        got.setdefault(r.surface, []).append(round(r.similarity, 9))
    assert got == want


def test_a_cluster_that_fits_a_task_is_one_block_and_never_meets_itself_again(spark):
    rows = [("ORG", 0, f"s{i:04d}", [float(np.cos(i)), float(np.sin(i))]) for i in range(2500)]
    df = spark.createDataFrame(rows, "label string, cluster int, surface string, vector array<double>")
    placed = A._by_radius(df, None)
    assert placed.select("own").distinct().count() == 1  # blocks follow bytes, not a fixed number of vectors
    reached = df.select("label", "surface", F.lit(-1.0).alias("last"))
    assert A.neighbour_cells(placed, reached).count() == 0


def test_tiles_of_two_blocks_search_both_directions():
    rng = np.random.default_rng(1)

    def block(names):
        vectors = np.round(rng.normal(size=(len(names), 3)), 1)
        vectors[3] = vectors[2]  # equal similarities go by name
        norms = np.sqrt((vectors**2).sum(axis=1))
        return pd.DataFrame({"label": "ORG", "surface": names, "vector": list(vectors), "radius": norms, "norm2": norms**2, "last": -np.inf})

    def want(own, other):
        found = {}
        for s, v in zip(own["surface"], own["vector"]):
            near = [(-round(float(v @ w), 9), t) for t, w in zip(other["surface"], other["vector"]) if t != s]
            found[s] = sorted(near)[:3]
        return found

    a, b = block([f"a{i:02d}" for i in range(23)]), block([f"b{i:02d}" for i in range(17)])
    for left, right, expected in ((a, b, want(a, b) | want(b, a)), (a, None, want(a, a))):
        got = {}
        for r in A._top_pairs(3, tile=5)(left, right).itertuples():
            got.setdefault(r.surface, []).append((-round(r.similarity, 9), r.candidate))
        assert {s: sorted(x) for s, x in got.items()} == expected


def test_vectors_clusters_and_the_whole_run(make, spark):
    records = make(
        ("a", "Ali Toshkentda", [("NAME", 0, 3), ("GEO", 4, 14)]),
        ("b", "Vali Buxoroda", [("NAME", 0, 4), ("GEO", 5, 13)]),
    )
    surfaces = A.entity_surfaces(records)
    assert surfaces.count() == 4
    tokens = surfaces.withColumn("tokens", F.array(F.length("surface").cast("bigint"), F.lit(1).cast("bigint")))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "token bigint, vector array<double>")
    for r in A.surface_vectors(tokens, vectors).collect():
        mean = np.mean([[len(r["surface"]), 1.0], [1.0, 1.0]], axis=0)
        assert np.allclose(r["vector"], mean / np.linalg.norm(mean))
    both, stats = augment_records(
        records, tokens, vectors, probability=1.0, num_clusters=1, max_candidates=3, seed=42
    )
    rows = both.orderBy("ord").collect()
    assert [r["hash"] for r in rows[:2]] == ["a", "b"] and len(rows) == 4
    assert rows[2]["text"] == "Vali Buxoroda" and rows[3]["text"] == "Ali Toshkentda"
    assert [r["augmentation"]["variant"] for r in rows[2:]] == [1, 2]
    assert all(r["hash"].startswith("cluster-") for r in rows[2:])
    assert {r["metric"]: r["value"] for r in stats.collect()} == {
        "input_records": 2, "added_records": 2, "replaced_entities": 4, "output_records": 4, "cluster_count": 2
    }


def test_switches(make, spark):
    records = make(("a", "Ali", [("NAME", 0, 3)]))
    options = dict(num_clusters=1, max_candidates=1, seed=1)
    for off in (dict(enabled=False, probability=0.5), dict(probability=0.0)):
        same, stats = augment_records(records, None, None, **off, **options)
        assert same is records and {r["skipped"] for r in stats.collect()} <= {"disabled", "probability is 0"}
        assert {r["metric"]: r["value"] for r in stats.collect()}["output_records"] == 1
    with pytest.raises(ValueError):
        augment_records(records, None, None, probability=1.5, **options)


def test_selection_is_seeded(make):
    records = make(*[(f"h{i}", "t", []) for i in range(400)])
    first = {r["hash"] for r in A.select_for_augmentation(records, 0.25, 1).collect()}
    assert first == {r["hash"] for r in A.select_for_augmentation(records, 0.25, 1).collect()}
    assert 60 < len(first) < 140
    assert A.select_for_augmentation(records, 1.0, 1).count() == 400


def test_clusters_per_label(spark):
    rows = [("ORG", f"o{i}", [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0]) for i in range(1, 13)]
    rows += [("GEO", "g0", [1.0, 0.0]), ("GEO", "g1", [0.0, 1.0]), ("GEO", "g2", [0.6, 0.8])]
    vectors = spark.createDataFrame(rows, "label string, surface string, vector array<double>").withColumn(
        "vector", A.unit(F.col("vector"))
    )
    got = {(r["label"], r["surface"]): r["cluster"] for r in A.cluster_surfaces(vectors, 2, 7).collect()}
    assert set(got) == {(r[0], r[1]) for r in rows}
    # n // 2 = 1 cluster for three surfaces, two separable ones for twelve
    assert {c for (label, _), c in got.items() if label == "GEO"} == {0}
    odd = {got[("ORG", f"o{i}")] for i in range(1, 13, 2)}
    even = {got[("ORG", f"o{i}")] for i in range(2, 13, 2)}
    assert len(odd) == len(even) == 1 and odd != even
    assert got == {(r["label"], r["surface"]): r["cluster"] for r in A.cluster_surfaces(vectors, 2, 7).collect()}


def plain_kmeans(vectors, centroids, rounds=25):
    """Cosine k-means on one label, with a fixed start."""

    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        new = []
        for c, old in enumerate(centroids):
            own = vectors[nearest == c]
            mean = own.mean(axis=0) if len(own) else old
            new.append(mean / max(np.linalg.norm(mean), 1e-12))
        stable = ((vectors @ np.array(new).T).argmax(axis=1) == nearest).all()
        centroids = np.array(new)
        if stable:
            break
    return (vectors @ centroids.T).argmax(axis=1)


def test_clusters_equal_plain_kmeans_of_each_label(spark):
    import hashlib

    rng = np.random.default_rng(4)
    rows = []
    for label, n in (("ORG", 150), ("NAME", 61), ("GEO", 1)):
        for i in range(n):
            v = rng.normal(size=5) + 3 * np.eye(5)[i % 4]
            rows.append((label, f"{label}{i:03d}", [float(x) for x in v / np.linalg.norm(v)]))
    rows.append(("OTHER", "x", [1.0, 0.0, 0.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "label string, surface string, vector array<double>").repartition(5)
    got = {(r.label, r.surface): r.cluster for r in A.cluster_surfaces(df, 6, 9).collect()}
    assert len(got) == len(rows) - 1
    for label in ("ORG", "NAME", "GEO"):
        own = [(s, v) for k, s, v in rows if k == label]
        drawn = sorted(own, key=lambda r: (hashlib.md5(f"9|{label}|{r[0]}".encode()).hexdigest(), r[0]))
        start = np.array([v for _, v in drawn[: min(6, max(1, len(own) // 2))]])
        want = plain_kmeans(np.array([v for _, v in own]), start)
        assert [got[label, s] for s, _ in own] == want.tolist()


def test_an_empty_cluster_keeps_its_centroid(spark):
    # two equal starts: the second one gets no members and stays where it is
    rows = [("ORG", f"s{i}", [1.0, 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "label string, surface string, vector array<double>")
    assert {r.cluster for r in A.cluster_surfaces(df, 2, 1).collect()} == {0}
    assert A.cluster_surfaces(df.limit(0), 2, 1).count() == 0


def test_nearest_centroid_prefers_the_lowest_on_ties(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "surface string, vector array<double>")
    centroids = spark.createDataFrame([(1, [0.0, 1.0]), (0, [1.0, 0.0])], "cluster int, centroid array<double>")
    got = {r["surface"]: r["cluster"] for r in A.assign_centroid(vectors, centroids).collect()}
    assert got == {"a": 0, "b": 1, "c": 0}
