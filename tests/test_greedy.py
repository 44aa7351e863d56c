import random
import time
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from spanloom.functions import greedy
from spanloom.functions.greedy import disjoint_flags, keep_disjoint, longest_first
from spanloom.operators.overlap import drop_overlaps_longest, select_non_overlapping
from workload import views as V

SPAN = "label string, start bigint, end bigint"


def chosen(spans, key):
    kept = []
    for label, start, end in (s for _, s in sorted((key(i, s), s) for i, s in enumerate(spans))):
        if all(end <= b or start >= c for _, b, c in kept):
            kept.append((label, start, end))
    return sorted(kept, key=lambda s: (s[1], s[2]))


def islands(rng, n, width):
    return [(rng.choice("ABC"), a, a + rng.randint(1, width)) for a in (rng.randint(0, 3 * n) for _ in range(n))]


def test_ordered_set_equals_comparing_with_all():
    rng = random.Random(2)
    for _ in range(300):
        spans = islands(rng, rng.randint(0, 40), rng.choice([1, 4, 30]))
        kept, want = [], []
        for _, start, end in spans:
            want.append(all(end <= b or start >= c for b, c in kept))
            kept += [(start, end)] * want[-1]
        assert disjoint_flags([s for _, s, _ in spans], [e for _, _, e in spans]) == want


@pytest.mark.parametrize("large", [0, 5, 10_000])
def test_records_with_islands_of_every_size(spark, monkeypatch, large):
    monkeypatch.setattr(greedy, "LARGE_RECORD", large)
    rng = random.Random(3)
    records = [islands(rng, rng.choice([0, 1, 3, 12, 60]), rng.choice([2, 9, 40])) for _ in range(60)] + [None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], f"id int, spans array<struct<{SPAN.replace(' ', ':')}>>".replace(",:", ","))
    got = {r.id: r.kept for r in df.select("id", keep_disjoint(F.col("spans"), longest_first).alias("kept")).collect()}
    for i, spans in enumerate(records):
        if spans is None:
            assert got[i] is None
            continue
        want = chosen(spans, lambda at, s: (s[1] - s[2], s[1], s[2], at))
        assert sorted((x.label, x.start, x.end) for x in got[i]) == sorted(want)


@pytest.mark.parametrize("large", [0, 5, 10_000])
def test_tables_with_islands_of_every_size(spark, monkeypatch, large):
    monkeypatch.setattr(greedy, "LARGE", large)
    rng = random.Random(4)
    texts = {f"t{i}": islands(rng, rng.choice([1, 4, 50]), rng.choice([3, 30])) for i in range(30)}
    rows = [(h, label, a, b, rng.randint(0, 3) / 4, i) for h, spans in texts.items() for i, (label, a, b) in enumerate(spans)]
    df = spark.createDataFrame(rows, f"hash string, {SPAN}, score double, idx int")
    longest = {}
    for r in drop_overlaps_longest(df).collect():
        longest.setdefault(r.hash, []).append((r.label, r.start, r.end))
    best = {}
    for r in select_non_overlapping(df.drop("idx")).collect():
        best.setdefault(r.hash, []).append((r.label, r.start, r.end))
    scores = {}
    for h, label, a, b, score, _ in rows:
        scores.setdefault(h, []).append((label, a, b, score))
    for h, spans in texts.items():
        assert sorted(longest[h]) == sorted(chosen(spans, lambda at, s: (s[1] - s[2], s[1], s[2], at)))
        kept = []
        for label, a, b, _ in sorted(scores[h], key=lambda s: (-s[3], s[1], s[1] - s[2], s[0])):
            if all(b <= x or a >= y for _, x, y in kept):
                kept.append((label, a, b))
        assert sorted(best[h]) == sorted(kept)


def test_an_island_of_fifty_thousand_spans_takes_seconds(spark):
    n = 50_000
    chain = spark.range(n).select(
        F.lit("long").alias("hash"), F.lit("ORG").alias("label"), (F.col("id") * 2).alias("start"), (F.col("id") * 2 + 3).alias("end"),
        (F.xxhash64("id") % 1000 / 1000.0).alias("score"),
    )
    start = time.monotonic()
    kept = select_non_overlapping(chain).collect()
    assert time.monotonic() - start < 15
    assert n // 3 <= len(kept) <= n // 2 + 1
    kept.sort(key=lambda r: r.start)
    assert all(a.end <= b.start for a, b in zip(kept, kept[1:], strict=False))
    start = time.monotonic()
    record = chain.groupBy("hash").agg(F.collect_list(F.struct("label", "start", "end")).alias("spans"))
    assert record.select(F.size(keep_disjoint(F.col("spans"), longest_first))).first()[0] == n // 2
    assert time.monotonic() - start < 15


def test_islands_that_go_on_over_batches(spark, capsys):
    rng = random.Random(6)
    rows = [(None if h == 3 else f"t{h}", *s, i) for h in range(7) for i, s in enumerate(islands(rng, 40, rng.choice([2, 5, 60])))]
    rows += [("n", "A", None, 4, 0), ("n", "A", 0, 9, 1), ("n", None, 2, 9, 2), ("n", "B", 3, None, 3), ("n", "C", 9, 12, 4), ("n", "C", 9, 12, 5)]
    df = spark.createDataFrame(rows, f"hash string, {SPAN}, idx int")
    want = {h: chosen([r[1:4] for r in rows if r[0] == h], lambda at, s: (s[1] - s[2], s[1], s[2], at)) for h in {r[0] for r in rows} - {"n"}}
    for size in (1, 3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {}
            for r in drop_overlaps_longest(df).collect():
                got.setdefault(r.hash, []).append((r.label, r.start, r.end))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        # a span without a bound meets none
        assert sorted(got.pop("n"), key=str) == sorted([("A", None, 4), ("A", 0, 9), ("B", 3, None), ("C", 9, 12)], key=str)
        assert {h: sorted(s) for h, s in got.items()} == {h: sorted(s) for h, s in want.items()}
    drop_overlaps_longest(df).explain()
    plan = capsys.readouterr().out
    # spans are neither collected to arrays nor sorted more than twice
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 2 and "collect_list" not in plan


def test_nested_spans_equal_the_expressions_of_the_view(spark, tmp_path):
    rows = [(i, None if i == 4 else "alpha beta  😀 gamma delta epsilon zeta " * (i % 5) + "end", None if i == 2 else "s") for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for r in V.gold(spark, str(tmp_path)).collect():
        spans = []
        for i, e in enumerate(r.entities or []):
            n = int(md5(f"{r.hash}|{i}|w".encode()).hexdigest()[:2], 16)
            spans.append((e.label, e.start, e.end))
            if n < 200:
                spans.append(("GEO" if n < 128 else e.label, max(e.start - n % 7, 0), min(e.end + n % 11, len(r.text))))
        want += [(r.hash, *s, idx) for idx, s in enumerate(spans)]
    assert len(want) > 20 and sorted(tuple(r) for r in V.nested(spark, str(tmp_path)).collect()) == sorted(want)
