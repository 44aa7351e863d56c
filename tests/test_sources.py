import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import sentence_hash
from spanloom.operators.augment import augment_append, rewrite_record
from spanloom.operators.converters import convert_arrays
from spanloom.operators.corpus import append_train, drop_empty_added
from spanloom.plans.corpus import merge_array_corpus, merge_token_corpus, thin_corpus
from spanloom.plans.evaluate import evaluate_files, load_comparison
from spanloom.sources.fingerprint import file_digests, table_fingerprint
from spanloom.schema import ENTITIES_DDL
from spanloom.sources.records import first_lines, parse_records, quarantine, read_lines, read_predictions, read_records, read_source_arrays
from spanloom.sources.sinks import write_jsonl


def dump(path, *lines, prefix=""):
    text = "\n".join(line if isinstance(line, str) else json.dumps(line, ensure_ascii=False) for line in lines)
    path.write_text(prefix + text + "\n", encoding="utf-8")
    return str(path)


def rec(h, text, *entities, **more):
    return {"hash": h, "text": text, "entities": [dict(zip(("label", "start", "end"), e)) for e in entities], **more}


GOOD = rec("a", "Али Toshkent", ("GEO", 4, 12), ("NAME", 0, 3), extra=1)


def test_reads_sorted_entities_and_other_fields_on_request(spark, tmp_path):
    path = dump(tmp_path / "r.jsonl", GOOD, rec("b", "x"))
    row = read_records(spark, path).orderBy("ord").first()
    assert [tuple(e) for e in row["entities"]] == [("NAME", 0, 3), ("GEO", 4, 12)]
    assert set(row.asDict()) == {"ord", "hash", "text", "entities"}
    kept = read_records(spark, path, extra=True).orderBy("ord").collect()
    assert [r["extra"] for r in kept] == ['{"extra":1}', None]
    write_jsonl(read_records(spark, path, extra=True), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert {x["hash"]: x.get("extra") for x in lines} == {"a": 1, "b": None}


def test_a_byte_order_mark_only_opens_a_file(spark, tmp_path):
    assert read_records(spark, dump(tmp_path / "r.jsonl", GOOD, prefix="﻿")).count() == 1
    with pytest.raises(ValueError, match="json"):
        read_records(spark, dump(tmp_path / "s.jsonl", GOOD, "﻿" + json.dumps(rec("b", "x"))))


def test_source_arrays_round_trip_and_stable_identifiers(spark, tmp_path):
    row = lambda i: {"text": f"matn {i}", "entities": ["matn"], "entity_type": ["ORG"]}
    lines = [json.dumps(row(i)) for i in range(200)]
    lines[3], lines[5], lines[7] = " ", "[1]", "﻿" + lines[7]
    path = dump(tmp_path / "s.jsonl", *lines, prefix="﻿")
    found = {}
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read_source_arrays(spark, path)
            assert rows.select("text").count() == 200
            assert {r["line"]: r["error"] for r in rows.collect() if r["error"]} == {4: "blank", 6: "object", 8: "object"}
            found[size] = {r["text"]: r["hash"] for r in convert_arrays(rows.filter("error is null")).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found["700"]) == 197 and found["700"] == found["128m"]


def test_merge_thin_and_augment_in_memory_keep_other_fields(spark, tmp_path):
    train = read_records(spark, dump(tmp_path / "t.jsonl", GOOD, rec("b", "x")), extra=True)
    new = spark.createDataFrame([(0, "uz-new", "yangi", [])], f"ord bigint, hash string, text string, entities {ENTITIES_DDL}")
    merged = append_train(train, new)
    thinned = drop_empty_added(merged, 0.0, 1)
    swap = spark.createDataFrame([("a", "NAME", 0, 3, "X")], "hash string, label string, start bigint, end bigint, replacement string")
    both = augment_append(thinned, rewrite_record(thinned, swap)).orderBy("ord").collect()
    assert [r["hash"] for r in both[:3]] == ["a", "b", "uz-new"] and len(both) == 4
    assert [r["extra"] for r in both] == ['{"extra":1}', None, None, None]
    assert both[3]["text"] == "X Toshkent" and both[3]["augmentation"]["source_hash"] == "a"


def test_inputs_are_parsed_once(spark, tmp_path):
    gold = read_records(spark, dump(tmp_path / "g.jsonl", GOOD))
    plan = gold._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and ".jsonl" not in plan


BAD = {
    "blank": "  ",
    "json": "{nope",
    "object": "[1]",
    "hash": {"hash": 5, "text": "x", "entities": []},
    "text": {"hash": "b", "text": True, "entities": []},
    "entities": {"hash": "b", "text": "x", "entities": None},
    "label": rec("b", "x", ("PER", 0, 1)),
    "offsets": rec("b", "x", ("ORG", 0, True)),
    "overlap": rec("b", "xyz", ("ORG", 0, 2), ("GEO", 1, 3)),
    "duplicate": rec("b", "xyz", ("ORG", 0, 2), ("ORG", 0, 2)),
    "duplicate_hash": GOOD,
}


@pytest.mark.parametrize("error", BAD)
def test_strict_and_lenient_reading(spark, tmp_path, error):
    path = dump(tmp_path / "r.jsonl", GOOD, BAD[error], rec("z", ""))
    with pytest.raises(ValueError, match=error):
        read_records(spark, path)
    kept = read_records(spark, path, strict=False)
    assert [r["hash"] for r in kept.orderBy("ord").collect()] == ["a", "z"]
    out = quarantine(parse_records(read_lines(spark, path))).collect()
    assert [r["error"] for r in out] == [error]


def test_a_limit_stops_reading_and_checking(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    for n in range(4):
        lines = [rec(f"{n}-{i}", f"text {i}") for i in range(10)]
        dump(folder / f"part {n}.jsonl", *lines, *(["{broken"] if n else []))
    for limit, last in ((1, "0-0"), (10, "0-9"), (20, "1-9")):
        rows = read_records(spark, str(folder), limit=limit).orderBy("ord").collect()
        assert [r.hash for r in rows] == [f"{i // 10}-{i % 10}" for i in range(limit)] and rows[-1].hash == last
    with pytest.raises(ValueError, match="json"):
        read_records(spark, str(folder), limit=21)
    # lenient reading goes on until it has enough good records
    rows = read_records(spark, str(folder), limit=25, strict=False).orderBy("ord").collect()
    assert [r.hash for r in rows] == [f"{i // 10}-{i % 10}" for i in range(25)]
    assert read_records(spark, str(folder), limit=99, strict=False).count() == 40
    with pytest.raises(ValueError, match="limit"):
        read_records(spark, str(folder), limit=0)


def test_a_limit_opens_the_first_files_only(spark, tmp_path):
    for n in range(9):
        dump(tmp_path / f"{n}.jsonl", *[rec(f"{n}-{i}", "x") for i in range(5)])
    lines = first_lines(spark, str(tmp_path), 12)
    assert lines.count() == 12
    assert {r.ord.file.rsplit("/", 1)[1] for r in lines.collect()} == {"0.jsonl", "1.jsonl", "2.jsonl"}
    files = {f for part in [lines] for f in part.inputFiles()}
    assert not any(str(tmp_path) in f for f in files)  # later readers see what was kept, not the source


def test_a_split_of_its_own_is_left_after_the_limit(spark, tmp_path):
    path = dump(tmp_path / "long.jsonl", *[rec(str(i), "x" * 100) for i in range(5000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = first_lines(spark, path, 700)
        got = [json.loads(r.value)["hash"] for r in lines.orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [str(i) for i in range(700)]


def test_other_number_types_are_rejected(spark, tmp_path):
    lines = [rec(f"h{i}", "xyz", ("ORG", 0, v)) for i, v in enumerate((1.0, "1", None, 10**30))]
    parsed = parse_records(read_lines(spark, dump(tmp_path / "r.jsonl", *lines)))
    assert [r["error"] for r in parsed.collect()] == ["offsets"] * 4


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError, match="no records"):
        read_records(spark, str(tmp_path / "e.jsonl"))


def test_inspection_accepts_repeated_hashes_and_other_labels(spark, tmp_path):
    path = dump(tmp_path / "r.jsonl", rec("a", "xy", ("DATE", 0, 1)), rec("a", "xy"))
    assert read_records(spark, path, mode="inspect").count() == 2


def test_predictions_may_lack_text(spark, tmp_path):
    line = {"hash": "a", "entities": [{"label": "ORG", "start": 0, "end": 99}]}
    assert read_predictions(spark, dump(tmp_path / "p.jsonl", line)).first()["text"] is None
    bad = {"hash": "a", "text": None, "entities": []}
    with pytest.raises(ValueError, match="text"):
        read_predictions(spark, dump(tmp_path / "q.jsonl", bad))


def test_round_trip_keeps_order_and_characters(spark, make, tmp_path):
    rows = [(f"h{i}", f"О‘z \"{i}\"\n", [("ORG", 0, 1)]) for i in range(40)]
    write_jsonl(make(*rows), str(tmp_path / "out"), ordered=True)
    back = read_records(spark, str(tmp_path / "out")).orderBy("ord").collect()
    assert [(r["hash"], r["text"]) for r in back] == [r[:2] for r in rows]
    raw = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    want = {"hash": "h0", "text": rows[0][1], "entities": [{"label": "ORG", "start": 0, "end": 1}]}
    assert raw.splitlines()[0] == json.dumps(want, ensure_ascii=False, separators=(",", ":"))
    with pytest.raises(Exception, match="already exists"):
        write_jsonl(make(*rows), str(tmp_path / "out"))


def test_evaluate_files(spark, tmp_path):
    gold = dump(tmp_path / "g.jsonl", rec("a", "Ali Toshkent", ("NAME", 0, 3)), rec("b", "x"))
    line = lambda h, *e: {k: v for k, v in rec(h, "", *e).items() if k != "text"}
    pred = dump(tmp_path / "p.jsonl", line("b"), line("a", ("NAME", 0, 3), ("GEO", 4, 12)))
    rows = {r["scope"]: r for r in evaluate_files(spark, gold, pred, str(tmp_path / "m")).collect()}
    assert rows["NAME"]["f1"] == 1.0 and rows["GEO"]["fp"] == 1 and rows["micro"]["records"] == 2
    assert load_comparison(spark, gold, pred).count() == 2
    for broken, message in (
        ([line("a")], "hashes differ"),
        ([line("b"), rec("a", "other")], "text differs"),
        ([line("b"), line("a", ("GEO", 4, 99))], "offsets"),
    ):
        with pytest.raises(ValueError, match=message):
            evaluate_files(spark, gold, dump(tmp_path / "b.jsonl", *broken))


def test_corpus_builds(spark, tmp_path):
    train = dump(tmp_path / "train.jsonl", rec("t", "eski matn"), rec("t2", "Ali", ("NAME", 0, 3)))
    dev = dump(tmp_path / "dev.jsonl", rec("d", "dev matni"))
    source = dump(
        tmp_path / "s.jsonl",
        {"id": 1, "text": "Ali Toshkentda", "entities": ["Ali", "Toshkent"], "entity_type": ["PER", "LOC"]},
        {"id": 2, "text": "dev matni", "entities": [], "entity_type": []},
        {"id": 3, "text": "bo'sh", "entities": [], "entity_type": []},
        {"id": 4, "text": "Ali Toshkentda", "entities": [], "entity_type": []},
        prefix="﻿",
    )
    one = str(tmp_path / "one")
    manifest = {(r["metric"], r["key"]): r["value"] for r in merge_array_corpus(spark, source, train, dev, one).collect()}
    assert manifest[("merged_train_records", "")] == 4 and manifest[("skipped_duplicate_text", "")] == 2
    assert manifest[("added_entities_by_target_label", "GEO")] == 1
    merged = read_records(spark, f"{one}/train").orderBy("ord").collect()
    assert [r["text"] for r in merged] == ["eski matn", "Ali", "Ali Toshkentda", "bo'sh"]
    assert [tuple(e) for e in merged[2]["entities"]] == [("NAME", 0, 3), ("GEO", 4, 14)]

    rows = [("Dataset_1", 2, "S1", "Vali", "S-PER"), ("Dataset_1", 3, "S1", "keldi", "O"), ("Dataset_2", 2, "S1", "yo'q", "O")]
    spark.createDataFrame(rows, "sheet string, row_no bigint, sentence_id string, word string, tag string").write.parquet(
        str(tmp_path / "tokens")
    )
    two = str(tmp_path / "two")
    merge_token_corpus(spark, str(tmp_path / "tokens"), f"{one}/train", f"{one}/dev", two)
    merged = read_records(spark, f"{two}/train").orderBy("ord").collect()
    assert [r["text"] for r in merged][4:] == ["Vali keldi", "yo'q"]
    want = spark.range(1).select(sentence_hash(F.lit("Dataset_1"), F.lit("S1"), F.lit("Vali keldi"))).first()[0]
    assert merged[4]["hash"] == want
    with pytest.raises(ValueError, match="missing sheets"):
        merge_token_corpus(spark, str(tmp_path / "tokens"), train, dev, two, sheets=("Other",))

    three = str(tmp_path / "three")
    report = {r["prefix"]: r for r in thin_corpus(spark, f"{two}/train", f"{two}/dev", three, drop_fraction=0.5).collect()}
    assert report[None]["eligible_records"] == 2 and report[None]["removed_records"] == 1
    assert read_records(spark, f"{three}/train").count() == 5


def test_long_files_are_digested_in_chunks(spark, tmp_path):
    import hashlib
    import random

    folder = tmp_path / "some files"
    folder.mkdir()
    want = {}
    for i, size in enumerate((0, 10, 11, 70, 100_003)):
        data = random.Random(i).randbytes(size)
        (folder / f"f%20#{i} x").write_bytes(data)
        want[f"f%20#{i} x"] = (size, hashlib.sha256(data).hexdigest())
    for whole in (0, 10, 1 << 20):
        rows = file_digests(spark, [str(folder), str(tmp_path / "absent")], whole=whole, chunk=7).collect()
        assert {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in rows} == want
    assert file_digests(spark, [str(tmp_path / "absent")]).count() == 0


def test_fingerprints(spark, tmp_path):
    path = dump(tmp_path / "a.txt", "abc")
    rows = file_digests(spark, [path, str(tmp_path / "none")]).collect()
    assert [r["sha256"] for r in rows] == ["edeaaff3f1774ad2888673770c6d64097e391bc362d7d6fb34982ddf0efd18cb"]
    digest = lambda *rows: table_fingerprint(spark.createDataFrame(list(rows), "s string, t string"), "t").first()["digest"]
    assert digest((None, "x")) != digest(("", "x")) and digest(("a", "b1:c")) != digest(("a1:b", "c"))
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert table_fingerprint(a, "a").collect() == table_fingerprint(a.orderBy(F.desc("i")), "a").collect()
