import json
import os

from spanloom.operators.typography import alias_index
from spanloom.streaming import intake


def run(stream, spark, tmp_path, name):
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / f"{name}-state"))
        .option("path", str(tmp_path / name))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name))


def checked_table(spark, folder, tmp_path):
    intake.use_state_store(spark)
    checked = intake.stream_checked(intake.parse_stream(intake.read_stream(spark, str(folder))))
    intake.write_checked(checked, str(tmp_path / "checked"), str(tmp_path / "checked-state")).awaitTermination(120)
    return spark.read.schema(checked.schema).parquet(str(tmp_path / "checked"))


def test_accepted_and_rejected_lines_are_the_input(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ['{"hash":"a","text":"one"}', '{"hash":"b","text":"two"}', '{"hash":"a","text":"clash"}', "", '{"hash":"c"}']
    lines += ['{"hash":"a","text":"third"}', '{"hash":"b","text":"two"}']
    (folder / "1.jsonl").write_text("\n".join(lines) + "\n")
    table = checked_table(spark, folder, tmp_path)
    good = intake.stream_intake(table).collect()
    assert sorted(r["hash"] for r in good) == ["a", "b"]
    bad = intake.stream_quarantine(table).collect()
    assert sorted(r["error"] for r in bad) == ["blank"] + ["duplicate_hash"] * 3 + ["text"]
    # of clashing texts of one batch each is in exactly one of the two tables
    texts = [json.loads(r["value"])["text"] for r in bad if r["error"] == "duplicate_hash"] + [r["text"] for r in good]
    assert sorted(texts) == ["clash", "one", "third", "two", "two"]
    assert sorted(r.value for r in table.collect()) == sorted(lines)
    # a second run sees only what arrived since, also in an old file; a repeat with another text is kept aside
    late = folder / "2.jsonl"
    late.write_text('{"hash":"a","text":"other"}\n{"hash":"d","text":"new"}\n')
    os.utime(late, (1_000_000_000, 1_000_000_000))
    table = checked_table(spark, folder, tmp_path)
    bad = intake.stream_quarantine(table).collect()
    assert any("other" in r["value"] for r in bad)
    assert sorted(r["hash"] for r in intake.stream_intake(table).collect()) == ["a", "b", "d"]
    assert table.count() == len(lines) + 2


def test_a_mark_is_removed_after_the_delay(monkeypatch):
    import pandas as pd

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers = []

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 0

    handle = Handle()
    marks = intake.FirstLines(1000)
    marks.init(handle)
    chunk = pd.DataFrame({"arrived": pd.to_datetime([5, 5], unit="ms"), "hash": ["a", "a"]})
    assert [list(c["error"]) for c in marks.handleInputRows(("a",), iter([chunk, chunk]), Timers())] == [[None, "duplicate_hash"], ["duplicate_hash"] * 2]
    assert handle.timers == [1005]
    list(marks.handleExpiredTimer(("a",), Timers(), None))
    assert [list(c["error"]) for c in marks.handleInputRows(("a",), iter([chunk]), Timers())] == [[None, "duplicate_hash"]]


def test_normalization_of_arriving_predictions(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = {"hash": "h", "text": "Sardor NUKUSGA", "entities": [{"label": "NAME", "start": 0, "end": 6}, {"label": "GEO", "start": 7, "end": 14}]}
    (folder / "1.jsonl").write_text(json.dumps(line) + "\n")
    aliases = spark.createDataFrame([("GEO", "nukusga", "Nukus")], "label string, alias string, canonical string")
    parsed = intake.parse_stream(intake.read_stream(spark, str(folder)), require_entities=True)
    named = intake.stream_normalize(parsed.filter("error is null"), alias_index(aliases))
    rows = run(named, spark, tmp_path, "named").orderBy("start").collect()
    assert [(r["surface"], r["normalized"]) for r in rows] == [("Sardor", "Sardor"), ("NUKUSGA", "Nukus")]


def test_batches_follow_bytes_and_not_the_number_of_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(120):
        (folder / f"{i}.jsonl").write_text(json.dumps({"hash": f"h{i}", "text": "t"}) + "\n")

    def batches(name, **limits):
        query = (
            intake.read_stream(spark, str(folder), **limits).writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / f"{name}-state"))
            .option("path", str(tmp_path / name)).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert spark.read.parquet(str(tmp_path / name)).count() == 120
        return len(list((tmp_path / f"{name}-state" / "commits").glob("[0-9]*")))

    assert batches("files") == 2
    assert batches("bytes", bytes_per_trigger=1024**2) == 1


def test_a_batch_outweighs_the_index_it_joins():
    from workload.q_sources import batch_bytes

    assert batch_bytes(0) == 4 * 1024**3
    assert all(n * 64 <= batch_bytes(n) for n in (10**6, 10**9, 10**12))
