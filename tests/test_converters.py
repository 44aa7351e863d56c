import random

from pyspark.sql import functions as F

from spanloom.operators import converters as C
from spanloom.operators.ordered import contiguous_groups, number_rows
from spanloom.operators.overlap import drop_overlaps_longest, overlap_join, select_non_overlapping


def overlaps(a, b):
    return a[0] < b[1] and b[0] < a[1]


def brute_place(text, surfaces):
    taken, used, out = [], set(), [None] * len(surfaces)
    for i in sorted(range(len(surfaces)), key=lambda k: (-len(surfaces[k]), k)):
        w = surfaces[i]
        spots = [(p, p + len(w)) for p in range(len(text)) if text.startswith(w, p)]
        spots = [s for s in spots if s not in used]
        free = [s for s in spots if not any(overlaps(s, t) for t in taken)]
        pick = (free or spots or [None])[0]
        if pick:
            used.add(pick)
            taken.append(pick)
            out[i] = pick[0]
    return out


def test_assignment_matches_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        text = "".join(rng.choice("ab ") for _ in range(25))
        words = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randrange(24)
            words.append(text[a : a + rng.randint(1, 4)])
        rows.append((i, text, words))
    df = spark.createDataFrame(rows, "ord bigint, text string, surfaces array<string>")
    for r in C.assign_occurrences(df).collect():
        assert r["starts"] == brute_place(r["text"], r["surfaces"]), r


def test_convert_arrays(spark):
    rows = [
        (0, "7", "Alisher Navoiy Toshkentda, Ali", ["Ali", "Alisher Navoiy", "Toshkent", "kent"], ["per", "PER", "LOC", "DATE"]),
        (1, None, "Ali", ["Bob"], ["PER"]),
        (2, "x", "Ali", ["Ali"], []),
        (3, "y", "Ali", [], []),
        (4, "z", "Alisher", ["Ali", "Alisher"], ["LOC", "PER"]),
    ]
    df = spark.createDataFrame(rows, "ord bigint, id string, text string, surfaces array<string>, labels array<string>")
    done = {r["ord"]: r for r in C.convert_arrays(df).collect()}
    assert [tuple(e) for e in done[0]["entities"]] == [("NAME", 0, 14), ("GEO", 15, 25), ("NAME", 27, 30)]
    assert done[0]["source_labels"] == ["PER", "PER", "LOC", "DATE"] and done[0]["error"] is None
    assert done[1]["error"] == "occurrence" and done[2]["error"] == "lengths"
    assert done[3]["entities"] == [] and done[3]["error"] is None
    # the short surface falls back onto the long one, grows to the same span and loses
    # or wins by order of arrival
    assert [tuple(e) for e in done[4]["entities"]] == [("GEO", 0, 7)] and done[4]["dropped_overlaps"] == 1


def greedy(spans, key):
    kept = []
    for s in sorted(spans, key=key):
        if not any(overlaps(s[1:3], k[1:3]) for k in kept):
            kept.append(s)
    return sorted((s[0], s[1], s[2]) for s in kept)


def random_spans(seed, n_docs=40):
    rng = random.Random(seed)
    rows = []
    for d in range(n_docs):
        seen = set()
        for i in range(rng.randint(0, 25)):
            start = rng.randrange(60)
            span = (rng.choice(["ORG", "NAME", "GEO"]), start, start + rng.randint(1, 8))
            if span not in seen:
                seen.add(span)
                rows.append((f"d{d}", *span, i, rng.randrange(6) / 4.0))
    return rows


def test_greedy_folds_match_brute_force(spark):
    rows = random_spans(1)
    df = spark.createDataFrame(rows, "hash string, label string, start bigint, end bigint, idx bigint, score double")
    for result, key in (
        (drop_overlaps_longest(df), lambda s: (s[1] - s[2], s[1], s[2], s[3])),
        (select_non_overlapping(df), lambda s: (-s[4], s[1], s[1] - s[2], s[0])),
    ):
        got = {}
        for r in result.collect():
            got.setdefault(r["hash"], []).append((r["label"], r["start"], r["end"]))
        docs = {h for h, *_ in rows}
        for doc in docs:
            assert sorted(got.get(doc, [])) == greedy([r[1:] for r in rows if r[0] == doc], key), doc


def test_greedy_example(spark):
    rows = [("h", "NAME", 0, 5, 3.0), ("h", "ORG", 0, 10, 2.0), ("h", "GEO", 11, 15, 1.0)]
    df = spark.createDataFrame(rows, "hash string, label string, start bigint, end bigint, score double")
    assert sorted(r["label"] for r in select_non_overlapping(df).collect()) == ["GEO", "NAME"]


def test_overlap_join_finds_each_pair_once(spark):
    rows = [r[:4] for r in random_spans(2)] + [("d0", "ORG", 0, 5000), ("d0", "GEO", 500, 3000)]
    df = spark.createDataFrame(rows, "hash string, label string, start bigint, end bigint")
    got = sorted(tuple(r) for r in overlap_join(df, df, cell=16).select(*df.columns, "other_label", "other_start", "other_end").collect())
    want = sorted((*a, *b[1:]) for a in rows for b in rows if a[0] == b[0] and overlaps(a[2:4], b[2:4]))
    assert got == want


def test_runs_across_blocks_match_a_sequential_scan(spark):
    rng = random.Random(4)
    rows, number = [], 0
    for sheet in ("A", "B"):
        for _ in range(300):
            number += rng.choice([1, 1, 1, 40])
            rows.append((sheet, number, rng.choice("xy") if rng.random() < 0.3 or not rows else rows[-1][2]))
    want, last, run, start = {}, (None, None), 0, None
    for sheet, row, value in rows:
        if sheet != last[0]:
            run = 0
        if (sheet, value) != last:
            run, start, last = run + 1, row, (sheet, value)
        want[(sheet, row)] = (start, run)
    df = spark.createDataFrame(rows, "sheet string, row_no bigint, sentence_id string")
    for block in (7, 64, 10**6):
        got = {
            (r["sheet"], r["row_no"]): (r["run_start"], r["run_no"])
            for r in contiguous_groups(df, "sheet", "row_no", "sentence_id", block).collect()
        }
        assert got == want


def test_number_rows(spark):
    orders = [3, 5, 17, 18, 19, 400, 401, 9000]
    df = spark.createDataFrame([(o,) for o in orders], "ord bigint")
    got = {r["ord"]: r["n"] for r in number_rows(df, "ord", "n", block=10).collect()}
    assert got == {o: i + 1 for i, o in enumerate(orders)}


MAP = {"PER": "NAME", "PERSON": "NAME", "LOC": "GEO", "ORG": "ORG"}


def sequential_bioes(tags):
    """(label, first, last) and malformed counts, one token at a time."""

    found, bad, open_, start = [], [], None, None
    for i, tag in enumerate(tags):
        prefix, label = (tag, None) if tag == "O" else tag.split("-", 1)
        continues = prefix in "IE" and open_ == label and open_ is not None
        if prefix in "IE" and not continues:
            bad.append("malformed_label_transition" if open_ is not None else f"malformed_{prefix.lower()}_without_b")
        if open_ is not None and not continues:
            found.append((open_, start, i - 1))
            open_ = None
        if prefix != "O" and not continues:
            open_, start = label, i
        if prefix in "ES":
            found.append((open_, start, i))
            open_ = None
    if open_ is not None:
        found.append((open_, start, len(tags) - 1))
    return found, sorted(bad)


def test_bioes_matches_a_sequential_decoder(spark):
    rng = random.Random(8)
    rows, tags_of = [], {}
    for s in range(150):
        tags = [rng.choice(["O", "O", "B-PER", "I-PER", "E-PER", "S-LOC", "I-LOC", "E-ORG", "B-ORG"]) for _ in range(rng.randint(1, 12))]
        tags_of[f"s{s}"] = tags
        rows += [("A", s * 100 + i, f"s{s}", f"w{i}", t) for i, t in enumerate(tags)]
    df = spark.createDataFrame(rows, "sheet string, row_no bigint, sentence_id string, word string, tag string")
    for r in C.decode_bioes(C.detokenize(C.sentence_groups(df, block=250))).collect():
        found, bad = sequential_bioes(tags_of[r["sentence_id"]])
        tokens = r["tokens"]
        assert [tuple(e) for e in r["spans"]] == [(l, tokens[a]["start"], tokens[b]["end"]) for l, a, b in found]
        assert sorted(s["malformed"] for s in r["states"] if s["malformed"]) == bad


def test_bioes_example_drops_unsupported_labels(spark):
    rows = [
        ("D", 2, "Sentence 1", "Ali", "S-PER"),
        ("D", 3, "Sentence 1", "Toshkent", "B-LOC"),
        ("D", 4, "Sentence 1", "shahriga", "e_loc"),
        ("D", 5, "Sentence 1", "2024", "S-DATE"),
        ("D", 6, "Sentence 1", ".", "O"),
        ("D", 7, "Sentence 2", "(", "O"),
        ("D", 8, "Sentence 2", "x", "bad"),
    ]
    df = spark.createDataFrame(rows, "sheet string, row_no bigint, sentence_id string, word string, tag string")
    decoded = C.decode_bioes(C.detokenize(C.sentence_groups(df)))
    first, second = C.convert_sentences(decoded).orderBy("run_no").collect()
    assert first["text"] == "Ali Toshkent shahriga 2024."
    assert [tuple(e) for e in first["entities"]] == [("NAME", 0, 3), ("GEO", 4, 21)]
    assert second["text"] == "(x" and second["error"] == "tag"
    counts = {(r["metric"], r["key"]): r["value"] for r in C.tag_quality_counts(decoded).collect()}
    assert counts[("dropped_source_entities", "DATE")] == 1 and counts[("source_entities", "LOC")] == 1


def test_parse_tag(spark):
    tags = ["o", "B-per", "b_geo-political", "O-X", "X-PER", "B-", "B", "", "S-##"]
    df = spark.createDataFrame([(t,) for t in tags], "t string").select(C.parse_tag(F.col("t")).alias("p"))
    got = [None if r["p"] is None else tuple(r["p"]) for r in df.collect()]
    assert got == [("O", None), ("B", "PER"), ("B", "GEOPOLITICAL"), ("O", "X"), None, None, None, None, ("S", "")]


def test_conversion_matches_brute_force(spark):
    rng = random.Random(21)
    names = {"PER": "NAME", "LOC": "GEO", "ORG": "ORG"}
    rows = []
    for i in range(200):
        text = "".join(rng.choice("ab-, ") for _ in range(30))
        words = []
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(29)
            words.append(text[at : at + rng.randint(1, 5)])
        rows.append((i, str(i), text, words, [rng.choice(["per", "LOC", "ORG", "DATE"]) for _ in words]))
    df = spark.createDataFrame(rows, "ord bigint, id string, text string, surfaces array<string>, labels array<string>")
    done = {r["ord"]: r for r in C.convert_arrays(df).collect()}
    for i, _, text, words, labels in rows:
        starts = brute_place(text, words)
        if None in starts:
            assert done[i]["error"] == "occurrence"
            continue
        spans = []
        for start, word, label in zip(starts, words, labels):
            end = start + len(word)
            while end < len(text) and (text[end].isalnum() or text[end] in "'’ʻʼ-_"):
                end += 1
            if label.upper() in names:
                spans.append((names[label.upper()], start, end, len(spans)))
        want = sorted(greedy(spans, lambda s: (s[1] - s[2], s[1], s[2], s[3])), key=lambda e: e[1])
        assert [tuple(e) for e in done[i]["entities"]] == want
        assert done[i]["dropped_overlaps"] == len(spans) - len(want)


def test_one_pass_finds_the_occurrences_of_many_words(monkeypatch):
    import random

    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 80)))
        words = {"".join(rng.choice("abé😀 ") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 20))}
        want = {w: [i for i in range(len(text)) if text.startswith(w, i)] for w in words}
        for several in (1, 1000):
            monkeypatch.setattr(C, "SEVERAL", several)
            assert C._occurrences(text, words) == want
