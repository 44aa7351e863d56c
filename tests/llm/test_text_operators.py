"""Toxicity, language, quality rules, line quality and fingerprints."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_support import edge, edge_rows, empty, prose, words

from spanloom.llm.arrays import windows, words_of
from spanloom.llm.fingerprints import SHARE, encode, entropy_levels, entropy_ranks, fingerprint_documents, fingerprints, likeness
from spanloom.llm.language_id import predict_language, train_language_id
from spanloom.llm.line_quality import forward_backward, score_line_quality, train_line_quality
from spanloom.llm.quality_rules import js_distance, language_references, quality_rules
from spanloom.llm.toxicity import features_of, score_toxicity, train_toxicity

TEXTS = [r[1] for r in edge_rows()]


def test_words_and_windows_equal_the_pattern():
    w = words_of(pa.array(TEXTS))
    raw = w.data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in TEXTS for x in words(t)]
    assert w.counts.tolist() == [len(words(t)) for t in TEXTS]
    hashes, _, rows = windows(w.hashes(), w.rows, 3, short=True)
    seen = {}
    for i, t in enumerate(TEXTS):
        own = words(t)
        want = [tuple(own[j : j + 3]) for j in range(len(own) - 2)] if len(own) >= 3 else ([tuple(own)] if own else [])
        assert rows[i + 1] - rows[i] == len(want)
        for gram, h in zip(want, hashes[rows[i] : rows[i + 1]].tolist(), strict=True):
            assert seen.setdefault(gram, h) == h
    assert len(set(seen.values())) == len(seen)


def plain_counts(text):
    own = words(text)
    grams = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {i + j for i in range(len(own) - 2) if grams[tuple(own[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(own),
        sum(map(len, own)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_rules_counts(spark):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate([*TEXTS, "a b c a b c d # <x>", "x y\nx y\n x y"])]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_counts(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_rules_tell_other_characters(spark):
    rng = random.Random(1)
    good = [(i, prose(rng, 200), "en") for i in range(20)]
    odd = [(100, " ".join("#" * rng.randint(2, 7) + str(i) for i in range(200)), None)]
    docs = spark.createDataFrame(good + odd, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules(docs, max_word_distance=1.0).collect()}
    assert not kept.pop(100) and all(kept.values())


def test_js_distance_by_definition():
    p, q = np.array([[2.0, 0, 2]]), np.array([1.0, 1, 2])
    m = np.array([0.375, 0.125, 0.5])
    want = (0.5 * np.log2(0.5 / 0.375) + 0.5 * np.log2(1) + 0.25 * np.log2(0.25 / 0.375) + 0.25 * np.log2(2) + 0) / 2
    assert abs(js_distance(p, q)[0] - np.sqrt(want)) < 1e-12 and abs(m.sum() - 1) < 1e-12


def toxic_rows():
    rng = random.Random(2)
    rows = []
    for i in range(240):
        bad = i % 4 == 0
        text = prose(rng, 40) + (" you zorbel idiot zorbelak you" if bad else "")
        rows.append((i, text, int(bad)))
    return rows


def test_toxicity_learns_words_and_scores_all(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    model = train_toxicity(docs, labels, rounds=5)
    assert "zorbel" in model.words
    fresh = spark.createDataFrame([(1, rows[0][1].upper()), (2, rows[1][1]), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in score_toxicity(fresh, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0
    assert got[3].score == got[4].score and all(0 <= r.score <= 1 for r in got.values())
    wide = score_toxicity(edge(spark, clash=True), model)
    assert wide.count() == len(edge_rows()) and wide.columns.count("score") == 1
    assert score_toxicity(empty(spark), model).count() == 0


def test_toxicity_of_one_class_or_nothing(spark):
    docs, labels = edge(spark), spark.createDataFrame([(5, 0), (6, None)], "doc_id long, label int")
    assert {r.score for r in score_toxicity(docs, train_toxicity(docs, labels)).collect()} == {0.0}
    assert {r.score for r in score_toxicity(docs, train_toxicity(empty(spark), labels.limit(0))).collect()} == {0.0}


def test_toxicity_features():
    f = features_of("You IDIOT! st0pid id1ot", frozenset({"st0pid"}), frozenset())
    assert f[2] == 1 and f[5] == 1 and f[9] > 0 and f[13] == 1
    assert features_of(None, frozenset(), frozenset()) == [0.0] * len(f)


def test_language_id_on_held_out_texts(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30, "abcdeé" if i % 2 else "vwxyzü"), "fr" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language_id(docs.where("doc_id < 40"))
    got = {r.doc_id: r for r in predict_language(docs.where("doc_id >= 40"), model).collect()}
    assert all(got[i].lang_pred == rows[i][2] and 0 < got[i].score <= 1 for i in range(40, 60))
    odd = {r.doc_id: r for r in predict_language(edge(spark, clash=True), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1, 2, 3, 4))
    assert predict_language(empty(spark), model).count() == 0
    nothing = train_language_id(empty(spark).select("text", "lang"))
    assert {r.lang_pred for r in predict_language(docs, nothing).collect()} == {"und"}


def test_language_weights_are_the_counts(spark):
    from spanloom.llm.language_id import BUCKETS, gram_buckets

    docs = spark.createDataFrame([("ab ab", "x"), ("cd", "y"), (None, "y"), ("q", None)], "text string, lang string")
    model = train_language_id(docs, smoothing=1.0)
    gram, _ = gram_buckets(["ab ab"])
    counts = np.bincount(gram, minlength=BUCKETS) + 1.0
    assert np.allclose(model.weights[:, 0], np.log(counts / counts.sum()), atol=1e-5)


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([0, 3, 4, 4 + 5])
    score, moves = rng.normal(size=9), rng.normal(size=(2, 2))
    marginal, pairs, log_z = forward_backward(score, lines, moves)
    want, want_pairs, want_z = np.zeros((9, 2)), np.zeros((2, 2)), 0.0
    for a, b in zip(lines[:-1], lines[1:], strict=True):
        n, total, part, moved = b - a, 0.0, np.zeros((b - a, 2)), np.zeros((2, 2))
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            p = np.exp(sum(score[a + i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            for i in range(n):
                part[i, y[i]] += p
                if i:
                    moved[y[i - 1], y[i]] += p
        want[a:b], want_pairs, want_z = part / total, want_pairs + moved / total, want_z + np.log(total)
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_line_quality_on_held_out_texts(spark):
    rng = random.Random(4)

    def text(good):
        lines = [prose(rng, 8) if good else " | ".join(prose(rng, 8).upper().split()) + "!!" for _ in range(5)]
        return "\n".join(lines)

    rows = [(i, text(i % 3 > 0), int(i % 3 > 0)) for i in range(150)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:100]], "doc_id long, label int")
    model = train_line_quality(docs, labels, steps=60)
    got = {r.doc_id: r for r in score_line_quality(docs, model).collect()}
    assert all(got[i].predicted == rows[i][2] for i in range(100, 150))
    assert got[1].good_lines == [0, 1, 2, 3, 4] and got[0].good_lines == []
    odd = score_line_quality(edge(spark, clash=True), model).collect()
    assert len(odd) == len(edge_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert odd[0].score == odd[1].score  # null and empty
    assert score_line_quality(empty(spark), model).count() == 0
    one = train_line_quality(docs, labels.where("label = 1"))
    assert {r.score for r in score_line_quality(docs, one).collect()} == {1.0}


def test_entropy_is_that_of_the_window():
    data = np.frombuffer(("".join(random.Random(6).choices("abc d\n", k=900)) + "z" * 100).encode(), np.uint8)
    levels = entropy_levels(data)
    for i in range(0, len(data) - 63, 13):
        assert levels[i] == sum(int(SHARE[n]) for n in Counter(data[i : i + 64].tolist()).values()) * 1000 // (6 << 20)


def plain_features(raw, ranks):
    """Starts of the features of one text, neighbourhood by neighbourhood."""

    data = np.frombuffer(raw, np.uint8)
    levels = entropy_levels(data)
    rank = {i: int(ranks[v]) for i, v in enumerate(levels.tolist()) if 100 < v <= 990}
    wins = Counter()
    for first in range(-63, len(levels)):
        own = [(rank[i], i) for i in range(first, first + 64) if i in rank]
        if own:
            wins[min(own)[1]] += 1
    return sorted(i for i, n in wins.items() if n >= 16)


def test_features_are_the_popular_windows(spark):
    rng = random.Random(7)
    texts = [prose(rng, 80), prose(rng, 300), "x" * 300, "short", "", prose(rng, 14)]
    ranks = np.random.default_rng(1).permutation(1001)
    chains = fingerprints(pa.array(texts), ranks)
    for text, chain in zip(texts, chains, strict=True):
        n = len(plain_features(text.encode(), ranks)) or (1 if text else 0)
        assert len(chain) == -(-n // 160)
        assert np.unpackbits(chain).sum() <= 5 * n
        alone = fingerprints(pa.array([text]), ranks)[0]
        assert encode(alone) == encode(chain)
    assert likeness(chains[0], chains[0]) == 1 and likeness(chains[4], chains[4]) == 1 and likeness(chains[4], chains[0]) == 0
    assert likeness(chains[0], chains[1]) == likeness(chains[1], chains[0]) < 0.2


@pytest.mark.parametrize("block_rows", [1, 4, 1000])
def test_fingerprints_of_edited_texts(spark, block_rows):
    rows = [(1, "añb" * 50), (9, None), (4, ""), (7, "abcdefg" * 30), (3, "xyz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprint_documents(docs, block_rows=block_rows).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (doc, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
    assert got[9].fingerprint == got[4].fingerprint == "" and got[9].near_next != got[9].near_edited


def test_neighbours_by_string_identifiers(spark):
    rng = random.Random(12)
    texts = {f"doc-{rng.randint(0, 10**6)}-é{i}": prose(rng, 20) for i in range(40)} | {"": "first", "😀": "last one", None: "no name"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r for r in fingerprint_documents(docs, block_rows=7).collect()}
    order = sorted(texts, key=lambda k: (k is not None, k or ""), reverse=True)
    for doc, after in zip(order, [*order[1:], order[0]], strict=True):
        half = len(texts[doc]) // 2
        edited = texts[doc][: len(texts[doc]) - half] + texts[after][:half]
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_words_that_sums_of_powers_confuse_have_different_hashes(spark):
    from spanloom.llm.overlap_join import overlap_join

    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    w = words_of(pa.array([f"{one} {two} {one}", one[:300], two[:300]]))
    first, second, third, short, other = w.hashes().tolist()
    assert first == third != second and short != other
    texts = [f"x {one} y x {two} y", f"{one} two three", f"{two} two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    judged = quality_rules(docs, language_references(docs.selectExpr("text", "'en' as lang")))
    assert {r.doc_id: r.n_repeat_words for r in judged.collect()} == {0: 0, 1: 0, 2: 0}
    joined = overlap_join(docs, k=4, percent=85)
    assert {r.doc_id: r.component_id for r in joined.collect()} == {0: 0, 1: 1, 2: 2}


def test_fingerprints_of_odd_rows(spark):
    got = fingerprint_documents(edge(spark, clash=True)).collect()
    assert len(got) == len(edge_rows())
    same = {r.fingerprint for r in got if r.doc_id in (5, 6)}
    assert len(same) == 1 and fingerprint_documents(empty(spark)).count() == 0
    assert entropy_ranks(empty(spark)).tolist() == list(range(1001))


def test_references_count_all_rows(spark):
    docs = spark.createDataFrame([("aab the", "x"), ("B1", "x"), (None, "x"), ("z", None)], "text string, lang string")
    classes, common = language_references(docs)["x"]
    assert classes[:4] == [3, 3, 1, 1] and sum(common) == 3 and common[-1] == 2
