"""Quality rules: divergence of a text's histograms from those of the languages.

A text is compared with language references by the Jensen-Shannon distance of two
histograms: classes of characters, and counts of common words.  The references are sums over
*all* documents of a language.  A text passes when it is near to at least one language.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrays import SPACE, Words, per_row, range_hashes, windows, words_of
from spanloom.llm.stage import parts

# Common words by language, lower case.
COMMON_WORDS = {
    "en": "the of and to in is that it was for on are as with be at by this have from or had an not but what all were when we there can your which their said if do will each about how up out them then she he his her they you i a so its no my",
    "de": "der die das und ist nicht ein eine zu den mit von auf für im dem sich des als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man wir ihr ich",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais comme ou si leur y dont aux cette ont ses lui nous tout elle deux même peu fait sans être bien",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está",
}
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
CLASSES = 10
CLASS = np.full(256, 8, np.uint8)  # 8: other ASCII
CLASS[128:192] = 255  # the further bytes of a character count once, with its first byte
CLASS[192:] = 9
CLASS[list(b"aeiou")] = 0
CLASS[[c for c in range(97, 123) if c not in b"aeiou"]] = 1
CLASS[65:91] = 2
CLASS[48:58] = 3
CLASS[list(b" \t")] = 4
CLASS[list(b"\r\n\v\f")] = 5
CLASS[list(b".,;:?!'\"-()")] = 6
CLASS[list(SYMBOLS)] = 7
SLICE_BYTES = 2_000_000


def vocabulary() -> tuple[np.ndarray, list[str]]:
    """Sorted hashes of the common words of all languages, and the words in that order."""

    words = sorted({w for text in COMMON_WORDS.values() for w in text.split()})
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    hashes = range_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
    order = np.argsort(hashes)
    return hashes[order], [words[i] for i in order]


def histograms(w: Words, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts per text of character classes, and of common words with all others last."""

    n = len(w.counts)
    kind = CLASS[w.data]
    row = np.repeat(np.arange(n), np.diff(w.offsets))
    seen = kind != 255
    classes = np.bincount(row[seen] * CLASSES + kind[seen], minlength=n * CLASSES).reshape(n, CLASSES)
    hashes = w.hashes(lower=True)
    at = np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)
    at[vocab[at] != hashes] = len(vocab)
    owner = np.repeat(np.arange(n), w.counts)
    words = np.bincount(owner * (len(vocab) + 1) + at, minlength=n * (len(vocab) + 1))
    return classes, words.reshape(n, len(vocab) + 1)


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """The plain counts of each text: words, their characters, symbols, repetition."""

    inside = ~SPACE[w.data]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    raw, dup = w.data.tobytes(), np.zeros(len(w.counts), np.int64)
    for i in np.flatnonzero(per_row(w.data == 10, w.offsets)):
        lines = [line for line in raw[w.offsets[i] : w.offsets[i + 1]].split(b"\n") if line.strip()]
        dup[i] = len(lines) - len(set(lines))
    hashes, index, rows = windows(w.hashes(), w.rows, 3, short=False)
    covered = np.zeros(len(w.starts) + 2, bool)
    owner = np.repeat(np.arange(len(w.counts)), np.diff(rows))
    key = hashes + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    for j in range(3):
        covered[index[twice] + j] = True
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": per_row(inside & ((w.data & 0xC0) != 0x80), w.offsets),
        "n_symbols": per_row(symbol[w.data], w.offsets),
        "n_dup_lines": dup,
        "n_repeat_words": per_row(covered[: len(w.starts)], w.rows),
    }


def language_references(docs: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Histogram sums of all documents of each language.

    Each task sums what it reads, Spark sums the tasks; what comes back is one row per
    language and histogram cell, whatever the number of documents.
    """

    vocab, _ = vocabulary()
    cells = CLASSES + len(vocab) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in parts(batch.column("text"), SLICE_BYTES):
                w = words_of(batch.column("text").slice(a, b - a))
                both = np.hstack(histograms(w, vocab))
                langs = np.array(batch.column("lang").slice(a, b - a).to_pylist(), object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + both[langs == lang].sum(0)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["lang", "cell", "n"]
            )

    rows = (
        docs.where("lang is not null and text is not null")
        .select("lang", "text")
        .mapInArrow(count, "lang string, cell int, n long")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    found: dict[str, np.ndarray] = {}
    for lang, cell, n in rows:
        found.setdefault(lang, np.zeros(cells, np.int64))[cell] = n
    return {k: (v[:CLASSES].tolist(), v[CLASSES:].tolist()) for k, v in sorted(found.items())}


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts to one histogram."""

    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)


def quality_rules(
    docs: DataFrame,
    references: dict[str, tuple[list[int], list[int]]] | None = None,
    keep_text: bool = False,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_class_distance: float = 0.2,
    max_word_distance: float = 0.33,
    class_guard: int = 300,
    word_guard: int = 150,
) -> DataFrame:
    """``docs`` without the text (unless ``keep_text``) with ``RESULT``: counts, distances, verdict.

    ``docs`` has ``text`` and, for the references, ``lang``; other columns pass through, except those
    named like a result.  A text fails the
    base with fewer than ``min_words`` words or with more than ``max_repeat_percent`` of its
    words in repeated three-word windows.  A text that passes it is kept when both distances to
    the nearest language are within their limits; a distance is only looked at from ``class_guard``
    characters and ``word_guard`` words on, as short texts are far from any language by chance.
    Null and empty texts have counts of 0 and fail the base.  Repeated rows give repeated
    results.  Without any language reference the distances are null and only the base decides.
    """

    references = language_references(docs) if references is None else references
    vocab, _ = vocabulary()
    results = [part.split()[0] for part in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in results and (keep_text or c != "text")]
    known = [(np.array(c), np.array(w)) for c, w in references.values()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in parts(batch.column("text"), SLICE_BYTES):
                w = words_of(batch.column("text").slice(a, b - a))
                out = base_counts(w)
                n = out["n_words"]
                failed = (n < min_words) | (100 * out["n_repeat_words"] > max_repeat_percent * n)
                passed = ~failed
                distance = [np.full(len(n), np.nan)] * 2
                if known:
                    classes, words = histograms(w, vocab)
                    distance = [
                        np.min([js_distance(classes, c) for c, _ in known], 0),
                        np.min([js_distance(words, x) for _, x in known], 0),
                    ]
                    passed &= (classes.sum(1) < class_guard) | (distance[0] <= max_class_distance)
                    passed &= (n < word_guard) | (distance[1] <= max_word_distance)
                columns = [*out.values(), failed, *distance, passed]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in kept), *(pa.array(c, from_pandas=True) for c in columns)],
                    [*kept, *results],
                )

    ddl = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    read = kept if keep_text else [*kept, "text"]
    return docs.select(*read).mapInArrow(judge, ", ".join([*ddl, RESULT]))
