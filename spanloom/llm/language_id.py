"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrays import mix
from spanloom.llm.stage import parts

UNKNOWN = "und"
BUCKETS = 1 << 15
SIZES = (1, 2, 3)
SLICE_BYTES = 1_000_000


@dataclass
class LanguageModel:
    """``weights[bucket, language]``: log-probability of a bucket; ``prior``: of a language."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray


def gram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of all n-grams, text after text, and the offsets of the texts.

    N-grams of ``SIZES`` code points of the whole lower-cased text; none crosses two texts.
    """

    lower = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lower], np.int64)
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, row = len(codes), np.repeat(np.arange(len(lower)), sizes)
    grams, owners = [], []
    for k in SIZES:
        m = max(n - k + 1, 0)
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + m] + np.uint64(1)
        inside = row[:m] == row[k - 1 : k - 1 + m]
        grams.append((mix(h[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(row[:m][inside])
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    return gram[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(lower)))))


def train_language_id(labelled: DataFrame, smoothing: float = 0.5, max_languages: int = 500) -> LanguageModel:
    """Learn from all rows ``text, lang``; rows with a null in either are left out.

    Each task counts its n-grams per language and sends at most one row per language and
    bucket; Spark sums them.  The matrix that comes back is bounded by ``max_languages`` x
    ``BUCKETS``; more languages are an error.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in parts(batch.column("text"), SLICE_BYTES):
                gram, at = gram_buckets(batch.column("text").slice(a, b - a).to_pylist())
                langs = np.array(batch.column("lang").slice(a, b - a).to_pylist(), object)
                spread = np.repeat(langs, np.diff(at)) if len(set(langs)) > 1 else None
                for lang in set(langs):
                    own = gram if spread is None else gram[spread == lang]
                    total = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    total[:BUCKETS] += np.bincount(own, minlength=BUCKETS)
                    total[BUCKETS] += int((langs == lang).sum())
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"]
            )

    table = (
        labelled.where("text is not null and lang is not null")
        .select("text", "lang")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    )
    rows = table.limit(max_languages + 1).collect()
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(r.lang for r in rows)
    counts = np.zeros((BUCKETS + 1, len(languages)))
    for r in rows:
        cells = np.array(r.cells, np.int64).reshape(-1, 2)
        counts[cells[:, 0], languages.index(r.lang)] = cells[:, 1]
    grams, texts = counts[:BUCKETS] + smoothing, counts[BUCKETS]
    return LanguageModel(
        languages, np.log(grams / grams.sum(0)).astype(np.float32), np.log(texts / max(texts.sum(), 1)) if languages else texts
    )


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the text, with ``lang_pred`` and ``score`` (posterior, 0 to 1).

    Null texts and texts without a letter, and all texts if nothing was learned, are ``und`` with
    score 0.  Ties go to the first language in sorted order.  Repeated rows and equal texts
    get equal results; other columns pass through, except those named like a result.
    """

    kept = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    languages = model.languages
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.prior))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, prior = shared.value
        for batch in batches:
            for a, b in parts(batch.column("text"), SLICE_BYTES):
                texts = batch.column("text").slice(a, b - a).to_pylist()
                known = np.array([bool(languages) and t is not None and any(map(str.isalpha, t)) for t in texts], bool)
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                gram, at = gram_buckets(texts)
                for i in np.flatnonzero(known):
                    # a sparse row: the n-grams of one text against the shared matrix
                    total = weights[gram[at[i] : at[i + 1]]].sum(0, dtype=np.float64) + prior
                    best[i] = total.argmax()
                    score[i] = 1 / np.exp(total - total[best[i]]).sum()
                names = [languages[best[i]] if known[i] else UNKNOWN for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in kept), pa.array(names, pa.string()), pa.array(score)],
                    [*kept, "lang_pred", "score"],
                )

    ddl = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["lang_pred string", "score double"]
    return docs.select(*kept, "text").mapInArrow(predict, ", ".join(ddl))
