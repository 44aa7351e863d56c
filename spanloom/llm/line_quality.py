"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad.  A line's features are its own and those of the lines before and
after it; the chain couples neighbouring labels.  The score of a text is the mean of the
lines' forward-backward marginals of "good", weighted by line length.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.arrays import range_hashes, words_of
from spanloom.llm.quality_rules import SYMBOLS, vocabulary
from spanloom.llm.stage import labelled_sample, parts

OWN = 12
FEATURES = 3 * OWN + 2
SLICE_BYTES = 2_000_000


def _class(chars: bytes | range) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


UPPER, DIGIT, SYMBOL = _class(range(65, 91)), _class(range(48, 58)), _class(SYMBOLS)
PUNCT, SHOUT, WIDE = _class(b".,;:'\"-()"), _class(b"!?"), _class(range(128, 256))


def line_features(text: pa.Array, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every ``\\n``-separated line, the offsets of each text's lines, line sizes.

    A text has one line more than line feeds; null and empty texts have one empty line.
    """

    w = words_of(text)
    feeds = np.flatnonzero(w.data == 10)
    starts = np.sort(np.concatenate((w.offsets[:-1], feeds + 1)), kind="stable")
    ends = np.sort(np.concatenate((feeds, w.offsets[1:])), kind="stable")
    lines = np.searchsorted(feeds, w.offsets) + np.arange(len(w.offsets))
    size, n = ends - starts, len(starts)

    def rate(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[ends] - total[starts]) / np.maximum(size, 1)

    hashes = w.hashes(lower=True)
    line_of = np.searchsorted(starts, w.starts, "right") - 1
    words = np.bincount(line_of, minlength=n)
    common = np.zeros(len(hashes), bool)
    if len(hashes):
        at = np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)
        common = vocab[at] == hashes
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    shape = range_hashes(w.data, starts, ends)
    owner = np.repeat(np.arange(len(lines) - 1), np.diff(lines))
    key = shape + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    seen = np.ones(n, bool)
    seen[np.unique(key, return_index=True)[1]] = False
    per = np.maximum(words, 1)
    own = np.stack(
        [
            np.log1p(size) / 5,
            np.log1p(words) / 5,
            rate(UPPER[w.data]),
            rate(DIGIT[w.data]) * 2,
            rate(SYMBOL[w.data]) * 4,
            rate(PUNCT[w.data]) * 4,
            rate(SHOUT[w.data]) * 4,
            rate(WIDE[w.data]),
            np.bincount(line_of, weights=common, minlength=n) / per,
            np.bincount(line_of, weights=again, minlength=n) / per * 2,
            seen & (size > 0),
            np.minimum(size / per / 10, 3),
        ],
        axis=1,
    )
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[lines[:-1]] = last[lines[1:] - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first] = after[last] = 0
    return np.hstack([own, before, after, first[:, None], np.ones((n, 1))]), lines, size


@dataclass
class LineModel:
    """Weights of the features for "good" against "bad", log transitions, share of good texts."""

    weights: np.ndarray
    moves: np.ndarray
    prior: float
    bends: tuple[float, float] = (1.0, 0.0)


def forward_backward(
    score: np.ndarray, lines: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals ``(line, label)``, expected transitions ``(2, 2)`` and the log partition.

    All chains advance together, longest first, one step per line position.
    """

    sizes = np.diff(lines)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = lines[:-1][order], sizes[order]
    top = np.maximum(score, 0)
    phi = np.stack([np.exp(-top), np.exp(score - top)], 1)
    trans = np.exp(moves)
    alpha, beta, norm = np.empty_like(phi), np.ones_like(phi), np.empty(len(score))
    deepest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(deepest), "left")  # chains longer than t
    for t in range(deepest):
        at = begin[: active[t]] + t
        a = phi[at] if t == 0 else (alpha[at - 1] @ trans) * phi[at]
        norm[at] = a.sum(1)
        alpha[at] = a / norm[at][:, None]
    pairs = np.zeros((2, 2))
    for t in range(deepest - 1, 0, -1):
        at = begin[: active[t]] + t
        right = phi[at] * beta[at] / norm[at][:, None]
        pairs += alpha[at - 1].T @ right * trans
        beta[at - 1] = right @ trans.T
    gamma = alpha * beta
    return gamma / gamma.sum(1, keepdims=True), pairs, float(np.log(norm).sum() + top.sum())


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> list:
    vocab, _ = vocabulary()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in parts(batch.column("text"), SLICE_BYTES):
                x, lines, size = line_features(batch.column("text").slice(a, b - a), vocab)
                x, size = x.astype(np.float32), size.astype(np.int32)
                raw = [x[i:j].tobytes() for i, j in zip(lines[:-1], lines[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(a, b - a), pa.array(raw, pa.binary()), pa.array([size[i:j].tobytes() for i, j in zip(lines[:-1], lines[1:], strict=True)], pa.binary())],
                    ["label", "x", "size"],
                )

    chosen = labelled_sample(docs, labels, rows, "line-quality")
    return chosen.select("text", "label").mapInArrow(compute, "label int, x binary, size binary").collect()


def train_line_quality(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 4_000, steps: int = 150, rate: float = 0.1, decay: float = 1e-3
) -> LineModel:
    """Learn from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, label`` 0 or 1).

    All lines take their text's label.  The sample is bounded by ``sample_rows`` labelled
    identifiers; its line features, not its
    texts, come to the driver, where the likelihood is climbed with Adam.  Both classes weigh the
    same.  Without rows, or with one class only, the model scores the share of good texts.
    """

    rows = _sample(docs, labels, sample_rows)
    y = np.array([r.label for r in rows], int)
    prior = float(y.mean()) if len(y) else 0.0
    if len(set(y)) < 2:
        return LineModel(np.zeros(FEATURES), np.zeros((2, 2)), prior)
    parts_ = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    groups = []
    for label in (0, 1):  # the two classes weigh differently, so they are summed apart
        own = [p for p, v in zip(parts_, y, strict=True) if v == label]
        lines = np.concatenate(([0], np.cumsum([len(p) for p in own])))
        groups.append((np.concatenate(own).astype(np.float64), lines, label, weight[y == label][0] / lines[-1] * len(own)))
    scale = sum(len(lines) * k for _, lines, _, k in groups)
    theta = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gradient = np.zeros_like(theta)
        for x, lines, label, k in groups:
            marginal, pairs, _ = forward_backward(x @ theta[:FEATURES], lines, theta[FEATURES:].reshape(2, 2))
            gradient[:FEATURES] += k * (x.T @ (label - marginal[:, 1]))
            seen = np.zeros((2, 2))
            seen[label, label] = lines[-1] - len(lines) + 1
            gradient[FEATURES:] += k * (seen - pairs).ravel()
        gradient = gradient / scale - decay * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model = LineModel(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), prior)
    size = [np.frombuffer(r.size, np.int32) for r in rows]
    lines = np.concatenate(([0], np.cumsum([len(p) for p in parts_])))
    raw = text_scores(np.concatenate(parts_).astype(np.float64), lines, np.concatenate(size), model)
    model.bends = _platt(raw, y)
    return model


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0.1, so that order is kept) and shift of a logistic curve over the raw logit."""

    z = np.log(raw) - np.log1p(-raw)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((y - p) * z).sum() - (a - 1), (y - p).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a + move[0], 0.1), b + move[1]
    return float(a), float(b)


def text_scores(x: np.ndarray, lines: np.ndarray, size: np.ndarray, model: LineModel) -> np.ndarray:
    """Length-weighted mean of the marginals of "good" per text, strictly between 0 and 1."""

    marginal, _, _ = forward_backward(x @ model.weights, lines, model.moves)
    weight = np.maximum(size, 1)
    total = np.concatenate(([0.0], np.cumsum(marginal[:, 1] * weight)))
    mass = np.concatenate(([0], np.cumsum(weight)))
    mean = (total[lines[1:]] - total[lines[:-1]]) / (mass[lines[1:]] - mass[lines[:-1]])
    return np.clip(mean, 1e-6, 1 - 1e-6)


def score_line_quality(docs: DataFrame, model: LineModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the text, with ``score``, ``predicted`` and ``good_lines``.

    ``good_lines`` are the numbers, from 0, of the lines whose marginal of "good" is at least one half.
    Null and empty texts count as one empty line and get a score.  Equal texts get equal
    scores; other columns pass through, except those named like a result.
    """

    kept = [c for c in docs.columns if c not in ("text", "score", "predicted", "good_lines")]
    vocab, _ = vocabulary()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in parts(batch.column("text"), SLICE_BYTES):
                x, lines, size = line_features(batch.column("text").slice(a, b - a), vocab)
                marginal, _, _ = forward_backward(x @ model.weights, lines, model.moves)
                raw = text_scores(x, lines, size, model)
                slope, shift = model.bends
                score = 1 / (1 + np.exp(-np.clip(slope * (np.log(raw) - np.log1p(-raw)) + shift, -30, 30)))
                if not model.weights.any():
                    score = np.full(len(raw), model.prior)
                good = np.flatnonzero(marginal[:, 1] >= 0.5)
                owner = np.searchsorted(lines, good, "right") - 1
                at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(raw))))).astype(np.int32)
                numbers = pa.ListArray.from_arrays(pa.array(at), pa.array((good - lines[owner]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in kept), pa.array(score), pa.array((score >= threshold).astype(np.int32)), numbers],
                    [*kept, "score", "predicted", "good_lines"],
                )

    ddl = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(*kept, "text").mapInArrow(compute, ", ".join([*ddl, "score double", "predicted int", "good_lines array<int>"]))
