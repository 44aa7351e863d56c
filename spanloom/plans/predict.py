"""Texts to predicted spans with a user's scorer."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from spanloom.operators.decode import (
    Scorer,
    decode_span_records,
    score_windows,
)
from spanloom.operators.typography import normalize_records
from spanloom.operators.windows import token_windows, tokenize_offsets


def predict_spans(
    records: DataFrame,
    load_scorer: Callable[[], Scorer],
    *,
    max_length: int = 512,
    stride: int = 128,
    batch_size: int = 16,
    threshold: float = 0.0,
    normalize: bool = True,
) -> DataFrame:
    """``(hash, entities)`` for records ``(hash, text)`` (or with their own ``tokens``)."""

    prepared = normalize_records(records) if normalize else records
    if "tokens" not in prepared.columns:
        prepared = tokenize_offsets(prepared)
    windows = token_windows(prepared.select("hash", "tokens"), max_length, stride)
    scored = score_windows(windows, load_scorer, batch_size=batch_size)
    return decode_span_records(scored, records, threshold)
