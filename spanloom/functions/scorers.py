"""A deterministic example scorer, to exercise ``score_windows`` without a model."""

import hashlib

import pandas as pd


def load_digest_scorer():
    """A scorer that proposes one span per token from the digest of the token."""

    def score(batch: pd.DataFrame) -> list:
        return [_spans(tokens) for tokens in batch["tokens"]]

    return score


def _spans(tokens) -> list[dict]:
    last = len(tokens) - 2
    found = []
    for i, token in enumerate(tokens):
        if token["tok"] is None:
            continue
        digest = hashlib.md5(token["tok"].encode(), usedforsecurity=False).hexdigest()
        found.append(
            {
                "label_id": int(digest[0], 16) % 3,
                "token_start": i,
                "token_end": min(i + int(digest[1], 16) % 2, last),
                "score": int(digest[2:4], 16) / 128.0 - 1.0,
            }
        )
    return found
