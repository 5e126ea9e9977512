"""Embedders behind one interface, with a deterministic offline default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384
#: Words (or tokens) of a text that a model sees.
WINDOW = 256


def masked_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the positions that the mask keeps: padding never enters, so a text's vector doesn't depend on its batch."""
    kept = mask[..., None].astype(np.float64)
    return (states * kept).sum(-2) / np.maximum(kept.sum(-2), 1e-9)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-9)


def hashed(text: str, dim: int = DIM, window: int = WINDOW) -> np.ndarray:
    """Signed word hashing of the first ``window`` words, unit length."""
    v = np.zeros(dim)
    for word in (text or "").lower().split()[:window]:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1
    return unit(v)


def hashed_all(texts: list[str]) -> np.ndarray:
    return np.stack([hashed(t) for t in texts]) if texts else np.zeros((0, DIM))


class TokenModel:
    """Adapter of a token model: ``tokens`` cuts a text into ids, ``states`` maps padded ids and their mask to a state for each.

    A text's vector is the mean of its own tokens' states, at unit length; texts are padded to the longest of their batch.
    """

    def __init__(self, tokens: Callable[[str], list[int]], states: Callable[[np.ndarray, np.ndarray], np.ndarray], window: int = WINDOW):
        self.tokens, self.states, self.window = tokens, states, window

    def __call__(self, texts: list[str]) -> np.ndarray:
        ids = [self.tokens(t)[: self.window] for t in texts]
        width = max(1, max(map(len, ids), default=1))
        padded, mask = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
        for n, row in enumerate(ids):
            padded[n, : len(row)], mask[n, : len(row)] = row, 1
        return unit(masked_mean(np.asarray(self.states(padded, mask), np.float64), mask))


def embedder(encode: Callable[[list[str]], np.ndarray] = hashed_all, batch: int = 64) -> Callable[[Column], Column]:
    """A column function over Arrow batches: ``encode`` gets up to ``batch`` texts at once. A null text has a null vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, at = [None] * len(texts), np.flatnonzero(texts.notna().to_numpy())
            for b in range(0, len(at), batch):
                rows = at[b : b + batch]
                for r, v in zip(rows, np.asarray(encode(texts.iloc[rows].tolist()), np.float32), strict=True):
                    out[r] = v
            yield pd.Series(out)

    return run
