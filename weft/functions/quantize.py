"""Vectors at 2, 3 or 4 bits per component: a fixed rotation, then a scalar code around the vector's own scale."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20_240_229
#: Range of a rotated unit vector's components, in standard deviations.
SPREAD = {2: 1.5, 3: 2.2, 4: 2.8}


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, bits: int) -> np.ndarray:
    """(rows, dim * bits / 8) bytes. Lengths are lost: codes stand for directions."""
    if bits not in SPREAD or x.shape[1] % 8:
        raise ValueError("2, 3 or 4 bits, and a dimension that 8 divides")
    length = np.linalg.norm(x, axis=1, keepdims=True)
    turned = (x / np.where(length > 0, length, 1)) @ rotation(x.shape[1]) * np.sqrt(x.shape[1])
    levels = 1 << bits
    code = np.clip(np.floor((turned / SPREAD[bits] + 1) / 2 * levels), 0, levels - 1).astype(np.uint8)
    planes = (code[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(x), -1), axis=1)


def decode(data: np.ndarray, dim: int, bits: int) -> np.ndarray:
    """Unit vectors near those that were encoded."""
    planes = np.unpackbits(data, axis=1)[:, : dim * bits].reshape(len(data), dim, bits)
    code = (planes << np.arange(bits, dtype=np.uint8)).sum(axis=2)
    turned = ((code + 0.5) / (1 << bits) * 2 - 1) * SPREAD[bits]
    x = turned @ rotation(dim).T
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def encoded(vectors: DataFrame, column: str, bits: int = 4) -> DataFrame:
    """The rows with ``code`` binary beside the vector."""

    @F.pandas_udf("binary")
    def code(v: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in encode(np.stack(v.to_numpy()).astype(np.float64), bits)] if len(v) else [], dtype=object)

    return vectors.withColumn("code", code(column))


def estimated(column: str, query: list[float], bits: int = 4):
    """Cosine of a query with encoded vectors, as a column."""

    @F.pandas_udf("double")
    def score(c: pd.Series) -> pd.Series:
        q = np.asarray(query, dtype=np.float64)
        data = np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) if len(c) else np.zeros((0, len(query) * bits // 8), np.uint8)
        return pd.Series(decode(data, len(query), bits) @ (q / max(np.linalg.norm(q), 1e-12)))

    return score(column)
