"""Embedders are plug-ins: anything that turns a column of texts into a column of vectors.

The default needs no model: every term adds or takes one at a place given by its hash, and the
sum is brought to length 1. The same text gives the same vector everywhere. Blank and null
texts give null.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.text import terms

Embedder = Callable[[Column], Column]


def hashing(width: int = 64) -> Embedder:
    """The default embedder."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(words: pd.Series) -> pd.Series:
        def one(found) -> list[float] | None:
            if found is None or not len(found):
                return None
            v = np.zeros(width)
            for w in found:
                h = zlib.crc32(w.encode())
                v[(h >> 1) % width] += 1 if h & 1 else -1
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return words.map(one)

    return lambda text: embed(terms(text))
