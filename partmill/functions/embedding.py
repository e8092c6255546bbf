"""Feature hashing of tokens and three-letter prefixes into a unit vector."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import VECTOR_DIM

TOKEN = re.compile(r"[a-z0-9]+")


def slot(token: str, dim: int = VECTOR_DIM) -> int:
    """Deterministic position: first eight hex digits of the token's md5, modulo dim."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_vector(texts: pd.Series) -> pd.Series:
    seen: dict[str, int] = {}
    out = np.zeros((len(texts), VECTOR_DIM))
    for row, text in enumerate(texts):
        index, weight = [], []
        for token, n in Counter(TOKEN.findall((text or "").lower())).items():
            for feature, w in ((token, 1.0), (token[:3], 0.25)) if len(token) >= 3 else ((token, 1.0),):
                at = seen.get(feature)
                if at is None:
                    at = seen[feature] = slot(feature)
                index.append(at)
                weight.append(w * n)
        vector = np.bincount(np.array(index, dtype="int64"), weights=weight, minlength=VECTOR_DIM)
        norm = float(np.sqrt((vector * vector).sum())) or 1.0
        out[row] = vector / norm
    return pd.Series(list(out))


# Never evaluated a second time for a filter the optimizer infers from its result.
hash_vector = hash_vector.asNondeterministic()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
