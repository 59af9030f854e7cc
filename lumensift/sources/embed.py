"""Text embeddings through an injected function."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From texts to unit vectors; made once in each worker.
Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed word counts in hashed places, of length 1."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                out[row, h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0).tolist()

    return embed


def embedded(rows: DataFrame, make: Callable[[], Embedder], text_col: str = "text", batch: int = 32) -> DataFrame:
    """Rows with an `embedding`; the model is made once per task and fed in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            texts = frame[text_col].fillna("").tolist()
            frame["embedding"] = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield frame

    plain = rows.drop("embedding")
    return plain.mapInPandas(run, T.StructType([*plain.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])).withColumn("embedding", F.col("embedding"))
