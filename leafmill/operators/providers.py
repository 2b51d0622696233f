"""Embedding providers: a plug-in function behind one Arrow UDF, with batches, retries and an offline default."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import unit_vector

Embedder = Callable[[list[str]], list[list[float]]]


def offline_embedder(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Deterministic vectors of hashed character pairs."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        for i in range(max(1, len(t) - 1)):
            h = int.from_bytes(hashlib.blake2b(t[i : i + 2].encode(), digest_size=4).digest(), "big")
            v[h % dim] += 1 if h & 1 << 31 else -1
        out.append((v / (np.linalg.norm(v) or 1)).tolist())
    return out


def embed(text: Column, embedder: Embedder = offline_embedder, batch: int = 10, attempts: int = 3, pause: float = 0.5) -> Column:
    """``struct<embedding, error>`` of each text; a batch that fails ``attempts`` times gives its rows the error."""

    @F.pandas_udf("embedding array<float>, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            texts, vectors, errors = [t or "" for t in s], [], []
            for i in range(0, len(texts), batch):
                own, got, error = texts[i : i + batch], None, None
                for k in range(attempts):
                    try:
                        got = embedder(own)
                        if len(got) != len(own):
                            raise ValueError(f"{len(got)} vectors for {len(own)} texts")
                        error = None
                        break
                    except Exception as e:  # the provider's errors are data here
                        got, error = None, str(e)
                        time.sleep(pause * (k + 1))
                vectors += got or [None] * len(own)
                errors += [error] * len(own)
            yield pd.DataFrame({"embedding": vectors, "error": errors})

    return run(text)


def question_vectors(questions: DataFrame, embedder: Embedder = offline_embedder, **options) -> DataFrame:
    """``question_id`` and ``qvec``, the unit vector of each question that the embedder answers; the others have no row."""
    e = questions.select("question_id", embed(F.col("question"), embedder, **options).alias("e")).where("e.error is null and exists(e.embedding, x -> x <> 0)")
    return e.select("question_id", unit_vector(F.col("e.embedding")).alias("qvec"))
