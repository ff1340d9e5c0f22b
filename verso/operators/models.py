"""Interfaces of the external models, with deterministic stand-ins.

A stand-in has the shape of the model that it stands for, not its quality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verso.functions.text import tokens


def embedder(embed: Callable[[list[list[str]]], np.ndarray]):
    """A vectorised embedding function from token arrays to vectors; the model is made once a worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embed([list(t) for t in batch]).astype(np.float32)), dtype=object)

    return run


def hashing_vectors(texts: list[list[str]], size: int = 64) -> np.ndarray:
    """Stand-in embedder: signed hashing of tokens, of length one unless empty."""
    out = np.zeros((len(texts), size))
    for i, words in enumerate(texts):
        for w in words:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % size] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def embed(text: Column, model: Callable = hashing_vectors) -> Column:
    return embedder(model)(tokens(text))


def overlap_score(question: Column, text: Column) -> Column:
    """Stand-in reranker: the share of a question's distinct tokens that a text has."""
    q, t = F.array_distinct(tokens(question)), tokens(text)
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0)), 6)


def extractive_answer(question: Column, context: Column, most: int = 400) -> Column:
    """Stand-in generator: the head of the best context, or a refusal."""
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit("Tôi không tìm thấy thông tin này.")).otherwise(F.substring(context, 1, most))
