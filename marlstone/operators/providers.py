"""Embedding, generation and OCR behind small interfaces, with offline defaults that need no model."""

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


class Embedder(Protocol):
    dims: int

    def embed(self, texts: Column) -> Column: ...


class HashingEmbedder:
    """Token counts hashed into ``dims`` places and scaled to unit length. Deterministic; its quality is not that of a trained model.

    Whole texts are read. ``longest`` cuts them to so many characters, as a service with such a limit would.
    """

    def __init__(self, dims: int = 64, longest: int | None = None):
        self.dims, self.longest = dims, longest

    def embed(self, texts: Column) -> Column:
        """Tokens are hashed by Spark; one Arrow function counts a batch's places."""
        dims = self.dims
        read = texts if self.longest is None else F.substring(texts, 1, self.longest)

        @F.pandas_udf("array<float>")
        def unit(cells: pd.Series) -> pd.Series:
            def one(c):
                v = np.bincount(np.asarray(c, dtype=np.int64), minlength=dims).astype(np.float64)
                norm = np.sqrt(v @ v)
                return (v / norm if norm else v).astype(np.float32)

            return cells.map(one)

        return unit(F.transform(T.tokens(read), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")))


class Generator(Protocol):
    def answer(self, question: Column, context: Column) -> Column: ...


class ExtractiveGenerator:
    """Answers with the first passages of the context."""

    def __init__(self, passages: int = 3):
        self.passages = passages

    def answer(self, question: Column, context: Column) -> Column:
        return F.array_join(F.slice(F.split(context, "\n\n"), 1, self.passages), "\n\n")
