"""Embedding providers: a port, a provider that needs no model file, and the session's own."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimension of each known model; the vectors of all have length 1.
MODELS = {"hashed-384": 384, "hashed-768": 768}
DEFAULT = "hashed-384"


@dataclass(frozen=True)
class Provider:
    """make: called once in each Python worker, gives a function from texts to a matrix with one row a text."""

    name: str
    dimension: int
    make: Callable[[], Callable[[list[str]], np.ndarray]]

    def column(self, text: Column) -> Column:
        make = self.make

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = make()
            for texts in batches:
                yield pd.Series(list(_unit(own(texts.fillna("").tolist())).astype(np.float32)))

        return embed(text)

    def vectors(self, texts: list[str]) -> list[list[float]]:
        """For a query's few texts, on the driver."""
        return _unit(self.make()(texts)).astype(np.float32).astype(float).tolist()


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def hashed(dimension: int) -> Provider:
    """Words and their parts of three characters, each added at a place and with a sign by its hash."""

    def make() -> Callable[[list[str]], np.ndarray]:
        import re

        word = re.compile(r"\w{2,}")

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension))
            for k, text in enumerate(texts):
                for w in word.findall(text.lower()):
                    for part, weight in [(w, 1.0), *((w[i : i + 3], 0.3) for i in range(len(w) - 2))]:
                        h = zlib.crc32(part.encode())
                        out[k, (h >> 1) % dimension] += weight if h & 1 else -weight
            return out

        return embed

    return Provider(f"hashed-{dimension}", dimension, make)


_current: list[Provider] = []


def provider(name: str | None = None) -> Provider:
    """The session's provider; another name replaces it."""
    if name is not None and (not _current or _current[0].name != name):
        if name not in MODELS:
            raise ValueError(f"unknown model {name}; known are {', '.join(MODELS)}")
        _current[:] = [hashed(MODELS[name])]
    if not _current:
        _current.append(hashed(MODELS[DEFAULT]))
    return _current[0]


def use(own: Provider | None) -> None:
    """Sets the session's provider to any other one; None goes back to the default."""
    _current[:] = [] if own is None else [own]


def throughput(texts: DataFrame, names: list[str], text_col: str = "text") -> dict[str, float]:
    """Vectors a second of each model over all texts."""
    n, out = texts.count(), {}
    for name in names:
        start = time.time()
        texts.select(hashed(MODELS[name]).column(F.col(text_col)).alias("v")).write.format("noop").mode("overwrite").save()
        out[name] = n / max(time.time() - start, 1e-9)
    return out
