"""Paths of a JSON text at every depth: base.key, base[i], in the text's order."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def of(value: object, base: str) -> list[str]:
    out, todo = [], [(value, base)]
    while todo:
        value, base = todo.pop()
        if isinstance(value, dict):
            inner = [(v, f"{base}.{k}") for k, v in value.items()]
        elif isinstance(value, list):
            inner = [(v, f"{base}[{i}]") for i, v in enumerate(value)]
        else:
            inner = []
        out.append(base)
        todo += reversed(inner)
    return out[1:]


def _told(texts: pd.Series, bases: pd.Series) -> pd.Series:
    def told(text: str | None, base: str) -> list[str]:
        try:
            return of(json.loads(text), base) if text else []
        except ValueError:
            return []

    return pd.Series([told(t, b) for t, b in zip(texts, bases)])


def paths(text: Column, base: Column) -> Column:
    """No built-in function walks to any depth, so this is a Python function over Arrow batches; invalid JSON has no paths."""
    return F.pandas_udf(_told, "array<string>")(text, base)
