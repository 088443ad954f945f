"""Language identification by rank-order n-gram profiles.

A profile is a text's, or a language's, PROFILE most frequent character n-grams of lengths 1 to 3
(letters of any script, lower case, runs of anything else and the text's end as one blank), by falling count, then by the letters. A document goes to
the language whose profile has the smallest out-of-place distance: the sum over the document's
n-grams of the difference of ranks, and PROFILE for those that the profile lacks.

Profiles are learned from labelled rows of the learning folds, from a sample of about SAMPLE rows by a hash of id
and text. Each language has an equal part of it, LEAST at least: a language with fewer rows than that is learned from
all of them, and none is left without rows. Defined cases: a null text and one without letters is `und` with score 0; ties go to
the language first in order; whole texts are used whatever their length; repeated rows each come
back; without learned rows everything is `und`; a null id is in a learning fold; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, id_in, id_out, text_in, written

PROFILE = 400
#: Labelled rows that profiles are learned from, about.
SAMPLE = 20_000
#: Rows that a language's profile is learned from at least, if it has as many.
LEAST = 500
#: Characters that are sorted at once; a longer text is alone.
BLOCK = 1_000_000
#: Bits of a letter's number, and texts that are sorted at once: both fit 64 bits with three letters.
LETTER_BITS, TEXTS = 18, 1000
UND = "und"


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """Number of the lower-case form of every letter, 1 for what is no letter; numbers follow the code points and have LETTER_BITS bits. 0 is no character."""
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    number = np.zeros(0x110000, dtype=np.uint32)
    number[every] = np.arange(2, len(every) + 2)
    low = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in every]
    out = np.ones(0x110000, dtype=np.uint32)
    out[every] = np.where(number[low] > 0, number[low], number[every])
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, n-gram and count, by text and n-gram. Each text ends with a blank; there are at most TEXTS texts."""
    codes = _letters()[np.frombuffer("".join(f"{t} " for t in texts).encode("utf-32-le", "replace"), dtype="<u4")].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) + 1 for t in texts])
    keep = codes != 1
    keep[1:] |= codes[:-1] != 1
    codes, owner = codes[keep], owner[keep]
    keys = []
    for n in (1, 2, 3):
        if len(codes) < n:
            continue
        key = owner[: len(codes) - n + 1] << np.uint64(3 * LETTER_BITS)
        for k in range(n):
            key = key | (codes[k : len(codes) - n + 1 + k] << np.uint64(LETTER_BITS * k))
        good = owner[: len(codes) - n + 1] == owner[n - 1 :]
        if n == 1:
            good &= codes != 1
        keys.append(key[good])
    key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
    key, count = np.unique(key, return_counts=True)
    return key >> np.uint64(3 * LETTER_BITS), key & np.uint64((1 << 3 * LETTER_BITS) - 1), count


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > BLOCK or i - start >= TEXTS):
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A language's n-grams in order of rank, for every language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col, folds, fold))
    rows = rows.select(F.col(lang_col).alias("lang"), text_in(text_col).alias("text"), F.xxhash64(id_in(id_col), F.col(text_col), F.lit(8)).alias("h"))
    langs = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("m"), F.min("h").alias("least")), "langs")
    number = langs.count()
    part = max(LEAST, -(-sample // max(1, number)))
    every = F.greatest(F.lit(1).cast("long"), F.floor(F.col("m") / part))
    rows = rows.join(bounded(langs.select("lang", every.alias("every"), "least"), number), "lang")
    rows = rows.where((F.pmod("h", "every") == 0) | (F.col("h") == F.col("least"))).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, number = np.unique(b["lang"].to_numpy(dtype=object).astype(str), return_inverse=True)
            texts = b["text"].tolist()
            for start, end in _blocks(texts):
                doc, gram, count = _grams(texts[start:end])
                part = pd.DataFrame({"l": number[start:end][doc.astype(np.int64)], "gram": gram.astype(np.int64), "n": count})
                part = part.groupby(["l", "gram"], as_index=False)["n"].sum()
                yield pd.DataFrame({"lang": names[part["l"]], "gram": part["gram"], "n": part["n"]})

    counts = rows.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "k").collect():  # PROFILE rows a language
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, dtype=np.uint64) for lang, g in sorted(out.items())}


def predict(texts: list[str], profiles: dict[str, np.ndarray]) -> tuple[list[str], list[float]]:
    langs, scores = [UND] * len(texts), [0.0] * len(texts)
    names = list(profiles)
    if not names:
        return langs, scores
    sorted_, ranks = {}, {}
    for name, grams in profiles.items():
        by = np.argsort(grams)
        sorted_[name], ranks[name] = grams[by], by
    for start, end in _blocks(texts):
        doc, gram, count = _grams(texts[start:end])
        if not len(doc):
            continue
        by = np.lexsort((gram, -count, doc))
        doc, gram = doc[by].astype(np.int64), gram[by]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
        keep = rank < PROFILE
        doc, gram, rank = doc[keep], gram[keep], rank[keep]
        used = np.bincount(doc, minlength=end - start)
        far = np.empty((len(names), end - start))
        for k, name in enumerate(names):
            at = np.minimum(np.searchsorted(sorted_[name], gram), len(sorted_[name]) - 1)
            out = np.where(sorted_[name][at] == gram, np.abs(ranks[name][at] - rank), PROFILE)
            far[k] = np.bincount(doc, weights=out, minlength=end - start)
        best = far.argmin(axis=0)
        for i in np.flatnonzero(used).tolist():
            langs[start + i] = names[best[i]]
            scores[start + i] = float(1 - far[best[i], i] / (used[i] * PROFILE))
    return langs, scores


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, scores = predict(b["text"].tolist(), profiles)
            yield pd.DataFrame({"doc_id": b["id"], "held_out": b["held"], "lang_pred": langs, "score": scores})

    df = docs.select(id_in(id_col).alias("id"), held_out(id_col, folds, fold).alias("held"), text_in(text_col).alias("text"))
    return id_out(df.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double"), "doc_id")
