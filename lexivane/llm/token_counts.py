"""Exact token counts of every prefix of every text, by prefix dynamic programming.

Texts are cut where the tokenizer's own splitting can't reach across (before white space that
follows other text), each unit's prefix counts are found once by dynamic programming and kept in
a bounded cache, and a text's table is the running sum of its units' steps: one signed byte a
character, from which any "how many tokens is the first part" or "how much text fits" question is
answered without encoding again.

Defined cases: a null text counts as empty (no tokens); special strings in a text count as one
token, as the library has it; repeated rows each come back; a very long text without white space is one unit, counted whole; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .bpe import RankedBpe
from .common import Recent, held, id_in, id_out, text_in

#: Units whose steps a worker keeps; older ones go.
CACHE = 150_000
BUDGET = 1024

#: White space beside the ASCII kind; texts with it are not cut into units.
_WIDE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_UNIT = re.compile("[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
_EDGE = re.compile(" [ \t\n\r\f\v]| $")


def units(text: str) -> list[str]:
    """Parts whose encodings, put together, are the text's: cut before white space that text follows."""
    if not text:
        return []
    if _WIDE.search(text):
        return [text]
    if _EDGE.search(text):
        return _UNIT.findall(text)
    parts = text.split(" ")
    out = [f" {p}" for p in parts]
    out[0] = parts[0]
    return out if parts[0] else out[1:]


class PrefixCounter:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.bpe = RankedBpe(path)
        added = Tokenizer.from_file(path).get_added_tokens_decoder().values()
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in added) + ")") if added else None
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.run = regex.compile(r"\s{2,}(?=\S)")
        self.cache: dict[str, bytes] = Recent(CACHE)
        self.words: dict[str, bytes] = Recent(CACHE)

    def _word(self, word: str) -> bytes:
        """The steps of one of the splitter's parts."""
        got = self.words[word]
        if got is None:
            data = word.encode()
            counts = self.bpe.prefix_counts(data)
            if len(data) > len(word):
                counts = [counts[at] for at in accumulate((len(c.encode()) for c in word), initial=0)]
            if word in ("'re", "'ve", "'ll"):  # before its last letter the splitter sees ' and a letter
                counts[2] = 2
            got = bytes([(b - a) & 255 for a, b in pairwise(counts)])
            if len(word) <= 64:
                self.words.put(word, got)
        return got

    def _plain(self, text: str) -> bytes:
        """Steps of a text without special strings."""
        steps = b"".join(map(self._word, self.word.findall(text)))
        if self.run.search(text):  # with text after it, a run's last blank is a part of its own
            counts = table(steps)
            for run in self.run.finditer(text):
                counts[run.end()] = counts[run.start()] + self.bpe.prefix_counts(run.group().encode())[-1]
            steps = np.diff(counts).astype(np.int8).tobytes()
        return steps

    def _unit(self, text: str) -> bytes:
        if not self.special or not self.special.search(text):
            return self._plain(text)
        counts, parts = [np.zeros(1, dtype=np.int64)], self.special.split(text)
        for k in range(0, len(parts), 2):
            base, sign = counts[-1][-1], parts[k + 1] if k + 1 < len(parts) else ""
            counts.append(base + table(self._plain(parts[k] + sign[:-1]))[1:])
            if sign:
                counts.append(base + table(self._plain(parts[k]))[-1:] + 1)
            counts = [np.concatenate(counts)]
        return np.diff(counts[0]).astype(np.int8).tobytes()

    def steps(self, text: str) -> bytes:
        """One signed byte a character: by how much its prefix counts more than the one before."""
        cache, out = self.cache, []
        for u in units(text):
            got = cache[u]
            if got is None:
                got = self._unit(u)
                if len(u) <= 64:
                    cache.put(u, got)
            out.append(got)
        return b"".join(out)


def counter(path: str) -> PrefixCounter:
    """One for each worker process and file, as long as no other operator's tasks need the worker."""
    return held(f"counter {path}", lambda: PrefixCounter(path))


def table(steps: bytes) -> np.ndarray:
    """Token counts of every prefix, the empty one first."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, dtype=np.int8), dtype=np.int64)])


def fitting(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens."""
    return int(np.flatnonzero(table(steps) <= budget)[-1])


def count_tokens(docs: DataFrame, path: str, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", keep_steps: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars, steps (zlib, one signed byte a character)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for b in batches:
            rows = []
            for i, text in zip(b["id"].tolist(), b["text"].tolist()):
                steps = own.steps(text)
                n = int(np.frombuffer(steps, dtype=np.int8).sum(dtype=np.int64))
                fit = len(text) if n <= budget and len(text) <= budget else fitting(steps, budget)
                rows.append((i, len(text.encode()), n, n > budget, fit, zlib.compress(steps, 1) if keep_steps else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "steps"])

    df = docs.select(id_in(id_col).alias("id"), text_in(text_col).alias("text"))
    return id_out(df.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, steps binary"), "doc_id")
