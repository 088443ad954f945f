"""Benchmark decontamination by template canonicalisation.

Words lose case and outer punctuation. In the template form, numbers, capitalised words within a sentence, and units
become typed placeholders, so that a question with other numbers or names has the same template; in the verbatim form
every word stays, so that a copy is found in any case and after any word. Windows of WINDOW words of the benchmark
are a table of hashes, item and place, in both forms. Windows of the documents are joined with it on the hash; before that, what no
benchmark window can equal is sorted out by a bit filter of bounded size. Hits of one item on one diagonal (the same shift
between item and document) are one alignment. In the template form its slots are then compared: one value of an item must go with
one value of the document throughout, else the windows with slots don't count. A document is contaminated by an item
when NEEDED windows of an alignment count in the template form, or three quarters of the item's windows, NEEDED at least, in the
verbatim one; or, in either, all of a shorter item.

An item's first word begins a sentence there, but in a document it may follow any word and look like a
name; the item's first window has a template for both, the second only for the same word. Characters of scripts
without blanks between words (Chinese, Japanese, Thai and others) are words of their own.

Defined cases: a null or empty text holds nothing; a null or empty item is in no document; an item with a null id contaminates, and
is not in the list; items of fewer than LEAST words are looked for only as a document's whole text; windows that
are mostly placeholders count only in alignments that have others; equal items are found each; an item found in several alignments
counts its best; very long texts are cut into windows like others; repeated rows each come back; empty tables give an empty result, or
nothing contaminated; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, NO_ID, SALTS, bounded, fresh_dir, held, id_in, id_out, text_in, written
from .files import read_bytes, write_bytes

WINDOW, NEEDED, LEAST = 8, 6, 4
#: Words whose code a worker keeps, and words of documents whose windows are found at once.
CACHE, TOGETHER = 300_000, 400_000
#: Bits of the filter by benchmark window, and the powers of two between which its size lies.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 256, 16, 27
UNITS = frozenset(
    "kg g mg lb lbs oz km m cm mm mi ft in mph kmh l ml s ms min h hr hrs sec secs second seconds minute minutes hour hours day days week weeks month months"
    " year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds"
    " ounce ounces liter liters litre litres gallon gallons dollar dollars cent cents euro euros usd eur gbp percent degree degrees".split()
)
_NUMBER = re.compile(r"[$€£+-]*\d[\d.,/:]*(?:%|st|nd|rd|th)?")
_MEASURE = re.compile(r"[$€£+-]*\d[\d.,/:]*([a-z]+)")
#: Scripts that are written without blanks between words.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿々-〇぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_EDGES = "。，、？！：；「」『』（）《》〈〉【】・ \t\r\n.,;:!?\"'()[]{}<>«»„“”‘’…`*_|#&-–—"
#: Low bits of a word's code: its kind, whether it may be a name, whether a sentence ends with it.
_KIND, _NAME, _END = np.uint64(3), np.uint64(4), np.uint64(8)
_FLAGS = np.uint64(15)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Hashes of the placeholders, by kind; 3 is a name.
_PLACE = np.array([0, *(xxhash.xxh64_intdigest(f"<{x}>") & ~15 for x in ("number", "unit", "name"))], dtype=np.uint64)
VERBATIM, TEMPLATE = 0, 1


class _Codes(dict):
    """Code of a word: hash of it without case and punctuation above, flags below; 0 for mere punctuation."""

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGES)
        if not bare:
            code = 0
        else:
            low = bare.lower()
            kind = 1 if _NUMBER.fullmatch(low) else 2 if low in UNITS else 0
            if (m := _MEASURE.fullmatch(low)) and m[1] in UNITS:
                kind = 1
            name = kind == 0 and bare[0].isupper() and not (len(bare) > 1 and bare.isupper())
            code = (xxhash.xxh64_intdigest(low) & ~15) | kind | 4 * name | 8 * (word[-1] in ".!?:" or word[-2:-1] in (".", "!", "?")) or 16
        self[word] = code
        return code


def _low(word: str) -> str:
    return word.strip(_EDGES).lower()


class Forms:
    """Words of several texts one after the other: the texts' first words, verbatim and template hashes, and slots."""

    def __init__(self, texts: list[str]):
        codes = held("words", _Codes)
        if len(codes) > CACHE:
            codes.clear()
        self.words: list[str] = []
        parts, counts = [], []
        for text in texts:
            words = (text if text.isascii() else _UNSPACED.sub(r" \g<0> ", text)).split()
            code = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
            if not code.all():
                words = [w for w, c in zip(words, code.tolist()) if c]
                code = code[code != 0]
            self.words += words
            parts.append(code)
            counts.append(len(words))
        code = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        self.counts = np.array(counts, dtype=np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.owner = np.repeat(np.arange(len(counts)), self.counts)
        self.may_be_name = (code & _NAME) != 0
        name = self.may_be_name.copy()
        name[1:] &= (code[:-1] & _END) == 0
        name[self.first[self.counts > 0]] = False
        kind = np.where(name, 3, (code & _KIND).astype(np.int64))
        self.verbatim, self.slot = code & ~_FLAGS, kind > 0
        self.template = np.where(self.slot, _PLACE[kind], self.verbatim)

    def windows(self, form: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size, the places where windows of that size begin, and their hashes."""
        n = len(form)
        left = (self.first + self.counts)[self.owner] - np.arange(n) if n else np.zeros(0, dtype=np.int64)
        state = np.zeros(n, dtype=np.uint64)
        for k in range(max(sizes, default=0)):
            if k >= n:
                return
            part = state[: n - k]
            part ^= form[k:]
            part *= _M1
            part ^= part >> np.uint64(29)
            if k + 1 in sizes:
                at = np.flatnonzero(left[: n - k] > k)
                yield k + 1, at, (state[at] + np.uint64(k + 1)) * _M2


_WINDOWS = "hash long, item long, mark long, place int, total int, size int, form int, named boolean, own array<string>, slot array<boolean>"


def _benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a window and form: its hash, item (id, and a mark of its text), place, windows of the item, words and slots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, text in zip(b["id"].tolist(), b["text"].tolist()):
                f = Forms([text])
                n = len(f.words)
                if not n:
                    continue
                size = min(WINDOW, n)
                mark = xxhash.xxh64_intdigest(text) - (1 << 63)
                forms = [(VERBATIM, f.verbatim, False), (TEMPLATE, f.template, False)]
                if f.may_be_name[0]:
                    other = f.template.copy()
                    other[0] = _PLACE[3]
                    forms.append((TEMPLATE, other, True))
                rows = []
                for form, hashes, named in forms:
                    for _, at, h in f.windows(hashes, [size]):
                        for p, x in list(zip(at.tolist(), h.astype(np.int64).tolist()))[: 1 if named else None]:
                            rows.append((x, item, mark, p, n - size + 1, size, form, named, f.words[p : p + size], f.slot[p : p + size].tolist()))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _WINDOWS.split(", ")])

    return benchmark.select(id_in(id_col).alias("id"), text_in(text_col).alias("text")).where("text != ''").mapInPandas(run, _WINDOWS)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of 2 to the power of bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), ((hashes * _M3) >> np.uint64(64 - bits)).astype(np.int64)


def _filter(windows: DataFrame, rows: int, folder: str) -> tuple[str, int]:
    """Writes the bit filter of the windows' hashes; its file and the logarithm of its size.

    The bits are put together by tasks; the driver gets their words, at most 2 to the power of FILTER_MOST bits.
    """
    bits = min(max((rows * FILTER_BITS).bit_length(), FILTER_LEAST), FILTER_MOST)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.unique(np.concatenate(_places(b["hash"].to_numpy().astype(np.uint64), bits)))
            word, bit = at >> 5, np.left_shift(np.int64(1), at & 31)
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, dtype=np.int64)
            yield pd.DataFrame({"word": word[start], "bits": np.bitwise_or.reduceat(bit, start) if len(start) else bit})

    words = windows.select("hash").mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(1 << (bits - 5), dtype="<u4")
    for r in words.toLocalIterator():
        table[r["word"]] = r["bits"]
    name = f"{folder}.filter"
    write_bytes(name, table.tobytes())
    return name, bits


_HITS = "id long, mark long, length long, hash long, form int, at int, words array<string>"


def _hits(docs: DataFrame, name: str, bits: int, sizes: list[int]) -> DataFrame:
    """docs: id, text. A row a window that passes the filter; a text is told by id, mark and length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.frombuffer(read_bytes(name), dtype="<u4")

        def known(h: np.ndarray) -> np.ndarray:
            one, two = _places(h, bits)
            out = np.flatnonzero(table[one >> 5] >> (one & 31).astype(np.uint32) & 1)
            return out[(table[two[out] >> 5] >> (two[out] & 31).astype(np.uint32) & 1) != 0]

        def told(b: pd.DataFrame) -> pd.DataFrame:
            f, rows = Forms(b["text"].tolist()), []
            ids, marks, lengths, first = b["id"].tolist(), b["mark"].tolist(), b["length"].tolist(), f.first.tolist()
            for form, hashes in ((VERBATIM, f.verbatim), (TEMPLATE, f.template)):
                for size, at, h in f.windows(hashes, sizes):
                    if size < LEAST:
                        whole = f.counts[f.owner[at]] == size
                        at, h = at[whole], h[whole]
                    got = known(h)
                    for p, d, x in zip(at[got].tolist(), f.owner[at[got]].tolist(), h[got].astype(np.int64).tolist()):
                        rows.append((ids[d], marks[d], lengths[d], x, form, p - first[d], f.words[p : p + size]))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in _HITS.split(", ")])

        for b in batches:
            start, chars = 0, 0
            for k, n in enumerate(b["length"].tolist()):
                if k > start and chars + n > 6 * TOGETHER:
                    yield told(b.iloc[start:k])
                    start, chars = k, 0
                chars += n
            yield told(b.iloc[start:])

    return docs.mapInPandas(run, _HITS)


def _counted(form: int, rows: list[tuple[int, bool, list[str], list[str], list[bool]]]) -> int:
    """How many windows of an alignment count. rows: place, whether the item's first word is taken as a name, words of the document and the item, slots."""
    own: dict[int, tuple[list[str], list[str], list[bool]]] = {}
    for place, named, words, item, slot in rows:
        if not named or _low(words[0]) == _low(item[0]):
            own[place] = words, item, slot
    if form == VERBATIM:
        return len(own)
    pairs: dict[str, set[str]] = defaultdict(set)
    for words, item, slot in own.values():
        for w, i, s in zip(words, item, slot):
            if s:
                pairs[_low(i)].add(_low(w))
    if any(len(v) > 1 for v in pairs.values()):
        return sum(not any(slot) for _, _, slot in own.values())
    if any(2 * sum(slot) <= len(slot) for _, _, slot in own.values()):
        return len(own)
    return sum(all(_low(w) == _low(i) for w, i in zip(words, item)) for words, item, _ in own.values())


def _alignments(joined: DataFrame) -> DataFrame:
    """id, mark, length, item, n: the items whose windows count in a text, and how many do."""
    shift = ["id", "mark", "length", "item", "of", "form", F.col("at") - F.col("place")]
    keys = joined.select(*shift[:-1], shift[-1].alias("shift"), "total", F.struct("place", "named", "words", "own", "slot").alias("hit"))
    lines = keys.groupBy("id", "mark", "length", "item", "of", "form", "shift", "total").agg(F.collect_set("hit").alias("hits"))  # at most the item's windows
    most = F.when(F.col("form") == VERBATIM, F.greatest(F.lit(NEEDED), F.ceil(3 * F.col("total") / 4).cast("int"))).otherwise(F.lit(NEEDED))
    need = F.least(most, F.col("total"))
    lines = lines.where(F.size("hits") >= need).select("id", "mark", "length", "item", "form", need.alias("need"), "hits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [_counted(form, [(h["place"], h["named"], list(h["words"]), list(h["own"]), list(h["slot"])) for h in hits]) for form, hits in zip(b["form"].tolist(), b["hits"].tolist())]
            out = b[["id", "mark", "length", "item"]].assign(n=n)
            yield out[out["n"] >= b["need"]]

    return lines.mapInPandas(run, "id long, mark long, length long, item long, n long")


def _told(text: str) -> list:
    """What tells a text besides its id."""
    return [F.xxhash64(text).alias("mark"), F.length(text).cast("long").alias("length")]


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """id, mark, length, items, windows: a row a contaminated text, as a table."""
    spark = docs.sparkSession
    windows = written(_benchmark_windows(benchmark, item_col, item_text), "windows")
    rows = windows.count()
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most WINDOW
    name, bits = _filter(windows, rows, fresh_dir(spark, "benchmark"))
    texts = docs.select(id_in(id_col).alias("id"), text_in(text_col).alias("text")).select("id", "text", *_told("text"))
    hits = written(_hits(texts, name, bits, sizes), "hits").dropDuplicates(["id", "mark", "length", "form", "at", "hash"])
    side = windows.withColumnRenamed("mark", "of")
    if rows <= BROADCAST_ROWS:
        joined = hits.join(F.broadcast(side), ["hash", "form"])
    else:  # a window with many hits is dealt to SALTS tasks
        joined = hits.withColumn("salt", F.pmod(F.xxhash64("id", "mark", "at"), F.lit(SALTS)))
        joined = joined.join(side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))), ["hash", "form", "salt"])
    real = F.nullif(F.col("item"), F.lit(NO_ID))
    return written(_alignments(joined).groupBy("id", "mark", "length").agg(F.sort_array(F.collect_set(real)).alias("items"), F.max("n").alias("windows")), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, contaminated, items (ids in order), windows (most that count in one alignment): one row a document."""
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text)
    rows = docs.select(id_in(id_col).alias("id"), text_in(text_col).alias("text")).select("id", *_told("text"))
    out = rows.join(bounded(found, found.count(), BROADCAST_ROWS), ["id", "mark", "length"], "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("windows").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("windows", F.lit(0).cast("long")).alias("windows"))
    return id_out(out, "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    found = _found(docs, benchmark, id_col, text_col, "item_id", "text")
    bad = found.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("length").alias("_length"))
    rows = docs.withColumn("_text", text_in(text_col)).withColumns({"_id": id_in(id_col), "_mark": F.xxhash64("_text"), "_length": F.length("_text").cast("long")}).drop("_text")
    return rows.join(bounded(bad, bad.count()), ["_id", "_mark", "_length"], "left_anti").select(*docs.columns)
