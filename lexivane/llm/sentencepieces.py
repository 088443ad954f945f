"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The new units of a batch (blanks, then text up to the next blank or line end: no piece reaches across) are
concatenated and indexed by a suffix array as deep as the longest piece. Every piece of the
vocabulary is looked up by binary search; its range in the array is the list of places where it
occurs. These edges are sorted by their end and relaxed in that order: the piece that ends a
prefix's encoding is the only one that fits the last piece of the prefix before it, that is, whose
border merging leaves alone. Characters without a piece become their bytes' pieces. Equal scores: the leftmost pair merges
first, as in the library.

Defined cases: a null or empty text has no ids; very long texts are indexed in parts of whole
units, and a unit beyond LONG_UNIT by an index that slides along it; units are kept between batches, fewer between tasks, in a bounded table; repeated
rows each come back; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import held, id_in, id_out, sparing, text_in
from .unit_ids import UnitIds

SPACE = "▁"
#: Units whose ids a worker keeps, in a task and from one task to the next, and characters indexed at once.
CACHE, STAYING, INDEX_CHARS = 300_000, 60_000, 400_000
#: Characters of a unit that is indexed alone, by a sliding index.
LONG_UNIT = 2000
#: Edges of a long unit that are Python objects at once.
EDGES = 50_000
#: Pairs of pieces whose fit a worker keeps: 2 to this power.
FITS = 20
_UNIT, _UNIT_WITH_LINES = re.compile(" *[^ \n]+| +|\n"), re.compile(" *[^ ]+| +")
#: Ends every unit in the index; a private-use character without a piece.
_END = "\U0010fffd"


class Vocabulary:
    """The pieces of a BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        self.scores = {p: sp.get_score(i) for p, i in self.pieces.items()}
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.cut_lines = not any("\n" in p for p in self.pieces)
        self.longest = max(map(len, self.pieces))
        self.histories: dict[int, tuple[list[tuple[float, str, str]] | None, str, str]] = {}
        self.fit_keys, self.fit_values = np.full(1 << FITS, -1, dtype=np.int64), np.zeros(1 << FITS, dtype=bool)
        self.known = UnitIds("int32", CACHE)
        order = sorted(self.pieces)
        self.order = np.array([self.pieces[p] for p in order], dtype=np.int32)
        self.lengths = np.array([len(p) for p in order], dtype=np.int32)
        self.codes = np.zeros((len(order), self.longest), dtype=np.int32)
        for k, p in enumerate(order):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        self.alphabet = np.unique(self.codes[self.codes > 0])
        #: Each piece's characters as places in the alphabet; its length where a piece has no more.
        self.letters = np.where(self.codes > 0, np.searchsorted(self.alphabet, self.codes), len(self.alphabet)).astype(np.int32)

    def merge(self, text: str) -> list[str]:
        """Pieces by merging the pair of best score, leftmost first: the rule itself, for tests."""
        parts, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(parts) and (score := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, len(parts[i]) + len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i]
            if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            nxt[i] = nxt[j]
            if nxt[i] < len(parts):
                prv[nxt[i]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [p for p in parts if p]

    def history(self, piece: int) -> tuple[list[tuple[float, str, str]] | None, str, str]:
        """The merges that make a piece, in their order: score, first and last part after it. None if merging makes other parts."""
        known = self.histories.get(piece)
        if known is None:
            parts, steps = list(self.text[piece]), []
            first, last = parts[0], parts[-1]
            while len(parts) > 1:
                best, at = max((self.scores.get(x + y, -np.inf), -k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
                if best == -np.inf:
                    break
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
                steps.append((best, parts[0], parts[-1]))
            known = self.histories[piece] = (steps if len(parts) == 1 else None, first, last)
        return known

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces gives these two.

        Each side's merges are known; they are taken in the order of their scores, the left side first where they are equal,
        until a merge across the border would come first.
        """
        (left, _, x), (right, y, _) = self.history(a), self.history(b)
        if left is None or right is None:
            return False
        i = j = 0
        across = self.scores.get(x + y, -np.inf)
        while True:
            one = left[i][0] if i < len(left) else -np.inf
            two = right[j][0] if j < len(right) else -np.inf
            if across > one and across >= two and across > -np.inf:
                return False
            if i == len(left) and j == len(right):
                return True
            if one >= two:
                edge, i = left[i][2], i + 1
                if edge != x:
                    x, across = edge, self.scores.get(edge + y, -np.inf)
            else:
                edge, j = right[j][1], j + 1
                if edge != y:
                    y, across = edge, self.scores.get(x + edge, -np.inf)

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """fit() for many pairs; what was asked before is in a table of FITS places, one for each remainder of a hash."""
        key = before.astype(np.int64) << 32 | piece
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FITS)).astype(np.int64)
        out = self.fit_values[at]
        new = np.flatnonzero(self.fit_keys[at] != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            told = np.fromiter((self.fit(k >> 32, k & 0xFFFFFFFF) for k in asked.tolist()), dtype=bool, count=len(asked))[back]
            out[new] = told
            self.fit_keys[at[new]], self.fit_values[at[new]] = key[new], told
        return out

    # -- suffix array -----------------------------------------------------------------------

    def _index_text(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix array, as deep as the longest piece, and each piece's range in it.

        Characters that some piece has are numbered, and as many numbers as go into 64 bits are one
        key, so suffixes and pieces are compared a few keys at a time.
        """
        alphabet = np.intersect1d(codes, self.alphabet)
        bits = max(1, int(len(alphabet) + 1).bit_length())
        each = 64 // bits
        depth = -(-self.longest // each) * each
        dense = np.zeros(len(codes) + depth, dtype=np.uint64)
        if len(alphabet):
            at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
            dense[: len(codes)] = np.where(alphabet[at] == codes, at + 1, len(alphabet) + 1)
            del at
        else:
            dense[: len(codes)] = 1
        keys = []
        for start in range(0, depth, each):
            key = np.zeros(len(codes), dtype=np.uint64)
            for k in range(start, start + each):
                key <<= np.uint64(bits)
                key |= dense[k : k + len(codes)]
            keys.append(key)
        del dense
        array = np.lexsort(keys[::-1])
        for k, key in enumerate(keys):
            keys[k] = key[array]
        array = array.astype(np.int32)
        # pieces with a character that the text lacks are nowhere in it
        known = np.append(np.isin(self.alphabet, alphabet), True)
        have = known[self.letters].all(axis=1)
        rows = np.flatnonzero(have)
        own = np.zeros((len(rows), depth), dtype=np.uint64)
        own[:, : self.longest] = np.append(np.searchsorted(alphabet, self.alphabet) + 1, 0)[self.letters[rows]]
        filler = np.where(np.arange(depth)[None, :] < self.lengths[rows][:, None], own, np.uint64((1 << bits) - 1))
        found = []
        for want, upper in ((own, False), (filler, True)):
            parts = []
            for start in range(0, depth, each):
                key = np.zeros(len(rows), dtype=np.uint64)
                for k in range(start, start + each):
                    key = key << np.uint64(bits) | want[:, k]
                parts.append(key)
            low, high = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), len(array))
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                less, same = np.zeros(len(open_), dtype=bool), np.ones(len(open_), dtype=bool)
                for text, part in zip(keys, parts):
                    x, y = text[mid], part[open_]
                    less |= same & (x < y)
                    same &= x == y
                go = less | same if upper else less
                low[open_[go]] = mid[go] + 1
                high[open_[~go]] = mid[~go]
            whole = np.zeros(len(self.order), dtype=np.int64)
            whole[rows] = low
            found.append(whole)
        return array, found[0], found[1]

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece (-1: a character without one) of every occurrence."""
        array, low, high = self._index_text(codes)
        n = high - low
        which = np.repeat(np.arange(len(n), dtype=np.int32), n)
        places = np.repeat((low - np.cumsum(n) + n).astype(np.int32), n)
        places += np.arange(len(places), dtype=np.int32)
        starts = array[places]
        del array, places
        alone = np.ones(len(codes), dtype=bool)
        alone[starts[self.lengths[which] == 1]] = False
        bare = np.flatnonzero(alone).astype(np.int32)
        ends = np.concatenate([starts + self.lengths[which], bare + 1])
        pieces = np.concatenate([self.order[which], np.full(len(bare), -1, dtype=np.int32)])
        del which
        return np.concatenate([starts, bare]), ends, pieces

    def _index(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, one after the other, and how many each has.

        Edges are relaxed by the distance of their end from their unit's start, for all units at once; of
        the edges with one end, the longest is tried first, then the next.
        """
        text = _END.join([*units, ""]).replace(" ", SPACE)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<i4")
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units)) + 1
        first = np.cumsum(sizes) - sizes
        base = np.repeat(first.astype(np.int32), sizes)
        starts, ends, pieces = self._edges(codes)
        by = (ends - base[starts]).astype(np.int64)
        by <<= 40
        by |= ends.astype(np.int64) << 8
        by |= self.longest + starts - ends
        by = np.argsort(by).astype(np.int32)
        starts = starts[by]
        ends = ends[by]
        pieces = pieces[by]
        del by
        opens = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))  # the longest edge of each end
        number = np.diff(np.append(opens, len(ends)))
        last, origin = np.full(len(codes) + 1, -1, dtype=np.int32), np.zeros(len(codes) + 1, dtype=np.int32)
        reach = ends[opens] - base[starts[opens]]
        cuts = np.searchsorted(reach, np.arange(1, int(reach[-1]) + 2))
        for lo, hi in zip(cuts, cuts[1:]):
            at, left = opens[lo:hi], number[lo:hi]
            while len(at):
                before, piece = last[starts[at]], pieces[at]
                ok = (before < 0) | (piece < 0)
                ask = np.flatnonzero(~ok)
                ok[ask] = self._fits(before[ask], piece[ask])
                good = at[ok]
                last[ends[good]], origin[ends[good]] = pieces[good], starts[good]
                more = ~ok & (left > 1)
                at, left = at[more] + 1, left[more] - 1
        # backwards: the ends on each unit's best path
        used = np.zeros(len(codes) + 1, dtype=bool)
        at = first + sizes - 1
        while len(at):
            used[at] = True
            at = origin[at]
            at = at[at > base[np.minimum(at, len(codes) - 1)]]
        where = np.flatnonzero(used)
        ids = last[where]
        ends = np.searchsorted(where, first + sizes - 1, side="right")
        bare = ids < 0
        if bare.any():
            parts = [[self.byte[b] for b in text[end - 1].encode()] for end in where[bare].tolist()]
            number = np.ones(len(ids), dtype=np.int64)
            number[bare] = list(map(len, parts))
            ids, bare = np.repeat(ids, number), np.repeat(bare, number)
            ids[bare] = [i for part in parts for i in part]
            ends = np.cumsum(number)[ends - 1]
        return ids, np.diff(ends, prepend=0)

    def _with_bytes(self, text: str, ends: list[int], ids: list[int]) -> np.ndarray:
        """Ids of a path on which characters without a piece become their bytes' pieces."""
        got = [[i] if i >= 0 else [self.byte[b] for b in text[end - 1].encode()] for end, i in zip(ends, ids)]
        return np.array([i for part in got for i in part], dtype=np.int32)

    def _long(self, unit: str) -> np.ndarray:
        """A unit beyond LONG_UNIT: the index slides along it, and edges are relaxed one after the other."""
        n, step, back = len(unit), INDEX_CHARS, self.longest
        last, size = np.full(n + 1, -1, dtype=np.int32), np.zeros(n + 1, dtype=np.int16)
        for at in range(0, n, step):
            low = max(0, at - back)
            codes = np.frombuffer(unit[low : at + step].encode("utf-32-le"), dtype="<i4")
            starts, ends, pieces = (x.astype(np.int64) for x in self._edges(codes))
            new = ends + low > at
            starts, ends, pieces = starts[new] + low, ends[new] + low, pieces[new]
            by = np.argsort(ends << 8 | self.longest + starts - ends)
            recent, done = dict(zip(range(low, at + 1), last[low : at + 1].tolist())), at
            for part in np.split(by, range(EDGES, len(by), EDGES)):
                for start, end, piece in zip(starts[part].tolist(), ends[part].tolist(), pieces[part].tolist()):
                    if end <= done:
                        continue
                    before = recent[start]
                    if before >= 0 and piece >= 0 and not self._fit_one(before, piece):
                        continue
                    recent[end] = last[end] = piece
                    size[end], done = end - start, end
        where, end = [], n
        while end > 0:
            where.append(end)
            end -= int(size[end])
        where.reverse()
        return self._with_bytes(unit, where, last[where].tolist())

    def _fit_one(self, before: int, piece: int) -> bool:
        key = before << 32 | piece
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - FITS
        if self.fit_keys[at] != key:
            self.fit_keys[at], self.fit_values[at] = key, self.fit(before, piece)
        return bool(self.fit_values[at])

    # -- encoding and decoding --------------------------------------------------------------

    def units(self, text: str) -> bytes | list[str]:
        """The text's units, with blanks for SPACE, or as bytes the text to be split at blanks and line ends; together they are the text after the dummy prefix."""
        if not text:
            return []
        whole = " " + text.replace(SPACE, " ")
        if not self.cut:
            return [whole]
        if not self.cut_lines or "  " in whole or whole[-1] == " " or " \n" in whole or "\0" in whole:
            return (_UNIT if self.cut_lines else _UNIT_WITH_LINES).findall(whole)
        return whole.encode()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        return self.known.encode(texts, self.units, self._encode_units)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of the texts."""
        ids, ends = self.encode_all(texts)
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, one after the other, and how many each has; INDEX_CHARS are indexed at once."""
        got, new, size = [], [], 0
        for u in units:
            if long := len(u) > LONG_UNIT:
                ids = self._long(u.replace(" ", SPACE))
            else:
                new.append(u)
                size += len(u) + 1
            if new and (long or size >= INDEX_CHARS):
                got.append(self._index(new))
                new, size = [], 0
            if long:
                got.append((ids, np.array([len(ids)])))
        if new:
            got.append(self._index(new))
        return np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got])

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if ids and self.text[ids[0]].startswith(SPACE) else text


def vocabulary(path: str) -> Vocabulary:
    """One for each worker process and file, as long as no other operator's tasks need the worker."""
    return held(f"pieces {path}", lambda: Vocabulary(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (of little-endian 32-bit ids), same (decoding gives the text back)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = vocabulary(path)
        for b in batches:
            rows = []
            for i, text, ids in zip(b["id"].tolist(), b["text"].tolist(), own.encode(b["text"].tolist())):
                rows.append((i, ids, len(ids), zlib.crc32(ids.tobytes()), own.decode(ids.tolist()) == text.replace(SPACE, " ")))
            yield pd.DataFrame(rows, columns=["doc_id", "ids", "n_tokens", "ids_crc32", "same"])
        own.known.shrink(STAYING)  # the next task may be another operator's

    df = docs.select(id_in(id_col).alias("id"), text_in(text_col).alias("text"))
    return id_out(df.mapInPandas(sparing(run), "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, same boolean"), "doc_id")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: null ids give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = vocabulary(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["id"], "text": [own.decode([] if x is None else list(x)) for x in b["ids"]]})

    df = encoded.select(id_in(id_col).alias("id"), encoded[ids_col].alias("ids"))
    return id_out(df.mapInPandas(run, "doc_id long, text string"), "doc_id")
