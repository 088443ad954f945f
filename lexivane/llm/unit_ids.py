"""The ids of text units in worker processes: each unit is encoded once while it is kept.

A unit has a number, and a number has a place in one flat array of ids, so that a text is a list of numbers
and the ids of many texts are gathered at once. Units of up to 16 bytes are told by these bytes, as two whole
numbers in arrays that are searched for many units together; longer ones, and those of texts that are not
split at blanks and line ends alone, are strings in a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Characters of a unit that is kept after its batch: long ones seldom come again.
LONGEST = 64
#: Parts of an array that are gathered at once, and bytes of texts that are split at once.
BLOCK, TEXT_BYTES = 1 << 15, 1 << 20

_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_A, _B, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def spans(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parts of flat, one after the other; the places of BLOCK parts at once are in memory."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=flat.dtype)
    done = 0
    for at in range(0, len(starts), BLOCK):
        part = slice(at, at + BLOCK)
        places = np.repeat(starts[part] - ends[part] + sizes[part], sizes[part])
        places += np.arange(done, done + len(places))
        out[done : done + len(places)] = flat[places]
        done += len(places)
    return out


class _Table:
    """From units of up to 16 bytes without zero bytes, as two whole numbers, to their numbers; open addressing."""

    def __init__(self, bits: int = 12):
        self.bits, self.count = bits, 0
        self.low, self.high, self.number = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)

    def _at(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = high * _B
        h ^= low
        h *= _A
        h ^= h >> _SHIFT
        h *= _B
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The units' numbers; -1: it has none."""
        at, last = self._at(low, high), (1 << self.bits) - 1
        out = self.number[at]
        open_ = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        at = at[open_]
        while len(open_):
            at = at + 1 & last
            out[open_] = found = self.number[at]
            more = (found >= 0) & ((self.low[at] != low[open_]) | (self.high[at] != high[open_]))
            open_, at = open_[more], at[more]
        return out

    def put(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Units that differ and have no numbers yet."""
        if 2 * (self.count + len(low)) > 1 << self.bits:
            have = np.flatnonzero(self.number >= 0)
            low, high, number = (np.concatenate([a[have], b]) for a, b in ((self.low, low), (self.high, high), (self.number, number)))
            self.__init__((2 * len(low)).bit_length())
        self.count += len(low)
        at, last, left = self._at(low, high), (1 << self.bits) - 1, np.arange(len(low))
        while len(left):
            free = left[self.number[at[left]] < 0]
            self.number[at[free]] = number[free]
            won = self.number[at[left]] == number[left]
            mine = left[won]
            self.low[at[mine]], self.high[at[mine]] = low[mine], high[mine]
            left = left[~won]
            at[left] = at[left] + 1 & last


class UnitIds:
    """Bounded: with more than `most` units at a batch's beginning those go that came once since the last time, and all but the half of `most` that came most."""

    def __init__(self, kind: str | np.dtype, most: int):
        self.kind, self.most = np.dtype(kind), most
        self.table, self.numbers, self.new = _Table(), {}, []
        self.flat, self.starts, self.sizes = np.zeros(0, dtype=self.kind), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        #: How often each unit came.
        self.used = np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return self.table.count + len(self.numbers)

    def _number(self, units: list[str]) -> np.ndarray:
        """The numbers of any units."""
        numbers = self.numbers
        got = list(map(numbers.get, units))
        if None in got:
            for k, n in enumerate(got):
                if n is None:
                    u = units[k]
                    n = numbers.get(u)
                    if n is None:
                        n = numbers[u] = len(self.sizes) + len(self.new)
                        self.new.append(u)
                    got[k] = n
        return np.array(got, dtype=np.int32)

    def _number_words(self, texts: list[bytes]) -> list[np.ndarray]:
        """The numbers of each text's units: these begin at each blank and line end, and after line ends."""
        raw = b"".join([*texts, bytes(16)])
        data = np.frombuffer(raw, dtype=np.uint8)[:-16]
        begin = data == 10
        begin[1:] |= begin[:-1].copy()
        begin |= data == 32
        first = np.cumsum([0, *map(len, texts[:-1])])
        begin[first] = True
        starts = np.flatnonzero(begin)
        sizes = np.diff(starts, append=len(data))
        eight = np.ndarray(shape=(len(data) + 9,), dtype="<u8", buffer=raw, strides=(1,))
        low = eight[starts] & _FIRST[np.minimum(sizes, 8)]
        high = eight[starts + 8] & _FIRST[np.clip(sizes - 8, 0, 8)]
        out = self.table.find(low, high)
        long = np.flatnonzero(sizes > 16)
        out[long] = 0
        if len(new := np.flatnonzero(out < 0)):
            x, y = low[new], high[new]
            by = np.lexsort((x, y))
            x, y = x[by], y[by]
            opens = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            number = (len(self.sizes) + len(self.new) - 1 + np.cumsum(opens)).astype(np.int32)
            out[new[by]] = number
            x, y, number = x[opens], y[opens], number[opens]
            self.table.put(x, y, number)
            self.new += [u.decode() for u in np.stack([x, y], axis=1).astype("<u8").view("S16")[:, 0].tolist()]
        out[long] = self._number([raw[a : a + n].decode() for a, n in zip(starts[long].tolist(), sizes[long].tolist())])
        return np.split(out, np.searchsorted(starts, first[1:]))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units' ids, one after the other, and where each unit's end."""
        sizes = self.sizes[numbers]
        return spans(self.flat, self.starts[numbers], sizes), np.cumsum(sizes)

    def encode(self, texts: list[str], split: Callable[[str], bytes | list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end.

        split: a text's units, or as bytes (not none, no zero byte) the text that is to be split at blanks and line ends.
        encode: from units to their ids, one after the other, and how many each has.
        """
        if len(self) > self.most or len(self.flat) > 8 * self.most:
            self.shrink(self.most // 2)
        got: list[np.ndarray] = [None] * len(texts)
        words, size = [], 0
        for k, text in enumerate(texts):
            own = split(text)
            if isinstance(own, bytes):
                words.append((k, own))
                size += len(own)
            else:
                got[k] = self._number(own)
            if words and (size >= TEXT_BYTES or k == len(texts) - 1):
                for (at, _), numbers in zip(words, self._number_words([x for _, x in words]), strict=True):
                    got[at] = numbers
                words, size = [], 0
        if self.new:
            flat, sizes = encode(self.new)
            self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.flat)])
            self.flat = np.concatenate([self.flat, flat.astype(self.kind, copy=False)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.used = np.concatenate([self.used, np.zeros(len(sizes), dtype=np.int64)])
        ends = np.cumsum(np.fromiter(map(len, got), dtype=np.int64, count=len(got)))
        numbers = np.concatenate([np.zeros(0, dtype=np.int32), *got])
        del got
        self.used += np.bincount(numbers, minlength=len(self.used))
        ids, unit_ends = self.ids(numbers)
        for u in self.new:
            if len(u) > LONGEST:
                self.used[self.numbers.pop(u)] = 0
        self.new = []
        return ids, np.append(0, unit_ends)[ends]

    def shrink(self, most: int) -> None:
        """Keeps the units that came more than once, at most so many, those that came most."""
        stay = self.used > 1
        if stay.sum() > most:
            stay &= self.used > np.sort(self.used)[-most - 1]
        number = np.cumsum(stay, dtype=np.int32) - 1
        numbers = np.flatnonzero(stay)
        self.flat, self.sizes = self.ids(numbers)[0], self.sizes[numbers]
        self.starts, self.used = np.cumsum(self.sizes) - self.sizes, self.used[numbers] // 2
        self.numbers = {u: int(number[n]) for u, n in self.numbers.items() if stay[n]}
        old, self.table = self.table, _Table()
        have = np.flatnonzero(old.number >= 0)
        have = have[stay[old.number[have]]]
        self.table.put(old.low[have], old.high[have], number[old.number[have]])
