"""Byte-pair merging by rank, and prefix dynamic programming over it.

A sequence of tokens is the encoding of its text exactly when every two neighbours, encoded
together, come out as these two. So the last token of a prefix is the only token that ends there,
fits the last token of the prefix before it, and the prefix's count is that prefix's plus one.
"""

from __future__ import annotations

import json


def byte_symbols() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankedBpe:
    """Byte-level BPE read from a tokenizers file. Ids: bytes first, then the merges in their order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_symbols()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            halves = self.ids[a], self.ids[b]
            new = self.ids.setdefault(a + b, len(self.halves))
            if new == len(self.halves):
                self.halves.append(halves)
            self.joined[halves] = new
        import ahocorasick

        self.fits: dict[int, bool] = {}
        self.finder = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.finder.add_word(token.decode("latin-1"), (i, len(token)))
        self.finder.make_automaton()

    def fit(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens a and b alone.

        Both are taken apart in the reverse order of merging; the border would go if some pair
        across it could have been merged before the merge that was just taken back.
        """
        left, right, before = a, b, 1 << 60
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < before:
                return False
            if left > right and left > 255:
                before = left
                left = self.halves[left][1]
            elif right > 255:
                before = right + 1
                right = self.halves[right][0]
            elif left > 255:
                before = left
                left = self.halves[left][1]
            else:
                return True

    def prefix_counts(self, data: bytes) -> list[int]:
        """Token count of data[:i] for i = 0 .. len(data); every token that ends somewhere comes from one automaton."""
        fits = self.fits
        if len(fits) > 500_000:
            fits.clear()
        last, counts, done = [-1], [0], 0
        for at, (token, n) in self.finder.iter(data.decode("latin-1")):
            if at < done:
                continue
            before = last[at + 1 - n]
            if before >= 0:
                key = before << 32 | token
                ok = fits.get(key)
                if ok is None:
                    ok = fits[key] = self.fit(before, token)
                if not ok:
                    continue
            last.append(token)
            counts.append(counts[at + 1 - n] + 1)
            done = at + 1
        return counts
