"""Literals in a search query: quoted ones, and words whose casing gives an identifier away."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Casings in the order in which they are tried, with the kind of name and the confidence each gives.
CASINGS = [
    ("className", "medium", r"[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+"),
    ("functionName", "medium", r"[a-z][a-z0-9]*(?:[A-Z][a-zA-Z0-9]*)+"),
    ("variableName", "medium", r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+"),
    ("identifier", "low", r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+"),
    ("packageName", "low", r"[a-z][a-z0-9]*(?:-[a-z0-9]+)+"),
]

# Words that are no literals whatever their casing.
PLAIN_WORDS = frozenset(
    "find the a an is are was were what where when how why which who this that these those and or but"
    " for with from to in on at by of all any some get set new class function const let var type"
    " interface import export default return async await null undefined true false".split()
)

_QUOTES = [("explicit-backtick", re.compile(r"`([^`]+)`")), ("explicit-quote", re.compile(r'"([^"]+)"'))]
_WHOLE = [(kind, re.compile(rf"^{p}$")) for kind, _, p in CASINGS]
_INSIDE = [
    (kind, sure, re.compile(rf"(?<![/:.])\b({p})\b(?![/:])" if kind == "packageName" else rf"\b({p})\b", re.ASCII))
    for kind, sure, p in CASINGS
]


@dataclass(frozen=True)
class Literal:
    value: str
    raw: str
    confidence: str
    method: str
    kind: str | None


def kind_of(value: str) -> str | None:
    return next((kind for kind, p in _WHOLE if p.match(value)), None)


def parse(query: str | None) -> tuple[list[Literal], str]:
    """The literals, and the query without the quoted ones; words that are literals by casing stay in it."""
    rest, found, known = query or "", [], set()
    for method, pattern in _QUOTES:
        hits = [m for m in pattern.finditer(rest) if m[1].strip()]
        found += [Literal(m[1], m[0], "high", method, kind_of(m[1])) for m in hits]
        for m in reversed(hits):
            rest = rest[: m.start()] + rest[m.end() :]
    known = {x.value.lower() for x in found}
    for kind, sure, pattern in _INSIDE:
        for m in pattern.finditer(query or ""):
            key = m[1].lower()
            if len(key) > 2 and key not in known and key not in PLAIN_WORDS:
                known.add(key)
                found.append(Literal(m[1], m[1], sure, "implicit-casing", kind))
    return found, rest.strip()
