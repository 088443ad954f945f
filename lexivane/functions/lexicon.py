"""Query terms and their expansion by a lexicon, which is a parameter: the queries' language decides on it."""

from __future__ import annotations

from dataclasses import dataclass

# Words that a query's terms leave out.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare", "ought", "used",
    "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just",
    "and", "but", "if", "or", "because", "until", "while", "this", "that", "these", "those", "what", "which", "who", "whom",
    "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her", "it", "its", "they", "them", "their",
]

# Weight of a synonym by its grade.
GRADES = {"strong": 0.9, "moderate": 0.6, "weak": 0.3}

#: A few entries to begin with; a fuller lexicon is the caller's.
BASIC: dict[str, list[tuple[str, str]]] = {
    "function": [("method", "strong"), ("func", "strong"), ("handler", "moderate"), ("callback", "moderate"), ("procedure", "weak"), ("routine", "weak")],
    "method": [("function", "strong"), ("func", "strong"), ("handler", "moderate")],
    "auth": [("authentication", "strong"), ("authorization", "strong"), ("login", "moderate"), ("signin", "moderate"), ("session", "weak"), ("security", "weak")],
}


@dataclass(frozen=True)
class Expanded:
    """terms: term, weight, grade (original for the query's own), and the term it stands for."""

    query: str
    original: list[str]
    terms: list[tuple[str, float, str, str]]

    @property
    def text(self) -> str:
        more = [t for t, _, grade, _ in self.terms if grade != "original"]
        return " ".join([*self.original, *more])


def query_terms(query: str) -> list[str]:
    """Lower-case words at white space, punctuation kept, without stop words."""
    return [w for w in query.lower().split() if w not in STOP_WORDS]


def expand(query: str, lexicon: dict[str, list[tuple[str, str]]] = BASIC, most: int = 10, weak: bool = False, least: int = 2) -> Expanded:
    """The query's terms, then synonyms in the lexicon's order until there are `most` terms in all. A query is one string."""
    own = query_terms(query)
    known = {k.lower(): v for k, v in lexicon.items()}
    out = {t: (t, 1.0, "original", t) for t in own if len(t) >= least}
    for term in own:
        for synonym, grade in known.get(term, []) if len(term) >= least else []:
            if (grade != "weak" or weak) and synonym.lower() not in out and len(out) < most:
                out[synonym.lower()] = (synonym, GRADES[grade], grade, term)
    return Expanded(query, own, list(out.values()))
