"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's own features and those of the lines before and after it speak
for either label, and a transition weight for either pair of neighbouring labels.
Forward-backward gives each line's marginal probability of good, and the mean over lines,
weighted by their length, is the document's score.

Lines have no labels of their own: they are latent. Learning fits the document's score, the length-weighted mean of
the marginals, to the document's label; its gradient goes through forward-backward, so a line may be good in a bad document.
Learned from the SAMPLE labelled documents of the learning folds that come first by a hash of the id; of these, from those of
at most LONGEST lines, as long as they have LINES lines together. A document is learned from as a whole or not at all.
Weights are found by full-batch Adam steps, each document weighing as much as any other of its label, and each label as
much as the other.

Defined cases: null and empty texts are one empty line, scored like any line; very long texts are scored whole, their features
in blocks of lines; a null id is in a learning fold but never labelled; labels that are null don't count, and of several of one
id the mean decides, a mean of one half being good; of several texts of one id the one with the smallest hash is learned from;
without labels of both kinds, or on an empty table, every score is 0.5, which is predicted as 1; repeated rows each come
back; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_in, id_out, text_in
from .language_id import held_out

#: Labelled documents that the weights are learned from; their lines together, and those of one.
SAMPLE, LINES, LONGEST = 4000, 120_000, 500
STEPS, RATE, DECAY = 100, 0.12, 1e-3
#: Bytes of text and lines whose features are found at once.
BLOCK_BYTES, BLOCK_LINES = 1 << 20, 20_000
#: Lines of a document that goes through forward-backward alone, line by line.
ALONE = 3000
FOLDS, FOLD = 3, 1

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>~^=+\\_@{}[]/", "|", "!", ".,;:?'\"()-", " \t\r\v\f")
_KINDS = len(_CLASSES) + 1
OWN = len(_CLASSES) + 9


@cache
def _class_of() -> np.ndarray:
    out = np.full(256, len(_CLASSES), dtype=np.int32)
    for k, chars in enumerate(_CLASSES):
        for c in chars:
            out[ord(c)] = k
    return out


def _histogram(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """Bytes of each class by line, BLOCK_BYTES at a time."""
    out = np.zeros((len(sizes), _KINDS), dtype=np.int64)
    ends = np.cumsum(sizes)
    for at in range(0, len(data), BLOCK_BYTES):
        part = np.frombuffer(data, dtype=np.uint8, count=min(BLOCK_BYTES, len(data) - at), offset=at)
        lo, hi = (int(np.searchsorted(ends, x, side="right")) for x in (at, at + len(part) - 1))
        inside = np.minimum(ends[lo : hi + 1], at + len(part)) - np.maximum(ends[lo : hi + 1] - sizes[lo : hi + 1], at)
        owner = np.repeat(np.arange(hi + 1 - lo, dtype=np.int32), inside)
        out[lo : hi + 1] += np.bincount(owner * _KINDS + _class_of()[part], minlength=(hi + 1 - lo) * _KINDS).reshape(-1, _KINDS)
    return out


def _word_features(line: str) -> tuple[float, ...]:
    words = line.split()
    n = len(words)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    same = sum(map(str.__eq__, words, words[1:]))
    return len(set(words)) / n, same / n, len(line) / n / 10, min(n, 50) / 50, float(words[0][0].isupper()), float(words[-1][-1] in ".?!")


def _own_features(lines: list[str], again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's own features, and its bytes. again: whether its document has it before."""
    raw = [x.encode() for x in lines]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    own = np.zeros((len(lines), OWN), dtype=np.float32)
    own[:, : _KINDS - 1] = np.sqrt(_histogram(b"".join(raw), sizes)[:, :-1] / np.maximum(sizes, 1)[:, None])
    own[:, _KINDS - 1 : _KINDS + 5] = np.array([_word_features(x) for x in lines], dtype=np.float32).reshape(-1, 6)
    own[:, _KINDS + 5] = np.log1p(sizes) / 6
    own[:, _KINDS + 6] = again
    own[:, _KINDS + 7] = sizes == 0
    return own, sizes


def _repeated(lines: list[str]) -> np.ndarray:
    """Whether a line that isn't empty equals an earlier one."""
    if len(lines) == 1:
        return np.zeros(1, dtype=bool)
    keys = np.fromiter(map(xxhash.xxh64_intdigest, lines), dtype=np.uint64, count=len(lines))
    out = np.ones(len(lines), dtype=bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out & (keys != np.uint64(xxhash.xxh64_intdigest("")))


def _cut(lines: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, x in enumerate(lines):
        if i > start and (size + len(x) > BLOCK_BYTES or i - start >= BLOCK_LINES):
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(lines):
        yield start, len(lines)


def _shifted(x: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x of the line before and of the line after; nothing across documents."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[first + counts - 1] = 0
    return before, after


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features by line (own, line before, line after, bias), and line length."""
    lines = text.split("\n")
    own, sizes = _own_features(lines, _repeated(lines))
    before, after = _shifted(own, np.zeros(1, dtype=np.int64), np.array([len(lines)]))
    return np.hstack([own, before, after, np.ones((len(own), 1), dtype=np.float32)]), sizes


class Chains:
    """Lines of several documents, in the order in which they are gone through: place by place, the longest documents first."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.first = counts, np.cumsum(counts) - counts
        by = np.argsort(-counts, kind="stable")
        self.order, sizes = self.first[by], counts[by]
        longest = int(sizes[0]) if len(sizes) else 0
        self.alive = np.searchsorted(-sizes, -np.arange(longest + 1), side="left").tolist()  # documents with more than t lines

    def forward(self) -> Iterator[np.ndarray]:
        return (self.order[: self.alive[t]] + t for t in range(1, len(self.alive) - 1))

    def backward(self) -> Iterator[np.ndarray]:
        return (self.order[: self.alive[t + 1]] + t for t in range(len(self.alive) - 3, -1, -1))


def _ratio(x: np.ndarray, both: float, left: float, right: float, none: float) -> np.ndarray:
    """Log odds after a step: of exp(both + x) + exp(left) against exp(right + x) + exp(none)."""
    return np.logaddexp(both + x, left) - np.logaddexp(right + x, none)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def messages(good: np.ndarray, trans: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good by line, from the lines up to it and from those after it; their sum is the marginal's."""
    (t00, t01), (t10, t11) = trans.tolist()
    forward, backward = good.astype(float), np.zeros(len(good))
    for at in chains.forward():
        forward[at] += _ratio(forward[at - 1], t11, t01, t10, t00)
    for at in chains.backward():
        backward[at] = _ratio(good[at + 1] + backward[at + 1], t11, t10, t01, t00)
    return forward, backward


def _messages_alone(good: list[float], trans: np.ndarray) -> np.ndarray:
    """messages() of one long document, added up."""
    (t00, t01), (t10, t11) = trans.tolist()

    def step(x: float, both: float, left: float, right: float, none: float) -> float:
        x = min(max(x, -500.0), 500.0)
        e = math.exp(x) if x < 0 else math.exp(-x)
        up, down = (math.exp(both) * e + math.exp(left), math.exp(right) * e + math.exp(none)) if x < 0 else (math.exp(both) + math.exp(left) * e, math.exp(right) + math.exp(none) * e)
        return math.log(up / down)

    out = np.array(good, dtype=float)
    x = good[0]
    for t in range(1, len(good)):
        x = step(x, t11, t01, t10, t00)
        out[t] += x
        x += good[t]
    x = 0.0
    for t in range(len(good) - 2, -1, -1):
        x = step(good[t + 1] + x, t11, t10, t01, t00)
        out[t] += x
    return out


class Crf:
    """weights: for good against bad, of features as they are (own, before, after, bias); trans: label before, label."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights.astype(np.float64), trans

    def _lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of good by line from features alone, line length, and lines of each text."""
        parts = [t.split("\n") for t in texts]
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        again = np.concatenate([_repeated(p) for p in parts])
        flat = [x for p in parts for x in p]
        own = self.weights[:-1].reshape(3, OWN).T.astype(np.float32)
        said, sizes = np.empty((len(flat), 3), dtype=np.float32), np.empty(len(flat), dtype=np.int64)
        for lo, hi in _cut(flat):
            x, sizes[lo:hi] = _own_features(flat[lo:hi], again[lo:hi])
            said[lo:hi] = x @ own
        # what a line says of the line after it comes from before, and the other way round
        first = np.cumsum(counts) - counts
        before, after = _shifted(said, first, counts)
        return said[:, 0] + before[:, 1] + after[:, 2] + self.weights[-1], sizes, counts

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good by line, line length, and lines of each text."""
        good, sizes, counts = self._lines(texts)
        if len(counts) == 1 and counts[0] > ALONE:
            both = _messages_alone(good.tolist(), self.trans)
        else:
            forward, backward = messages(good, self.trans, Chains(counts))
            both = forward + backward
        return _sigmoid(both), sizes, counts

    def _score(self, texts: list[str]) -> list[float]:
        good, sizes, counts = self.marginals(texts)
        weight = np.maximum(sizes, 1)
        first = np.cumsum(counts) - counts
        return np.clip(np.round(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 6), 0, 1).tolist()

    def score(self, texts: list[str]) -> list[float]:
        """Texts are taken together up to BLOCK_BYTES and BLOCK_LINES; one beyond that, or of more than ALONE lines, is alone."""
        out: list[float] = []
        part, size, lines = [], 0, 0
        for t in texts:
            n = t.count("\n") + 1
            if part and (n > ALONE or size + len(t) > BLOCK_BYTES or lines + n > BLOCK_LINES):
                out += self._score(part)
                part, size, lines = [], 0, 0
            part.append(t)
            size, lines = size + len(t), lines + n
            if n > ALONE:
                out += self._score(part)
                part, size, lines = [], 0, 0
        return out + self._score(part) if part else out


def score_gradient(good: np.ndarray, weight: np.ndarray, trans: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document scores, and their gradients by each line's log odds (by line) and by the transitions (by document).

    weight: of the lines, 1 in each document. one and none are the expected weight of good lines up to a line, given that
    it is good or bad; after_one and after_none that of the lines after it. The derivative is a covariance with the score.
    """
    (t00, t01), (t10, t11) = trans.tolist()
    forward, backward = messages(good, trans, chains)
    one, none = weight.copy(), np.zeros(len(good))
    from_one, from_none = np.zeros(len(good)), np.zeros(len(good))  # the line before is good, given this one
    for at in chains.forward():
        k1, k0 = _sigmoid(forward[at - 1] + (t11 - t01)), _sigmoid(forward[at - 1] + (t10 - t00))
        from_one[at], from_none[at] = k1, k0
        one[at] += k1 * one[at - 1] + (1 - k1) * none[at - 1]
        none[at] = k0 * one[at - 1] + (1 - k0) * none[at - 1]
    after_one, after_none = np.zeros(len(good)), np.zeros(len(good))
    for at in chains.backward():
        nxt = good[at + 1] + backward[at + 1]
        k1, k0 = _sigmoid(nxt + (t11 - t10)), _sigmoid(nxt + (t01 - t00))
        up, down = weight[at + 1] + after_one[at + 1], after_none[at + 1]
        after_one[at], after_none[at] = k1 * up + (1 - k1) * down, k0 * up + (1 - k0) * down
    p = _sigmoid(forward + backward)
    given_one, given_none = one + after_one, none + after_none
    score = np.add.reduceat(p * weight, chains.first)
    by_line = p * (1 - p) * (given_one - given_none)
    own = np.repeat(score, chains.counts)
    inner = np.ones(len(good), dtype=bool)
    inner[chains.first] = False
    before_one, before_none = np.concatenate([[0.0], one[:-1]]), np.concatenate([[0.0], none[:-1]])
    by_trans = np.zeros((len(chains.counts), 2, 2))
    for j, k, chance, seen in (
        (0, 0, (1 - p) * (1 - from_none), before_none + after_none),
        (0, 1, p * (1 - from_one), before_none + weight + after_one),
        (1, 0, (1 - p) * from_none, before_one + after_none),
        (1, 1, p * from_one, before_one + weight + after_one),
    ):
        by_trans[:, j, k] = np.add.reduceat(np.where(inner, chance * (seen - own), 0.0), chains.first)
    return score, by_line, by_trans


def fit(parts: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS) -> Crf:
    """parts: features by line, line length, and label, of each document."""
    size = 3 * OWN + 1
    labels = np.array([y for _, _, y in parts], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return Crf(np.zeros(size), np.zeros((2, 2)))
    x = np.concatenate([p for p, _, _ in parts]).astype(np.float32)
    chains = Chains(np.array([len(p) for p, _, _ in parts]))
    length = np.maximum(np.concatenate([n for _, n, _ in parts]), 1).astype(float)
    length /= np.repeat(np.add.reduceat(length, chains.first), chains.counts)
    mean, scale = x.mean(axis=0, dtype=float), x.std(axis=0, dtype=float)
    mean[-1], scale[scale < 1e-6] = 0.0, 1.0
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = 0.5 / share[labels] / len(labels)
    theta, trans = np.zeros(size), np.zeros((2, 2))
    m = [np.zeros(size), np.zeros((2, 2))]
    v = [np.zeros(size), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        score, by_line, by_trans = score_gradient((x @ theta.astype(np.float32)).astype(float), length, trans, chains)
        sure = np.clip(score, 1e-3, 1 - 1e-3)
        pull = weight * (score - labels) / (sure * (1 - sure))
        gradient = [x.T @ (by_line * np.repeat(pull, chains.counts)).astype(np.float32) + DECAY * theta, (by_trans * pull[:, None, None]).sum(axis=0) + DECAY * trans]
        for k, (value, g) in enumerate(zip((theta, trans), gradient)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            value -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    plain = theta / scale
    plain[-1] -= (plain * mean).sum()
    return Crf(plain, trans)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Crf:
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    marks = marks.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).where(~held_out("id", FOLDS, FOLD))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(id_in(id_col).alias("id"), text_in(text_col).alias("text")).join(F.broadcast(marks), "id")
    rows = rows.where(F.length("text") - F.length(F.translate("text", "\n", "")) < LONGEST)
    rows = rows.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, y in zip(b["id"].tolist(), b["text"].tolist(), b["y"].tolist()):
                x, n = line_features(text)
                out.append((i, y, xxhash.xxh64_intdigest(str(i)) >> 1, x.astype("<f4").tobytes(), n.astype("<i8").tobytes()))
            yield pd.DataFrame(out, columns=["id", "y", "h", "x", "n"])

    # in order of a hash of the id until LINES lines are reached; at most `sample` rows come to the driver, one after the other
    found = rows.mapInPandas(run, "id long, y int, h long, x binary, n binary")
    parts, lines = [], 0
    for r in found.orderBy("h", "id").toLocalIterator():
        n = np.frombuffer(r["n"], dtype="<i8")
        lines += len(n)
        if lines > LINES:
            break
        parts.append((np.frombuffer(r["x"], dtype="<f4").reshape(-1, 3 * OWN + 1), n, r["y"]))
    return fit(parts)


def classify(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = crf.score(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["id"], "held_out": b["held"], "score": score, "predicted": [int(s >= 0.5) for s in score]})

    df = docs.select(id_in(id_col).alias("id"), held_out(id_col, FOLDS, FOLD).alias("held"), text_in(text_col).alias("text"))
    return id_out(df.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int"), "doc_id")


def keep_good(docs: DataFrame, crf: Crf, text_col: str = "text") -> DataFrame:
    """The documents whose score is 0.5 or more, with all their columns."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(crf.score(texts.tolist()))

    return docs.where(score(text_in(text_col)) >= 0.5)
