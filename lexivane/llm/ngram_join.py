"""N-gram Jaccard join by vertical partitioning.

The global order of the n-grams is the order of their 64-bit hashes; it is cut into fragments, and a document's sorted set
is a row a fragment: (document, fragment, n-grams). The overlap of a candidate pair is counted in each fragment by
itself, in whatever task the fragment's rows meet, and the partial counts are summed per pair.

Candidates come from finer fragments of the same order. A pair that links at similarity s differs in at most (1 - s) / s
of the smaller set's size, k n-grams (a ninth at 0.9, a quarter at 0.8), so when more than k finer fragments
aren't empty, one of them agrees as a whole. Fingerprints of whole fragments are thus exact signatures: a pair that shares
none can't link, and a frequent n-gram alone makes no candidates. There are so many that about SLACK more agree than one even in a band's
smallest sets, some of whose fragments are empty, and each set can leave out as many of its longest lists: what unrelated texts share, a
common passage, is in few of them.

Rows are told apart by a number of their own. Rows with equal sets are one class; links are sought between class
representatives. A list of representatives with equal fingerprint is not expanded into pairs of rows. Its members are dealt to
blocks of BLOCK, and every two blocks are compared in one task by the sizes of their fragments: the sum of the sizes' differences is
a lower bound of the sets' difference. The pairs that the bound leaves are covered by stars: a list's pivot and those of its members that
have such a pair, so that every pair is a pivot and a member, or two members of one pivot. Overlaps are counted for pivot and member, which also gives the member's
difference from the pivot. The overlap of two members' differences gives the pair's overlap exactly; a pivot's members
are dealt to blocks again, and every two blocks are compared as a matrix in one task. A pair of several stars
counts under its smallest pivot, so every link is found once. Tasks return sums of links and a forest that keeps the components;
links() returns the pairs.

Exact up to collisions of 64-bit hashes. Defined cases: null, empty and blank texts have an empty set and
link with nothing; very long texts are whole sets, in rows of a fragment each; repeated rows each come back; rows that share an id are one
document for the components, whatever their texts; rows with a null id link as others do, and come back with the smallest id
that their links reach, or null; a pair exactly at the similarity links; a link counts once for each row of the other class, and copies
link with each other; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction
from functools import cache
from math import exp

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, bounded, forget, id_in, id_out, text_in, written

N = 3
#: Links have at least this share of their union in common.
SIMILARITY = 0.9
#: Fragments that aren't empty beyond those that the differences of a linked pair can touch, in a band's smallest sets on average: so many more
#: agree, and so many of a set's longest lists can go.
SLACK = 16
#: Sizes are dealt to bands, each this much wider than the one before; a pair meets in its smaller size's band.
GROWTH = 1.5
#: Fragments of the global order in which a pair's overlap is counted.
COUNTED = 8
#: Members of a pivot that are compared with as many others in one task, and n-grams at once.
BLOCK, WIDTH = 256, 4096
#: Lists of smaller pivots, at most, by which a member tells that a pair was compared with one of these.
EARLIER = 256
#: Sizes of fragments that are compared at once.
PAIRS = 4_000_000
MAX_ROUNDS = 60

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; the whole sequence when there are fewer words."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and 0x20 and 0x09-0x0D only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = xxhash.xxh64_intdigest
    h = np.fromiter(map(own, words), dtype=np.uint64, count=len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * _M1 + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def ratio(similarity: float) -> tuple[int, int]:
    """num, den: links have num * union <= den * intersection."""
    exact = Fraction(str(similarity))
    if not 0 < exact < 1:
        raise ValueError("similarity lies between 0 and 1")
    return exact.numerator, exact.denominator


@cache
def bands(num: int, den: int) -> list[int]:
    """Lower ends of the size bands; smaller sets link with none but their equals."""
    out = [-(-num // (den - num))]
    while out[-1] <= 1 << 40:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * GROWTH))))
    return out


@cache
def parts_of(lower: int, largest: int, num: int, den: int) -> tuple[int, int]:
    """touched: how many n-grams two linked sets of a band differ in at most; and the band's number of fragments.

    Of parts fragments, a set of lower n-grams leaves parts * exp(-lower / parts) empty on average. A set with touched or fewer
    that aren't empty has to keep the empty ones as well, which it shares with sets that it has nothing in common with.
    """
    touched = largest * (den - num) // num
    parts = want = touched + 1 + SLACK
    while parts * (1 - exp(-lower / parts)) < want and parts < 4 * want:
        parts += 1 + parts // 1000
    return touched, parts


def signatures(grams: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the fragments, for the band of the set's size and each band of smaller partners; and band << 16 | spare of each.

    A linked pair shares more than spare fingerprints of the band.
    """
    n, lower = len(grams), bands(num, den)
    if n < lower[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    here = int(np.searchsorted(lower, n, side="right")) - 1
    keys, tags = [], []
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(grams * _M1), dtype=np.uint64)])
    for band in range(here, -1, -1):
        largest = lower[band + 1] - 1
        if band < here and den * largest < num * n:
            break
        touched, parts = parts_of(lower[band], largest, num, den)
        ends = (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(grams, ends), [n]])
        sizes = np.diff(at)
        keep = sizes > 0
        spare = int(keep.sum()) - touched - 1
        if spare < 0:  # then an empty fragment may be all that a pair shares
            keep[:], spare = True, 0
        spare = min(spare, 0xFFFF)
        key = mix((sums[at[1:]] - sums[at[:-1]]) * _M1 + np.arange(parts, dtype=np.uint64) * _M2 + sizes.astype(np.uint64) * _M3 + np.uint64(band))
        keys.append(np.unique(key[keep]))
        tags.append(np.full(len(keys[-1]), band << 16 | spare, dtype=np.int32))
    return np.concatenate(keys), np.concatenate(tags)


def _marks(grams: np.ndarray) -> tuple[int, int]:
    """Two sums of a set's hashes, which stand for it."""
    a, b = mix(grams * _M1).sum(dtype=np.uint64), mix(grams * _M3 + _M1).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["id"].tolist(), b["text"].tolist()):
                g = shingles(text, n)
                keys, tags = signatures(g, num, den)
                rows.append((i, len(g), *_marks(g), keys.astype(np.int64), tags, profile(g)))
            yield pd.DataFrame(rows, columns=["id", "n", "f", "g", "keys", "tags", "sizes"])

    return docs.mapInPandas(run, "id long, n long, f long, g long, keys array<long>, tags array<int>, sizes binary")


def profile(grams: np.ndarray) -> bytes:
    """Sizes of a power of two of fragments, two to four n-grams on average; 255 stands for more."""
    bits = max(0, (len(grams) // 2).bit_length() - 1)
    place = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), dtype=np.int64)
    return np.minimum(np.bincount(place, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _coarse(sizes: list[bytes], bins: int) -> np.ndarray:
    """Fragment sizes of sets that all have the same number of fragments, brought to fewer."""
    whole = np.frombuffer(b"".join(sizes), dtype=np.uint8)
    return whole.reshape(len(sizes), bins, -1).sum(axis=2, dtype=np.int16)


def _near(n: np.ndarray, sizes: np.ndarray, m: np.ndarray, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the sizes of fragments let two sets link, for many pairs."""
    out = np.zeros(len(n), dtype=bool)
    one, two = (np.fromiter(map(len, x), dtype=np.int64, count=len(n)) for x in (sizes, others))
    kinds, kind = np.unique(np.stack([one, two]), axis=1, return_inverse=True)
    for k, (a, b) in enumerate(kinds.T.tolist()):
        at, bins = np.flatnonzero(kind.ravel() == k), min(a, b)
        apart = np.abs(_coarse(sizes[at].tolist(), bins) - _coarse(others[at].tolist(), bins)).sum(axis=1, dtype=np.int64)
        out[at] = (den + num) * apart <= (den - num) * (n[at] + m[at])
    return out


def _alike(g: Mapping[str, np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """x, pivot of stars that cover the pairs between two blocks (or in one) whose fragments' sizes let them link.

    g: in order of x; keys are the lists that a member is in: only members of one list are compared, and of these not two that have one
    of earlier in common (if there is such a column). star is the pivot that a member (or it itself) is known with: two of one star, and it
    and its members, are covered.
    """
    x, n, star, block, raw = (np.asarray(g[c]) for c in ("x", "n", "star", "block", "sizes"))
    one, two = np.flatnonzero(block == int(g["i"][0])), np.flatnonzero(block == int(g["j"][0]))
    rows = np.arange(len(x))

    def shared(lists: str) -> np.ndarray:
        number, keys = _flat(list(g[lists]))
        return _overlap(np.repeat(rows, number), keys, one, two, len(x)) > 0

    open_ = np.zeros((len(x), len(x)), dtype=bool)
    open_[np.ix_(one, two)] = shared("keys") & ~shared("earlier") if "earlier" in g else shared("keys")
    open_ |= open_.T
    open_ &= (star[:, None] != star) & (x[:, None] != star) & (star[:, None] != x)
    open_ &= (den + num) * np.abs(n[:, None] - n) <= (den - num) * (n[:, None] + n)
    left, right = np.nonzero(np.triu(open_, 1))
    if not len(left):
        return []
    bins = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    open_[:] = False
    level = np.minimum(bins[left], bins[right])
    for fine in np.unique(level).tolist():  # every pair at the coarser one's fineness
        sizes, at = np.zeros((len(x), fine), dtype=np.int16), bins >= fine
        for own in np.unique(bins[at]).tolist():
            same = np.flatnonzero(bins == own)
            sizes[same] = _coarse(raw[same].tolist(), fine)
        pairs = np.flatnonzero(level == fine)
        for part in np.split(pairs, range(PAIRS // fine + 1, len(pairs), PAIRS // fine + 1)):
            u, v = left[part], right[part]
            open_[u, v] = (den + num) * np.abs(sizes[u] - sizes[v]).sum(axis=1, dtype=np.int64) <= (den - num) * (n[u] + n[v])
    out = []
    for k in np.flatnonzero(open_.any(axis=1)).tolist():
        members = np.flatnonzero(open_[k])
        if len(members):  # all of them come after k
            out += [(m, int(x[k])) for m in x[members].tolist()]
            open_[np.ix_(members, members)] = False
    return out


def _left(g: Mapping[str, np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """x, p of the members of a pivot p that have a pair left between two blocks (or in one): all ends of the stars."""
    p = int(g["p"][0])
    ends = {x for star in (_alike(g, num, den) if len(g["x"]) > 1 else []) for x in star}
    return [(x, p) for x in sorted(ends) if x != p]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], told: Callable[[dict[str, np.ndarray]], list], columns: list[str]) -> Iterator[pd.DataFrame]:
    """told() of every group of rows with equal keys, as arrays by column; rows come in order of the keys."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        own = b[keys].to_numpy()
        ends = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist()]
        every = {c: b[c].to_numpy() for c in b.columns}
        out = [r for s, e in zip(ends, ends[1:]) for r in told({c: v[s:e] for c, v in every.items()})]
        rest = b.iloc[ends[-1] :]
        yield pd.DataFrame(out, columns=columns)
    if rest is not None and len(rest):
        yield pd.DataFrame(told({c: rest[c].to_numpy() for c in rest.columns}), columns=columns)


def _blocked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows: key, block, blocks and more. A row for each two blocks of a key with the row's own in it, i and j, dealt and ordered by them."""
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k")).drop("k", "blocks")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", *order)


def _covered(stars: DataFrame, lists: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """stars: x, p, two, a list's members and pivots, and whether a list has nobody else; lists: key, x, p, the members of lists of three and
    more, pivots included. Returns x, p of the stars that cover what the sizes of fragments leave of each list.

    First every member is compared with its lists' pivots, and kept with the smallest that it may link with, and with all that a list
    of two pairs it with: no other list may have both. Then blocks of members of one pivot's lists, as far as these aren't of one
    such star, are compared with each other; those with a pair left become members of the lists' pivot, so that no member has more than
    a row a pivot, however many pairs a group has left.
    """

    @F.pandas_udf("boolean")
    def near(n: pd.Series, sizes: pd.Series, m: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series(_near(n.to_numpy(), sizes.to_numpy(), m.to_numpy(), others.to_numpy(), num, den))

    many = written(stars.groupBy("p").agg(F.count(F.lit(1)).alias("m")), "many")
    large = many.where(F.col("m") >= BLOCK)
    blocks = F.ceil((F.coalesce("m", F.lit(0)) + 1) / BLOCK).cast("int")
    rows = stars.join(bounded(large, large.count()), "p", "left").withColumn("blocks", blocks).drop("m")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    pivots = rows.select("p", "block").distinct().join(sizes.select(F.col("row").alias("p"), F.col("n").alias("pn"), F.col("sizes").alias("own")), "p")
    rows = written(rows.join(sizes.withColumnRenamed("row", "x"), "x").join(pivots, ["p", "block"]).select("x", "p", "two", near("n", "sizes", "pn", "own").alias("near")), "compared")
    first = written(rows.where("near").groupBy("x").agg(F.min("p").alias("star")), "first")
    twos = rows.where("near AND two").select("x", "p")
    # lists whose members are of several stars
    own = lists.join(bounded(first, first.count()), "x", "left").withColumn("star", F.coalesce("star", "x"))
    open_ = own.groupBy("key").agg(F.min("star").alias("a"), F.max("star").alias("b")).where("a < b").select("key")
    open_ = written(open_, "open")
    own = own.join(bounded(open_, open_.count()), "key")
    # of each member, its first lists in order of their pivots: two that share such a list are compared with its pivot's members only
    first_lists = F.slice(F.sort_array(F.collect_list(F.struct("p", "key"))), 1, EARLIER)
    firsts = written(own.groupBy("x").agg(first_lists.alias("firsts")), "firsts")
    # a member has a row a pivot, with short hashes of its lists: a collision only adds a comparison
    own = own.groupBy("p", "x", "star").agg(F.collect_set(F.hash("key")).alias("keys")).join(firsts, "x")
    before = F.filter("firsts", lambda r: r["p"] < F.col("p"))
    own = written(own.withColumn("earlier", F.transform(before, lambda r: r["key"])).drop("firsts"), "members")
    blocks = written(own.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    own = own.join(bounded(blocks, blocks.count()), "p").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    own = own.join(sizes.withColumnRenamed("row", "x"), "x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _groups(batches, ["p", "i", "j"], lambda g: _left(g, num, den), ["x", "p"])

    more = _blocked(own, "p", "x").mapInPandas(run, "x long, p long")
    return first.select("x", F.col("star").alias("p")).union(twos).union(more).distinct()


def _fragments(docs: DataFrame, n: int) -> DataFrame:
    """docs: id, text. Returns id, n, f, g and, a row each, fragment and its n-grams in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = (np.arange(1, COUNTED, dtype=np.float64) / COUNTED * 2.0**64).astype(np.uint64)
        for b in batches:
            rows, size = [], 0
            for i, text in zip(b["id"].tolist(), b["text"].tolist()):
                g = shingles(text, n)
                marks = _marks(g)
                rows += [(i, len(g), *marks, k, x.astype(np.int64)) for k, x in enumerate(np.split(g, np.searchsorted(g, edges)))]
                size += len(g)
                if size > 1 << 20:
                    yield pd.DataFrame(rows, columns=["id", "n", "f", "g", "fragment", "grams"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["id", "n", "f", "g", "fragment", "grams"])

    return docs.mapInPandas(run, "id long, n long, f long, g long, fragment int, grams array<long>")


def _overlaps(stars: DataFrame, fragments: DataFrame) -> DataFrame:
    """stars: x, p, block. fragments: x, fragment, grams. Returns x, p, block, nx, np, common and diff (what only one of them has).

    A row for each pair and fragment, counted by itself, then summed by pair. A pivot's fragment goes to
    each block of its members, so no task gets more than BLOCK members' rows of a pivot's fragment.
    """
    pivots = written(stars.select("p", "block").distinct(), "pivots")
    pivots = fragments.select(F.col("x").alias("p"), "fragment", F.col("grams").alias("own")).join(bounded(pivots, pivots.count()), "p")
    part = fragments.join(bounded(stars, stars.count()), "x").join(pivots, ["p", "block", "fragment"])
    left, right = F.array_except("grams", "own"), F.array_except("own", "grams")
    part = part.select("x", "p", "block", F.size("grams").alias("nx"), F.size("own").alias("np"), left.alias("left"), right.alias("right"))
    part = part.select("x", "p", "block", "nx", "np", (F.col("nx") - F.size("left")).alias("common"), F.concat("left", "right").alias("diff"))
    sums = [F.sum(c).alias(c) for c in ("nx", "np", "common")]
    return part.groupBy("x", "p", "block").agg(*sums, F.flatten(F.collect_list("diff")).alias("diff"))  # COUNTED rows a pair


def _linked(common, nx, ny, num: int, den: int):
    return den * common >= num * (nx + ny - common)


def _overlap(owner: np.ndarray, value: np.ndarray, one: np.ndarray, two: np.ndarray, rows: int) -> np.ndarray:
    """How many values each of the rows one has in common with each of two."""
    out = np.zeros((len(one), len(two)), dtype=np.int64)
    _, col, seen = np.unique(value, return_inverse=True, return_counts=True)
    shared = seen > 1
    keep = shared[col]
    owner, col = owner[keep], (np.cumsum(shared) - 1)[col[keep]]
    by = np.argsort(col, kind="stable")
    owner, col = owner[by], col[by]
    for at in range(0, int(shared.sum()), WIDTH):
        lo, hi = np.searchsorted(col, [at, at + WIDTH])
        part = np.zeros((rows, WIDTH), dtype=np.float32)
        part[owner[lo:hi], col[lo:hi] - at] = 1
        out += (part[one] @ part[two].T).astype(np.int64)
    return out


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in lists], dtype=np.int64)
    return sizes, np.concatenate([np.asarray(v, dtype=np.int64) for v in lists])


def _block_links(g: Mapping[str, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in g of the members of both blocks, and which of them link and belong to this pivot."""
    p, i, j = (int(g[c][0]) for c in ("p", "i", "j"))
    x, nx, block = (g[c] for c in ("x", "nx", "block"))
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
    sizes, diff = _flat(g["diff"].tolist())
    rows = np.arange(len(x))
    apart = sizes[one][:, None] + sizes[two] - 2 * _overlap(np.repeat(rows, sizes), diff, one, two, len(x))
    both = nx[one][:, None] + nx[two]
    link = _linked((both - apart) // 2, nx[one][:, None], nx[two], num, den)
    if i == j:
        np.fill_diagonal(link, False)
    number, pivot = _flat(g["pivots"].tolist())
    owner = np.repeat(rows, number)
    low = pivot < p
    link &= _overlap(owner[low], pivot[low], one, two, len(x)) == 0
    # a pair of a member and its own pivot was compared before
    by = np.argsort(x)
    at = by[np.minimum(np.searchsorted(x[by], pivot), len(x) - 1)]
    direct = np.zeros((len(x), len(x)), dtype=bool)
    hit = x[at] == pivot
    direct[owner[hit], at[hit]] = direct[at[hit], owner[hit]] = True
    return one, two, link & ~direct[np.ix_(one, two)]


def _forest(link: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of a matrix of links between rows and columns."""
    left, right = link.any(axis=1), link.any(axis=0)
    while left.any():
        todo = [(0, int(left.argmax()))]
        left[todo[0][1]] = False
        while todo:
            side, k = todo.pop()
            line, free = (link[k], right) if side == 0 else (link[:, k], left)
            for m in np.flatnonzero(line & free).tolist():
                free[m] = False
                todo.append((1 - side, m))
                yield (k, m) if side == 0 else (m, k)


def _cross(done: DataFrame, stars: DataFrame, num: int, den: int, pairs: bool, weights: DataFrame | None = None) -> DataFrame:
    """a, b, n of the links between members of one pivot.

    With pairs every link (n = 0); else a row (a, a, n) with the weight n of a's partners in a block, and links
    (n = 0) that connect what all of them connect together with those to the pivot.
    """
    many = written(done.groupBy("p").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "many")
    own = stars.select("x", "p").union(stars.select(F.col("p").alias("x"), "p")).distinct().groupBy("x").agg(F.collect_list("p").alias("pivots"))
    rows = done.join(bounded(many, many.count()), "p").select("p", "x", "nx", "near", "diff", "block", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(own, "x")
    if weights is not None:
        rows = rows.join(weights, "x", "left")
    rows = rows.withColumn("w", F.coalesce("w", F.lit(1).cast("long")) if weights is not None else F.lit(1).cast("long"))
    rows = _blocked(written(rows, "differences"), "p")

    def told(g: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
        one, two, link = _block_links(g, num, den)
        if not link.any():
            return []
        x, w, near = (g[c] for c in ("x", "w", "near"))
        same = int(g["i"][0]) == int(g["j"][0])
        if pairs:
            found = ((int(x[one[u]]), int(x[two[v]])) for u, v in zip(*np.nonzero(np.triu(link) if same else link)))
            return [(min(a, b), max(a, b), 0) for a, b in found]
        out = [(a, a, n) for a, n in zip(x[one].tolist(), (link @ w[two]).tolist()) if n]
        if not same:
            out += [(a, a, n) for a, n in zip(x[two].tolist(), (w[one] @ link).tolist()) if n]
        far = link & ~(near[one][:, None] & near[two])  # two that link with the pivot are connected already
        return out + [(int(x[one[u]]), int(x[two[v]]), 0) for u, v in _forest(far)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _groups(batches, ["p", "i", "j"], told, ["a", "b", "n"])

    return rows.mapInPandas(run, "a long, b long, n long")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns x, root (the smallest id reachable) for every x that has an edge.

    Rounds of hooking neighbours to the smallest neighbour and of pointer jumping; each round is
    written to the shared folder.
    """
    links = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    roots = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("x"), "root")
    before = roots = written(roots, "roots")
    for _ in range(MAX_ROUNDS):
        # the smallest root of the neighbours reaches each member's root as well
        seen = links.join(roots.select(F.col("x").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("x")).agg(F.min("r").alias("r"))
        hooked = roots.join(seen, "x").select("x", "root", F.least("root", "r").alias("new"))
        low = hooked.groupBy("root").agg(F.min("new").alias("low"))
        new = hooked.join(low, "root").select("x", "root", F.least("new", "low").alias("new"))
        jump = roots.select(F.col("x").alias("new"), F.col("root").alias("jump"))
        new = new.join(jump, "new", "left").select("x", F.least("new", F.coalesce("jump", "new")).alias("new"), "root")
        new = written(new, "roots")
        changed = new.where("new < root").limit(1).count()
        forget(before)
        before, roots = new, new.select("x", F.col("new").alias("root"))
        if not changed:
            forget(links)
            return roots
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _compared(texts: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """texts: id, text. Returns members: row, id, n, rep (null for empty sets), w (rows of the class); weights: x, w of classes of
    several rows; stars: x, p, block; and the stars compared."""
    signed = written(_signed(texts, n, num, den).withColumn("row", F.monotonically_increasing_id()), "signed")
    # classes of equal sets; only those with several rows need a join
    full = signed.select("row", "n", "f", "g").where("n > 0")
    classes = full.groupBy("n", "f", "g").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("w")).where("w > 1")
    classes = written(classes, "classes")
    member = signed.select("row", "id", "n", "f", "g").join(classes, ["n", "f", "g"], "left")
    rep = F.when(F.col("n") > 0, F.coalesce("rep", "row"))
    member = written(member.select("row", "id", "n", "f", "g", rep.alias("rep"), F.coalesce("w", F.lit(1).cast("long")).alias("w")), "members")
    # a class's smallest row stands for it
    copies = member.where(F.col("row") != F.col("rep")).select("row")
    whole = signed.where(F.size("keys") > 0).select("row", "keys", "tags").join(bounded(copies, copies.count()), "row", "left_anti")
    keys = whole.select(F.col("row").alias("x"), F.explode(F.arrays_zip("keys", "tags")).alias("k")).select("x", F.col("k.keys").alias("key"), F.col("k.tags").alias("tag"))
    # the keys, most of which occur once, are moved once
    alike = Window.partitionBy("key")
    lists = keys.select("*", *(f("x").over(alike).alias(c) for f, c in ((F.count, "m"), (F.min, "p"), (F.max, "q")))).where("p < q")
    lists = written(lists, "lists")
    sizes = written(signed.select("row", "n", "sizes"), "sizes")
    forget(signed)
    # a pair that shares more than `spare` lists of a band shares one besides each one's `spare` longest
    by_length = Window.partitionBy("x", "tag").orderBy(F.desc("m"), "key")
    long = lists.where("m > 2").withColumn("r", F.row_number().over(by_length)).where(F.col("r") > F.col("tag").bitwiseAND(0xFFFF))
    long = written(long.select("key", "x", "p"), "long")
    pairs = long.where("x > p").select("x", "p", F.lit(False).alias("two")).union(lists.where("m = 2 AND x = q").select("x", "p", F.lit(True)))
    pairs = written(pairs.groupBy("x", "p").agg(F.max("two").alias("two")), "pairs")
    forget(lists)
    stars = written(_covered(pairs, long, sizes, num, den), "covered")
    for table in (sizes, pairs, long):
        forget(table)
    many = written(stars.groupBy("p").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK), "many")
    stars = stars.join(bounded(many, many.count()), "p", "left")
    block = F.pmod(F.xxhash64("x"), F.ceil(F.coalesce("m", F.lit(1)) / BLOCK)).cast("int")
    stars = written(stars.select("x", "p", block.alias("block")), "stars")
    used = stars.select(F.col("x").alias("row")).union(stars.select(F.col("p").alias("row"))).distinct()
    used = written(used.join(member.select("row", "id", "n", "f", "g"), "row"), "used")
    ids, rows = used.select("id").distinct(), used.count()
    needed = texts.join(bounded(ids, rows), "id", "left_semi")
    found = _fragments(needed, n).join(bounded(used, rows), ["id", "n", "f", "g"]).select(F.col("row").alias("x"), "fragment", "grams")
    found = written(found, "fragments")
    if found.count() > COUNTED * rows:  # rows of one id and one set are one row here
        found = found.dropDuplicates(["x", "fragment"])
    done = _overlaps(stars, found)
    done = written(done.withColumn("near", _linked(F.col("common"), F.col("nx"), F.col("np"), num, den)), "verified")
    forget(found)
    weights = classes.select(F.col("rep").alias("x"), "w")
    return member, weights, stars, done


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, a_rows, b_rows: every link between class representatives, a < b, with the rows of both classes.

    a and b are the smallest ids of the classes (null without one). As many rows as there are links, which can grow with the square of
    a group of near copies.
    """
    num, den = ratio(similarity)
    texts = docs.select(id_in(id_col).alias("id"), text_in(text_col).alias("text"))
    member, _, stars, done = _compared(texts, n, num, den)
    direct = done.where("near").select(F.col("p").alias("a"), F.col("x").alias("b"))
    out = direct.union(_cross(done, stars, num, den, pairs=True).select("a", "b"))
    told = member.groupBy("rep").agg(F.min(_real("id")).alias("id"), F.max("w").alias("w"))
    for c in ("a", "b"):
        out = out.join(told.select(F.col("rep").alias(c), F.col("id").alias(f"{c}_id"), F.col("w").alias(f"{c}_rows")), c)
    turned = F.col("a_id") > F.col("b_id")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return out.select(pick("a_id", "b_id").alias("a"), pick("b_id", "a_id").alias("b"), pick("a_rows", "b_rows").alias("a_rows"), pick("b_rows", "a_rows").alias("b_rows"))


def _real(name: str) -> Column:
    """An id, null where it stands for a null one."""
    return F.nullif(F.col(name), F.lit(NO_ID))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other rows that the row links with): one row a document."""
    num, den = ratio(similarity)
    texts = docs.select(id_in(id_col).alias("id"), text_in(text_col).alias("text"))
    member, weights, stars, done = _compared(texts, n, num, den)
    cross = written(_cross(done, stars, num, den, pairs=False, weights=weights), "cross")
    direct = written(done.where("near").select(F.col("x").alias("a"), F.col("p").alias("b")), "direct")
    forget(done)
    # rows of one id are one document
    again = member.where(F.col("rep").isNotNull()).groupBy(_real("id").alias("id")).agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("id IS NOT NULL AND a < b")
    again = written(again.select("id", "a"), "again")
    same = member.join(bounded(again, again.count()), "id").where("rep != a").select("a", F.col("rep").alias("b"))
    roots = components(direct.union(cross.where("a != b").select("a", "b")).union(same))
    ends = direct.union(direct.select("b", "a")).join(weights.withColumnRenamed("x", "b"), "b", "left").select("a", F.coalesce("w", F.lit(1)).alias("n"))
    counts = ends.union(cross.where("a = b").select("a", "n")).groupBy(F.col("a").alias("x")).agg(F.sum("n").alias("links"))
    told = written(roots.join(counts, "x", "left").withColumnRenamed("x", "rep"), "told")
    # the smallest id of what hangs together: of a root's rows, or of a class's
    ids = member.where("w > 1").groupBy("rep").agg(F.min(_real("id")).alias("least"))
    own = member.where("row = rep").join(told, "rep").join(ids, "rep", "left").select("root", F.coalesce("least", _real("id")).alias("least"))
    label = own.groupBy("root").agg(F.min("least").alias("label"))
    named = ids.join(told, "rep", "full").join(label, "root", "left").select("rep", F.coalesce("label", "least").alias("label"), "links")
    # an id that some of its rows have in another component's place: empty sets take part in nothing
    out = member.join(named, "rep", "left")
    total = F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.col("w") - 1 + F.coalesce("links", F.lit(0)))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", _real("id")).alias("component_id"), total.cast("long").alias("n_links"))
    return id_out(out, "doc_id")


def keep_one(docs: DataFrame, n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component, that of the smallest id (a null comes last), with all its columns.

    Rows have numbers of their own for the join, so repeated and null ids are rows as any others.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = jaccard_join(rows, "_row", n=n, similarity=similarity).where("n_links > 0").select(F.col("doc_id").alias("_row"), "component_id")
    found = written(found.join(rows.select("_row", "doc_id"), "_row"), "found")  # component_id: the smallest _row
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    gone = written(found.select("_row").join(first.select("_row"), "_row", "left_anti"), "copies")
    return rows.join(gone, "_row", "left_anti").drop("_row")
