"""Content-addressed store of token ids.

A rolling hash over each document's ids sets chunk borders by content, so equal passages give
equal chunks. Tasks write new chunks to pack files; of chunks that several tasks wrote, one
place stays: the tasks' raw packs (compressed as a whole) become final packs without the others. Recipe files list
the documents in ascending id order with the digests and places of their chunks; a Merkle tree
over the documents of each recipe file, and over the files, goes to the manifest. The reader
fetches chunks by place, checks every digest and every root, and yields the ids.

Files: pack = chunks end to end (little-endian ids, 2 bytes each where the vocabulary allows, else
4). Recipe = one line of JSON a document: [doc_id, n_ids, [[digest, pack, offset, bytes], ...]].
Manifest = JSON with id width, recipe files, their documents, ids, first id's place and roots.

Defined cases: a null or empty text is the end id alone; a very long text is cut into chunks like any other, and is in one task as a whole; null ids come first; repeated rows are documents of their
own, next to each other; an empty table is a manifest without files; other columns are ignored.
Attempts of tasks that were lost leave files that no index names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_dir, held, id_in, id_out, join_uneven, text_in, written
from .files import make_dir, opened, read_bytes, remove, write_bytes
from .bpe import byte_symbols
from .token_counts import _WIDE, units
from .unit_ids import UnitIds, spans

END_ID = 2
#: Ids of the rolling window, and the mean chunk length beyond the window.
WINDOW, MEAN_CHUNK = 16, 512
MAX_CHUNK = 8192
PACK_BYTES = 32 << 20
#: Bytes of a recipe file before compression.
RECIPE_BYTES = 8 << 20
#: Units whose ids, and chunks whose places, a worker keeps.
CACHE, SEEN = 450_000, 100_000

#: A unit without white space inside and without apostrophes: printable ASCII and letters from U+00C0 to U+024F.
_PLAIN = re.compile(" ?[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: The bytes of a token that can lie within such a unit, and those of one kind of character.
_WITHIN = re.compile(rb" ?[\x80-\xbf]?(?:[!-&(-~]|[\xc3-\xc9][\x80-\xbf])*[\xc3-\xc9]?")
_ONE_KIND = re.compile(rb" ?(?:[A-Za-z\x80-\xbf\xc3-\xc9]*|[0-9]+|[!-&(-/:-@\[-`{-~]+)")

#: What keeps a text from being cut at its line ends: other white space, and line ends beside blanks or line ends.
_LOOSE = ("\0", "\n\n", " \n", "\n ", "\t", "\r", "\f", "\v", "\x1c", "\x1d", "\x1e", "\x1f")

_GEAR = np.random.default_rng(4).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


class CachedEncoder:
    """The tokenizers library over the units of a text, each unit encoded once while it is kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.known = UnitIds(self.kind, CACHE)
        # a special string of the vocabulary: nothing reaches across it, so it can stand between units
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.between = next(iter(added), "")
        self.special = list(added)
        self.simple, self.gap = self._without_pattern(path)

    def _without_pattern(self, path: str):
        """A second encoder that leaves out the word pattern, for plain units, and a character to put between them; None where that could change ids.

        The pattern cuts such a unit between letters, digits and other characters. When no token holds
        two of these kinds, merging never crosses a cut, and cutting changes nothing; nor does it cross a character
        that no other token holds. Apostrophes are left to the pattern.
        """
        from tokenizers import Tokenizer, pre_tokenizers

        told = json.loads(self.library.to_str())
        cut = told.get("pre_tokenizer") or {}
        known = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and told["model"].get("type") == "BPE"
        if not known or told.get("normalizer") or any(not t["special"] for t in told.get("added_tokens", [])):
            return None, ""
        to_byte = byte_symbols()
        tokens = [bytes(map(to_byte.__getitem__, t)) for t in told["model"]["vocab"] if t not in self.special]
        if any(_WITHIN.fullmatch(t) and not _ONE_KIND.fullmatch(t) for t in tokens):
            return None, ""
        apart = [chr(c) for c in range(32) if [bytes([c])] == [t for t in tokens if c in t] and chr(c) not in "\t\n\v\f\r\x1c\x1d\x1e\x1f"]
        if not apart:
            return None, ""
        simple = Tokenizer.from_file(path)
        simple.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return simple, apart[0]

    def _encode_joined(self, units: list[str], library, between: str) -> tuple[np.ndarray, np.ndarray]:
        """Many units as one text with a mark between them: the ids without the marks, and how many each unit has."""
        if not between:
            each = [e.ids for e in library.encode_batch_fast(units, add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], dtype=self.kind), np.array(list(map(len, each)), dtype=np.int64)
        ids = np.array(library.encode_batch_fast([between.join(units)], add_special_tokens=False)[0].ids, dtype=self.kind)
        marks = ids == library.encode(between, add_special_tokens=False).ids[0]
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, one after the other, and how many each has."""
        kinds = np.ones(len(units), dtype=np.int8)
        if self.simple:
            kinds[[u is not None for u in map(_PLAIN.fullmatch, units)]] = 0
        whole = "".join(units)
        for special in self.special:
            if special in whole:
                kinds[[special in u for u in units]] = 2
        del whole
        order = np.argsort(kinds, kind="stable")
        plain, other, rest = (order[kinds[order] == k].tolist() for k in range(3))
        flat, sizes = [np.zeros(0, dtype=self.kind)], [np.zeros(0, dtype=np.int64)]
        for library, between, own in ((self.simple, self.gap, plain), (self.library, self.between, other)):
            for at in range(0, len(own), 512):
                ids, n = self._encode_joined([units[k] for k in own[at : at + 512]], library, between)
                flat.append(ids)
                sizes.append(n)
        for k in rest:
            flat.append(np.array(self.library.encode(units[k], add_special_tokens=False).ids, dtype=self.kind))
            sizes.append(np.array([len(flat[-1])]))
        sizes = np.concatenate(sizes)
        if len(sizes) != len(units):
            raise ValueError("a unit holds the mark that stands between units")
        flat, back = np.concatenate(flat), np.argsort(order)
        return spans(flat, (np.cumsum(sizes) - sizes)[back], sizes[back]), sizes[back]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        return self.known.encode(texts, lines_and_units, self._encode_units)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.encode_all(texts)
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def lines_and_units(text: str) -> bytes | list[str]:
    """The text's units, or the text as bytes to be split at blanks and single line ends, where only words stand around them."""
    if not text or "  " in text or any(c in text for c in _LOOSE) or text[0] in " \n" or text[-1] in " \n" or not text.isascii() and _WIDE.search(text):
        return units(text)
    return text.encode()


def encoder(path: str) -> CachedEncoder:
    return held(f"encoder {path}", lambda: CachedEncoder(path))


def borders(ids: np.ndarray) -> list[int]:
    """Ends of the chunks: where the hash of the last WINDOW ids says so, MAX_CHUNK ids at most, and at the end."""
    sums = np.cumsum(_GEAR[ids.astype(np.int64) & 0xFFFF], dtype=np.uint64)
    rolled = sums[WINDOW:] - sums[:-WINDOW]
    rolled = (rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    cuts = (np.flatnonzero(rolled % np.uint64(MEAN_CHUNK) == 0) + WINDOW + 1).tolist()
    out, last = [], 0
    for cut in [*cuts, len(ids)]:
        while cut - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if cut > last:
            out.append(cut)
            last = cut
    return out


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; a level's odd last node moves up as it is; no leaves: the digest of nothing."""
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


class _Pack:
    """Chunks on their way to pack files."""

    def __init__(self, folder: str):
        self.folder, self.parts, self.size, self.name = folder, [], 0, f"{uuid.uuid4().hex}.raw"

    def add(self, data: bytes) -> tuple[str, int]:
        if self.size >= PACK_BYTES:
            self.close()
        at = self.size
        self.parts.append(data)
        self.size += len(data)
        return self.name, at

    def close(self) -> None:
        if self.parts:
            write_bytes(f"{self.folder}/{self.name}", zstandard.ZstdCompressor(level=1).compress(b"".join(self.parts)))
        self.parts, self.size, self.name = [], 0, f"{uuid.uuid4().hex}.raw"


_ENCODED = "doc_id long, n_ids long, digests array<binary>, new array<struct<digest: binary, pack: string, at: long, size: int>>"


def _encode(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, pack, seen = encoder(tokenizer), _Pack(folder), set()
        for b in batches:
            rows = []
            for doc_id, ids in zip(b["doc_id"].tolist(), own.encode(b["text"].tolist())):
                ids = np.append(ids, own.kind.type(END_ID))
                start, digests, new = 0, [], []
                for end in borders(ids):
                    data = ids[start:end].tobytes()
                    key = digest(data)
                    digests.append(key)
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        new.append((key, *pack.add(data), len(data)))
                    start = end
                rows.append((doc_id, len(ids), digests, new))
            yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "digests", "new"])
        pack.close()

    return docs.mapInPandas(run, _ENCODED)


def _compact(places: DataFrame, folder: str) -> DataFrame:
    """places: digest, pack, at, size, keep. Writes each pack's chunks to keep to its final pack; returns digest, pack, at, size."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        raw = b["pack"].iloc[0]
        b = b[b["keep"]].drop_duplicates(["at"]).sort_values("at")
        data = zstandard.ZstdDecompressor().decompress(read_bytes(f"{folder}/{raw}")) if len(b) else b""
        parts = [data[start : start + n] for start, n in zip(b["at"].tolist(), b["size"].tolist())]
        name = f"{uuid.uuid4().hex}.pack"
        if parts:
            write_bytes(f"{folder}/{name}", b"".join(parts))
        sizes = b["size"].to_numpy()
        return pd.DataFrame({"digest": b["digest"], "pack": name, "at": sizes.cumsum() - sizes, "size": sizes})

    return places.groupBy("pack").applyInPandas(run, "digest binary, pack string, at long, size int")


def _leaf(line: bytes) -> bytes:
    return digest(line)


def _recipes(docs: DataFrame, folder: str) -> DataFrame:
    """docs: doc_id, n_ids, chunks (digest, pack, at, size in order), in ascending order within partitions.

    A file ends at RECIPE_BYTES; part and file give the order of the files.
    """

    def put(lines: list[bytes], first: int, n_ids: int, file: int) -> pd.DataFrame:
        name = f"{uuid.uuid4().hex}.recipe"
        write_bytes(f"{folder}/{name}", zlib.compress(b"\n".join(lines), 1))
        row = (TaskContext.get().partitionId(), file, name, first, len(lines), n_ids, merkle([_leaf(x) for x in lines]).hex())
        return pd.DataFrame([row], columns=["part", "file", "name", "first", "docs", "ids", "root"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines, size, first, n_ids, file = [], 0, None, 0, 0
        for b in batches:
            for doc_id, n, chunks in zip(b["doc_id"].tolist(), b["n_ids"].tolist(), b["chunks"].tolist()):
                first = doc_id if first is None else first
                lines.append(json.dumps([doc_id, n, [[bytes(c["digest"]).hex(), c["pack"], c["at"], c["size"]] for c in chunks]]).encode())
                size += len(lines[-1])
                n_ids += n
                if size >= RECIPE_BYTES:
                    yield put(lines, first, n_ids, file)
                    lines, size, first, n_ids, file = [], 0, None, 0, file + 1
        if lines:
            yield put(lines, first, n_ids, file)

    return docs.mapInPandas(run, "part int, file int, name string, first long, docs long, ids long, root string")


def write_store(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the store and returns its manifest's address."""
    make_dir(folder)
    spark = docs.sparkSession
    df = docs.select(id_in(id_col).alias("doc_id"), text_in(text_col).alias("text"))
    done = written(_encode(df, tokenizer, folder), "encoded")
    places = done.select(F.explode("new").alias("c")).select("c.*")
    owner = places.groupBy("digest").agg(F.min(F.struct("pack", "at")).alias("o"))
    ruled = places.join(owner, "digest").select("digest", "pack", "at", "size", ((F.col("o.pack") == F.col("pack")) & (F.col("o.at") == F.col("at"))).alias("keep"))
    packs = written(ruled, "ruled")
    index = written(_compact(packs, folder), "index")
    # rows are told apart by a number of their own: repeated ids are documents of their own
    entries = done.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "n_ids", F.posexplode("digests").alias("seq", "digest"))
    found = join_uneven(entries, index, "digest").groupBy("doc_id", "row", "n_ids").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "pack", "at", "size"))).alias("chunks"))
    n = max(1, spark.sparkContext.defaultParallelism)
    ordered = found.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    # one row a recipe file
    made = sorted(written(_recipes(ordered, folder), "recipes").collect(), key=lambda r: (r["part"], r["file"]))

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pack in b["pack"].tolist():
                remove(f"{folder}/{pack}")
            yield b

    packs.select("pack").distinct().mapInPandas(drop, "pack string").count()
    start, files = 0, []
    for r in made:
        files.append({"name": r["name"], "first": r["first"], "docs": r["docs"], "ids": r["ids"], "start": start, "root": r["root"]})
        start += r["ids"]
    top = merkle([bytes.fromhex(f["root"]) for f in files]).hex()
    width = encoder(tokenizer).width
    write_bytes(f"{folder}/manifest.json", json.dumps({"width": width, "ids": start, "root": top, "files": files}).encode())
    return f"{folder}/manifest.json"


class _Chunks:
    """Chunk bytes by place: the pack in hand as a whole, others by seeking; digests checked."""

    def __init__(self, folder: str):
        self.folder, self.whole, self.open = folder, {}, {}
        self.near: dict[bytes, bytes] = {}

    def get(self, key: str, pack: str, at: int, size: int) -> bytes:
        data = self.near.get(key)
        if data is None:
            src = self.open.get(pack)
            if src is None:
                if len(self.open) >= 64:
                    self.open.pop(next(iter(self.open))).close()
                fs, path = opened(f"{self.folder}/{pack}")
                src = self.open[pack] = fs.open_input_file(path)
            data = src.read_at(size, at)
            if digest(data).hex() != key:
                raise ValueError(f"chunk {key} in {pack} is damaged")
            if len(self.near) >= 4096:
                self.near.clear()
            self.near[key] = data
        return data


def read_store(spark: SparkSession, manifest: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<int>; null without with_ids), ids_crc32: one row a document, all digests and roots checked."""
    folder = manifest.rpartition("/")[0]
    told = json.loads(read_bytes(manifest))
    if merkle([bytes.fromhex(f["root"]) for f in told["files"]]).hex() != told["root"]:
        raise ValueError("the manifest's root does not fit its files")
    kind = np.dtype("<u2" if told["width"] == 2 else "<u4")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks = _Chunks(folder)
        for b in batches:
            for name, start, root in zip(b["name"].tolist(), b["start"].tolist(), b["root"].tolist()):
                lines = zlib.decompress(read_bytes(f"{folder}/{name}")).split(b"\n")
                if merkle([_leaf(x) for x in lines]).hex() != root:
                    raise ValueError(f"recipe file {name} is damaged")
                rows = []
                for line in lines:
                    doc_id, n, places = json.loads(line)
                    ids = np.frombuffer(b"".join([chunks.get(*p) for p in places]), dtype=kind)
                    if len(ids) != n:
                        raise ValueError(f"document {doc_id} has {len(ids)} ids, not {n}")
                    rows.append((doc_id, start, n, ids.astype("<u4")))
                    start += n
                    if len(rows) == 512:
                        yield _frame(rows, with_ids)
                        rows = []
                if rows:
                    yield _frame(rows, with_ids)

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.LongType()), T.StructField("root", T.StringType())])
    files = spark.createDataFrame([(f["name"], f["start"], f["root"]) for f in told["files"]], schema)
    if told["files"]:
        files = files.repartition(len(told["files"]))
    return id_out(files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids array<int>, ids_crc32 long"), "doc_id")


def _frame(rows: list, with_ids: bool) -> pd.DataFrame:
    return pd.DataFrame([(*r[:3], r[3].astype(np.int32) if with_ids else None, zlib.crc32(r[3].tobytes())) for r in rows], columns=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Writes the store to a folder in the shared one, and reads it back."""
    spark = docs.sparkSession
    return read_store(spark, write_store(docs, tokenizer, folder or fresh_dir(spark, "token-store")), with_ids)
