"""WARC archives: writing with payload deduplication, and a sequential reader.

Of records with equal payloads the one with the largest id is a response, the others are revisit
records that refer to it. Every record is a gzip member of its own. The reader goes through a file
once: it decompresses piece by piece, frames each block by its content length, starts anew at each
member, and checks block and payload digests.

Defined cases: a null payload is empty; empty payloads are equal payloads; repeated rows with the
largest id are all responses; a null id is written without a number and never referred to unless
all ids of its payload are null, when all are responses; a null url is left out; an empty table
gives no archive and an empty result. Attempts of lost tasks leave files that no list names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, NO_ID, fresh_dir, id_in, id_out, join_small, written
from .files import make_dir, opened

#: Compressed bytes after which a new file begins, and that are read at once.
FILE_BYTES, READ_BYTES = 64 << 20, 1 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{base32(sha1_hex)}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Reader:
    """Records of one archive, in order: (header fields with lower-case names, block)."""

    def __init__(self, source, name: str = "archive"):
        self.source, self.name = source, name
        self.raw, self.plain, self.inflater = b"", bytearray(), None

    def _more(self) -> bool:
        """Some more plain bytes of the member in hand; False at its end."""
        if self.inflater is None or self.inflater.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
            if not self.raw:
                raise ValueError(f"{self.name} ends within a member")
        self.plain += self.inflater.decompress(self.raw, READ_BYTES)
        self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
        return True

    def _need(self, n: int) -> None:
        while len(self.plain) < n:
            if not self._more():
                raise ValueError(f"a record of {self.name} is shorter than it says")

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            if not self.raw:
                self.raw = self.source.read(READ_BYTES)
            if not self.raw:
                return
            self.inflater, self.plain = zlib.decompressobj(31), bytearray()
            while (end := self.plain.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    raise ValueError(f"a record of {self.name} has no end of header")
            version, *lines = bytes(self.plain[:end]).decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"{self.name} has a member that is no record")
            head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            n = int(head["content-length"])
            self._need(end + 4 + n + 4)
            block = bytes(self.plain[end + 4 : end + 4 + n])
            while self._more():
                pass
            if bytes(self.plain[end + 4 + n :]) != b"\r\n\r\n":
                raise ValueError(f"a record of {self.name} is longer than it says")
            yield head, block


def checked(head: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """Page, payload bytes, payload digest, type, refers_to and payload of a record whose digests fit."""
    if base32(hashlib.sha1(block).hexdigest()) != head["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {head['warc-record-id']} does not fit")
    number = lambda s: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)>", s or "")) else None
    fields, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", fields)[1])
    told = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != size or base32(hashlib.sha1(payload).hexdigest()) != told):
        raise ValueError(f"payload digest of {head['warc-record-id']} does not fit")
    return number(head["warc-record-id"]), size, told, head["warc-type"], number(head.get("warc-refers-to")), payload


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", broadcast_rows: int = BROADCAST_IDS // 4) -> DataFrame:
    """Writes archives to folder; returns file, records: one row a file."""
    make_dir(folder)
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    df = pages.select(id_in(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    df = df.withColumn("sha1", F.sha1("payload"))
    real = F.when(F.col("page") != F.lit(NO_ID), F.col("page"))
    again = df.groupBy("sha1").agg(F.max(real).alias("last"), F.count(F.lit(1)).alias("m")).where("m > 1 AND last IS NOT NULL").drop("m")
    again = written(again, "again")
    df = join_small(df, again, ["sha1"], again.count(), broadcast_rows)
    df = df.select("page", "url", "payload", "sha1", F.coalesce(F.when(F.col("last") != F.col("page"), F.col("last")), F.lit(NO_ID)).alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = opened(folder)
        out, name, records, done = None, "", 0, []
        for b in batches:
            for page, url, data, sha1, to in zip(*(b[c].tolist() for c in ("page", "url", "payload", "sha1", "refers_to"))):
                if out is not None and out.tell() >= FILE_BYTES:
                    out.close()
                    done.append((name, records))
                    out = None
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                plain = record(None if page == NO_ID else page, url, bytes(data), sha1, None if to == NO_ID else to)
                out.write(squeeze.compress(plain) + squeeze.flush())
                records += 1
        if out is not None:
            out.close()
            done.append((name, records))
        yield pd.DataFrame(done, columns=["file", "records"])

    return written(df.mapInPandas(run, "file string, records long"), "archives")


def read_archives(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row a record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = opened(folder)
        for b in batches:
            for name, records in zip(b["file"].tolist(), b["records"].tolist()):
                rows, total = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as src:
                    for head, block in Reader(src, name):
                        page, size, told, kind, to, _ = checked(head, block)
                        rows.append((NO_ID if page is None else page, size, told, kind, NO_ID if to is None else to))
                        total += 1
                        if len(rows) == 4096:
                            yield pd.DataFrame(rows, columns=_READ)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_READ)
                if total != records:
                    raise ValueError(f"{name} has {total} records, not {records}")

    n = max(1, files.count())
    out = files.repartition(n).mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return id_out(id_out(out, "page_id"), "refers_to")


_READ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives to a folder in the shared one and reads them back."""
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    return read_archives(spark, write_archives(pages, folder), folder)


#: Base 32 of a hexadecimal digest, in SQL: 40 hexadecimal digits are 32 groups of five bits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
m AS (SELECT h, max(page_id) AS last FROM d GROUP BY h),
bits AS (SELECT h, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(h, i, 1))::INT), 4, '0')), '') AS b FROM m),
b32 AS (SELECT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(1, 6), lambda j: (substr(b, i * 5 + j, 1)::INT << (5 - j))))::INT, 1)), '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d JOIN m USING (h) JOIN b32 USING (h)
"""
