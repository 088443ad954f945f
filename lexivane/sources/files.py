"""Directory scan, and what of it is indexed, searched or left out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keywords import extension

# Extensions that are indexed, and folders that are not entered (names, compared as they are).
EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs .mts .cts .json .md .py .go .rs .java .yaml .yml .toml .sql .txt".split()
IGNORED = (
    "node_modules .pnpm-store .yarn vendor .git dist build out .output target .next .nuxt .svelte-kit .vercel .netlify .cache .turbo"
    " .parcel-cache .eslintcache coverage .nyc_output __pycache__ .venv venv .pytest_cache .idea .DS_Store Thumbs.db"
).split()

# Extensions of binary files, marks of bundled files, files of operating systems.
BINARY = (
    ".png .jpg .jpeg .gif .ico .svg .webp .bmp .tiff .pdf .doc .docx .xls .xlsx .ppt .pptx .zip .tar .gz .7z .rar .bz2"
    " .exe .dll .so .dylib .bin .dat .obj .o .mp3 .mp4 .wav .avi .mov .flac .ogg .woff .woff2 .ttf .eot .otf"
).split()
BUNDLED = ".min.js .min.css .bundle.js .bundle.css .prod.js .prod.css .chunk.js .chunk.css".split()
SYSTEM = ".ds_store thumbs.db desktop.ini".split()
SEARCHED_CHARS = 1 << 20


def in_folder(path: Column, names: list[str]) -> Column:
    """Whether a folder of the path has one of the names."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.array(*map(F.lit, names)))


def likely_binary(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = extension(path).isin(BINARY) | name.isin(SYSTEM)
    for mark in BUNDLED:
        out = out | F.contains(path, F.lit(mark))
    return out


def searchable(path: Column, content: Column) -> Column:
    return (F.length(content) <= SEARCHED_CHARS) & ~F.contains(content, F.char(F.lit(0))) & ~extension(path).isin(BINARY)


def qualified(spark: SparkSession, root: str) -> str:
    """The full address of a folder, as Spark's readers give it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toString().rstrip("/")


def scan(spark: SparkSession, root: str, extensions: list[str] | None = EXTENSIONS, ignored: list[str] = IGNORED, since: datetime | None = None) -> DataFrame:
    """path (from the root), mtime, size, content, changed. extensions None: every file. since None: all changed.

    Files are listed by Spark; a plan that doesn't select content doesn't read it.
    """
    base = qualified(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.substr(F.col("path"), F.lit(len(base) + 2))
    out = files.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))
    if ignored:
        out = out.where(~in_folder(F.col("path"), ignored))
    if extensions is not None:
        out = out.where(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1).isin(extensions))
    return out.withColumn("changed", F.lit(True) if since is None else F.col("mtime") > F.lit(since))
