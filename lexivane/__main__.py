"""Command line: index, query, status, reset."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions import display, query_literals
from .operators import modules, ranking
from .sources import index
from .sources.store import Store


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexivane")
    p.add_argument("--store", default=".lexivane")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index").add_argument("folder")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--top", "-k", type=int, default=10)
    q.add_argument("--min-score", "-s", type=_share, default=0.15)
    q.add_argument("--type", "-t", help="an extension, with or without its dot")
    q.add_argument("--filter", "-f", action="append", default=[], help="a folder or a glob; may be given again")
    q.add_argument("--rank-by", choices=list(ranking.ORDERS), default="structured")
    q.add_argument("--core", action="store_true", help="results of the core module too")
    q.add_argument("--preview", action="store_true", help="the first lines of each result")
    sub.add_parser("status")
    sub.add_parser("reset")
    return p


def _share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("must lie between 0 and 1")
    return value


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexivane").getOrCreate()
    out = []
    if args.command == "index":
        out = [f"{k}: {n}" for k, n in sorted(index.refresh(spark, args.folder, args.store).items())]
    elif args.command == "query":
        quoted, _ = query_literals.parse(args.text)
        patterns = (f"*.{args.type.removeprefix('.')}",) if args.type else ()
        found = index.search(spark, args.store, args.text, args.top, args.rank_by, args.min_score, patterns, tuple(args.filter), args.core)
        rows = [r.asDict() for r in found.withColumn("module", modules.display_name(found["module"])).collect()]  # --top rows
        if args.preview:
            out = display.results(rows).split("\n")
        else:
            out = [f"{r['score']:.4f} {r['path']}:{r['start_line']}-{r['end_line']} {r['kind']} {r['name'] or ''}".rstrip() for r in rows]
        out += [f"literal {x.value} ({x.kind or 'text'}, {x.confidence})" for x in quoted]
    elif args.command == "status":
        out = [f"{r['table_name']}: {r['files']} files, {r['rows']} rows" for r in Store(spark, args.store).status().collect()]
    else:
        Store(spark, args.store).reset()
    print(*out, sep="\n")
    return out


if __name__ == "__main__":
    main()
