"""Results, durations and ages as text."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

#: Lines and characters of a preview, characters of a line of an exact match, exact matches shown.
PREVIEW_LINES, PREVIEW_CHARS, MATCH_CHARS, MATCHES = 3, 80, 76, 10


def duration(ms: float) -> str:
    if ms < 1000:
        return f"{ms:.0f}ms"
    if ms < 60_000:
        return f"{ms / 1000:.1f}s"
    return f"{int(ms // 60_000)}m {ms % 60_000 / 1000:.1f}s"


def age(then: datetime, now: datetime) -> str:
    seconds = int((now - then).total_seconds())
    for limit, unit, name in ((60, 0, ""), (3600, 60, "m"), (86_400, 3600, "h"), (604_800, 86_400, "d")):
        if seconds < limit:
            return f"{seconds // unit}{name} ago" if unit else "just now"
    return then.date().isoformat()


def _cut(line: str, most: int) -> str:
    return line[:most] + ("..." if len(line) > most else "")


def _share(x: float) -> str:
    return f"{100 * x:.1f}%"


def results(rows: Iterable[dict]) -> str:
    """rows: path, start_line, end_line, name, score, structured, semantic, kind, module (its name), exported, exact, content."""
    out = []
    for k, r in enumerate(rows, 1):
        name = f" ({r['name']})" if r.get("name") else ""
        told = [f"Score: {_share(r['score'])}"]
        told += [f"{label}: {_share(r[key])}" for label, key in (("Structured", "structured"), ("Semantic", "semantic")) if r.get(key) is not None]
        told += [f"Type: {r['kind']}", f"via {r['module']}"]
        told += [word for word, key in (("exported", "exported"), ("exact match", "exact")) if r.get(key)]
        out.append(f"{k}. {r['path']}:{r['start_line']}-{r['end_line']}{name}\n   {' | '.join(told)}")
        out += [f"      {_cut(line, PREVIEW_CHARS)}" for line in (r.get("content") or "").split("\n")[:PREVIEW_LINES]]
        out.append("")
    return "\n".join([f"Found {sum(1 for x in out if x == '')} results:", "", *out]) if out else "No results found."


def hybrid(exact: dict | None, rows: list[dict]) -> str:
    """exact: query, total_files, total_matches, and files (path, matches, line, before, content, after) of the exact track."""
    out = []
    if exact and exact["total_matches"]:
        files = exact["files"][:MATCHES]
        some = f"showing {len(files)} of {exact['total_files']} files, {exact['total_matches']} total matches"
        out += [f"Exact matches ({some if len(files) < exact['total_files'] else str(exact['total_files']) + ' files, ' + str(exact['total_matches']) + ' matches'})", f'Query: "{exact["query"]}"', ""]
        for k, f in enumerate(files, 1):
            out.append(f"  {k}. {f['path']}" + (f" ({f['matches']} matches)" if f["matches"] > 1 else ""))
            for mark, line, text in ((" ", f["line"] - 1, f.get("before")), (">", f["line"], f["content"]), (" ", f["line"] + 1, f.get("after"))):
                if text or mark == ">":
                    out.append(f"   {mark} {line:>4} | {_cut(text or '', MATCH_CHARS)}")
        out.append("")
        out += ["Results" + (" (raised by exact matches)" if any(r.get("exact") for r in rows) else ""), ""] if rows else []
        return "\n".join(out) + (results(rows) if rows else "")
    return results(rows)
