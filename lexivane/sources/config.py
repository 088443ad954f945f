"""Settings of an index: defaults, JSON file, checks; weights merged over their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from .files import EXTENSIONS, IGNORED


@dataclass
class Config:
    version: str = "1"
    extensions: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    ignored: list[str] = field(default_factory=lambda: list(IGNORED))
    top_k: int = 10
    min_score: float = 0.15
    weights: dict[str, dict[str, float]] = field(default_factory=dict)


def merged(defaults: dict, own: dict | None) -> dict:
    """own over defaults, at every depth."""
    out = dict(defaults)
    for key, value in (own or {}).items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load(path: str | Path) -> Config:
    """Defaults when there is no file; unknown keys are left out."""
    own = json.loads(Path(path).read_text()) if Path(path).exists() else {}
    return Config(**{f.name: own[f.name] for f in fields(Config) if f.name in own})


def save(config: Config, path: str | Path) -> None:
    Path(path).write_text(json.dumps(asdict(config), indent=2))


def issues(config: Config) -> list[tuple[str, str, str]]:
    """level (error, warning or info), field, message."""
    out = []
    if not config.extensions:
        out.append(("error", "extensions", "no extension: nothing would be indexed"))
    out += [("error", "extensions", f"{e!r} has no leading dot") for e in config.extensions if not str(e).startswith(".")]
    out += [("warning", "extensions", f"{e!r} is given twice") for e in sorted({e for e in config.extensions if config.extensions.count(e) > 1})]
    out += [("warning", "ignored", f"{p!r}: names of folders only, no paths") for p in config.ignored if "/" in p]
    if not 0 <= config.min_score <= 1:
        out.append(("error", "min_score", "must lie between 0 and 1"))
    if config.top_k < 1:
        out.append(("error", "top_k", "must be 1 or more"))
    out += [("warning", f"weights.{m}.{n}", "negative") for m, ws in config.weights.items() for n, w in ws.items() if w < 0]
    if ".git" not in config.ignored:
        out.append(("info", "ignored", ".git would be scanned"))
    return out
