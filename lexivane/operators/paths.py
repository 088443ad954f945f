"""Path context, boosts, prefix joins and conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Layers in order, with the words that give them away.
LAYERS = {
    "controller": ["controller", "controllers", "handler", "handlers", "route", "routes", "api"],
    "service": ["service", "services", "usecase", "usecases", "application"],
    "repository": ["repository", "repositories", "repo", "repos", "dao", "store", "storage"],
    "model": ["model", "models", "entity", "entities", "schema", "schemas"],
    "util": ["util", "utils", "utility", "utilities", "helper", "helpers", "common", "shared"],
    "config": ["config", "configs", "configuration", "settings"],
    "middleware": ["middleware", "middlewares", "interceptor", "interceptors"],
    "domain": ["domain", "core", "business"],
    "infrastructure": ["infrastructure", "infra", "external", "adapters"],
    "presentation": ["presentation", "view", "views", "component", "components", "ui"],
    "test": ["test", "tests", "spec", "specs", "__tests__", "__test__"],
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folders(path: Column) -> Column:
    return F.filter(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda s: s != "")


def layer(path: Column) -> Column:
    """First layer whose word the file name contains or a folder equals."""
    name, out = F.lower(file_name(path)), F.lit(None).cast("string")
    dirs = F.transform(folders(path), F.lower)
    for key, words in reversed(LAYERS.items()):
        fits = F.arrays_overlap(dirs, F.array(*map(F.lit, words)))
        for w in words:
            fits = fits | F.contains(name, F.lit(w))
        out = F.when(fits, F.lit(key)).otherwise(out)
    return out


def domain(path: Column) -> Column:
    """Innermost folder of three and more characters that is no layer word and not generic."""
    known = [w for words in LAYERS.values() for w in words] + ["src", "lib", "app", "apps", "packages", "index", "main", "dist", "build"]
    return F.get(F.filter(F.reverse(F.transform(folders(path), F.lower)), lambda s: (F.length(s) > 2) & ~s.isin(known)), F.lit(0))


def boost(path: Column, terms: list[str]) -> Column:
    """0.10 for the domain, 0.05 for the layer, 0.05 for any folder that a term contains or is contained in."""
    def near(c: Column) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(c, F.lit(t)) | F.contains(F.lit(t), c)
        return F.coalesce(out, F.lit(False))

    return F.when(near(domain(path)), 0.1).otherwise(0.0) + F.when(near(layer(path)), 0.05).otherwise(0.0) + F.when(F.exists(F.transform(folders(path), F.lower), near), 0.05).otherwise(0.0)


def fits_pattern(path: Column, patterns: list[str]) -> Column:
    """*.x: the path ends so; else it contains the pattern; any of them."""
    out = F.lit(False)
    for p in patterns:
        out = out | (F.endswith(path, F.lit(p[1:])) if p.startswith("*.") else F.contains(path, F.lit(p)))
    return out


def fits_filter(path: Column, wanted: str) -> Column:
    if any(c in wanted for c in "*?[]{}!"):
        return path.rlike(tx.glob_regex(wanted))
    bare = wanted.strip("/").removeprefix("./")
    return (path == bare) | F.startswith(path, F.lit(f"{bare}/"))


def longest_prefix(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files: path; roots: root, name. Adds the name of the longest root that holds the path.

    The path's own ancestors are the join keys, so the join is an equi-join.
    """
    parts = F.split(F.col("path"), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    steps = files.select("path", F.explode(up).alias("root"))
    return steps.join(roots, "root").groupBy("path").agg(F.max_by("name", F.length("root")).alias("project"))


def fits_exact(path: Column, wanted: list[str]) -> Column:
    """The exact track's filter: a glob, or a folder or file at the start of the path or a folder anywhere in it; any of them."""
    out = F.lit(False)
    for w in wanted:
        bare = w.replace("\\", "/").strip("/")
        if any(c in bare for c in "*?[]{}!"):
            out = out | path.rlike(tx.glob_regex(bare))
        else:
            out = out | (path == bare) | F.startswith(path, F.lit(f"{bare}/")) | F.contains(path, F.lit(f"/{bare}/"))
    return out
