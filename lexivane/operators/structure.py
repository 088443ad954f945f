"""What a file's place in a tree tells: path keywords and context, text for embedding, the nearest README, projects, conventions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import introspection, paths

# Folders that name no domain, those left out of a context, those left out of a summary's keywords.
NO_DOMAIN = ["src", "lib", "app", "packages", "modules"]
NO_CONTEXT = ["src", "lib", "app"]
GENERIC = ["src", "lib", "app", "index", "dist", "build", "out", "node_modules"]

# Names of a README in order of priority.
READMES = ["README.md", "readme.md", "Readme.md", "README.MD", "index.md", "INDEX.md"]

# Folders of projects with the type of what they hold; packages that tell a project's type.
PROJECT_FOLDERS = {"apps": "app", "packages": "library", "libs": "library", "services": "service", "scripts": "script", "tools": "script"}
MONOREPO_FOLDERS = ["apps", "packages", "libs", "services"]
APP_PACKAGES, SERVICE_PACKAGES = ["next", "react", "vue", "svelte"], ["express", "fastify", "koa", "hono"]

# Folders left out of a file's introspection keywords.
NO_SEGMENT = ["src", "lib", "index"]


def _bare(path: Column) -> Column:
    """The path without its last suffix, with / between its parts."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"\.[^.]+$", "")


def _long(words: Column, least: int = 3) -> Column:
    return F.filter(words, lambda w: F.length(w) >= least)


def path_keywords(path: Column) -> Column:
    """Each part of the path and its words, of three and more characters, without words that are common in code; distinct, in order."""
    parts = F.filter(F.split(_bare(path), "/"), lambda s: F.length(s) > 1)
    words = lambda s: F.split(F.lower(F.regexp_replace(F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2"), "[_-]", " ")), r"\s+")
    each = F.flatten(F.transform(parts, lambda s: F.concat(F.array(F.lower(s)), words(s))))
    return F.array_distinct(F.filter(_long(each), lambda w: ~w.isin(tx.COMMON_KEYWORDS)))


def summary_keywords(path: Column) -> Column:
    """path_keywords() without generic folders."""
    return F.filter(path_keywords(path), lambda w: ~w.isin(GENERIC))


def path_context(path: Column) -> Column:
    """segments, layer, domain, depth of a path, as a struct."""
    parts = F.split(_bare(path), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    layers = [w for words in paths.LAYERS.values() for w in words]
    domain = F.get(F.filter(F.reverse(F.transform(dirs, F.lower)), lambda s: (F.length(s) > 2) & ~s.isin(NO_DOMAIN + layers)), F.lit(0))
    name, layer = F.lower(F.element_at(parts, -1)), F.lit(None).cast("string")
    for key, words in reversed(paths.LAYERS.items()):
        fits = F.arrays_overlap(F.transform(dirs, F.lower), F.array(*map(F.lit, words)))
        for w in words:
            fits = fits | F.contains(name, F.lit(w))
        layer = F.when(fits, F.lit(key)).otherwise(layer)
    return F.struct(dirs.alias("segments"), layer.alias("layer"), domain.alias("domain"), F.size(dirs).alias("depth"))


def context_text(path: Column) -> Column:
    """[domain layer folders] of a path: the last three folders of three and more characters; empty without any."""
    told = path_context(path)
    dirs = told["segments"]
    last = F.filter(_long(F.slice(dirs, F.greatest(F.size(dirs) - 2, F.lit(1)), F.lit(3))), lambda s: ~F.lower(s).isin(NO_CONTEXT))
    parts = F.array_distinct(F.concat(F.array_compact(F.array(told["domain"], told["layer"])), F.transform(last, F.lower)))
    return F.when(F.size(parts) > 0, F.concat(F.lit("["), F.array_join(parts, " "), F.lit("]"))).otherwise("")


def embedding_text(path: Column, content: Column, name: Column | None = None, doc: Column | None = None) -> Column:
    """A chunk's text for embedding: context, file name unless the context has it, name, documentation, content."""
    context = context_text(path)
    file = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    told = F.when((F.length(file) > 2) & ~F.contains(F.lower(context), F.lower(file)), file)
    parts = [F.nullif(context, F.lit("")), told]
    parts += [F.concat(F.nullif(name, F.lit("")), F.lit(":"))] if name is not None else []
    parts += [F.nullif(doc, F.lit(""))] if doc is not None else []
    return F.concat_ws(" ", *parts, content)


def nearest_readme(files: DataFrame) -> DataFrame:
    """files: path. path, readme: of the nearest folder up to the root, the first of READMES; null without any.

    A file's ancestors are join keys: one row a folder level, no comparison of paths with each other.
    """
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace(F.col("path"), "/?[^/]*$", "")
    prio = F.array_position(F.array(*map(F.lit, READMES)), name)
    readmes = files.where(name.isin(READMES)).select(folder.alias("folder"), prio.alias("prio"), F.col("path").alias("readme"))
    readmes = readmes.groupBy("folder").agg(F.min_by("readme", "prio").alias("readme"))
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, F.size(parts) - 1 - i), "/"))
    levels = files.select("path", F.posexplode(ups).alias("up", "folder"))
    near = levels.join(readmes, "folder").groupBy("path").agg(F.min_by("readme", "up").alias("readme"))
    return files.select("path").join(near, "path", "left")


def projects(files: DataFrame, depth: int = 10) -> DataFrame:
    """files: path, content. root, name, type of every project: folders in a monorepo's folders, and folders with a package.json (these win)."""
    parts = F.split("path", "/")
    inside = files.where(parts[0].isin(MONOREPO_FOLDERS) & (F.size(parts) > 2)).select(F.concat_ws("/", parts[0], parts[1]).alias("root"), parts[1].alias("name"), parts[0].alias("kind"))
    by_folder = inside.select("root", "name", _type_of("kind").alias("type"), F.lit(1).alias("prio")).distinct()
    told = files.where((F.element_at(parts, -1) == "package.json") & (F.size(parts) > 1) & (F.size(parts) <= depth + 1))
    told = told.select(F.regexp_replace("path", "/package.json$", "").alias("root"), F.try_parse_json("content").alias("j")).where("j IS NOT NULL")
    name = F.coalesce(F.try_variant_get("j", "$.name", "string"), F.element_at(F.split("root", "/"), -1))
    by_package = told.select("root", name.alias("name"), _package_type(F.col("j")).alias("type"), F.lit(0).alias("prio"))
    every = by_folder.unionByName(by_package)
    return every.groupBy("root").agg(F.min_by(F.struct("name", "type"), "prio").alias("p")).select("root", "p.name", "p.type")


def _type_of(folder: str) -> Column:
    out = F.lit("unknown")
    for k, v in PROJECT_FOLDERS.items():
        out = F.when(F.col(folder) == k, v).otherwise(out)
    return out


def _package_type(j: Column) -> Column:
    def uses(names: list[str]) -> Column:
        out = F.lit(False)
        for n in names:
            for part in ("dependencies", "devDependencies"):
                out = out | F.try_variant_get(j, f"$.{part}['{n}']", "string").isNotNull()
        return out

    exports = F.try_variant_get(j, "$.main", "string").isNotNull() | F.try_variant_get(j, "$.exports", "variant").isNotNull()
    return F.when(uses(APP_PACKAGES), "app").when(uses(SERVICE_PACKAGES), "service").when(exports, "library").otherwise("unknown")


def project_of(files: DataFrame, found: DataFrame) -> DataFrame:
    """files: path; found: root, name, type. path, project, root, type: the longest root that holds the path, else its project folder, else root."""
    held = paths.longest_prefix(files.select("path"), found.select("root", F.struct("name", "root", "type").alias("name")))
    folder = F.regexp_extract("path", f"^({'|'.join(PROJECT_FOLDERS)})/([^/]+)", 1)
    name = F.regexp_extract("path", f"^({'|'.join(PROJECT_FOLDERS)})/([^/]+)", 2)
    out = files.select("path").join(held, "path", "left").withColumns({"folder": folder, "own": name})
    by_folder = F.col("folder") != ""
    return out.select(
        "path",
        F.coalesce("project.name", F.when(by_folder, F.col("own")).otherwise("root")).alias("project"),
        F.coalesce("project.root", F.when(by_folder, F.concat_ws("/", "folder", "own")).otherwise("")).alias("root"),
        F.coalesce("project.type", F.when(by_folder, _type_of("folder")).otherwise("unknown")).alias("type"),
    )


def overridden(files: DataFrame, overrides: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """files: path, root, scope, framework. overrides, a configuration's few: project path, scope, framework; the first that fits decides."""
    scope, framework = F.col("scope"), F.col("framework")
    for where, s, f in reversed(overrides):
        fits = F.startswith("path", F.lit(f"{where}/")) | (F.col("root") == where)
        scope = F.when(fits, F.coalesce(F.lit(s), F.col("scope"))).otherwise(scope)
        framework = F.when(fits, F.coalesce(F.lit(f), F.col("framework"))).otherwise(framework)
    return files.withColumns({"scope": scope, "framework": framework})


@dataclass(frozen=True)
class Convention:
    """A kind of file: fits, a regular expression of the whole path; words it always gives; and words from the path.

    dynamic: a regular expression whose first group gives words; without: words that it doesn't give; unless: paths that don't fit.
    """

    id: str
    category: str
    fits: str
    words: list[str]
    dynamic: str | None = None
    without: tuple[str, ...] = ()
    unless: str | None = None


_JS = "(ts|tsx|js|jsx|mjs|cjs)"
_PARENT = r"(?:^|/)([^/]+)/[^/]+$"
_PLAIN = ("src", "lib", ".", "")

# Kinds of files. A configuration's further kinds are a parameter.
CONVENTIONS = [
    Convention("index-file", "entry-point", rf"(^|/)index\.{_JS}$", ["entry", "barrel", "exports", "module"], _PARENT, ("src", "lib", "dist", "build", ".", "")),
    Convention("main-file", "entry-point", rf"(^|/)main\.{_JS}$", ["entry", "main", "entrypoint", "bootstrap", "startup"]),
    Convention("app-component", "entry-point", r"(^|/)App\.(tsx|jsx|vue|svelte)$", ["root", "app", "application", "component", "main"]),
    Convention("deno-mod", "entry-point", r"(^|/)mod\.ts$", ["entry", "module", "deno", "exports"], _PARENT, _PLAIN),
    Convention("python-init", "entry-point", r"(^|/)__init__\.py$", ["entry", "package", "init", "python", "module"], _PARENT, _PLAIN),
    Convention("rust-lib", "entry-point", r"(^|/)(lib|main)\.rs$", ["entry", "crate", "rust", "module"]),
    Convention("go-main", "entry-point", r"(^|/)main\.go$", ["entry", "main", "go", "golang", "entrypoint"], _PARENT, ("cmd", "src", ".", "")),
    Convention("python-main", "entry-point", r"(^|/)__main__\.py$", ["entry", "main", "python", "entrypoint", "cli"], _PARENT, _PLAIN),
    Convention("python-app", "entry-point", r"(^|/)(app|main|run)\.py$", ["entry", "main", "python", "app", "entrypoint"]),
    Convention("python-manage", "entry-point", r"(^|/)manage\.py$", ["entry", "django", "python", "manage", "cli", "admin"]),
    Convention("python-wsgi", "entry-point", r"(^|/)(wsgi|asgi)\.py$", ["entry", "wsgi", "asgi", "python", "server", "web"]),
    Convention("package-json", "configuration", r"(^|/)package\.json$", ["package", "dependencies", "npm", "scripts", "manifest", "node"]),
    Convention("go-mod", "configuration", r"(^|/)go\.mod$", ["go", "golang", "module", "dependencies", "package", "workspace"]),
    Convention("makefile", "build", r"(^|/)(Makefile|makefile|GNUmakefile)$", ["make", "build", "automation", "tasks", "compile"]),
    Convention("requirements-txt", "configuration", r"(^|/)(requirements\.txt|requirements[-_][^/]*)$", ["python", "pip", "dependencies", "packages", "requirements"]),
    Convention("dts-file", "types", r"\.d\.ts$", ["types", "declarations", "typescript", "definitions"]),
    Convention("types-file", "types", r"(\.types\.ts|(^|/)types\.ts)$", ["types", "definitions", "typescript", "interfaces"], r"([^/]+)\.types\.ts$"),
    Convention("types-folder", "types", r"(^|/)types/", ["types", "definitions"]),
    Convention("test-file", "test", r"(\.test\.|\.spec\.|_test\.)[^/]*$", ["test", "spec", "unit test"], r"([^/]+)\.(?:test|spec)\."),
    Convention("test-folder", "test", r"(^|/)(__tests__|test|tests)/", ["test", "testing"]),
]


def conventions(path: Column, table: list[Convention] = CONVENTIONS) -> Column:
    """id, category, words of every convention that a path fits, in the table's order."""
    def told(c: Convention) -> Column:
        fits = path.rlike(c.fits) if c.unless is None else path.rlike(c.fits) & ~path.rlike(c.unless)
        words = F.array(*map(F.lit, c.words))
        if c.dynamic:
            own = F.transform(F.split(F.regexp_extract(path, c.dynamic, 1), "/"), F.lower)
            words = F.concat(words, F.filter(own, lambda w: (F.length(w) > 1) & ~w.isin([*c.without, ""])))
        return F.when(fits, F.struct(F.lit(c.id).alias("id"), F.lit(c.category).alias("category"), words.alias("words")))

    return F.array_compact(F.array(*map(told, table)))


def convention_keywords(path: Column, table: list[Convention] = CONVENTIONS) -> Column:
    return F.array_distinct(F.flatten(F.transform(conventions(path, table), lambda c: c["words"])))


def introspection_keywords(path: Column, project: Column, framework: Column | None = None, table: list[Convention] = CONVENTIONS) -> Column:
    """Words of the file name, project, scope, layer, domain, language, framework, folders and conventions; distinct, in this order."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    parts = F.flatten(F.transform(F.split(name, "[-_.]"), lambda p: F.split(p, "(?=[A-Z])")))
    told = [F.when(project != "root", F.lower(project)), F.nullif(introspection.scope(path, project), F.lit("unknown")), introspection.layer(path), introspection.domain(path), introspection.language(path)]
    told += [framework] if framework is not None else []
    dirs = F.filter(_long(F.transform(paths.folders(path), F.lower)), lambda s: ~s.isin(NO_SEGMENT))
    return F.array_distinct(F.concat(_long(F.transform(parts, F.lower), 2), F.array(F.lower(name)), F.array_compact(F.array(*told)), dirs, convention_keywords(path, table)))
