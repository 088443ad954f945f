"""What a path and a text tell of a file: language, layer, domain, scope, framework; and the boost they give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.keywords import extension

# Extensions of each language.
LANGUAGES = {
    "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "python": [".py"], "go": [".go"],
    "rust": [".rs"], "java": [".java"], "kotlin": [".kt"], "swift": [".swift"], "ruby": [".rb"], "php": [".php"],
    "csharp": [".cs"], "cpp": [".cpp", ".hpp"], "c": [".c", ".h"], "markdown": [".md"], "json": [".json"],
    "yaml": [".yaml", ".yml"], "text": [".txt"],
}

# Layers in order, with their words.
LAYERS = {
    "controller": ["controller", "api", "routes", "route", "handler"],
    "service": ["service", "logic", "usecase", "usecases", "handler"],
    "repository": ["repository", "repo", "dao", "store", "persistence"],
    "model": ["model", "models", "entity", "entities", "schema", "schemas", "types", "type"],
    "util": ["util", "utils", "helper", "helpers", "common", "lib"],
    "config": ["config", "configuration", "settings"],
    "middleware": ["middleware", "middlewares"],
    "domain": ["domain"],
    "infrastructure": ["infrastructure", "infra"],
    "application": ["application", "app"],
    "presentation": ["presentation", "ui", "views", "view", "component", "components"],
    "test": ["test", "tests", "spec", "specs", "__tests__", "e2e"],
}

# Feature areas in order, and folders that name none.
DOMAINS = (
    "auth authentication user users account accounts profile profiles product products item items catalog order orders"
    " cart checkout payment payments billing subscription subscriptions notification notifications email sms report reports"
    " analytics metrics dashboard admin settings search chat message messages feed post posts comment comments media upload"
    " file files storage cache session log logs audit"
).split()
NO_DOMAIN = ["src", "lib", "app", "apps", "packages", "services", "modules", "features", *(w for ws in LAYERS.values() for w in ws)]

# What a project's name tells of its scope, what a layer tells, and what folders tell.
SCOPE_NAMES = {
    "frontend": "web webapp frontend client ui app mobile react vue angular next nuxt".split(),
    "backend": "api server backend service worker lambda functions".split(),
    "shared": "shared common utils lib core types models".split(),
    "tooling": "scripts tools cli devtools build config infra".split(),
}
SCOPE_LAYERS = {"backend": ["controller", "repository", "middleware"], "frontend": ["presentation"], "shared": ["util", "model"], "tooling": ["test"]}
SCOPE_FOLDERS = {"backend": ["server", "api", "backend"], "frontend": ["client", "web", "frontend", "ui"], "shared": ["shared", "common", "lib", "libs"]}

# Packages whose import tells the framework.
FRAMEWORKS = {"nextjs": "next", "express": "express", "fastify": "fastify", "react": "react", "vue": "vue", "angular": "@angular/", "nestjs": "@nestjs/", "koa": "koa"}

# Query words that go with a scope.
SCOPE_TERMS = {"backend": ["api", "server", "backend", "endpoint", "route"], "frontend": ["ui", "component", "page", "view", "frontend", "client"]}


def _first(cases: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for fits, value in reversed(cases):
        out = F.when(fits, F.lit(value)).otherwise(out)
    return out


def segments(path: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), ""), F.lower)


def language(path: Column) -> Column:
    ext = extension(path)
    return _first([(ext.isin(exts), name) for name, exts in LANGUAGES.items()])


def layer(path: Column) -> Column:
    """By a word in the file name, else by the innermost folder that is a layer's word."""
    parts = segments(path)
    name = F.element_at(parts, -1)
    by_name = _first([(name.rlike("|".join(words)), key) for key, words in LAYERS.items()])
    told = F.transform(F.reverse(F.slice(parts, 1, F.size(parts) - 1)), lambda s: _first([(s.isin(words), key) for key, words in LAYERS.items()]))
    return F.coalesce(by_name, F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0)))


def domain(path: Column) -> Column:
    """The first part of the path that is, or starts or ends with, a feature area."""
    def area(s: Column) -> Column:
        near = _first([(F.startswith(s, F.lit(d)) | F.endswith(s, F.lit(d)), d) for d in DOMAINS])
        return F.when(s.isin(NO_DOMAIN), None).when(s.isin(DOMAINS), s).otherwise(near)

    return F.get(F.filter(F.transform(segments(path), area), lambda x: x.isNotNull()), F.lit(0))


def scope(path: Column, project: Column) -> Column:
    """By the project's name, else by the layer, else by the first telling part of the path."""
    by_name = _first([(F.lower(project).rlike("|".join(words)), key) for key, words in SCOPE_NAMES.items()])
    by_layer = _first([(layer(path).isin(words), key) for key, words in SCOPE_LAYERS.items()])
    told = F.transform(segments(path), lambda s: _first([(s.isin(words), key) for key, words in SCOPE_FOLDERS.items()]))
    return F.coalesce(by_name, by_layer, F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0)), F.lit("unknown"))


def framework(content: Column) -> Column:
    """By the first framework whose package is imported or required."""
    return _first([(content.rlike(f"(?:from |require\\()['\"]{package}"), name) for name, package in FRAMEWORKS.items()])


def boost(path: Column, project: Column, terms: list[str]) -> Column:
    """x 1.1 for the domain, 1.05 for the layer, the scope and the project, 1.03 for every folder with a query term."""
    def near(c: Column, both: bool) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(c, F.lit(t)) | (F.contains(F.lit(t), c) if both else F.lit(False))
        return F.coalesce(out, F.lit(False))

    own, parts = scope(path, project), segments(path)
    scopes = [s for s, words in SCOPE_TERMS.items() if set(words) & set(terms)]
    out = F.when(near(domain(path), True), 1.1).otherwise(1.0) * F.when(near(layer(path), True), 1.05).otherwise(1.0)
    if scopes:
        out = out * F.when(own.isin(scopes), 1.05).otherwise(1.0)
    hits = F.size(F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: near(s, False)))
    named = (project != "root") & near(F.lower(project), False)
    return out * F.pow(F.lit(1.03), hits) * F.when(named, 1.05).otherwise(1.0)
