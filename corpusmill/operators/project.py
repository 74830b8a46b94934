"""Project probes: frameworks, tools, configuration files and locale files, found by name and read as JSON."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import matches
from corpusmill.operators.context_rules import _found
from corpusmill.sources.files import language_counts, manifest_dependencies

# What shows a framework, a tool or a service: (kind, name, dependency or '', file pattern or '').
SIGNS = [
    ("framework", "nextjs", "next", ""), ("framework", "react", "react", ""), ("framework", "vue", "vue", ""), ("framework", "svelte", "svelte", ""),
    ("framework", "angular", "@angular/core", ""), ("framework", "express", "express", ""), ("framework", "nestjs", "@nestjs/core", ""), ("framework", "tailwind", "tailwindcss", ""),
    ("framework", "django", "", r"(?:^|/)manage\.py\z"), ("framework", "vite", "vite", ""),
    ("package-manager", "npm", "", r"(?:^|/)package-lock\.json\z"), ("package-manager", "pnpm", "", r"(?:^|/)pnpm-lock\.yaml\z"), ("package-manager", "yarn", "", r"(?:^|/)yarn\.lock\z"),
    ("package-manager", "cargo", "", r"(?:^|/)Cargo\.lock\z"), ("package-manager", "go", "", r"(?:^|/)go\.sum\z"), ("package-manager", "poetry", "", r"(?:^|/)poetry\.lock\z"),
    ("linter", "eslint", "eslint", r"(?:^|/)(?:\.eslintrc[^/]*|eslint\.config\.[cm]?js)\z"), ("linter", "biome", "@biomejs/biome", r"(?:^|/)biome\.json\z"), ("linter", "ruff", "", r"(?:^|/)ruff\.toml\z"), ("formatter", "prettier", "prettier", r"(?:^|/)(?:\.prettierrc[^/]*|prettier\.config\.[cm]?js)\z"),
    ("test", "vitest", "vitest", ""), ("test", "jest", "jest", ""), ("test", "pytest", "", r"(?:^|/)(?:pytest\.ini|conftest\.py)\z"),
    ("ci", "github-actions", "", r"(?:^|/)\.github/workflows/[^/]+\.ya?ml\z"), ("ci", "gitlab", "", r"(?:^|/)\.gitlab-ci\.yml\z"),
]


def detect(files: DataFrame) -> DataFrame:
    """kind, name of all frameworks, package managers, linters, formatters, test tools and services in use."""
    spark = files.sparkSession
    deps = manifest_dependencies(files).select(F.col("name").alias("dep")).distinct()
    by_dep = F.broadcast(spark.createDataFrame([(k, n, d) for k, n, d, _ in SIGNS if d], "kind string, name string, dep string"))
    out = deps.join(by_dep, "dep").select("kind", "name")
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"))) for k, n, _, p in SIGNS if p]))
    return out.unionByName(files.select(F.explode(hits).alias("h")).select("h.kind", "h.name")).distinct()


def info(files: DataFrame) -> DataFrame:
    """One relation of everything a project shows: kind, name, n."""
    langs = language_counts(files).select(F.lit("language").alias("kind"), F.col("lang").alias("name"), F.col("n_files").cast("long").alias("n"))
    return langs.unionByName(detect(files).withColumn("n", F.lit(1).cast("long")))


def config_lint(files: DataFrame) -> DataFrame:
    """Findings on configuration files; a file that should be there and is not is found at the manifest."""
    at = lambda pattern: files.filter(F.col("path").rlike(pattern)).withColumn("num", F.lit(1))
    manifest = at(r"(?:^|/)package\.json\z")
    ts = at(r"(?:^|/)tsconfig\.json\z").withColumn("o", F.from_json(F.regexp_replace("content", r"(?m)^\s*//.*$", ""), "struct<compilerOptions:struct<strict:boolean,target:string>>")["compilerOptions"])
    out = _found(ts.filter(~F.coalesce("o.strict", F.lit(False))), "config-lint/tsconfig-strict", "warning")
    out = out.unionByName(_found(ts.filter(F.lower("o.target").isin("es3", "es5", "es6", "es2015", "es2016", "es2017")), "config-lint/tsconfig-target", "info", F.col("o.target")))

    def missing(pattern: str, rule: str):
        there = files.filter(F.col("path").rlike(pattern)).limit(1).select(F.lit(1).alias("one"))
        return _found(manifest.withColumn("one", F.lit(1)).join(there, "one", "left_anti"), rule, "info")

    out = out.unionByName(missing(r"(?:^|/)(?:\.eslintrc[^/]*|eslint\.config\.[cm]?[jt]s)\z", "config-lint/missing-eslint"))
    out = out.unionByName(missing(r"(?:^|/)(?:\.prettierrc[^/]*|prettier\.config\.[cm]?[jt]s)\z", "config-lint/missing-prettier"))
    out = out.unionByName(missing(r"(?:^|/)\.editorconfig\z", "config-lint/missing-editorconfig"))
    scripts = F.map_keys(F.coalesce(F.from_json("content", "struct<scripts:map<string,string>>")["scripts"], F.create_map().cast("map<string,string>")))
    lacks = manifest.withColumn("lacks", F.array_except(F.array(*map(F.lit, ("build", "test", "lint"))), scripts)).filter("size(lacks) > 0")
    out = out.unionByName(_found(lacks, "config-lint/package-json-scripts", "info", F.array_join("lacks", ",")))
    vite = at(r"(?:^|/)vite\.config\.[cm]?[jt]s\z")
    out = out.unionByName(_found(vite.filter(~matches(F.col("content"), r"sourcemap\s*:")), "config-lint/vite-config", "info"))
    nxt = at(r"(?:^|/)next\.config\.[cm]?[jt]s\z")
    return out.unionByName(_found(nxt.filter(~matches(F.col("content"), r"reactStrictMode\s*:\s*true")), "config-lint/next-config", "info"))


def _nesting(json: Column) -> Column:
    """How deep the braces of a JSON text nest, those in strings aside."""
    marks = F.regexp_extract_all(F.regexp_replace(json, r'"(?:\\.|[^"\\])*+"', ""), F.lit("[{}]"), F.lit(0))
    step = lambda acc, m: F.struct((acc["now"] + F.when(m == "{", 1).otherwise(-1)).alias("now"), F.greatest(acc["most"], acc["now"] + F.when(m == "{", 1).otherwise(0)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def locale_keys(files: DataFrame, folders: str = r"(?:^|/)(?:locales?|i18n|messages|lang|translations)/(?:.*/)?([A-Za-z]{2}(?:-[A-Za-z]{2})?)\.json\z") -> DataFrame:
    """locale, name (joined with dots) of all leaves of locale files, however deep they stand.

    Values are variants, so that a text that looks like an object is a text. Each level replaces an object by its
    entries and keeps leaves; there are as many levels as the deepest file has, which is one number that a first look
    at the files gives. Broken files and empty objects have no keys; what is no object is a leaf, lists too.
    """
    rows = files.withColumn("locale", F.regexp_extract("path", folders, 1)).filter("locale <> ''")
    deepest = rows.agg(F.max(_nesting(F.col("content"))).alias("n")).first().n or 0
    level = rows.select("locale", F.lit("").alias("name"), F.try_parse_json("content").alias("v")).filter("schema_of_variant(v) LIKE 'OBJECT%'")
    for _ in range(deepest):
        entry = "struct(if(name = '', e.key, concat(name, '.', e.key)) AS name, e.value AS v)"
        inner = f"CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN transform(map_entries(cast(v AS map<string, variant>)), e -> {entry}) ELSE array(struct(name, v)) END"
        level = level.select("locale", F.explode(F.expr(inner)).alias("x")).select("locale", "x.name", "x.v")
    return level.filter("name <> ''").select("locale", "name").distinct()


def deep_merge(base: dict, over: dict) -> dict:
    """Configuration of two sources: maps merge, all else of ``over`` wins."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


# The default configuration, and named ones that extend it.
DEFAULTS = {
    "quality": {"maxFunctionLoc": 50, "maxFileLoc": 300, "maxNesting": 4, "maxParams": 5, "maxCyclomatic": 10, "maxCoupling": 10},
    "imports": {"maxCircularDepth": 5}, "ci": {"failBelow": 70, "failOnErrors": True}, "scoring": {"smoothing": 20000, "maxPerRule": 5, "mode": "logarithmic"}, "rules": {},
}
PRESETS = {"strict": {"ci": {"failBelow": 85}, "quality": {"maxNesting": 3}}, "relaxed": {"ci": {"failBelow": 50, "failOnErrors": False}}, "recommended": {}}


def config(own: dict | None = None) -> dict:
    """The default configuration with the presets that ``own`` extends and its own values, checked by kind."""
    own = own or {}
    out = DEFAULTS
    names = own.get("extends", [])
    for name in [names] if isinstance(names, str) else names:
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name}")
        out = deep_merge(out, PRESETS[name])
    out = deep_merge(out, {k: v for k, v in own.items() if k != "extends"})
    for section, values in DEFAULTS.items():
        for key, value in values.items():
            got = out[section][key]
            if isinstance(value, bool) != isinstance(got, bool) or (isinstance(value, int | float) and not isinstance(got, int | float)):
                raise ValueError(f"{section}.{key} has the wrong kind")
    return out


#: Where a configuration stands in a folder or one above it, in this order.
CONFIG_FILES = (".lint/config.yml", ".lint/config.yaml", ".lint/config.json")


def find_config(start: str) -> Path | None:
    """The first configuration file in a folder of the driver's file system, or in the nearest folder above it."""
    folder = Path(start).resolve()
    for place in (folder, *folder.parents):
        for name in CONFIG_FILES:
            if (place / name).is_file():
                return place / name
    return None


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    for word, value in (("true", True), ("false", False), ("null", None), ("~", None), ("", None)):
        if text.lower() == word:
            return value
    try:
        return float(text) if re.search(r"[.eE]", text) else int(text)
    except ValueError:
        return text


def parse_yaml(text: str) -> dict:
    """Nested maps, lists of scalars and scalars, which is all that a configuration holds; else ValueError."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(?:^|\s)#.*$", "", line) for line in text.split("\n")) if x.strip() and x.strip() != "---"]
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    for n, (indent, row) in enumerate(rows):
        while stack[-1][0] >= indent:
            stack.pop()
        if isinstance(stack[-1][1], list) and not row.startswith("- "):
            stack.pop()  # a list at the indent of its key is over
        own = stack[-1][1]
        if row.startswith("- ") and isinstance(own, list):
            own.append(_scalar(row[2:]))
            continue
        m = re.match(r"""(?:"([^"]+)"|'([^']+)'|([^:\s][^:]*?))\s*:(?:\s+(.*))?$""", row)
        if not m or not isinstance(own, dict):
            raise ValueError(f"no configuration: {row}")
        key, value = m[1] or m[2] or m[3], m[4]
        below = rows[n + 1] if n + 1 < len(rows) else (0, "")
        if not value and (below[0] > indent or (below[0] == indent and below[1].startswith("- "))):
            own[key] = [] if below[1].startswith("- ") else {}
            stack.append((indent - 1 if below[0] == indent else indent, own[key]))
        else:
            own[key] = _scalar(value or "")
    return root


def read_config(path: Path | str, seen: tuple[Path, ...] = ()) -> dict:
    """A configuration file with the files that it extends, the nearest winning; presets are left to ``config``."""
    path = Path(path).resolve()
    if path in seen:
        raise ValueError(f"{path} extends itself")
    text = path.read_text()
    own = (json.loads(text) if path.suffix == ".json" else parse_yaml(text)) or {}
    base = own.get("extends")
    if isinstance(base, str) and (base.startswith((".", "/")) or base.endswith((".yml", ".yaml", ".json"))):
        parent = path.parent / base
        if not parent.is_file():
            raise ValueError(f"{path} extends {base}, which is no file")
        return deep_merge(read_config(parent, (*seen, path)), {k: v for k, v in own.items() if k != "extends"})
    return own


def load_config(start: str) -> dict:
    """The configuration of a project: its file's, or that of a folder above, with all it extends, over the defaults."""
    path = find_config(start)
    return config(read_config(path)) if path else config()


# Modules that come with the runtime.
BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector",
    "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm",
    "wasi", "worker_threads", "zlib",
)


def declared(files: DataFrame) -> DataFrame:
    """name: what manifests, requirements and Python projects declare, and what comes with the runtime."""
    npm = manifest_dependencies(files).select("name")
    line = F.trim(F.col("line"))
    pip = files.filter(F.col("path").rlike(r"(?:^|/)requirements\.txt\z")).select(F.explode(F.split("content", "\n")).alias("line")).filter(~line.rlike(r"^(?:#|\z)")).select(F.trim(F.regexp_extract(line, r"^[^=<>!\[]*", 0)).alias("name"))
    toml = files.filter(F.col("path").rlike(r"(?:^|/)pyproject\.toml\z")).select(F.explode(F.split("content", "\n")).alias("line")).select(F.regexp_extract(line, r'^"?([a-zA-Z0-9_-]+)"?\s*[=<>]', 1).alias("name"))
    own = files.sparkSession.createDataFrame([(x,) for x in BUILTINS], "name string")
    return npm.unionByName(pip).unionByName(toml).unionByName(own).filter("name <> ''").distinct()


def alias_names(files: DataFrame) -> DataFrame:
    """name: what a compiler's configuration maps to own folders, without the star at its end."""
    text = F.regexp_replace("content", r"(?m)^\s*//.*$", "")
    paths = files.filter(F.col("path").rlike(r"(?:^|/)[jt]sconfig[^/]*\.json\z")).select(F.from_json(text, "struct<compilerOptions:struct<paths:map<string,array<string>>>>")["compilerOptions"]["paths"].alias("p"))
    return paths.filter("p IS NOT NULL").select(F.explode(F.map_keys("p")).alias("key")).select(F.regexp_replace("key", r"/?\*\z", "").alias("name")).filter("name <> ''").distinct()


def missing_config(files: DataFrame, name: str = ".lint/config.yml") -> DataFrame:
    """One finding if a project has no configuration of its own."""
    has = files.filter(F.col("path").rlike(r"(?:^|/)" + name.replace(".", r"\.") + r"\z")).limit(1)
    one = files.sparkSession.createDataFrame([(name.split("/")[0], "meta-quality/missing-config", "info", 1, 1, name)], "path string, rule string, severity string, line int, col int, message string")
    return one.join(has.select(F.lit(1).alias("one")), F.lit(True), "left_anti")
