"""Renderings of findings: JSON, SARIF, text by file, and rows of other tools read as findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import redact
from corpusmill.model import SEVERITIES
from corpusmill.plans.findings import engine, severity_rank


def as_json(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))


def _level():
    return F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """A row per rule, from its first finding."""
    w = Window.partitionBy("rule").orderBy("path", "line", "col", "message")
    first = findings.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return first.select("rule", _level().alias("level"), F.to_json(F.struct(F.col("rule").alias("id"), F.struct(F.col("message").alias("text")).alias("shortDescription"), F.struct(_level().alias("level")).alias("defaultConfiguration"))).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF 2.1.0 result per finding: written as lines, they are a run's results without a row that holds all."""
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.greatest("col", F.lit(1)).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select("path", "line", "rule", F.to_json(F.struct(F.col("rule").alias("ruleId"), _level().alias("level"), F.struct(redact(F.col("message")).alias("text")).alias("message"), F.array(place).alias("locations"))).alias("json"))


def by_file(findings: DataFrame, most: int = 50) -> DataFrame:
    """path, n, text: the worst ``most`` findings of each file as lines of text (a report's limit)."""
    w = Window.partitionBy("path").orderBy(severity_rank("severity"), "line", "rule", "col", "message")
    rows = findings.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("path"))).filter(F.col("r") <= most)
    line = F.concat(F.lit("  "), F.col("line").cast("string"), F.lit(" "), F.col("severity"), F.lit(" "), F.col("rule"))
    return rows.groupBy("path").agg(F.first("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def by_rule(findings: DataFrame, places: int = 3) -> DataFrame:
    """engine, rule, n, worst (severity), places: findings by engine and rule, with the first places of each."""
    by = findings.groupBy("rule").agg(F.count("*").alias("n"), F.min(severity_rank("severity")).alias("rank"))
    w = Window.partitionBy("rule").orderBy("path", "line", "col", "message")
    at = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"))
    first = findings.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= places).groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", at.alias("at")))), lambda x: x["at"]), "\n").alias("places"))
    worst = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.least(F.col("rank"), F.lit(len(SEVERITIES) - 1)).cast("int") + 1)
    return by.join(first, "rule").select(engine("rule").alias("engine"), "rule", "n", worst.alias("worst"), "places")


def agent_prompt(findings: DataFrame) -> DataFrame:
    """path, n, text: the findings of each file as a task list for a coding agent, secrets masked; files in order."""
    line = F.concat(F.lit("- Line "), F.col("line").cast("string"), F.lit(": ["), F.upper("severity"), F.lit("] "), F.col("rule"), F.lit("\n  "), redact(F.coalesce("message", F.lit(""))))
    by = findings.groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "rule", "col", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return by.select("path", "n", F.concat(F.lit("## "), F.col("path"), F.lit("\n"), F.col("text")).alias("text")).orderBy("path")


def lsp(findings: DataFrame) -> DataFrame:
    """Ranges from 0, severities from 1."""
    return findings.select("path", "rule", F.greatest(F.col("line") - 1, F.lit(0)).alias("start_line"), F.greatest(F.col("col") - 1, F.lit(0)).alias("start_char"), (severity_rank("severity") + 1).alias("severity"))


# ---- output of other tools, a JSON document a row in column json

def ruff(rows: DataFrame) -> DataFrame:
    one = "array<struct<code:string,message:string,filename:string,location:struct<row:int,column:int>>>"
    d = rows.select(F.explode(F.from_json("json", one)).alias("d"))
    return _tool(d, F.col("d.filename"), F.concat(F.lit("lint-external/ruff/"), F.col("d.code")), F.when(F.col("d.code").rlike("^(?:E9|F)"), "error").otherwise("warning"), F.col("d.location.row"), F.col("d.location.column"), F.col("d.message"))


def golangci(rows: DataFrame) -> DataFrame:
    one = "struct<Issues:array<struct<FromLinter:string,Text:string,Severity:string,Pos:struct<Filename:string,Line:int,Column:int>>>>"
    d = rows.select(F.explode(F.from_json("json", one)["Issues"]).alias("d"))
    return _tool(d, F.col("d.Pos.Filename"), F.concat(F.lit("lint-external/golangci/"), F.col("d.FromLinter")), F.when(F.col("d.Severity") == "error", "error").otherwise("warning"), F.col("d.Pos.Line"), F.col("d.Pos.Column"), F.col("d.Text"))


def clippy(rows: DataFrame) -> DataFrame:
    one = "struct<reason:string,message:struct<message:string,level:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:int,column_start:int,is_primary:boolean>>>>"
    d = rows.select(F.from_json("json", one).alias("d")).filter("d.reason = 'compiler-message' AND d.message.code.code IS NOT NULL").withColumn("s", F.element_at(F.filter("d.message.spans", lambda s: s["is_primary"]), 1))
    return _tool(d, F.col("s.file_name"), F.concat(F.lit("lint-external/clippy/"), F.regexp_replace("d.message.code.code", "^clippy::", "")), F.when(F.col("d.message.level") == "error", "error").otherwise("warning"), F.col("s.line_start"), F.col("s.column_start"), F.col("d.message.message"))


def npm_audit(rows: DataFrame) -> DataFrame:
    one = "struct<vulnerabilities:map<string,struct<name:string,severity:string,range:string>>>"
    d = rows.select(F.explode(F.map_values(F.from_json("json", one)["vulnerabilities"])).alias("d"))
    severity = F.when(F.col("d.severity").isin("critical", "high"), "error").when(F.col("d.severity") == "moderate", "warning").otherwise("info")
    return _tool(d, F.lit("package.json"), F.lit("security-deep/dependency-vulnerability"), severity, F.lit(1), F.lit(1), F.concat_ws(" ", "d.name", "d.range"))


def pip_audit(rows: DataFrame) -> DataFrame:
    one = "struct<dependencies:array<struct<name:string,version:string,vulns:array<struct<id:string,fix_versions:array<string>>>>>>"
    d = rows.select(F.explode(F.from_json("json", one)["dependencies"]).alias("p")).select("p.name", F.explode("p.vulns").alias("v"))
    return _vulnerable(d, "requirements.txt", F.lit("error"), F.concat_ws(" ", "name", "v.id"))


def cargo_audit(rows: DataFrame) -> DataFrame:
    one = "struct<vulnerabilities:struct<list:array<struct<advisory:struct<id:string,title:string>,package:struct<name:string,version:string>>>>>"
    d = rows.select(F.explode(F.from_json("json", one)["vulnerabilities"]["list"]).alias("v"))
    return _vulnerable(d, "Cargo.toml", F.lit("error"), F.concat_ws(" ", "v.package.name", "v.advisory.id"))


def govulncheck(rows: DataFrame) -> DataFrame:
    """A JSON object a line; those with a finding count."""
    d = rows.select(F.from_json("json", "struct<finding:struct<osv:string,fixed_version:string>>")["finding"].alias("v")).filter("v.osv IS NOT NULL").distinct()
    return _vulnerable(d, "go.mod", F.lit("error"), F.col("v.osv"))


def _vulnerable(d: DataFrame, path: str, severity, message) -> DataFrame:
    return _tool(d, F.lit(path), F.lit("security-deep/dependency-vulnerability"), severity, F.lit(1), F.lit(1), message)


#: The sections of a report on unused code, each a map of file to symbols.
UNUSED_SECTIONS = ("files", "dependencies", "exports", "types", "classMembers", "enumMembers")


def knip(rows: DataFrame) -> DataFrame:
    """Unused files, dependencies, exports, types, class and enum members: a finding for each symbol of a section.

    Sections are maps of file to symbols; the tool's other form, a list of files and one of issues, is read too.
    """
    one = "struct<" + ",".join(f"{s}:map<string,array<string>>" for s in UNUSED_SECTIONS) + ">"
    d = rows.filter(~F.col("json").rlike(r'"files"\s*:\s*\[') & ~F.contains("json", F.lit('"issues"'))).select(F.from_json("json", one).alias("d"))
    found = [_tool(d.select(F.explode(f"d.{s}").alias("path", "symbols")).select("path", F.explode("symbols").alias("x")), F.col("path"), F.lit(f"knip/{s}"), F.lit("warning"), F.lit(1), F.lit(1), F.col("x")) for s in UNUSED_SECTIONS]
    place = "array<struct<name:string,line:int,col:int>>"
    listed = "struct<files:array<string>,issues:array<struct<file:string," + ",".join(f"{s}:{place}" for s in UNUSED_SECTIONS[1:4]) + "," + ",".join(f"{s}:map<string,{place}>" for s in UNUSED_SECTIONS[4:]) + ">>>"
    d = rows.filter(F.col("json").rlike(r'"files"\s*:\s*\[') | F.contains("json", F.lit('"issues"'))).select(F.from_json("json", listed).alias("d"))
    found.append(_tool(d.select(F.explode("d.files").alias("f")), F.col("f"), F.lit("knip/files"), F.lit("warning"), F.lit(1), F.lit(1), F.lit("")))
    issues = d.select(F.explode("d.issues").alias("i"))
    for s in UNUSED_SECTIONS[1:]:  # members stand by the class or enum that has them
        own = F.col(f"i.{s}") if s in UNUSED_SECTIONS[:4] else F.flatten(F.map_values(f"i.{s}"))
        rows_ = issues.select("i.file", F.explode(own).alias("x"))
        found.append(_tool(rows_, F.col("file"), F.lit(f"knip/{s}"), F.lit("warning"), F.coalesce("x.line", F.lit(1)), F.coalesce("x.col", F.lit(1)), F.col("x.name")))
    return reduce(DataFrame.unionByName, found)


def _tool(d: DataFrame, path, rule, severity, line, col, message) -> DataFrame:
    return d.select(path.alias("path"), rule.alias("rule"), severity.alias("severity"), line.cast("int").alias("line"), col.cast("int").alias("col"), message.alias("message"))


def dependency_audit(dependencies: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Manifest rules over (path, kind, name, version): unpinned, in two sections, deprecated, behind the latest."""
    # Packages that have been given up.
    deprecated = ("babel-eslint", "eslint-plugin-babel", "node-sass", "request", "request-promise", "left-pad", "buffer", "mkdirp", "rimraf", "har-validator", "npmconf", "glob")
    by_version = {"core-js": "2"}
    row = lambda df, rule, severity: df.select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.col("name").alias("message"))
    given_up = F.col("name").isin(*deprecated)
    for name, version in by_version.items():
        given_up |= (F.col("name") == name) & F.startswith("version", F.lit(version))
    out = row(dependencies.filter(F.col("version").rlike(r"^(?:\*|latest|x|>=?)")), "dep-audit/unpinned", "warning")
    twice = dependencies.filter(F.col("kind").isin("dependencies", "devDependencies")).groupBy("path", "name").agg(F.countDistinct("kind").alias("k")).filter("k > 1")
    peer = dependencies.groupBy("path", "name").agg(F.bool_or(F.col("kind") == "peerDependencies").alias("p"), F.bool_or(F.col("kind") == "dependencies").alias("d")).filter("p AND d")
    out = out.unionByName(row(twice, "dep-audit/cross-listed", "warning")).unionByName(row(peer, "dep-audit/peer-in-deps", "warning")).unionByName(row(dependencies.filter(F.col("kind").isin("dependencies", "devDependencies") & given_up).select("path", "name").distinct(), "dep-audit/deprecated", "warning"))
    if latest is not None:
        part = lambda c, n: F.regexp_extract(c, r"(\d+)\.(\d+)", n).try_cast("int")
        both = dependencies.join(latest.select("name", F.col("version").alias("new")), "name").withColumn("major", part("new", 1) > part("version", 1)).withColumn("minor", (part("new", 1) == part("version", 1)) & (part("new", 2) > part("version", 2)))
        out = out.unionByName(row(both.filter("major"), "dep-audit/major-outdated", "warning")).unionByName(row(both.filter("minor"), "dep-audit/minor-outdated", "info"))
    return out


def manifest_audit(files: DataFrame) -> DataFrame:
    """Manifests that name no engine of theirs, and those beside no lock file."""
    # Files that lock versions.
    locks = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb")
    own = files.filter(F.col("path").rlike(r"(?:^|/)package\.json\z")).withColumn("d", F.from_json("content", "struct<engines:map<string,string>>"))
    folder = F.regexp_replace("path", r"[^/]*\z", "")
    locked = files.filter(F.regexp_extract("path", r"([^/]*)\z", 1).isin(*locks)).select(folder.alias("folder")).distinct()
    row = lambda df, rule, severity: df.select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit("").alias("message"))
    bare = own.filter(F.coalesce(F.try_element_at("d.engines", F.lit("node")), F.lit("")) == "")
    needs = own.withColumn("folder", folder)
    return row(bare, "dep-audit/missing-engines", "info").unionByName(row(needs.join(locked, "folder", "left_anti"), "dep-audit/missing-lockfile", "error"))
