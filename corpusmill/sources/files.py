"""Sources: trees of files, tables of texts, JSON histories, changed-path lists, ignore lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.model import EXTENSIONS

# Folders that are never read.
PRUNED = ("node_modules", ".git", "dist", "build", "coverage", "vendor")
#: Rows from which files are made that one task takes; where that is more than TASKS tasks, up to four times as many.
ROWS, TASKS = 4096, 64
HISTORY = "timestamp timestamp, score int, errors int, warnings int, info int, suggestions int, filesScanned int, engines array<string>, durationMs double"


def language(ext: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower(ext))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a narrow table dealt by their key, ROWS a task: a few megabytes of keys, one task to read, may be the texts of many tasks.

    Each task writes the source of its projection anew, which for all line rules takes as long as some hundred files, so
    that tasks of a large table take more rows.
    """
    n = -(-rows.count() // ROWS)
    n = min(n, max(TASKS, -(-n // 4)))
    return rows.repartition(n, key) if n > 1 else rows


def as_files(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """path, ext, lang, content (without a byte order mark) of any table of texts; null content is empty.

    Spark guesses the size of made texts, and of lines and tokens cut from them, by their number of columns, and would
    send tables of a corpus through the driver to every executor; so files, and what is read from them, ask for merge
    joins. A table known to be small is marked with F.broadcast, which comes before that.
    """
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)
    clean = F.regexp_replace(F.coalesce(content, F.lit("")), "^\\x{FEFF}", "")
    return rows.select(path.alias("path"), ext.alias("ext"), language(ext).alias("lang"), clean.alias("content")).hint("merge")


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ** over folders, * and ? within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return rf"^{out}\z"


def collect(files: DataFrame, *, langs: list[str] | None = None, include: list[str] | None = None, ignore: list[str] | None = None, exclude: tuple[str, ...] = PRUNED, only: DataFrame | None = None) -> DataFrame:
    """Files of the languages asked for, without excluded folders and ignored globs, of the included globs or paths."""
    out = files
    if only is not None:
        return out.join(only.select("path").distinct(), "path", "left_semi")
    if langs is not None:
        out = out.filter(F.col("lang").isin(langs))
    parts = F.split("path", "/")
    if exclude:
        out = out.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, exclude))))
    for glob in ignore or []:
        out = out.filter(~F.col("path").rlike(glob_regex(glob)))
    if include:
        out = out.filter(F.col("path").rlike("|".join(f"(?:{glob_regex(g)})" for g in include)))
    return out


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """A folder tree as files, with the raw bytes for checks of marks and line ends."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return collect(as_files(rows, F.col("path"), F.decode("content", "UTF-8")), **options)


def byte_order_marks(raw: DataFrame) -> DataFrame:
    """Findings on binary files (path, content) that start with the bytes of a mark."""
    rows = raw.filter(F.hex(F.substring("content", 1, 3)) == "EFBBBF")
    return rows.select("path", F.lit("syntax-deep/bom-present").alias("rule"), F.lit("warning").alias("severity"), F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit("").alias("message"))


def changed(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files whose name, or whose path's end, is that of a changed path."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    keys = paths.select(F.col("path").alias("c_path"), base("path").alias("base")).distinct()
    # The end of a path implies its name, so the name is the join key and the end needs no test of its own.
    return files.withColumn("base", base("path")).join(keys.select("base").distinct(), "base", "left_semi").drop("base")


def language_counts(files: DataFrame) -> DataFrame:
    return files.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n_files"))


def read_history(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Scan records, a JSON object a line; broken lines are skipped; the last ``last`` ones by time."""
    rows = spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)
    return rows if last is None else rows.orderBy(F.desc("timestamp")).limit(last)


def append_history(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(path, kind, name, version) of all dependencies in package manifests."""
    kinds = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    parsed = files.filter(F.col("path").rlike(r"(?:^|/)package\.json\z")).select("path", F.from_json("content", ", ".join(f"{k} map<string,string>" for k in kinds)).alias("m"))

    def entries(kind: str) -> Column:
        own = F.map_entries(F.coalesce(F.col(f"m.{kind}"), F.create_map().cast("map<string,string>")))
        return F.transform(own, lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("version")))

    return parsed.select("path", F.explode(F.concat(*map(entries, kinds))).alias("d")).select("path", "d.kind", "d.name", "d.version")
