"""Base relations over files: lines, imports, exports, strings, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import extract, java, trim_all

IMPORT_TS = r"^\s*import\s+(?:type\s+)?(?:[^'\"]*\s+from\s+)['\"]([^'\"]+)['\"]"
IMPORT_CALL = r"\b(?:require|import)\s*\(\s*['\"]([^'\"]+)['\"]"
IMPORT_PY = r"^\s*(?:from\s+(\S+)\s+import\b|import\s+([A-Za-z0-9_.]+))"
EXPORT = r"^export\s+(?:default\s+)?(?:async\s+)?(?:function|const|let|var|class|enum|interface|type)\s+(\w+)"


def lines(files: DataFrame) -> DataFrame:
    """path, lang, num (from 1), text; trailing empty lines are kept."""
    return files.select("path", "lang", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text")).select("path", "lang", (F.col("pos") + 1).alias("num"), "text")


def imports(all_lines: DataFrame) -> DataFrame:
    """path, num, source, symbols (of braces, by their local names), type_only."""
    text = F.col("text")
    js = F.coalesce(F.nullif(extract(text, IMPORT_TS, 1), F.lit("")), F.nullif(extract(text, IMPORT_CALL, 1), F.lit("")))
    py = F.coalesce(F.nullif(extract(text, IMPORT_PY, 1), F.lit("")), F.nullif(extract(text, IMPORT_PY, 2), F.lit("")))
    source = F.when(F.col("lang").isin("typescript", "javascript"), js).when(F.col("lang") == "python", py)
    braces = extract(text, r"\{([^}]*)\}", 1)
    local = F.transform(F.split(braces, ","), lambda s: F.element_at(F.split(trim_all(F.regexp_replace(s, r"^\s*type\s+", "")), r"\s+as\s+"), -1))
    named = F.nullif(extract(text, r"^\s*import\s+(?:type\s+)?(?:\*\s+as\s+)?(\w+)\s*(?:,\s*\{[^}]*\}\s*)?from\b", 1), F.lit(""))
    symbols = F.filter(F.concat(F.array(F.coalesce(named, F.lit(""))), F.when(text.rlike(java(r"^\s*import\b")), local).otherwise(F.array().cast("array<string>"))), lambda s: s != "")
    return all_lines.withColumn("source", source).filter("source IS NOT NULL").select("path", "lang", "num", "source", symbols.alias("symbols"), text.rlike(r"^\s*import\s+type\s").alias("type_only"))


def go_imports(all_lines: DataFrame) -> DataFrame:
    """path, num, source, name (the local one, or the last part of the path) of Go imports, alone or in a block."""
    go = all_lines.filter("lang = 'go'")
    w = Window.partitionBy("path").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    edge = F.when(go["text"].rlike(r"^\s*import\s*\("), True).when(go["text"].rlike(r"^\s*\)"), False)
    rows = go.withColumn("inside", F.coalesce(F.last(edge, ignorenulls=True).over(w), F.lit(False)))
    alone, listed = r"^\s*import\s+(?:([\w.]+)\s+)?\"([^\"]+)\"", r"^\s*(?:([\w.]+)\s+)?\"([^\"]+)\""
    part = lambda n: F.when(F.col("inside"), extract(F.col("text"), listed, n)).otherwise(extract(F.col("text"), alone, n))
    rows = rows.withColumn("source", part(2)).withColumn("given", part(1)).filter("source <> ''")
    return rows.select("path", "num", "source", F.when(F.col("given") != "", F.col("given")).otherwise(F.element_at(F.split("source", "/"), -1)).alias("name"))


def exports(all_lines: DataFrame) -> DataFrame:
    name = extract(F.col("text"), EXPORT, 1)
    return all_lines.filter(F.col("lang").isin("typescript", "javascript")).withColumn("name", name).filter("name <> ''").select("path", "num", "name")


def words(all_lines: DataFrame) -> DataFrame:
    """path, num, word, for each identifier."""
    return all_lines.select("path", "num", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("word"))


def strings(all_lines: DataFrame, least: int = 8) -> DataFrame:
    """path, num, value of quoted literals of ``least`` characters or more."""
    quoted = F.concat(F.regexp_extract_all("text", F.lit(r"'([^'\n]*)'"), 1), F.regexp_extract_all("text", F.lit(r'"([^"\n]*)"'), 1))
    return all_lines.select("path", "num", F.explode(quoted).alias("value")).filter(F.length("value") >= least)


def encoding(files: DataFrame) -> DataFrame:
    """path, has_crlf, line_ending: mixed if lone line feeds outnumber the CR LF ones, which there are."""
    crlf, lf = F.regexp_count("content", F.lit("\r\n")), F.regexp_count("content", F.lit("\n"))
    kind = F.when((crlf > 0) & (lf - crlf > crlf), "mixed").when(crlf > 0, "crlf").otherwise("lf")
    return files.select("path", (crlf > 0).alias("has_crlf"), kind.alias("line_ending"), (F.instr("content", "﻿") > 0).alias("has_zwnbsp"))
