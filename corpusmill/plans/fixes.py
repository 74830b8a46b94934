"""Fixes as a pure transformation: steps are chosen, applied to files bottom up, and verified by a new score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import java

SAFE = 0.8
#: Rules whose line is deleted, and those whose line is rewritten (pattern, text, confidence).
DELETE = {"ast-slop/decorative-comment": 0.95, "ast-slop/meta-comment": 0.9, "ast-slop/narrative-comment": 0.7, "ast-slop/debug-path": 0.85}
REPLACE = {
    "python-deep/bare-except": (r"\bexcept\s*:", "except Exception:", 0.9),
    "python-deep/pass-stub": (r"\bpass\b", "raise NotImplementedError", 0.7),
    "syntax-deep/trailing-whitespace": (r"[ \t]+\z", "", 1.0),
    "ast-slop/as-any": (r"\bas\s+any\b", "as unknown", 0.6),
}
#: Rules whose findings can be fixed: a detector for steps alone needs no others.
FIXABLE = (*DELETE, *REPLACE)


def propose(findings: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """path, line, rule, kind (delete or replace), old, new, confidence, for findings that can be fixed.

    Findings that hold the text of their line need no lines: a join would move all lines of a corpus.
    """
    rows = findings.filter(F.col("rule").isin(*FIXABLE))
    if lines is None:
        rows = rows.withColumnRenamed("text", "old")
    else:
        rows = rows.join(lines.select("path", F.col("num").alias("line"), F.col("text").alias("old")), ["path", "line"])
    new, sure = F.lit(""), F.lit(None).cast("double")
    for rule, (pattern, text, confidence) in REPLACE.items():
        new = F.when(F.col("rule") == rule, F.regexp_replace("old", java(pattern), text)).otherwise(new)
        sure = F.when(F.col("rule") == rule, confidence).otherwise(sure)
    for rule, confidence in DELETE.items():
        sure = F.when(F.col("rule") == rule, confidence).otherwise(sure)
    kind = F.when(F.col("rule").isin(*DELETE), "delete").otherwise("replace")
    return rows.select("path", "line", "rule", kind.alias("kind"), "old", new.alias("new"), sure.alias("confidence"))


def plan(steps: DataFrame, safe: bool = True) -> DataFrame:
    """The steps that are taken: one a line, the surest, and with ``safe`` only from SAFE on; numbered bottom up."""
    rows = steps.filter(F.col("kind") != "refactor")
    if safe:
        rows = rows.filter(F.col("confidence") >= SAFE)
    rows = rows.repartition("path")  # serves both windows
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("path", "line").orderBy(F.desc("confidence"), "rule"))).filter("r = 1").drop("r")
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("line"))).cast("int"))


def apply(files: DataFrame, lines: DataFrame, steps: DataFrame) -> DataFrame:
    """path, content of files with steps: a line whose text is still the step's old text is replaced or deleted."""
    rows = lines.join(steps.select("path"), "path", "left_semi").join(steps.select("path", F.col("line").alias("num"), "kind", "old", "new"), ["path", "num"], "left")
    same = F.col("old") == F.col("text")
    kept = rows.filter(~F.coalesce(same & (F.col("kind") == "delete"), F.lit(False))).withColumn("out", F.when(same, F.col("new")).otherwise(F.col("text")))
    return kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("num", "out"))), lambda x: x["out"]), "\n").alias("content"))


def remaining(findings: DataFrame, steps: DataFrame) -> DataFrame:
    """Findings that no step takes away, by path, rule and line."""
    return findings.join(steps.select("path", "rule", "line"), ["path", "rule", "line"], "left_anti")


def preview(steps: DataFrame) -> DataFrame:
    return steps.select("path", "line", F.concat(F.lit("-"), F.col("old")).alias("before"), F.when(F.col("kind") == "delete", F.lit(None)).otherwise(F.concat(F.lit("+"), F.col("new"))).alias("after"))
