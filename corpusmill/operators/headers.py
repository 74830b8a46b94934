"""Headers of functions over several lines, their parameters split where brackets are balanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strings, brackets, commas, and what stands between them; possessive, so that long texts need no stack.
_PIECE = r""""(?:\\.|[^"\\])*+"?|'(?:\\.|[^'\\])*+'?|[\[({]|[\])}]|,|[^\[({\])},"']++"""
_STRING_OR_COMMENT = r"""("(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+')|#.*"""
_DEF = r"^\s*(?:async\s+)?def\s+\w+\s*\("


def split_balanced(text: Column) -> Column:
    """What stands between the first bracket of a text and its mate, split at commas that no other bracket holds.

    A fold over pieces: strings are one piece each, so that commas and brackets in them count for nothing.
    """
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        opens, closes = p.isin("(", "[", "{"), p.isin(")", "]", "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        cut = (p == ",") & (s["depth"] == 1) | closes & (depth == 0)
        begun = s["depth"] > 0
        return F.when(s["done"], s).otherwise(
            F.struct(
                depth.alias("depth"),
                (closes & (depth <= 0)).alias("done"),
                F.when(cut | ~begun, "").otherwise(F.concat(s["now"], p)).alias("now"),
                F.when(cut & begun, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]).alias("out"),
            )
        )

    return F.filter(F.aggregate(pieces, start, step, lambda s: s["out"]), lambda x: F.trim(x) != "")


def python_headers(lines: DataFrame) -> DataFrame:
    """path, num and text of the headers of Python functions; those over several lines as one, comments left out.

    A header is a def and the lines behind it up to the one that closes its brackets. Windows over a file's lines see
    how many brackets are open; only lines of headers are gathered.
    """
    w = Window.partitionBy("path").orderBy("num")
    rows = lines.filter("lang = 'python'").withColumn("bare", F.regexp_replace("text", _STRING_OR_COMMENT, "$1"))
    rows = rows.withColumn("part", F.sum(F.when(F.col("text").rlike(_DEF), 1).otherwise(0)).over(w)).filter("part > 0")
    code = F.regexp_replace("bare", r"""["'](?:\\.|[^"'\\])*+["']""", "")
    own = Window.partitionBy("path", "part").orderBy("num")
    rows = rows.withColumn("open", F.sum(F.regexp_count(code, F.lit(r"[\[({]")) - F.regexp_count(code, F.lit(r"[\])}]"))).over(own))
    ended = F.max(F.when(F.col("open") <= 0, 1)).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("ended", ended).filter("ended IS NULL")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("num", "bare"))), lambda r: r["bare"]), " ")
    return rows.groupBy("path", "part").agg(F.min("num").alias("num"), joined.alias("text")).select("path", "num", "text")


def python_parameters(lines: DataFrame) -> DataFrame:
    """path, num (of the def), place, name, value (of its default) and hinted of all parameters of Python functions.

    self, cls, starred ones and the marks / and * are left out.
    """
    rows = python_headers(lines).select("path", "num", F.posexplode(split_balanced(F.col("text"))).alias("place", "text"))
    # The default stands behind the first = that is no comparison and in no bracket of an annotation.
    name = F.trim(F.regexp_extract("text", r"^\s*([A-Za-z_]\w*)", 1))
    value = F.trim(F.regexp_extract("text", r"""(?s)^(?:\[[^\]]*+\]|"[^"]*+"|'[^']*+'|[^=\["'])*+=(?!=)(.*)\z""", 1))
    rows = rows.withColumn("name", name).filter("name <> '' AND name NOT IN ('self', 'cls')")
    return rows.select("path", "num", "place", "name", value.alias("value"), F.contains("text", F.lit(":")).alias("hinted"))


def parameter_rules(lines: DataFrame) -> DataFrame:
    """Parameters without a type, and with a list or map as default, wherever in a header they stand."""
    rows = python_parameters(lines)
    out = lambda d, rule: d.select("path", F.lit(rule).alias("rule"), F.lit("warning").alias("severity"), F.col("num").cast("int").alias("line"), F.lit(1).alias("col"), F.col("name").alias("message"))
    return out(rows.filter("NOT hinted"), "python-deep/no-type-hint").unionByName(out(rows.filter(F.col("value").rlike(r"^(?:\[\s*\]|\{\s*\})\z")), "python-deep/mutable-default"))
