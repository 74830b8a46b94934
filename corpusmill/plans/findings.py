"""What happens to findings: severity overrides, suppression, removal of repeats, counts, scores, gates, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import extract, matches, round_half_up
from corpusmill.model import DEFAULT_TIER, EOF_LINE, SEVERITIES, SEVERITY_WEIGHT, TIERS
from corpusmill.rules import CATEGORIES, FACTS, RULE_TIERS


def severity_rank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(len(SEVERITIES))
    for n, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(c == s, n).otherwise(out)
    return out


def engine(rule: Column | str = "rule") -> Column:
    return F.substring_index(rule, "/", 1)


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def described(findings: DataFrame) -> DataFrame:
    """Findings with engine, category, fixable, suggestion (replace, insert, delete, refactor or null) and confidence."""
    rule = F.col("rule")
    part = lambda n: _lookup({k: v[n] for k, v in FACTS.items() if v[n] is not None}, rule)
    category = F.coalesce(part(0), _lookup(CATEGORIES, engine(rule)), F.lit("style"))
    return findings.withColumns({"engine": engine(rule), "category": category, "fixable": F.coalesce(part(1), F.lit(False)), "suggestion": part(2), "confidence": part(3)})


def override(findings: DataFrame, overrides: list[tuple[str, str]]) -> DataFrame:
    """New severities by rule: an exact entry beats wildcards (prefix/*), of which the first wins; off drops the row."""
    exact = {k: v for k, v in overrides if not k.endswith("*")}
    new = F.lit(None).cast("string")
    for k, v in reversed([o for o in overrides if o[0].endswith("*")]):
        new = F.when(F.startswith("rule", F.lit(k[:-1].rstrip("/"))), v).otherwise(new)
    if exact:
        new = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]), "rule"), new)
    return findings.withColumn("severity", F.coalesce(new, "severity")).filter("severity <> 'off'")


#: A directive in a comment: what it does, and the rules that it names (none: all). The second four are older names.
DIRECTIVE = r"(?://|#|/\*|<!--)\s*lint-(ignore-next|ignore-line|ignore-start|ignore-end|ignore|disable-next-line|disable-line|disable|enable)\b[ ]*([A-Za-z0-9_/*, -]*)"
_KINDS = {"ignore-next": "next", "ignore": "next", "disable-next-line": "next", "ignore-line": "line", "disable-line": "line", "ignore-start": "start", "disable": "start", "ignore-end": "end", "enable": "end"}


def directives(lines: DataFrame) -> DataFrame:
    """path, num, kind (next, line, start or end), rules (named ones; none: all)."""
    kind = _lookup(_KINDS, extract(F.col("text"), DIRECTIVE, 1))
    named = F.filter(F.split(F.regexp_replace(extract(F.col("text"), DIRECTIVE, 2), r"\*/|--.*\z|-->", ""), r"[, ]+"), lambda s: ~s.isin("", "*"))
    return lines.filter(F.contains("text", F.lit("lint-"))).withColumn("kind", kind).filter("kind IS NOT NULL").select("path", "num", "kind", named.alias("rules"))


def suppress(findings: DataFrame, lines: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Findings that no directive covers: of their line, of the line before, or of a block (open ones end the file).

    A block ends at the next end; a start before that takes the place of the first.
    """
    marks = directives(lines)
    target = F.when(F.col("kind") == "line", F.col("num")).otherwise(F.col("num") + 1)
    one = marks.filter(F.col("kind").isin("next", "line")).select("path", target.alias("a"), target.alias("b"), "rules")
    w = Window.partitionBy("path").orderBy("num")
    edge = marks.filter(F.col("kind").isin("start", "end")).withColumn("then", F.lead("kind").over(w)).withColumn("stop", F.lead("num").over(w))
    block = edge.filter("kind = 'start' AND (then IS NULL OR then = 'end')").select("path", F.col("num").alias("a"), F.coalesce("stop", F.lit(EOF_LINE)).alias("b"), "rules")
    spans = one.unionByName(block).select(F.col("path").alias("s_path"), "a", "b", F.explode_outer("rules").alias("rule_named")).hint("merge")
    hit = (F.col("path") == F.col("s_path")) & F.col("line").between(F.col("a"), F.col("b")) & (F.col("rule_named").isNull() | (F.col("rule_named") == F.col("rule")))
    return findings.filter(~F.col("rule").isin(*disabled) if disabled else F.lit(True)).join(spans, hit, "left_anti")


def ignored_files(text: DataFrame) -> DataFrame:
    """Globs of an ignore list: its lines that begin with file:."""
    return text.select(F.trim(F.regexp_replace("value", r"#.*\z", "")).alias("line")).filter(F.startswith("line", F.lit("file:"))).select(F.trim(F.substring(F.col("line"), 6, 1 << 20)).alias("glob")).filter("glob <> ''")


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of two scans as new, fixed or kept ones; findings that repeat count as often as they stand."""
    columns = ["path", "rule", "severity", "line", "col", "message"]
    # One grouping counts both sides, so that each scan is read once; three set operations would read each three times.
    side = lambda rows, n: rows.select(*columns, F.lit(n).alias("a"), F.lit(1 - n).alias("b"))
    n = side(before, 1).unionByName(side(after, 0)).groupBy(*columns).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = (("new", F.col("b") - F.col("a")), ("fixed", F.col("a") - F.col("b")), ("kept", F.least("a", "b")))
    rows = n.select(*columns, F.explode(F.array(*[F.struct(F.lit(name).alias("change"), n_.alias("n")) for name, n_ in parts])).alias("c")).filter("c.n > 0")
    return rows.select(*columns, "c.change", F.explode(F.sequence(F.lit(1).cast("long"), "c.n")).alias("i")).drop("i")


#: Libraries and calls that tell that a project translates its texts.
TRANSLATES = r"react-i18next|i18next|vue-i18n|intl|react-intl|@lingui|i18n\.t|gettext"


def translation_gate(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings on translation only of projects that translate: one whose code names a library for it."""
    uses = files.filter(F.col("lang").isin("typescript", "javascript") & matches(F.col("content"), TRANSLATES)).agg((F.count("*") > 0).alias("translates"))
    rows = findings.join(F.broadcast(uses))  # one row
    return rows.filter(F.col("translates") | ~F.startswith("rule", F.lit("i18n-lint/"))).drop("translates")


def first_of_each(findings: DataFrame) -> DataFrame:
    """One row a path, line and rule: the worst, then the leftmost, then by message."""
    w = Window.partitionBy("path", "line", "rule").orderBy(severity_rank("severity"), "col", "message")
    return findings.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def at_least(findings: DataFrame, severity: str = "info") -> DataFrame:
    return findings.filter(severity_rank("severity") <= SEVERITIES.index(severity))


# ---- counts and ranks

def severity_counts(findings: DataFrame) -> DataFrame:
    """A row for each severity, also those without findings."""
    spark = findings.sparkSession
    dim = spark.createDataFrame([(n, s) for n, s in enumerate(SEVERITIES)], "rank int, severity string")
    return dim.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def engine_rollup(findings: DataFrame) -> DataFrame:
    """Counts by engine and rule, by engine, and of all."""
    rows = findings.select(engine().alias("engine"), "rule")
    return rows.rollup("engine", "rule").agg(F.count("*").alias("n"))


def top_rules(findings: DataFrame, k: int = 10) -> DataFrame:
    by = findings.groupBy("rule").agg(F.count("*").alias("n"), F.min(severity_rank("severity")).cast("int").alias("worst"))
    return by.orderBy(F.desc("n"), "rule").limit(k)


def first_places(findings: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("rule").orderBy("path", "line", "col", "message")
    return findings.withColumn("r", F.row_number().over(w).cast("int")).filter(F.col("r") <= k).select("rule", "r", "path", "line")


# ---- scores

#: No tier counts more findings of a rule.
MOST_CAP = 40


def with_tiers(findings: DataFrame, tiers: dict[str, str] | None = None) -> DataFrame:
    """mult and cap of each finding's rule (``tiers``, or those of the rule table); others are of the default tier."""
    tier = F.coalesce(_lookup(RULE_TIERS if tiers is None else tiers or {"": DEFAULT_TIER}, F.col("rule")), F.lit(DEFAULT_TIER))
    mult, cap = (F.element_at(F.create_map(*[F.lit(x) for k, v in TIERS.items() for x in (k, v[i])]), tier) for i in (0, 1))
    return findings.withColumn("mult", mult).withColumn("cap", cap)


def score(findings: DataFrame, n_files: int, *, tiers: dict[str, str] | None = None, by: tuple[str, ...] = (), smoothing: float = 20000.0, max_per_rule: float = 5.0, mode: str = "logarithmic") -> DataFrame:
    """One row (or one a group): score, label, density, total, n_capped. No findings at all: no row for that group.

    Of each rule the first ``cap`` findings count (by path, line, column), with severity weight times multiplier.
    Logarithmic: a rule's sum ends at max_per_rule, the total is scaled by the density of errors and warnings, and
    100 falls by its logarithm. Linear: 100 less the total.
    """
    weight = F.lit(0.0)
    for s, w in SEVERITY_WEIGHT.items():
        weight = F.when(F.col("severity") == s, w).otherwise(weight)
    w = Window.partitionBy(*by, "rule").orderBy("path", "line", "col", "message")
    # Findings are made once: dealt by all columns that either side reads, so that both read the same exchange.
    columns = list(dict.fromkeys([*by, "rule", "severity", "path", "line", "col", "message"]))
    findings = findings.select(*columns).repartition(*columns)
    # Only the first findings of a rule are ranked (each task keeps MOST_CAP of them before they move again); all are counted.
    first = findings.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= MOST_CAP)
    rows = with_tiers(first, tiers).filter(F.col("r") <= F.col("cap")).withColumn("w", weight * F.col("mult"))
    rows = rows.withColumn("run", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    log = mode == "logarithmic"
    within = ~(F.lit(log) & (F.col("w") > 0) & (F.col("run") > max_per_rule))
    rules = rows.groupBy(*by, "rule").agg(F.sum("w").alias("w"), F.count(F.when(within, 1)).alias("within"))
    every = findings.groupBy(*by, "rule").agg(F.count("*").alias("n"), F.count(F.when(F.col("severity").isin("error", "warning"), 1)).alias("bad"))
    rules = every.join(rules, [*by, "rule"]).withColumn("capped", F.col("n") - F.col("within"))
    total = F.sum(F.least("w", F.lit(max_per_rule)) if log else F.col("w")).alias("total")
    out = rules.groupBy(*by).agg(total, F.sum("capped").cast("long").alias("n_capped"), F.sum("bad").alias("bad"))
    density = F.least(F.lit(1.0), F.col("bad") / F.lit(float(n_files + smoothing))) if n_files + smoothing > 0 else F.lit(1.0)
    x = F.col("total") * density
    raw = 100.0 - 100.0 * F.log1p(x) / F.log1p(100.0 + x) if log else F.lit(100.0) - F.col("total")
    out = out.withColumn("density", density).withColumn("score", round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("int"))
    return out.select(*by, "score", label("score").alias("label"), "density", "total", "n_capped")


def label(c: str) -> Column:
    return F.when(F.col(c) >= 75, "healthy").when(F.col(c) >= 50, "needs work").otherwise("critical")


def badge(c: str) -> Column:
    return F.when(F.col(c) >= 80, "brightgreen").when(F.col(c) >= 50, "yellow").when(F.col(c) >= 30, "orange").otherwise("red")


def exit_code(scores: DataFrame, *, fail_below: int = 70, fail_on_errors: bool = True) -> DataFrame:
    """has_errors, scoreable and score as an exit code: errors before a missing score before a low one."""
    bad = F.col("has_errors") & F.lit(fail_on_errors)
    return scores.withColumn("code", F.when(bad, 1).when(~F.col("scoreable"), 2).when(F.col("score") < fail_below, 3).otherwise(0))


def scoreable(files: DataFrame, supported: tuple[str, ...], most: float = 0.8) -> DataFrame:
    """One row: whether under ``most`` of the files with a language are in ones that nothing supports."""
    share = F.count(F.when(~F.col("lang").isin(*supported), 1)) / F.count("*")
    return files.filter("lang IS NOT NULL").agg(share.alias("unsupported")).select("unsupported", (F.col("unsupported") < most).alias("scoreable"))


def baseline_gate(scores: DataFrame, baseline: int | None) -> DataFrame:
    return scores.withColumn("passed", F.lit(True) if baseline is None else F.col("score") >= baseline)


# ---- effort

# Minutes and priority of each complexity.
_EFFORT = {"trivial": (1, 1), "simple": (5, 2), "moderate": (15, 3), "complex": (60, 4)}


def assess(findings: DataFrame) -> DataFrame:
    """complexity, minutes and priority of described findings (see ``described``), by the first rule that holds.

    Complex: architecture, errors that cannot be fixed or that are of security. Moderate: other errors; warnings that
    can be fixed but suggest nothing, or are of security or performance. Trivial: what can be fixed as suggested with
    a confidence over 0.8, unless it is deleted. All else is simple.
    """
    error, warning = F.col("severity") == "error", F.col("severity") == "warning"
    security, suggests = F.col("category") == "security", F.col("suggestion").isNotNull()
    kind = F.when((F.col("category") == "architecture") | (error & (~F.col("fixable") | security)), "complex")
    kind = kind.when(error | (warning & ((F.col("fixable") & ~suggests) | security | (F.col("category") == "performance"))), "moderate")
    sure = F.col("fixable") & suggests & (F.col("confidence") > 0.8) & (F.col("suggestion") != "delete")
    kind = kind.when(sure, "trivial").otherwise("simple")
    part = lambda n: F.element_at(F.create_map(*[F.lit(x) for k, v in _EFFORT.items() for x in (k, v[n])]), F.col("complexity"))
    return findings.withColumn("complexity", kind).withColumn("minutes", part(0)).withColumn("priority", part(1))


def effort(assessed: DataFrame) -> DataFrame:
    """One row: n, numbers by complexity, minutes, the highest priority, and the time as text."""
    by = [F.count(F.when(F.col("complexity") == k, 1)).alias(f"n_{k}") for k in _EFFORT]
    out = assessed.agg(F.count("*").alias("n"), *by, F.coalesce(F.sum("minutes"), F.lit(0)).cast("long").alias("minutes"), F.coalesce(F.max("priority"), F.lit(0)).cast("int").alias("priority"))
    hours, rest = F.floor(F.col("minutes") / 60).cast("string"), F.col("minutes") % 60
    text = F.when(F.col("minutes") < 60, F.concat(F.col("minutes").cast("string"), F.lit(" min"))).when(rest > 0, F.concat(hours, F.lit("h "), rest.cast("string"), F.lit("m"))).otherwise(F.concat(hours, F.lit("h")))
    return out.withColumn("effort", text)


# ---- history

def trend(history: DataFrame, at: str = "timestamp", value: str = "score") -> DataFrame:
    """Each record with the one before, the change, and what the change means."""
    w = Window.orderBy(at)  # a project's own records: one row a scan
    rows = history.withColumn("before", F.lag(value).over(w)).withColumn("change", F.col(value) - F.col("before"))
    kind = F.when(F.col("change") < -10, "severe-regression").when(F.col("change") < -3, "degrading").when(F.col("change") > 5, "improving").when(F.col("change").isNotNull(), "stable")
    return rows.withColumn("kind", kind).withColumn("level", F.least(F.floor(F.col(value) / 100 * 8), F.lit(7)).cast("int"))


def spikes(now: DataFrame, before: DataFrame, over: int = 10) -> DataFrame:
    """Engines whose findings grew by more than ``over``; an engine may be missing on either side."""
    a, b = now.select("engine", F.col("n").alias("n")), before.select(F.col("engine"), F.col("n").alias("m"))
    rows = a.join(b, "engine", "full_outer").select("engine", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("m", F.lit(0)).cast("long").alias("before"))
    return rows.filter(F.col("n") - F.col("before") > over)


def sparkline(levels: list[int]) -> str:
    return "".join("▁▂▃▄▅▆▇█"[i] for i in levels)


def age(then: Column, now: Column) -> Column:
    s = F.unix_seconds(now) - F.unix_seconds(then)
    t = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "just now").when(s < 3600, t(60, "m ago")).when(s < 86400, t(3600, "h ago")).otherwise(t(86400, "d ago"))


# ---- rules

def catalogue(findings_rules: DataFrame, tiers: dict[str, str] | None = None) -> DataFrame:
    """rule, engine, tier, sorted by engine and rule."""
    known = _lookup(RULE_TIERS if tiers is None else tiers, F.col("rule"))
    return findings_rules.select("rule").distinct().select("rule", engine().alias("engine"), F.coalesce(known, F.lit(DEFAULT_TIER)).alias("tier")).orderBy("engine", "rule")


def search(rules: DataFrame, text: str) -> DataFrame:
    """Rules by how well they fit a text: the whole id, its start, a part of it, or its engine; nearest spelling last."""
    t = text.lower()
    fit = F.when(F.lower("rule") == t, 10).when(F.startswith(F.lower("rule"), F.lit(t)), 8).when(F.contains(F.lower("rule"), F.lit(t)), 5).when(F.contains(F.lower("engine"), F.lit(t)), 2).otherwise(0)
    return rules.withColumn("fit", fit).withColumn("distance", F.levenshtein(F.lower("rule"), F.lit(t)).cast("int"))


def ast_preferred(findings: DataFrame, confirmed: str = "confirmed", confidence: str = "confidence") -> DataFrame:
    w = Window.partitionBy("path", "rule", "line").orderBy(F.desc(confirmed), F.desc(confidence), "message")
    return findings.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def is_ignored_list(text: DataFrame) -> DataFrame:
    """Rule ids of an ignore list: a line each, without comments and file: entries."""
    return text.select(F.trim("value").alias("rule")).filter(~matches(F.col("rule"), r"^(?:#|file:|\z)"))


def verified(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the two scores, and whether a fix holds (a lower score rolls it back)."""
    one = lambda df, name: df.select(F.col("score").alias(name), F.lit(1).alias("one"))
    return one(before, "before").join(one(after, "after"), "one").select("before", "after", (F.col("after") >= F.col("before")).alias("holds"))


def coverage(files: DataFrame, supported: tuple[str, ...], least: float = 0.3) -> DataFrame:
    """One row: the share of the languages in use that are supported, and whether it suffices."""
    langs = files.filter("lang IS NOT NULL").select("lang").distinct()
    return langs.agg((F.count(F.when(F.col("lang").isin(*supported), 1)) / F.greatest(F.lit(1), F.count("*"))).alias("share")).select("share", (F.col("share") >= least).alias("covered"))


def category_scores(findings: DataFrame, n_files: int, **options) -> DataFrame:
    """A score for each engine's findings."""
    return score(findings.withColumn("engine", engine()), n_files, by=("engine",), **options)


def slower(now: DataFrame, before: DataFrame) -> DataFrame:
    """Engines' mean times against an earlier run, in percent."""
    both = now.select("engine", F.col("avg_ms").alias("ms")).join(before.select("engine", F.col("avg_ms").alias("before_ms")), "engine")
    return both.withColumn("change", F.try_divide((F.col("ms") - F.col("before_ms")) * 100, F.col("before_ms")))
