"""Detectors over relations of a whole corpus: joins, anti joins, groupings, similarity and cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import extract, matches, trim_all
from corpusmill.operators.context_rules import _found
from corpusmill.operators.folds import COMMON_NAMES, COPIED_LINES
from corpusmill.operators.views import words
from corpusmill.plans.storage import Scratch

#: Windows that are cut from a file at once.
WINDOWS = 1000
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js", ".py")


# ---- duplicates

def normalised(text: Column) -> Column:
    """A line without its comment and outer white space."""
    return trim_all(F.regexp_replace(text, r"(?://|#).*\z", ""))


def blocks(files: DataFrame, window: int = 14, step: int = 5, least: int = 10, most_lines: int | None = 2000) -> DataFrame:
    """path, start, stop, text (joined normalised lines), key: windows of lines, every ``step`` lines.

    Files of more than ``most_lines`` lines have none, if that is given. Of a file, stretches of WINDOWS windows are cut
    first, then windows of these: a row for each window, with all lines to cut it from, would be the square of a file.
    """
    stretch = step * WINDOWS
    rows = files.select("path", F.lit(0).alias("at"), F.split("content", "\n", -1).alias("ls")).filter(F.size("ls") >= window)
    if most_lines is not None:
        rows = rows.filter(F.size("ls") <= most_lines)
    for every, length in ((stretch, stretch - step + window), (step, window)):
        cut = F.transform(F.sequence(F.lit(0), F.size("ls") - window, F.lit(every)), lambda s: F.struct((F.col("at") + s).alias("at"), F.slice("ls", s + 1, length).alias("ls")))  # noqa: B023
        # The outer explode keeps Spark from asking whether there are pieces by a filter that cuts them once more.
        rows = rows.select("path", F.explode_outer(cut).alias("p")).select("path", "p.at", "p.ls")
    text = F.array_join(F.filter(F.transform("ls", normalised), lambda x: x != ""), "\n")
    rows = rows.select("path", (F.col("at") + 1).cast("int").alias("start"), (F.col("at") + window).cast("int").alias("stop"), text.alias("text"))
    return rows.filter(F.length("text") >= least).withColumn("key", F.md5("text"))


def identical_blocks(all_blocks: DataFrame) -> DataFrame:
    """key, n_files, first_path, first_line: windows that stand in two files or more."""
    by = all_blocks.groupBy("key").agg(F.countDistinct("path").alias("n_files"), F.count("*").alias("n"), F.min(F.struct("path", "start")).alias("first"))
    return by.filter("n_files >= 2").select("key", F.col("n_files").cast("long"), F.col("n").cast("long").alias("n"), F.col("first.path").alias("first_path"), F.col("first.start").alias("first_line"))


def is_boilerplate(text: Column) -> Column:
    """Windows that are half imports, or mostly comments."""
    rows = F.split(text, "\n")
    share = lambda p: F.size(F.filter(rows, lambda x: matches(x, p))) / F.size(rows)
    return (share(r"^\s*(?:import\b|from\b|export\s+\*|.*require\()") >= 0.5) | (share(r"^\s*(?://|/\*|\*|#)") >= 0.7)


def similar_blocks(all_blocks: DataFrame, num: int = 90, den: int = 100) -> DataFrame:
    """Pairs of distinct window texts of token sets alike that stand in two files, each with a place; equal texts are one before the join.

    The places are the first ones; where these are in one file, that of b, else that of a, is the first in its last file.
    A pair is left out only if all places of both texts are in one file.
    """
    place = lambda c: F.struct(F.col(f"{c}.path").alias("path"), F.abs(f"{c}.start").alias("start"))
    seen = all_blocks.filter(~is_boilerplate(F.col("text"))).groupBy("key").agg(F.min(F.struct("path", "start")).alias("first"), F.max(F.struct("path", (-F.col("start")).alias("start"))).alias("last"), F.first("text").alias("text"))
    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), 1))
    # The places are a part of the id, so that they need no join of their own.
    sets = seen.select(F.struct("key", place("first").alias("first"), place("last").alias("last")).alias("id"), tokens.alias("tokens"))
    first, other = F.col("a.first.path"), F.col("b.first.path")
    at_a = F.when((first == other) & (F.col("b.last.path") == first), F.col("a.last")).otherwise(F.col("a.first"))
    at_b = F.when((first == other) & (F.col("b.last.path") != first), F.col("b.last")).otherwise(F.col("b.first"))
    pairs = similar_sets(sets, num, den).select(at_a.alias("a"), at_b.alias("b"), "n_both", "n_either").filter("a.path <> b.path")
    return pairs.select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("path", "start")], "n_both", "n_either")


def merged_regions(all_blocks: DataFrame) -> DataFrame:
    """Regions of a file made of windows that recur elsewhere and overlap by more than half.

    The region grows as windows join it, which a plain window function cannot say: a fold over the sorted starts.
    """
    shared = all_blocks.join(identical_blocks(all_blocks).select("key"), "key", "left_semi").groupBy("path").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (F.least(last["stop"], x["stop"]) - F.greatest(last["start"], x["start"]) + 1 > (x["stop"] - x["start"] + 1) / 2)
        grown = F.struct(F.least(last["start"], x["start"]).alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    return shared.select("path", F.explode(F.aggregate("spans", empty, add)).alias("r")).select("path", "r.start", "r.stop")


def set_candidates(sets: DataFrame, num: int = 90, den: int = 100) -> DataFrame:
    """(a, b) of ids a < b whose sets may be similar; all that are stand here.

    Sets na and nb that are similar differ in (na + nb) (den - num) / (den + num) tokens at most. Cut by the tokens'
    hashes into one part more than that, they agree in a whole part, so that the hashes of parts are the join key: at
    num/den = 0.9 some nine tokens at once, where one token alone would be that of a share of all sets. Sizes go in
    classes, so that similar sets lie in the same or in neighbouring ones and are cut alike: each set is cut as those of
    its class and as those of the next one are.
    """
    # A little more than the logarithm of the ratio of sizes, so that no rounding parts sets by two classes.
    step = max(math.log(den / num), 1e-6) * (1 + 1e-6)
    n, e = F.size("tokens"), F.col("e")
    # Sets that are empty have no logarithm, so no class, and none here asks for their tokens before these are made.
    own = sets.select("id", n.alias("n"), "tokens", F.floor(F.ln(n) / step).alias("c"))
    cut = own.select("id", "n", "c", F.explode(F.array("c", F.col("c") + 1)).alias("e"), "tokens")
    largest = F.floor(F.exp((e + 1) * step)) + 1
    cut = cut.withColumn("m", F.floor(largest * 2 * (den - num) / (den + num)) + 1)
    part = F.transform("tokens", lambda t: F.struct(F.pmod(F.xxhash64(t), F.col("m")).alias("p"), F.xxhash64(t).alias("x")))
    # Parts without a token are parts too.
    bare = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda p: F.struct(p.alias("p"), F.lit(0).cast("long").alias("x")))
    # The outer explode keeps Spark from asking whether there are parts by a filter that makes them once more.
    rows = cut.select("id", "n", "c", "e", F.explode_outer(F.concat(part, bare)).alias("t")).select("id", "n", "c", "e", "t.p", "t.x")
    keys = rows.groupBy("id", "n", "c", "e", "p").agg(F.bit_xor("x").alias("x"))
    a, b = (keys.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), "e", "p", "x") for x in "ab")
    near = a.join(b, ["e", "p", "x"]).filter("a < b").filter(F.greatest("ca", "cb") == e)
    return near.filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b").distinct()


def similar_sets(sets: DataFrame, num: int = 90, den: int = 100) -> DataFrame:
    """(a, b, n_both, n_either) for ids a < b whose token sets have Jaccard num/den or more: exact, see set_candidates.

    ``sets`` has id and tokens (an array of distinct tokens).
    """
    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    rows = set_candidates(sets, num, den).join(left, "a").join(right, "b").withColumn("n_both", F.size(F.array_intersect("ta", "tb")).cast("long"))
    rows = rows.withColumn("n_either", (F.size("ta") + F.size("tb") - F.col("n_both")).cast("long"))
    return rows.filter(F.col("n_both") * den >= F.col("n_either") * num).select("a", "b", "n_both", "n_either")


def similar_groups(sets: DataFrame, num: int = 90, den: int = 100) -> DataFrame:
    """(a, b, n_both, n_either) that say all similar pairs of ``sets`` without writing each of them down.

    Ids of equal token sets are one before the join, the smallest id: each other one has a row with it (a), where
    n_both = n_either, and the smallest ids have the rows of similar_sets. Two ids are similar if and only if their
    smallest ids are the same or stand in one row. Empty sets equal each other. Null ids and token arrays take no part.
    """
    keyed = sets.filter("id IS NOT NULL AND tokens IS NOT NULL").withColumn("key", F.sha2(F.to_json(F.array_sort("tokens")), 256))
    # Partial minima first, and the smallest ids go to slices of a key: one set may be that of most ids.
    slices = 64
    first = keyed.groupBy("key").agg(F.min("id").alias("a"), F.first("tokens").alias("tokens"))
    dealt = first.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("key", "slice", "a")
    own = keyed.select("id", "key", F.size("tokens").cast("long").alias("n_both")).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    same = own.join(dealt, ["key", "slice"]).filter("id <> a").select("a", F.col("id").alias("b"), "n_both", F.col("n_both").alias("n_either"))
    return same.unionByName(similar_sets(first.select(F.col("a").alias("id"), "tokens"), num, den))


def repeated_constants(strings: DataFrame, least: int = 3, shown: int = 10) -> DataFrame:
    """Literals that stand ``least`` times in as many files, where they stand first, and some of the places."""
    usable = strings.filter(~matches(F.col("value"), r"^(?:https?://|\.{1,2}/|@|use )") & ~matches(F.col("value"), r"^[a-z-]+/[a-z0-9/_-]+\z") & matches(F.col("value"), r"[A-Za-z]"))
    place = F.concat(F.col("path"), F.lit(":"), F.col("num").cast("string"))
    by = usable.groupBy("value").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"), F.min(F.struct("path", "num")).alias("first"))
    by = by.filter((F.col("n") >= least) & (F.col("n_files") >= least))
    # Of a literal that stands everywhere, each task keeps the first places alone.
    one = usable.select("value", place.alias("place")).distinct().withColumn("r", F.row_number().over(Window.partitionBy("value").orderBy("place"))).filter(F.col("r") <= shown)
    places = one.groupBy("value").agg(F.array_join(F.array_sort(F.collect_list("place")), ",").alias("places"))
    return by.join(places, "value").select("value", F.col("n").cast("long"), F.col("n_files").cast("long"), F.col("first.path").alias("path"), F.col("first.num").cast("int").alias("line"), "places")


def one_line_functions(lines: DataFrame) -> DataFrame:
    """path, num, name, types, body of functions that a line declares; the body is the line behind the header."""
    head = r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)"
    name, params = extract(F.col("text"), head, 1), extract(F.col("text"), head, 2)
    types = F.array_join(F.transform(F.split(params, ","), lambda p: trim_all(F.regexp_replace(p, r"^[^:]*:?", ""))), ",")
    after = F.lead("text").over(Window.partitionBy("path").orderBy("num"))
    return lines.withColumn("name", name).withColumn("types", types).withColumn("body", F.regexp_replace(F.coalesce(after, F.lit("")), r"\s+", " ")).filter("name <> ''").select("path", "num", "name", "types", "body")


def copied_functions(functions: DataFrame, least: int = COPIED_LINES) -> DataFrame:
    """Bodies of more than ``least`` lines that functions of two names or more have: one row a body.

    ``functions`` has path, num, name, n_lines and body (see folds.functions). Names that many functions share do not
    count. A body that very many functions have is reduced to a row in each task first.
    """
    usable = functions.filter((F.col("n_lines") > least) & ~F.col("name").isin(*COMMON_NAMES))
    by = usable.groupBy(F.md5("body").alias("key"), "name").agg(F.count("*").alias("n"), F.min(F.struct("path", "num", "name")).alias("first"))
    by = by.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("n_names"), F.min("first").alias("first"))
    return by.filter("n_names >= 2").select("key", "n", "n_names", F.col("first.path").alias("path"), F.col("first.num").cast("int").alias("line"), F.col("first.name").alias("name"))


def copied_function_findings(functions: DataFrame) -> DataFrame:
    """Each copied body as a finding at its first function."""
    return _found(copied_functions(functions).withColumnRenamed("line", "num"), "dup-detect/copy-paste-function", "warning", F.col("name"))


def copied_signatures(functions: DataFrame, least: int = 4) -> DataFrame:
    """Pairs of functions of a file with the same parameter types."""
    f = functions.filter(F.length("types") >= least)
    a, b = f.select("path", "types", F.col("name").alias("a"), F.col("num").alias("na")), f.select("path", "types", F.col("name").alias("b"), F.col("num").alias("nb"))
    return a.join(b, ["path", "types"]).filter("na < nb AND a <> b").select("path", "types", "a", "b")


# ---- imports and exports

def spread_imports(imports: DataFrame, least_files: int = 15, share: float = 0.3) -> DataFrame:
    """Modules that many files import, and the symbols that a good part of these take."""
    files = imports.groupBy("source").agg(F.countDistinct("path").alias("n_files")).filter(F.col("n_files") >= least_files)
    symbols = imports.select("source", "path", F.explode("symbols").alias("symbol")).groupBy("source", "symbol").agg(F.countDistinct("path").alias("n"))
    common = symbols.join(files, "source").filter(F.col("n") >= share * F.col("n_files")).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("symbols"))
    return files.join(common, "source", "left").select("source", F.col("n_files").cast("long"), F.coalesce("symbols", F.lit("")).alias("symbols"))


def unused_imports(imports: DataFrame, lines: DataFrame) -> DataFrame:
    """Imported symbols that no later line of their file has as a word: all of an import's, or some."""
    rows = imports.filter("lang <> 'python'").select("path", "num", "source", F.size("symbols").alias("n"), F.explode("symbols").alias("word"))
    last = words(lines).groupBy("path", "word").agg(F.max("num").alias("last"))
    unused = rows.join(last, ["path", "word"], "left").filter("last IS NULL OR last <= num")
    by = unused.groupBy("path", "num", "source", "n").agg(F.count("*").alias("k"), F.array_join(F.array_sort(F.collect_list("word")), ",").alias("symbols"))
    rule = F.when(F.col("k") == F.col("n"), "import-intelligence/unused-import").otherwise("import-intelligence/unused-symbol")
    return by.select("path", rule.alias("rule"), F.lit("warning").alias("severity"), F.col("num").cast("int").alias("line"), F.lit(1).alias("col"), F.col("symbols").alias("message"))


def duplicate_imports(imports: DataFrame) -> DataFrame:
    by = imports.filter("lang <> 'python'").groupBy("path", "source").agg(F.count("*").alias("n"), F.min("num").alias("num")).filter("n >= 2")
    return _found(by, "import-intelligence/duplicate-import", "suggestion", F.col("source"))


def tree_shakeable(imports: DataFrame) -> DataFrame:
    # Packages of which only parts should be imported.
    packages = ("lodash", "moment", "rxjs", "antd", "date-fns", "ramda", "@mui/material")
    return _found(imports.filter(F.col("source").isin(*packages) & (F.size("symbols") > 0)), "import-intelligence/tree-shakeable", "suggestion", F.col("source"))


def undeclared_imports(imports: DataFrame, declared: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Bare imports whose package is not declared: an anti join. ``declared`` has name (dependencies and builtins).

    Imports that begin with one of ``aliases`` (name) are the project's own: an anti join on the parts of their path.
    """
    source = F.col("source")
    package = F.when(source.startswith("@"), F.regexp_extract(source, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(source, r"^([^/]+)", 1))
    bare = imports.filter((F.col("lang") != "python") & ~matches(source, r"^(?:[./]|node:|@/|~/)")).withColumn("name", package)
    bare = bare.join(declared.select("name").distinct(), "name", "left_anti")
    if aliases is not None:
        parts = F.split(source, "/")
        starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        own = bare.select("path", "num", F.explode(starts).alias("alias")).join(aliases.select(F.col("name").alias("alias")).distinct(), "alias", "left_semi").select("path", "num").distinct()
        bare = bare.join(own, ["path", "num"], "left_anti")
    return _found(bare, "ast-slop/hallucinated-import", "error", F.col("name"))


def unused_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Exported names that no file imports; capitalised ones are taken for types."""
    taken = imports.select(F.explode("symbols").alias("name")).distinct()
    return _found(exports.filter(~matches(F.col("name"), r"^[A-Z]|Engine\z")).join(taken, "name", "left_anti"), "dead-flow/unused-export", "info", F.col("name"))


def high_coupling(imports: DataFrame, most: int = 10) -> DataFrame:
    by = imports.filter("NOT type_only").groupBy("path").agg(F.countDistinct("source").alias("n"), F.min("num").alias("num")).filter(F.col("n") > most)
    return _found(by, "arch-constraints/high-coupling", "warning", F.col("n"))


# What tells the layers, in their order.
UI_PATHS = [r"/components?/", r"/views?/", r"/pages?/", r"/ui/", r"/screens?/", r"\.(?:tsx|jsx)\z"]
DB_SOURCES = [r"(?:^|\.\./|\./)(?:db|database|models?|repositories?|entities?|knex|prisma|drizzle|sequelize|typeorm|mongoose)/", r"/db/", r"/lib/db/", r"/data/(?:models?|repositories?|entities?)/"]
API_PATHS = [r"/api/", r"/routes?/", r"/controllers?/", r"/handlers?/", r"/endpoints?/"]
SERVICE_SOURCES = [r"/services?/", r"/use-?cases?/", r"/business/", r"/domain/"]


def layer_violation(imports: DataFrame) -> DataFrame:
    """Views, or routes that pass by the services, which import the database."""
    any_ = lambda c, patterns: matches(F.col(c), "(?i)(?:" + "|".join(patterns) + ")")
    ui, db, api, service = any_("path", UI_PATHS), any_("source", DB_SOURCES), any_("path", API_PATHS), any_("source", SERVICE_SOURCES)
    return _found(imports.filter(db & (ui | (api & ~service))), "arch-constraints/layer-violation", "warning", F.col("source"))


def user_rules(rules: list[dict], imports: DataFrame, lines: DataFrame) -> DataFrame:
    """Rules of a project: forbid_import, forbid_import_from_path, require_pattern (globs over paths and sources)."""
    from corpusmill.sources.files import glob_regex

    out = None
    for r in rules:
        where = F.col("path").rlike(glob_regex(r.get("where", "**")))
        rule, severity = f"arch-rules/{r['name']}", r.get("severity", "warning")
        if r["type"] == "require_pattern":
            has = lines.filter(matches(F.col("text"), r["pattern"])).select("path").distinct()
            rows = _found(lines.filter(where).groupBy("path").agg(F.min("num").alias("num")).join(has, "path", "left_anti"), rule, severity, F.lit(r["pattern"]))
        else:
            hit = F.col("source").rlike(glob_regex(r.get("forbid") or r["match"]))
            if r["type"] == "forbid_import_from_path":
                hit &= F.col("path").rlike(glob_regex(r["from"]))
            rows = _found(imports.filter(where & hit), rule, severity, F.col("source"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- graphs

def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, num, dst: relative imports joined to the files that they may mean, with the first line that says so."""
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    joined = F.concat(folder, F.lit("/"), F.regexp_replace("source", r"^(?:\./)+", ""))
    for _ in range(8):  # a/../ goes, step by step
        joined = F.regexp_replace(joined, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    tries = F.array(*[F.concat(joined, F.lit(s)) for s in SUFFIXES], *[F.concat(F.regexp_replace(joined, r"\.js\z", ""), F.lit(".ts"))])
    rows = imports.filter(F.startswith("source", F.lit("."))).select(F.col("path").alias("src"), "num", F.explode(F.array_distinct(tries)).alias("dst"))
    return rows.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").groupBy("src", "dst").agg(F.min("num").alias("num")).select("src", "num", "dst")


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: relative imports joined to the files that they may mean."""
    return import_targets(imports, files).select("src", "dst")


def cycles(edges: DataFrame, deepest: int = 5) -> DataFrame:
    """Cycles of at most ``deepest`` edges, once each, from their smallest vertex."""
    return cycle_members(edges, deepest).select(F.size("members").cast("long").alias("n"), F.array_join("members", " > ").alias("cycle"))


def circular_dependency(imports: DataFrame, files: DataFrame, deepest: int = 5) -> DataFrame:
    """Cycles of imports, each at the import of its smallest file; those of one import are told together."""
    to = Scratch(files.sparkSession, "targets").keep(import_targets(imports, files), "targets").hint("merge")
    rows = cycle_members(to.select("src", "dst"), deepest)
    rows = rows.select(F.element_at("members", 1).alias("src"), F.coalesce(F.try_element_at("members", F.lit(2)), F.element_at("members", 1)).alias("dst"), F.array_join("members", " > ").alias("cycle"))
    by = rows.join(to, ["src", "dst"]).groupBy(F.col("src").alias("path"), "num").agg(F.array_join(F.array_sort(F.collect_set("cycle")), ", ").alias("cycles"))
    return _found(by, "import-intelligence/circular-dependency", "warning", F.col("cycles"))


def cycle_members(edges: DataFrame, deepest: int = 5) -> DataFrame:
    """members: the vertices of each cycle of at most ``deepest`` edges, from the smallest.

    Paths grow by one join a step and keep to vertices larger than their start, so that each cycle grows once; the
    number of steps is fixed. Vertices without an edge in or out are on no cycle and go first. Edges and steps are
    written to scratch tables: as one plan, each step would make all edges and all steps before it anew.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    edges = scratch.keep(edges.select("src", "dst"), "edges").hint("merge")
    e = edges.filter("src <> dst")
    for i in range(2):
        kept = e.join(e.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select("src", "dst")
        e = scratch.keep(kept, f"live-{i}").hint("merge")
    paths = e.filter("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("members"))
    out = edges.filter("src = dst").select(F.array("src").alias("members"))
    for i in range(deepest - 1):
        step = paths.join(e.withColumnRenamed("src", "last").withColumnRenamed("dst", "next"), "last").filter((F.col("next") == F.col("start")) | (F.col("next") > F.col("start")) & ~F.array_contains("members", F.col("next")))
        step = scratch.keep(step.select("start", "next", "members"), f"step-{i}").hint("merge")
        out = out.unionByName(step.filter("next = start").select("members"))
        paths = step.filter("next > start").select("start", F.col("next").alias("last"), F.concat("members", F.array("next")).alias("members"))
    return out.distinct()


# ---- markup and translations

def unused_selectors(lines: DataFrame) -> DataFrame:
    """Classes and ids of style sheets that no page or component has."""
    marks = lambda mark: F.transform(F.regexp_extract_all("text", F.lit(rf"{mark}([A-Za-z_][\w-]*)\s*[,{{:]"), 1), lambda n: F.concat(F.lit(mark.strip("\\")), n))
    css = lines.filter("lang = 'css'").select("path", "num", F.explode(F.concat(marks(r"\."), marks("#"))).alias("name"))
    lists = F.concat(F.regexp_extract_all("text", F.lit(r"class(?:Name)?\s*=\s*\"([^\"]*)\""), 1), F.regexp_extract_all("text", F.lit(r"class(?:Name)?\s*=\s*'([^']*)'"), 1))
    ids = F.regexp_extract_all("text", F.lit(r"\bid\s*=\s*[\"']([^\"']*)[\"']"), 1)
    names = F.concat(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, r"\s+"))), lambda n: F.concat(F.lit("."), n)), F.transform(ids, lambda n: F.concat(F.lit("#"), n)))
    used = lines.filter(F.col("lang").isin("html", "typescript", "javascript")).select(F.explode(names).alias("name")).distinct()
    return _found(css.join(used, "name", "left_anti"), "css/unused-selector", "info", F.col("name"))


def translations(used: DataFrame, locale_keys: DataFrame) -> DataFrame:
    """(rule, name, locale): keys in use that a locale lacks, and keys that some locales have and others lack.

    used has name; locale_keys has locale and name.
    """
    locales = locale_keys.select("locale").distinct()
    all_ = F.broadcast(locales.agg(F.array_sort(F.collect_set("locale")).alias("all")))  # one row of locale names
    have = locale_keys.groupBy("name").agg(F.collect_set("locale").alias("have"))
    both = used.select("name").distinct().join(have, "name", "left").join(all_).select(F.lit("i18n-lint/missing-translation-key").alias("rule"), "name", F.explode(F.array_except("all", F.coalesce("have", F.array().cast("array<string>")))).alias("locale"))
    some = have.join(all_).filter(F.size("all") >= 2).select(F.lit("i18n-lint/untranslated-locale").alias("rule"), "name", F.explode(F.array_except("all", "have")).alias("locale"))
    return both.unionByName(some)


def translation_keys(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("lang").isin("typescript", "javascript")).select("path", "num", F.explode(F.regexp_extract_all("text", F.lit(r"\bt\(\s*['\"]([\w.-]+)['\"]"), 1)).alias("name"))


# ---- more on imports

def type_only_imports(imports: DataFrame, lines: DataFrame) -> DataFrame:
    """Imports all of whose symbols stand in type positions alone (behind a colon, <, as, extends or implements)."""
    ts = lines.filter("lang = 'typescript'").filter(~matches(F.col("text"), r"^\s*import\b"))
    bare = F.regexp_replace("text", r"(?::\s*|<\s*|\bas\s+|\bextends\s+|\bimplements\s+)[A-Za-z_][\w.]*", "")
    values = words(ts.select("path", "num", bare.alias("text"))).select("path", "word").distinct()
    any_ = words(ts).select("path", "word").distinct()
    rows = imports.filter("lang = 'typescript' AND NOT type_only AND size(symbols) > 0").select("path", "num", "source", F.size("symbols").alias("n"), F.explode("symbols").alias("word"))
    typed = rows.join(any_, ["path", "word"], "left_semi").join(values, ["path", "word"], "left_anti").groupBy("path", "num", "source", "n").agg(F.count("*").alias("k")).filter("k = n")
    return _found(typed, "import-intelligence/type-only-import", "suggestion", F.col("source"))


def reexports(lines: DataFrame) -> DataFrame:
    """path, source, symbol of index files that pass symbols on."""
    index = lines.filter(F.col("path").rlike(r"/index\.[jt]sx?\z"))
    names = F.transform(F.split(extract(F.col("text"), r"^export\s+(?:type\s+)?\{([^}]*)\}\s*from\b", 1), ","), lambda s: trim_all(F.regexp_replace(s, r"\s+as\s+.*\z", "")))
    source = extract(F.col("text"), r"^export\s+.*\bfrom\s+['\"]([^'\"]+)['\"]", 1)
    return index.select("path", source.alias("source"), F.explode(F.filter(names, lambda s: s != "")).alias("symbol")).filter("source <> ''")


def barrel_bypass(imports: DataFrame, passed_on: DataFrame) -> DataFrame:
    """Symbols imported through an index file although their own file is known."""
    folder = F.regexp_replace(F.regexp_replace("source", r"/index(?:\.[jt]sx?)?\z", ""), r"^(?:\.{1,2}/)+", "")
    rows = imports.filter(F.startswith("source", F.lit("."))).select("path", "num", "source", folder.alias("folder"), F.explode("symbols").alias("symbol"))
    known = passed_on.select(F.element_at(F.split(F.regexp_replace("path", r"/index\.[jt]sx?\z", ""), "/"), -1).alias("last"), "symbol", F.col("source").alias("own")).dropDuplicates(["last", "symbol"])
    rows = rows.withColumn("last", F.element_at(F.split("folder", "/"), -1))
    return _found(rows.join(known, ["last", "symbol"]), "import-intelligence/barrel-bypass", "suggestion", F.concat_ws(" ", "symbol", "own"))


def aliases(imports: DataFrame, files: DataFrame, alias: str = "@/", root: str = "src/") -> DataFrame:
    """Climbing imports that have an alias, and aliased ones whose target no file is."""
    climb = imports.filter(F.col("source").rlike(r"^(?:\.\./){2,}")).withColumn("to", F.concat(F.lit(alias), F.regexp_replace("source", r"^(?:\.\./)+", "")))
    out = _found(climb, "import-intelligence/alias-canonical", "suggestion", F.col("to"))
    named = imports.filter(F.startswith("source", F.lit(alias))).withColumn("to", F.concat(F.lit(root), F.substring(F.col("source"), len(alias) + 1, 1 << 20)))
    tries = named.select("path", "num", "source", F.explode(F.array(*[F.concat("to", F.lit(s)) for s in SUFFIXES])).alias("target"))
    found = tries.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("path", "num").distinct()
    return out.unionByName(_found(named.join(found, ["path", "num"], "left_anti"), "import-intelligence/broken-alias", "error", F.col("source")))


def package_edges(lines: DataFrame) -> DataFrame:
    """src, dst between Go packages, by the last part of what they import."""
    go = lines.filter("lang = 'go'")
    own = go.withColumn("src", extract(F.col("text"), r"^package\s+(\w+)", 1)).filter("src <> ''").select("path", "src").distinct()
    to = go.withColumn("dst", extract(F.col("text"), r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?:[^\"]*/)?([A-Za-z_]\w*)\"\s*\z", 1)).filter("dst <> ''").select("path", "dst")
    local = own.select(F.col("src").alias("dst")).distinct()
    return to.join(local, "dst", "left_semi").join(own, "path").select("src", "dst").distinct()


def package_cycles(lines: DataFrame, deepest: int = 5) -> DataFrame:
    """Go packages that import each other in a circle of at most ``deepest``: a finding at the first file of each folder."""
    rings = cycle_members(package_edges(lines), deepest).filter("size(members) > 1").select(F.array_sort("members").alias("ring")).distinct()
    rings = rings.select(F.explode("ring").alias("package"), F.array_join("ring", " -> ").alias("ring"))
    own = lines.filter("lang = 'go'").withColumn("package", extract(F.col("text"), r"^package\s+(\w+)", 1)).filter("package <> ''")
    folders = own.groupBy("package", F.regexp_replace("path", r"/?[^/]*\z", "").alias("folder")).agg(F.min("path").alias("path"))
    return _found(folders.join(rings, "package").withColumn("num", F.lit(1)), "go-deep/package-cycle", "error", F.col("ring"))


def workspaces(files: DataFrame) -> DataFrame:
    """Workspace folders of a manifest that hold no file."""
    listed = files.filter(F.col("path").rlike(r"(?:^|/)package\.json\z")).select("path", F.explode(F.from_json("content", "struct<workspaces:array<string>>")["workspaces"]).alias("glob"))
    base = F.concat(F.regexp_replace("path", r"package\.json\z", ""), F.regexp_replace("glob", r"/?\*.*\z", ""))
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split("path", "/")) - 1)), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("folder")).distinct()
    return _found(listed.withColumn("folder", F.rtrim(base, F.lit("/"))).withColumn("num", F.lit(1)).join(folders, "folder", "left_anti"), "ast-slop/workspace-misconfig", "warning", F.col("glob"))
