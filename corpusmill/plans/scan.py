"""A whole scan: detectors chosen from a registry, their findings overridden, suppressed, scored and counted."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import context_rules, folds, headers, line_rules, relations, syntax, views
from corpusmill.operators.project import config as read_config
from corpusmill.operators.project import alias_names, config_lint, declared
from corpusmill.plans import findings as P
from corpusmill.plans.storage import Scratch
from corpusmill.sources.diffs import in_ranges

COLUMNS = ["path", "rule", "severity", "line", "col", "message"]
#: Characters of text whose lines one task keeps.
CHARS = 1 << 21


@dataclass
class Context:
    """What detectors read: files and the relations made of them.

    Lines are dealt and sorted by file once and kept, so that no window of a detector moves or sorts them again. They
    are dealt to as many tasks as the text needs: every branch of every detector reads all of these, so that a fixed
    number would be thousands of empty tasks on a small corpus, and too large ones on a large corpus.
    """

    files: DataFrame
    config: dict
    disabled: set[str] = field(default_factory=set)

    def release(self) -> None:
        """Give the memory of the kept lines and imports back, when nothing will be read again."""
        self.lines.unpersist()
        self.imports.unpersist()

    def __post_init__(self):
        n = -(-(self.files.agg(F.sum(F.length("content"))).first()[0] or 1) // CHARS)
        self.lines = views.lines(self.files).repartition(n, "path").sortWithinPartitions("path", "num").persist(StorageLevel.MEMORY_AND_DISK)
        self.imports = views.imports(self.lines).persist(StorageLevel.MEMORY_AND_DISK)
        self.exports = views.exports(self.lines)


Detector = Callable[[Context], DataFrame]
REGISTRY: dict[str, Detector] = {}


def detector(name: str):
    """Add a detector (own or of a plugin): a function of a Context that returns findings."""

    def add(f: Detector) -> Detector:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered already")
        REGISTRY[name] = f
        return f

    return add


def check_plugin(plugin: object, path: str) -> list[str]:
    """What a plugin lacks: a name, a description, the languages that it reads, and run, a function of a Context."""
    lacks = [f"{path}: {x} must be a text that is not empty" for x in ("name", "description") if not (isinstance(getattr(plugin, x, None), str) and getattr(plugin, x).strip())]
    langs = getattr(plugin, "languages", None)
    if not isinstance(langs, (list, tuple)) or not langs or not all(isinstance(x, str) and x.strip() for x in langs):
        lacks.append(f"{path}: languages must be a list of texts that is not empty")
    if not callable(getattr(plugin, "run", None)):
        lacks.append(f"{path}: run must be a function")
    return lacks


def load_plugin(path: str) -> list[str]:
    """Register the detector of a Python file that defines ``plugin``; what is wrong with it, if anything.

    The file runs on the driver, so it must be trusted; its run gets a Context whose files are those of its languages.
    """
    spec = importlib.util.spec_from_file_location(f"corpusmill_plugin_{Path(path).stem}", path)
    try:
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    except Exception as e:  # noqa: BLE001  a plugin may fail in any way
        return [f"{path}: {e}"]
    plugin = getattr(module, "plugin", None)
    if lacks := check_plugin(plugin, path):
        return lacks
    detector(plugin.name)(lambda c: plugin.run(Context(c.files.filter(F.col("lang").isin(*plugin.languages)), c.config, c.disabled)))
    return []


detector("lines")(lambda c: line_rules.detect(c.lines, disabled=c.disabled))
detector("context")(lambda c: context_rules.all_rules(c.files, c.lines))
detector("more-context")(lambda c: context_rules.more_rules(c.files, c.lines))
detector("folds")(lambda c: folds.all_folds(c.files))
detector("tree")(lambda c: syntax.tree_rules(c.files))
detector("numbers")(lambda c: line_rules.precision_loss(c.lines))
detector("copied-functions")(lambda c: relations.copied_function_findings(folds.functions(c.files)))
detector("config")(lambda c: config_lint(c.files))


detector("unused-imports")(lambda c: relations.unused_imports(c.imports, c.lines))
detector("import-forms")(lambda c: relations.duplicate_imports(c.imports).unionByName(relations.tree_shakeable(c.imports)).unionByName(relations.type_only_imports(c.imports, c.lines)))
detector("import-targets")(lambda c: relations.aliases(c.imports, c.files).unionByName(relations.barrel_bypass(c.imports, relations.reexports(c.lines))))
detector("undeclared-imports")(lambda c: relations.undeclared_imports(c.imports, declared(c.files), alias_names(c.files)))
detector("unused-exports")(lambda c: relations.unused_exports(c.exports, c.imports))
detector("architecture")(lambda c: relations.high_coupling(c.imports, c.config["quality"]["maxCoupling"]).unionByName(relations.layer_violation(c.imports)))
detector("cycles")(lambda c: relations.circular_dependency(c.imports, c.files, c.config["imports"]["maxCircularDepth"]))
detector("selectors")(lambda c: relations.unused_selectors(c.lines))
detector("parameters")(lambda c: headers.parameter_rules(c.lines))
detector("go-packages")(lambda c: relations.package_cycles(c.lines))
detector("workspaces")(lambda c: relations.workspaces(c.files))


def findings(files: DataFrame, config: dict | None = None, engines: list[str] | None = None, at_once: int = 0, changes: DataFrame | None = None) -> DataFrame:
    """All findings of the engines (detector names) chosen, after overrides and suppression, one a path, line and rule.

    With ``at_once`` each detector's findings are written to a scratch table, that many detectors at a time, so that
    their plans are made and compiled side by side; otherwise all are one lazy plan. ``changes`` (path, start, stop)
    leaves the findings on changed lines.
    """
    cfg = read_config(config)
    off = {r for r, s in cfg["rules"].items() if s == "off" and not r.endswith("*")}
    context = Context(files, cfg, off)
    names = engines or list(REGISTRY)
    if at_once:
        scratch = Scratch(files.sparkSession, "scan")
        with ThreadPoolExecutor(at_once) as pool:
            rows = list(pool.map(lambda n: scratch.keep(REGISTRY[n](context).select(*COLUMNS), re.sub(r"\W+", "-", n)), names))
        context.release()
    else:
        rows = [REGISTRY[n](context).select(*COLUMNS) for n in names]
    out = syntax.in_code(reduce(DataFrame.unionByName, rows), context.lines)
    out = P.override(out, list(cfg["rules"].items())) if cfg["rules"] else out
    out = P.first_of_each(P.suppress(P.translation_gate(out, files), context.lines))
    return out if changes is None else in_ranges(out, changes)


def result(files: DataFrame, found: DataFrame, n_files: int, config: dict | None = None) -> DataFrame:
    """One row: the score with its label, and the numbers of findings by severity."""
    cfg = read_config(config)["scoring"]
    own = P.score(found, n_files, smoothing=float(cfg["smoothing"]), max_per_rule=float(cfg["maxPerRule"]), mode=cfg["mode"])
    counts = found.agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s}") for s in ("error", "warning", "info", "suggestion")])
    empty = found.sparkSession.createDataFrame([(1,)], "one int")
    rows = empty.join(own.withColumn("one", F.lit(1)), "one", "left").join(counts.withColumn("one", F.lit(1)), "one", "left")
    return rows.select(F.coalesce("score", F.lit(100)).alias("score"), F.coalesce("label", F.lit("healthy")).alias("label"), "n_error", "n_warning", "n_info", "n_suggestion")


def timings(runs: DataFrame) -> DataFrame:
    """engine, n, avg, min, max, total of (engine, ms), the slowest first."""
    return runs.groupBy("engine").agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.sum("ms").alias("total_ms")).orderBy(F.desc("total_ms"), "engine")


def html_trend(history: DataFrame) -> str:
    """A page with the numbers of a scan history (a row a scan; a report's limit is its last 500 scans)."""
    rows = history.orderBy(F.desc("timestamp")).limit(500).collect()[::-1]
    scores = [r.score for r in rows if r.score is not None]
    if not scores:
        return "<html><body><p>No scans yet.</p></body></html>"
    step = 600 / max(1, len(scores) - 1)
    line = " ".join(f"{i * step:.1f},{200 - 2 * s}" for i, s in enumerate(scores))
    return f'<html><body><h1>Scores</h1><p>{len(scores)} scans, {min(scores)} to {max(scores)}, mean {sum(scores) / len(scores):.1f}</p><svg width="600" height="200"><polyline points="{line}" fill="none" stroke="black"/></svg></body></html>'
