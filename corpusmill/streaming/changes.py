"""Continuous scans: changes gathered until they are quiet, and the latest findings of each path."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quiet(changes: DataFrame, gap: str = "2 seconds", late: str = "1 minute", by: tuple[str, ...] = ()) -> DataFrame:
    """Sessions of changes: each ends when nothing has changed for ``gap``; works on streams (with a watermark) and tables."""
    rows = changes.withWatermark("ts", late) if changes.isStreaming else changes
    out = rows.groupBy(F.session_window("ts", gap).alias("session"), *by).agg(F.count("*").alias("n_changes"))
    return out.select(*by, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n_changes")


def rescan(files: DataFrame, scan: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """For each micro-batch of changed files (path, ext, lang, content), scan the last version of each."""

    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), "ts").alias("f")).select("f.*")
        write(scan(last.select("path", "ext", "lang", "content")), number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def latest_findings(findings: DataFrame) -> DataFrame:
    """What appears and what goes as a path is scanned again: path, rule, line, change (added or removed).

    ``findings`` is a stream of path, scan (a growing number) and found, an array of rule:line. The state of a path
    is its last set.
    """

    def update(key: tuple, batches, state: GroupState):
        known = set(state.get[0]) if state.exists else set()
        out = []
        for pdf in batches:
            for row in pdf.sort_values("scan").itertuples():
                now = set(row.found)
                out += [(key[0], x, "added") for x in sorted(now - known)] + [(key[0], x, "removed") for x in sorted(known - now)]
                known = now
        state.update((sorted(known),))
        yield pd.DataFrame(out, columns=["path", "finding", "change"])

    return findings.groupBy("path").applyInPandasWithState(update, "path string, finding string, change string", "found array<string>", "append", GroupStateTimeout.NoTimeout)


def repair_steps(scores: list[int], target: int, most: int) -> list[tuple[int, str]]:
    """The control of a repair loop over the score after each turn: keep, roll back if lower, stop at the target."""
    out, best = [], scores[0] if scores else 0
    for turn, s in enumerate(scores[1 : most + 1], 1):
        out.append((turn, "rollback" if s < best else "keep"))
        best = max(best, s)
        if best >= target:
            out.append((turn, "stop"))
            break
    return out
