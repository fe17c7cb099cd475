"""Snapshots of an evaluation: summary, details and worst segments under a version of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import metrics


def evaluation_snapshot(evaluated: DataFrame, diagnostics: DataFrame, path: str, version: str) -> str:
    """Writes the summary, the rows of ``metrics.evaluated_files`` and the segments that a reviewer should see as JSON to
    ``path``/``version``.  A version that is there already is an error, so a snapshot never changes.  Returns its path."""
    place = f"{path.rstrip('/')}/{version}"
    metrics.evaluation_summary(evaluated).write.json(f"{place}/summary")
    evaluated.write.json(f"{place}/details")
    metrics.worst(diagnostics).write.json(f"{place}/worst_segments")
    return place
