"""Repairs of findings: what one would change, and its steps added to the pipeline only
if that is still the one that was looked at."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.errors import PreparationError
from tidemill.functions.codec import decode, encode
from tidemill.functions.expressions import quoted
from tidemill.functions.staging import staged
from tidemill.operators.health import Finding, Repair, RowFilter, repairs
from tidemill.operators.rows import ORDER, with_order
from tidemill.plans.pipeline import Pipeline, replay

SAMPLE_PAIRS = 8


class RepairConflict(PreparationError):
    """The pipeline is no longer the one that was previewed."""


@dataclass(frozen=True)
class Preview:
    fingerprint: str
    rows_before: int
    rows_after: int
    columns_before: int
    columns_after: int
    columns_removed: tuple[str, ...]
    #: Values of the columns on both sides that became null.
    values_lost: int
    #: Rows whose value in the finding's first column differs; 0 if rows go.
    changed_rows: int
    #: (before, after, rows) of the most frequent changes.
    samples: tuple[tuple[str | None, str | None, int], ...]

    @property
    def rows_removed(self) -> int:
        return max(self.rows_before - self.rows_after, 0)


def options(df: DataFrame, pipeline: Pipeline, finding: Finding) -> list[Repair]:
    return repairs(replay(df, pipeline.steps), finding)


def _chosen(df: DataFrame, pipeline: Pipeline, finding: Finding, title: str) -> Repair:
    for option in options(df, pipeline, finding):
        if option.title == title:
            return option
    raise PreparationError(f"{finding.code} has no repair {title!r}")


def _counted(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(F.when(quoted(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(columns))).first()
    return row[0], {c: row[i + 1] for i, c in enumerate(columns)}


def preview(df: DataFrame, pipeline: Pipeline, finding: Finding, title: str) -> Preview:
    """What the repair ``title`` of a finding would change in the pipeline's result.

    The present state is staged once with an id for each row; the repaired one comes
    from it, so that rows are told by their ids and not by their values."""
    option = _chosen(df, pipeline, finding, title)
    before = staged(with_order(replay(df, pipeline.steps, keep_order=True)))
    after = replay(before, option.steps, keep_order=True)
    ours, theirs = [c for c in before.columns if c != ORDER], [c for c in after.columns if c != ORDER]
    shared = [c for c in theirs if c in ours]
    rows_before, nulls_before = _counted(before, shared)
    rows_after, nulls_after = _counted(after, shared)
    touched = [c for c in finding.columns if c in shared]
    changed, samples = 0, ()
    if touched and rows_before == rows_after:
        text = quoted(touched[0]).cast("string")
        pairs = before.select(ORDER, text.alias("before")).join(after.select(ORDER, text.alias("after")), ORDER).filter(~F.col("before").eqNullSafe(F.col("after")))
        counted = staged(pairs.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n")))
        changed = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        samples = tuple((r["before"], r["after"], r["n"]) for r in counted.orderBy(F.desc("n"), "before", "after").limit(SAMPLE_PAIRS).collect())
    lost = sum(max(nulls_after[c] - nulls_before[c], 0) for c in shared)
    return Preview(pipeline.fingerprint(), rows_before, rows_after, len(ours), len(theirs), tuple(c for c in ours if c not in theirs), lost, changed, samples)


def apply(df: DataFrame, pipeline: Pipeline, finding: Finding, title: str, expected: str) -> Pipeline:
    """The pipeline with the repair's steps, whose ids tell where they come from.
    Refused unless the pipeline's fingerprint is ``expected``, that of the preview."""
    if pipeline.fingerprint() != expected:
        raise RepairConflict("the pipeline changed after the preview; look at it again")
    option = _chosen(df, pipeline, finding, title)
    return pipeline.append(*(replace(s, step_id=f"repair-{finding.code}-{secrets.token_hex(4)}") for s in option.steps))


def stored_filter(rows: RowFilter, df: DataFrame) -> dict[str, Any]:
    """A finding's filter as JSON values; its values keep their exact types."""
    kind = df.schema[rows.columns[0]].dataType if rows.columns else None
    return {"kind": rows.kind, "columns": list(rows.columns), "values": [encode(v, kind) for v in rows.values], "low": rows.low, "high": rows.high}


def loaded_filter(stored: dict[str, Any], df: DataFrame) -> RowFilter:
    kind = df.schema[stored["columns"][0]].dataType if stored["columns"] else None
    return RowFilter(stored["kind"], tuple(stored["columns"]), tuple(decode(v, kind) for v in stored["values"]), stored["low"], stored["high"])
