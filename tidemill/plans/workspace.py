"""Named datasets with pipelines, and joins of two as a dataset of its own: previewed,
refused where they would mislead, and written with a frozen history of both parents."""

from __future__ import annotations

import json
import re
import threading
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from tidemill.errors import PreparationError
from tidemill.operators import joins
from tidemill.operators.joins import JoinSpec
from tidemill.operators.steps import Step
from tidemill.plans.pipeline import Pipeline, lineage, replay
from tidemill.sources import versions

PREVIEW_ROWS, MAX_SNAPSHOT_BYTES, MAX_NAME = 50, 2 << 20, 120


class JoinConflict(PreparationError):
    """A parent's pipeline changed while its join was being made."""


@dataclass(frozen=True)
class Origin:
    """A source column and the steps, as (dataset, place in its pipeline), between it
    and the column whose origin it is."""

    dataset: str
    column: str
    steps: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class ParentSnapshot:
    """A parent as it was joined; what its pipeline becomes later changes nothing."""

    role: str
    dataset: str
    version: int
    fingerprint: str
    steps: tuple[dict, ...]
    columns: dict[str, tuple[Origin, ...]]
    truncated: bool = False


@dataclass(frozen=True)
class Provenance:
    kind: str
    keys: tuple[tuple[str, str], ...]
    suffix: str
    #: (side, parent's column, result's column)
    columns: tuple[tuple[str, str, str], ...]
    parents: tuple[ParentSnapshot, ParentSnapshot]


@dataclass(frozen=True)
class Dataset:
    name: str
    table: str
    pipeline: Pipeline = Pipeline()
    provenance: Provenance | None = None


def display_name(name: str) -> str:
    """A name to show: no folders, no control characters, not too long."""
    last = re.split(r"[/\\]", name.strip())[-1]
    clean = re.sub(r"[\x00-\x1f\x7f<>:\"|?*]", "", last).strip(" .")[:MAX_NAME]
    return clean or "join"


def _size(snapshot: ParentSnapshot) -> int:
    return len(json.dumps(asdict(snapshot), ensure_ascii=False, default=str).encode())


def within_budget(snapshot: ParentSnapshot, most: int = MAX_SNAPSHOT_BYTES) -> ParentSnapshot:
    """Trimmed in stages, each of them marked: first the steps on the way of columns
    (where a column comes from matters more), then the parameters of steps, then all
    but the parent's identity."""
    if _size(snapshot) <= most:
        return snapshot
    snapshot = replace(snapshot, truncated=True, columns={c: tuple(dict.fromkeys(replace(o, steps=()) for o in origins)) for c, origins in snapshot.columns.items()})
    if _size(snapshot) <= most:
        return snapshot
    snapshot = replace(snapshot, steps=tuple({**s, "params": {}} for s in snapshot.steps))
    return snapshot if _size(snapshot) <= most else replace(snapshot, steps=(), columns={})


class Workspace:
    """Datasets by name, in tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.datasets: dict[str, Dataset] = {}
        self._lock = threading.Lock()

    def __getitem__(self, name: str) -> Dataset:
        if name not in self.datasets:
            raise PreparationError(f"there is no dataset {name!r}")
        return self.datasets[name]

    def _free(self, name: str) -> str:
        name = display_name(name)
        if name in self.datasets:
            raise PreparationError(f"there is a dataset {name!r} already")
        return name

    def add(self, name: str, df: DataFrame) -> Dataset:
        name = self._free(name)
        table = f"{self.root}/{len(self.datasets):04d}"
        versions.commit(df, table)
        self.datasets[name] = Dataset(name, table)
        return self.datasets[name]

    def set_steps(self, name: str, *steps: Step) -> Dataset:
        with self._lock:
            self.datasets[name] = replace(self[name], pipeline=self[name].pipeline.with_steps(steps))
            return self.datasets[name]

    def stored(self, name: str) -> DataFrame:
        return versions.read_current(self.spark, self[name].table)

    def frame(self, name: str) -> DataFrame:
        """The dataset after its pipeline."""
        return replay(self.stored(name), self[name].pipeline.steps)

    def origins(self, name: str) -> dict[str, tuple[Origin, ...]]:
        """Where each column of the dataset's result comes from, through all joins;
        from the recorded snapshots, whatever the parents are now. No data is read."""
        dataset = self[name]
        return _origins(dataset, self.stored(name))

    def snapshot(self, name: str, role: str, columns: list[str]) -> ParentSnapshot:
        dataset = self[name]
        found = _origins(dataset, self.stored(name))
        version = versions.current(self.spark, dataset.table).version
        steps = tuple({"id": s.step_id, "kind": s.kind, "params": s.params} for s in dataset.pipeline.steps)
        return within_budget(ParentSnapshot(role, name, version, dataset.pipeline.fingerprint(), steps, {c: found[c] for c in columns if c in found}))

    def _sides(self, left: str, right: str) -> tuple[DataFrame, DataFrame]:
        if left == right:
            raise PreparationError("a dataset is not joined with itself here")
        return self.frame(left), self.frame(right)

    def preview(self, left: str, right: str, spec: JoinSpec, rows: int = PREVIEW_ROWS) -> DataFrame:
        """The first rows of the join, in the order of the sides."""
        return joins.join(*self._sides(left, right), spec, in_order=True).limit(rows)

    def materialise(self, left: str, right: str, spec: JoinSpec, name: str) -> Dataset:
        """The join as a dataset of its own. Refused: a dataset with itself, a result
        without rows (the forecast tells, so no join is run for it), a taken name, and
        parents whose pipelines change before the result is written."""
        name = self._free(name)
        before = {n: self[n].pipeline.fingerprint() for n in (left, right)}
        ours, theirs = self._sides(left, right)
        if joins.forecast(ours, theirs, spec).first()["estimated_rows"] == 0:
            raise PreparationError("no rows meet; look at the key")
        columns = joins.layout(ours, theirs, spec)
        parents = tuple(self.snapshot(n, role, [c for side, c, _ in columns if side == role] + [k[i] for k in spec.keys]) for n, role, i in ((left, "left", 0), (right, "right", 1)))
        table = f"{self.root}/{len(self.datasets):04d}"
        versions.commit(joins.join(ours, theirs, spec), table)
        with self._lock:
            for parent in parents:
                if not before[parent.dataset] == parent.fingerprint == self[parent.dataset].pipeline.fingerprint():
                    raise JoinConflict(f"the pipeline of {parent.dataset!r} changed meanwhile; join again")
            self.datasets[name] = Dataset(name, table, Pipeline(), Provenance(spec.kind, tuple(spec.keys), spec.suffix, tuple(columns), parents))
        return self.datasets[name]


def _origins(dataset: Dataset, stored: DataFrame) -> dict[str, tuple[Origin, ...]]:
    came = dataset.provenance
    base: dict[str, tuple[Origin, ...]] = {}
    for c in stored.columns:
        base[c] = (Origin(dataset.name, c),)
    if came:
        by_role = {p.role: p for p in came.parents}
        for side, source, name in came.columns:
            base[name] = by_role[side].columns.get(source, (Origin(by_role[side].dataset, source),))
    out = {}
    for c, history in lineage(stored, dataset.pipeline.steps).items():
        own = tuple((dataset.name, at) for at in history.steps)
        out[c] = tuple(dict.fromkeys(replace(o, steps=(*o.steps, *own)) for s in history.sources for o in base[s]))
    return out
