"""Repairs that are previewed and guarded, and joins that become datasets."""

import pytest
from pyspark.sql import functions as F

from tidemill.errors import PreparationError
from tidemill.operators import health, joins
from tidemill.operators.joins import JoinSpec
from tidemill.operators.steps import Step
from tidemill.plans import repair_flow, workspace
from tidemill.plans.pipeline import Pipeline, replay


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [(i, ["Paris", "paris ", "PARIS", "Rome", "Oslo"][i % 5] if i % 9 else None, float(i) if i != 30 else 1e6, None) for i in range(60)]
    return spark.createDataFrame(rows, "id int, city string, amount double, note string").repartition(5)


def finding_of(df, code, column=None):
    return next(f for f in health.analyse(df) if f.code == code and (column is None or f.columns == (column,)))


def test_preview_of_changed_values(spark, dirty):
    found = finding_of(dirty, "case_variant_categories")
    option = next(o for o in repair_flow.options(dirty, Pipeline(), found) if o.safety == "safe")
    got = repair_flow.preview(dirty, Pipeline(), found, option.title)
    # 47 rows hold Paris in three spellings and others; one spelling stays.
    rows = [r["city"] for r in dirty.collect()]
    after = [r["city"] for r in replay(dirty, option.steps).collect()]
    moved = sum(rows.count(s) for s in set(rows) - {None}) - sum(min(rows.count(s), after.count(s)) for s in set(rows) - {None})
    assert got.changed_rows == moved == sum(n for *_, n in got.samples) > 10 and got.rows_removed == 0 and got.values_lost == 0
    assert all(b != a for b, a, _ in got.samples) and list(got.samples) == sorted(got.samples, key=lambda x: (-x[2], x[0], x[1]))


def test_preview_of_lost_rows_and_columns(spark, dirty):
    missing = finding_of(dirty, "missing_values", "city")
    got = repair_flow.preview(dirty, Pipeline(), missing, "drop the rows")
    assert (got.rows_before, got.rows_after, got.rows_removed, got.changed_rows, got.samples) == (60, 53, 7, 0, ())
    empty = finding_of(dirty, "all_null_column")
    got = repair_flow.preview(dirty, Pipeline(), empty, "drop the column")
    assert (got.columns_before, got.columns_after, got.columns_removed) == (4, 3, ("note",))


def test_preview_counts_lost_values(spark):
    df = spark.createDataFrame([(i, "n/a" if i % 10 == 0 else str(i)) for i in range(100)], "id int, v string")
    found = finding_of(df, "mixed_semantic_types")
    got = repair_flow.preview(df, Pipeline(), found, "marks to null, then numbers")
    assert got.values_lost == 10 and got.changed_rows == 100 and len(got.samples) == repair_flow.SAMPLE_PAIRS


def test_preview_is_of_the_pipelines_result(spark, dirty):
    pipeline = Pipeline().append(Step("filter_rows", {"column": "id", "operator": "lt", "value": "40"}))
    found = finding_of(replay(dirty, pipeline.steps), "missing_values", "city")
    assert repair_flow.preview(dirty, pipeline, found, "drop the rows").rows_before == 40


def test_apply_is_refused_after_a_change(spark, dirty):
    found = finding_of(dirty, "missing_values", "city")
    pipeline = Pipeline()
    seen = repair_flow.preview(dirty, pipeline, found, "drop the rows")
    done = repair_flow.apply(dirty, pipeline, found, "drop the rows", seen.fingerprint)
    assert replay(dirty, done.steps).count() == 53 and done.steps[-1].step_id.startswith("repair-missing_values-") and done.undo().steps == ()
    with pytest.raises(repair_flow.RepairConflict):
        repair_flow.apply(dirty, done, found, "drop the rows", seen.fingerprint)
    with pytest.raises(PreparationError, match="no repair"):
        repair_flow.apply(dirty, pipeline, found, "wish it away", seen.fingerprint)


def test_filters_survive_json(spark, dirty):
    import json

    for found in health.analyse(dirty):
        if found.rows:
            again = repair_flow.loaded_filter(json.loads(json.dumps(repair_flow.stored_filter(found.rows, dirty))), dirty)
            assert health.affected_rows(dirty, again).count() == health.affected_rows(dirty, found.rows).count() == found.affected


@pytest.fixture
def space(spark, tmp_path):
    w = workspace.Workspace(spark, str(tmp_path))
    w.add("clients", spark.createDataFrame([(1, "Oslo"), (2, "Rome"), (4, "Bern")], "client_id int, city string"))
    w.add("orders", spark.createDataFrame([(10, 1, 5.0), (11, 1, 6.0), (12, 2, 7.0), (13, 99, 8.0)], "order_id int, client_id int, amount double"))
    w.add("goods", spark.createDataFrame([(10, "pen"), (12, "ink")], "order_id int, what string"))
    return w


ORDERS = JoinSpec((("client_id", "client_id"),))


def test_join_preview_and_dataset(spark, space):
    assert sorted(map(tuple, space.preview("orders", "clients", ORDERS).collect())) == [(10, 1, 5.0, "Oslo"), (11, 1, 6.0, "Oslo"), (12, 2, 7.0, "Rome")]
    assert space.preview("orders", "clients", ORDERS, rows=1).count() == 1
    made = space.materialise("orders", "clients", ORDERS, "with clients")
    assert sorted(map(tuple, space.frame("with clients").collect())) == [(10, 1, 5.0, "Oslo"), (11, 1, 6.0, "Oslo"), (12, 2, 7.0, "Rome")]
    assert made.provenance.kind == "inner" and [p.dataset for p in made.provenance.parents] == ["orders", "clients"]


def test_joins_that_are_refused(spark, space):
    with pytest.raises(PreparationError, match="itself"):
        space.materialise("orders", "orders", ORDERS, "x")
    with pytest.raises(PreparationError, match="itself"):
        space.preview("orders", "orders", ORDERS)
    with pytest.raises(PreparationError, match="no rows meet"):
        space.materialise("orders", "goods", JoinSpec((("client_id", "order_id"),)), "x")
    with pytest.raises(PreparationError, match="compared"):
        space.materialise("orders", "clients", JoinSpec((("client_id", "city"),)), "x")
    with pytest.raises(PreparationError, match="already"):
        space.materialise("orders", "clients", ORDERS, "goods")
    with pytest.raises(PreparationError, match="no dataset"):
        space.materialise("orders", "nothing", ORDERS, "x")
    assert set(space.datasets) == {"clients", "orders", "goods"}


def test_a_parent_that_changes_meanwhile(spark, space, monkeypatch):
    real = workspace.versions.commit

    def slow(*args):
        space.set_steps("clients", Step("drop_columns", {"columns": ["city"]}))
        return real(*args)

    monkeypatch.setattr(workspace.versions, "commit", slow)
    with pytest.raises(workspace.JoinConflict):
        space.materialise("orders", "clients", ORDERS, "x")
    assert "x" not in space.datasets


def test_origins_through_two_joins(spark, space):
    space.set_steps("orders", Step("add_column", {"name": "twice", "expression": "amount * 2"}), Step("rename_column", {"column": "amount", "to": "sum"}))
    space.materialise("orders", "clients", ORDERS, "one")
    space.set_steps("one", Step("add_column", {"name": "mixed", "expression": "twice + client_id"}))
    space.materialise("one", "goods", JoinSpec((("order_id", "order_id"),)), "two")
    before = space.origins("two")
    space.set_steps("orders")  # what parents become changes no history
    space.set_steps("one", Step("drop_columns", {"columns": ["city"]}))
    assert space.origins("two") == before
    names = {c: {(o.dataset, o.column) for o in found} for c, found in before.items()}
    assert names == {"order_id": {("orders", "order_id")}, "client_id": {("orders", "client_id")}, "sum": {("orders", "amount")}, "twice": {("orders", "amount")}, "city": {("clients", "city")}, "mixed": {("orders", "amount"), ("orders", "client_id")}, "what": {("goods", "what")}}
    assert {o.steps for o in before["mixed"] if o.column == "amount"} == {(("orders", 1), ("one", 1))}
    assert before["sum"][0].steps == (("orders", 2),)


def test_snapshots_are_trimmed_in_stages(space):
    found = {f"c{i}": (workspace.Origin("d", f"c{i}", tuple(("d", k) for k in range(50))),) for i in range(20)}
    whole = workspace.ParentSnapshot("left", "d", 1, "f", tuple({"id": str(i), "kind": "k", "params": {"x": "y" * 100}} for i in range(20)), found)
    size = workspace._size(whole)
    assert workspace.within_budget(whole, size) == whole
    one = workspace.within_budget(whole, size - 1)
    assert one.truncated and one.steps == whole.steps and all(o[0].steps == () for o in one.columns.values())
    two = workspace.within_budget(whole, workspace._size(one) - 1)
    assert two.columns == one.columns and all(s["params"] == {} for s in two.steps)
    three = workspace.within_budget(whole, workspace._size(two) - 1)
    assert (three.steps, three.columns, three.dataset, three.fingerprint) == ((), {}, "d", "f")


@pytest.mark.parametrize(("given", "shown"), [("../../x", "x"), ("a\x00b", "ab"), ("", "join"), ("..", "join"), ("C:\\t\\y.csv", "y.csv"), ("n" * 500, "n" * workspace.MAX_NAME)])
def test_names_to_show(given, shown):
    assert workspace.display_name(given) == shown
