import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.errors import PreparationError
from tidemill.functions.expressions import parse_number
from tidemill.functions.formula import compile_formula
from tidemill.operators import decision, health, joins, robust, skyline
from tidemill.operators.health import RowFilter
from tidemill.operators.joins import JoinSpec
from tidemill.operators.rows import ORDER, ordinals, with_order
from tidemill.operators.steps import OPERATIONS, Step
from tidemill.plans import sql_window
from tidemill.plans.pipeline import Pipeline, impact, lineage, plan, replay, required_columns
from tidemill.sources.readers import read_table
from tidemill.sources.package import write_package
from tidemill.sources.writers import export, fingerprint


@pytest.fixture(scope="module")
def messy(spark):
    rows = [("Moscow ", "1 200,50", "done"), ("moscow", "н/д", "Done"), ("Kazan", "-", None), ("Kazan", "7", "new"), ("Kazan", "7", "new")]
    return spark.createDataFrame(rows, "city string, amount string, status string")


def test_pipeline_replay_undo_and_lineage(spark, messy):
    todo = (
        Step("trim_whitespace", {"columns": ["city"]}),
        Step("change_case", {"columns": ["city"], "mode": "title"}),
        Step("normalize_nulls", {"columns": ["amount"]}),
        Step("parse_number", {"column": "amount"}),
        Step("deduplicate", {"columns": ["city", "amount"]}),
        Step("add_column", {"name": "double", "expression": "[amount] * 2"}),
    )
    got = [tuple(r) for r in replay(messy, todo).orderBy("city", F.desc_nulls_last("amount")).collect()]
    assert got == [("Kazan", 7.0, "new", 14.0), ("Kazan", None, None, None), ("Moscow", 1200.5, "done", 2401.0), ("Moscow", None, "Done", None)]
    assert [p.effect.rows for p in plan(messy, todo)] == [False, False, False, False, True, False]
    told = lineage(messy, todo)
    assert told["double"].sources == ("amount",) and told["city"].steps == (1, 2)
    assert required_columns(messy, (*todo, Step("drop_columns", {"columns": ["status"]}))) == ("city", "amount")
    lost = impact(messy, todo[:3], todo[3])
    assert (lost.rows_before, lost.rows_after, lost.lost) == (5, 5, {})
    p = Pipeline().append(todo[0]).append(todo[1])
    assert p.undo().steps == todo[:1] and p.undo().redo().steps == todo[:2]
    assert p.fingerprint() != p.undo().fingerprint()


def test_each_step_on_each_type_works_or_refuses(spark):
    df = spark.sql("SELECT * FROM VALUES (1Y, 2L, 'NaN'::double, true, ' 1,5 ', DATE'2024-02-01', TIMESTAMP_NTZ'2024-02-01 10:00:00', array(1)), (NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL) AS t(i, l, f, b, s, d, ts, a)")
    params = {"to": "x2", "name": "x2", "expression": "1", "order": df.columns, "operator": "eq", "value": "1", "mode": "lower"}
    for kind in OPERATIONS:
        for c in df.columns:
            for to in ("x2", "integer", "float", "string", "boolean", "date", "datetime") if kind == "cast_column" else ("x2",):
                step = Step(kind, params | {"column": c, "columns": [c], "to": to if kind != "replace_values" else "2"} | ({"mode": "exact"} if kind == "replace_values" else {}))
                try:
                    replay(df, (step,)).collect()
                except PreparationError:
                    pass


def test_sort_then_keep_first_follows_the_new_order(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).repartition(5)
    got = {r["k"]: r["v"] for r in replay(df, (Step("sort_rows", {"column": "v", "descending": True}), Step("deduplicate", {"columns": ["k"]}))).collect()}
    assert got == {k: max(v for v in range(100) if v % 7 == k) for k in range(7)}


def test_ordinals_are_dense(spark):
    df = ordinals(with_order(spark.range(50).repartition(4)), "n").collect()
    assert sorted(r["n"] for r in df) == list(range(50))
    assert [r["n"] for r in sorted(df, key=lambda r: r[ORDER])] == list(range(50))


@pytest.mark.parametrize(
    ("text", "want"),
    [("7 // 2", 3.0), ("-7 % 3", 2.0), ("1 / 0", math.inf), ("x ** 2", 9.0), ("min(x, 5)", 3), ("len(strip(s))", 2), ("s + '!'", " ab!"), ("1 < x <= 3", True), ("num('1e2')", 100.0), ("int('2.9')", 2), ("round(2.5)", 2.0), ("log(0)", -math.inf), ("concat(s, None, x)", " ab3"), ("contains(s, 'b') and not startswith(s, 'b')", True)],
)
def test_formula(spark, text, want):
    df = spark.createDataFrame([(3, " ab")], "x int, s string")
    assert df.select(compile_formula(text, df.schema).alias("v")).first()["v"] == want


@pytest.mark.parametrize("text", ["__import__('os')", "x.y", "s + 1", "x + 's'", "[nope]", "lambda: 1", "x if s else 1", "open('f')", "x == s", "(" * 40 + "x" + ")" * 40 + "+" * 3, "'a' * 3"])
def test_formula_refuses(spark, text):
    with pytest.raises(PreparationError):
        compile_formula(text, spark.createDataFrame([(3, "ab")], "x int, s string").schema)


def test_forecast_equals_the_join(spark):
    rng = random.Random(5)
    for kinds in (("bigint", "int"), ("double", "bigint"), ("string", "string"), ("double", "double")):
        make = {"bigint": lambda: rng.choice([None, 1, 2, 3]), "int": lambda: rng.choice([None, 2, 3, 4]), "double": lambda: rng.choice([None, 1.0, 2.0, float("nan"), -0.0, 0.0]), "string": lambda: rng.choice([None, "", "a", "b"])}
        a = spark.createDataFrame([(make[kinds[0]](), i) for i in range(12)], f"k {kinds[0]}, v int")
        b = spark.createDataFrame([(make[kinds[1]](), i) for i in range(15)], f"k {kinds[1]}, w int")
        for kind in joins.KINDS:
            spec = JoinSpec((("k", "k"),), kind)
            assert joins.forecast(a, b, spec).first()["estimated_rows"] == joins.join(a, b, spec).count(), (kinds, kind)


def test_join_refuses_and_names(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([("1", "y")], "k string, v string")
    with pytest.raises(PreparationError):
        joins.join(a, b, JoinSpec((("k", "k"),)))
    assert joins.join(a, a, JoinSpec((("k", "k"),), "full")).columns == ["k", "v", "k_2", "v_2"]


def test_health_counts_equal_rows(spark):
    rows = [(i, "Moscow" if i % 3 else " moscow", None if i % 20 == 0 else float(i % 10), None, "one", "12" if i % 9 else "n/a", 999999.0 if i == 7 else float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, city string, amount double, empty string, one string, mixed string, out double")
    found = health.analyse(df)
    codes = {f.code for f in found}
    assert {"all_null_column", "missing_values", "whitespace_anomaly", "case_variant_categories", "mixed_semantic_types", "constant_column", "potential_identifier", "outlier_values"} <= codes
    for f in found:
        if f.rows is not None:
            assert health.affected_rows(df, f.rows).count() == f.affected, f
        for r in health.repairs(df, f):
            replay(df, r.steps).count()
    assert health.count_affected(df.union(df), RowFilter("duplicated_by")) == 400
    assert health.analyse(df.limit(0)) == []


def test_topsis_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9, 10.0), (2, 0.8, 5.0), (3, 0.7, 20.0)], "k int, q double, ms double")
    got = {r["k"]: (round(r["closeness"], 6), r["rank"]) for r in decision.topsis(df, "k", {"q": "max", "ms": "min"}, {"q": 0.6, "ms": 0.4}).collect()}
    assert got == {1: (0.690431, 2), 2: (0.860346, 1), 3: (0.0, 3)}
    assert sum(r["share"] for r in robust.weight_shares(df, "k", {"q": "max", "ms": "min"}, samples=200).collect()) == pytest.approx(1)
    many = spark.range(3000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    rows = [tuple(r) for r in many.collect()]
    want = {i for i, a, b in rows if not any(c >= a and d <= b and (c > a or d < b) for _, c, d in rows)}
    assert {r["id"] for r in skyline.pareto(spark.createDataFrame(rows, "id long, a double, b double"), "id", {"a": "max", "b": "min"}).collect()} == want


def test_sql_guard(spark):
    t = {"orders": spark.range(5).withColumnRenamed("id", "k"), "данные": spark.range(2)}
    assert sql_window.run(spark, "SELECT k FROM orders ORDER BY k", t, rows=2).rows == [(0,), (1,)]
    assert sql_window.run(spark, "SELECT k FROM orders ORDER BY k", t, rows=2).truncated == "rows"
    sql_window.check(spark, "WITH a AS (SELECT k FROM orders) SELECT count(*) FROM a WHERE k IN (SELECT k FROM orders)", tuple(t))
    for bad in (
        "",
        "SELECT 1",
        "DROP TABLE orders",
        "CREATE TABLE x AS SELECT * FROM orders",
        "INSERT INTO orders SELECT 1",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM orders",
        "SELECT * FROM orders WHERE k = (SELECT reflect('java.lang.Math', 'abs', 1))",
        "SELECT * FROM range(5), orders",
        "SELECT * FROM nowhere",
        "SELECT * FROM spark_catalog.default.orders",
        "SELECT k FROM orders; SELECT 1",
        "SELECT k FROM orders WHERE 'a' LIKE '" + "%a" * 30 + "'",
        "WITH a AS (SELECT current_user() AS u FROM orders) SELECT * FROM a",
        "EXPLAIN SELECT * FROM orders",
    ):
        with pytest.raises(PreparationError):
            sql_window.check(spark, bad, tuple(t))


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a,b", True), (2, None, "x\"y", None), (None, 1.5, None, False), (4, -2.0, "=1+1", True)], "i int, f double, s string, b boolean").coalesce(1)
    for kind in ("csv", "tsv", "parquet", "jsonl", "orc"):
        path = str(tmp_path / f"t.{kind}")
        export(df, path, kind)
        got = read_table(spark, path, kind, df.schema if kind in ("csv", "tsv") else None).select("i", "f", "s", "b").orderBy(F.col("i").asc_nulls_last())
        want = [tuple(r) for r in df.orderBy(F.col("i").asc_nulls_last()).collect()]
        want = [("'=1+1" if kind in ("csv", "tsv") and c == "=1+1" else c) for row in want for c in row]
        assert [c for r in got.collect() for c in r] == want, kind
    for kind in ("json", "arrow"):
        path = str(tmp_path / f"u.{kind}")
        export(df, path, kind)
        assert read_table(spark, path).count() == 4
    assert fingerprint(df) == fingerprint(spark.createDataFrame(df.collect(), df.schema).coalesce(1))
    assert fingerprint(df) != fingerprint(df.orderBy(F.desc("i")).coalesce(1))
    assert write_package(df, str(tmp_path / "p"))["rows"] == 4
    (tmp_path / "c.csv").write_bytes("имя;число\nИван;1\nПётр;2\n".encode("cp1251"))
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "c.csv")).collect()] == [("Иван", 1), ("Пётр", 2)]
    (tmp_path / "b.csv").write_bytes(b"a\0b")
    with pytest.raises(PreparationError):
        read_table(spark, str(tmp_path / "b.csv"))


def test_key_suggestions_count_all_values(spark):
    left = spark.range(21000).select((F.col("id") * 7).alias("ref"))
    right = spark.range(150000).select(F.col("id").alias("key"))
    row = joins.suggest_keys(left, right).first()
    assert (row["left"], row["right"], row["overlap_share"], row["relation"]) == ("ref", "key", 1.0, "1:1")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 200,50", 1200.5), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("1.234.567", 1234567.0), ("1,234,567", 1234567.0), ("-1.234,56", -1234.56), ("+7", 7.0), ("12,5", 12.5), ("1.234", 1.234),
        ("1,234", 1.234), ("1\u00a0000", 1000.0), ("12.34,5", None), ("1,23,456", None), ("1.2.3", None), ("1.234,", None), (",5", 0.5), ("5.", 5.0), ("1,5e3", 1500.0), ("1.234,5e3", None), ("", None),
        ("abc", None), ("--5", None), ("1234.567,8", None), ("1.234,567.8", None), ("nan", float("nan")), ("5d", None), (None, None),
    ],
)
def test_parse_number(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(parse_number(F.col("s")).alias("v")).first()["v"]
    assert got == want or want != want and got != got


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT current_user FROM t", "SELECT session_user FROM t", "SELECT user FROM t", "SELECT current_database FROM t", "SELECT current_user() FROM t", "SELECT a.id FROM t a POSITIONAL JOIN t b", "SELECT * FROM t ASOF JOIN t b ON true",
        "SELECT 2 ^ 3 FROM t", "SELECT * FROM other", "DROP TABLE t", "SELECT * FROM range(3)", "SELECT input_file_name() FROM t", "SELECT 1", "", "SELECT * FROM t; SELECT * FROM t", "SELECT java_method('java.lang.System', 'exit', 1) FROM t",
        "SELECT * FROM parquet.`/etc`", "SELECT (SELECT current_user) FROM t", "WITH x AS (SELECT session_user AS s FROM t) SELECT * FROM x",
    ],
)
def test_sql_window_refuses(spark, sql):
    with pytest.raises(PreparationError):
        sql_window.query(spark, sql, {"t": spark.range(3)})


def test_sql_window_time_limit(spark):
    with pytest.raises(PreparationError, match="took more"):
        sql_window.run(spark, "SELECT count(*) FROM t WHERE sha2(CAST(id AS STRING), 256) < '0'", {"t": spark.range(10**11)}, seconds=2)


def test_findings_do_not_depend_on_the_number_of_columns(spark):
    df = spark.range(1000).select(*((F.when(F.col("id") % 500 == 0, 2).otherwise(1)).alias(f"c{i}") for i in range(3)), *(F.when(F.col("id") % 9 == 0, F.lit("Ab ")).otherwise("ab").alias(f"t{i}") for i in range(3)), *((F.col("id") % 10 + F.when(F.col("id") == 7, 1000).otherwise(0)).alias(f"n{i}") for i in range(3)))
    found = {(f.code, f.columns[0] if f.columns else ""): f for f in health.analyse(df)}
    for i in range(3):
        assert found["near_constant_column", f"c{i}"].affected == 2 and found["near_constant_column", f"c{i}"].rows.values == (1,)
        assert found["case_variant_categories", f"t{i}"].affected == 1000
        assert found["outlier_values", f"n{i}"].affected == 1
    for f in found.values():
        if f.rows and f.affected is not None:
            assert health.count_affected(df, f.rows) == f.affected
