"""What the SQL window refuses, and what it must not refuse."""

import pytest
from pyspark.sql import functions as F

from tidemill.errors import PreparationError
from tidemill.plans import sql_window

NATION = "/root/testdata/sf0.001/nation.parquet"


@pytest.fixture(scope="module")
def tables(spark):
    orders = spark.range(200).select(F.col("id"), (F.col("id") * 1.5).alias("amount"), F.element_at(F.array(*map(F.lit, ("RU", "US", "DE", "FR"))), (F.col("id") % 4 + 1).cast("int")).alias("country"), F.lit("q").alias("version"))
    return {"orders": orders, "users": orders.select("id", F.concat(F.lit("u"), "id").alias("name"), F.array("id").alias("many"))}


@pytest.mark.parametrize(
    "sql",
    [
        # Names that are computed, files, other catalogues, time travel, streams.
        f"SELECT count(*) FROM orders, IDENTIFIER('parquet.`{NATION}`')", f"SELECT * FROM orders JOIN IDENTIFIER('parq' || 'uet.`{NATION}`') ON true", "SELECT * FROM IDENTIFIER('orders')", f"SELECT * FROM orders, parquet.`{NATION}`",
        "SELECT * FROM orders, spark_catalog.default.orders", "SELECT * FROM orders VERSION AS OF 1", "SELECT * FROM STREAM orders", f"SELECT (SELECT count(*) FROM parquet.`{NATION}`) FROM orders", f"SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM csv.`{NATION}`)",
        f"WITH x AS (SELECT * FROM parquet.`{NATION}`) SELECT * FROM x, orders", f"SELECT * FROM orders, LATERAL (SELECT * FROM parquet.`{NATION}`)", f"SELECT id FROM orders UNION SELECT n_nationkey FROM parquet.`{NATION}`",
        # Functions that reach outside, however named.
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.name') FROM orders", "SELECT IDENTIFIER('current_user')() FROM orders", "SELECT IDENTIFIER('id') FROM orders", "SELECT system.builtin.current_user() FROM orders",
        "SELECT java_method('java.lang.System', 'exit', 1) FROM orders", "SELECT reflect('java.lang.Math', 'abs', 1) FROM orders", "SELECT try_reflect('java.lang.Math', 'abs', 1) FROM orders", "SELECT version() FROM orders", "SELECT current_user FROM orders", "SELECT CURRENT_DATABASE() FROM orders",
        "SELECT input_file_name() FROM orders", "SELECT raise_error('x') FROM orders", "SELECT spark_partition_id() FROM orders", "SELECT my_function(id) FROM orders", "SELECT transform(array(1), x -> current_user()) FROM orders",
        "SELECT id FROM orders ORDER BY current_user()", "SELECT sum(id) OVER (PARTITION BY current_user()) FROM orders", "SELECT count(*) FILTER (WHERE current_user() = 'root') FROM orders", "SELECT id FROM orders GROUP BY id, uuid()", "SELECT * FROM orders a JOIN users b ON a.id = b.id AND version() = ''",
        "SELECT CASE WHEN true THEN current_schema() END FROM orders", "SELECT id FROM orders HAVING current_user() = ''", "SELECT * FROM orders LATERAL VIEW explode(array(current_user())) t AS u",
        # Statements, scripts, variables, parameters.
        "BEGIN CREATE TEMPORARY VIEW hacked AS SELECT * FROM orders; SELECT * FROM hacked; END", "BEGIN SELECT * FROM orders; END", "EXECUTE IMMEDIATE 'SELECT * FROM orders'", "DECLARE x INT", "SET VAR x = 1", "SET spark.sql.ansi.enabled=false", "CREATE VIEW v AS SELECT * FROM orders",
        "CREATE TABLE evil AS SELECT * FROM orders", "INSERT INTO orders VALUES (1)", "UPDATE orders SET amount = 0", "DROP TABLE orders", "CACHE TABLE orders", "EXPLAIN SELECT * FROM orders", "DESCRIBE orders", "SHOW TABLES", "SELECT TRANSFORM(id) USING 'cat' FROM orders", "ADD JAR 'x'", "ANALYZE TABLE orders COMPUTE STATISTICS",
        "SELECT :p FROM orders", "SELECT ? FROM orders", "SELECT * FROM orders; DROP TABLE orders", "SELECT 1 FROM orders; SELECT 2 FROM orders", " DROP TABLE orders", "/*c*/DROP/*c*/TABLE orders", "REFRESH TABLE orders", "USE default",
        # Rows out of nothing, no table at all.
        "SELECT * FROM range(1000000)", "SELECT * FROM orders, range(10)", "SELECT * FROM orders, explode(array(1))", "SELECT 1", "VALUES (1)", "", "  ",
        # Patterns.
        "SELECT id FROM orders WHERE country LIKE concat(repeat('%', 50), 'a')", "SELECT id FROM orders WHERE country LIKE '" + "%a" * 30 + "'", "SELECT id FROM orders WHERE like(country, concat(repeat('%', 50), 'a'))", "SELECT id FROM orders WHERE country NOT ILIKE country || '%'", "SELECT id FROM orders WHERE country RLIKE repeat('(a+)+', 20)",
        "SELECT a.id FROM orders a POSITIONAL JOIN users b", "SELECT 2 ^ 3 FROM orders", "SELECT \x00id FROM orders",
    ],
)
def test_refused(spark, tables, sql):
    with pytest.raises(PreparationError):
        sql_window.query(spark, sql, tables)
    assert not spark.catalog.listTables()


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("SELECT * FROM orders LIMIT 5", 5), ("SELECT country, count(*) AS n, avg(amount) AS a FROM orders GROUP BY country HAVING count(*) > 1 ORDER BY n DESC NULLS LAST", 4), ("SELECT o.id, u.name FROM orders o JOIN users u ON o.id = u.id LIMIT 10", 10), ("WITH t AS (SELECT * FROM orders WHERE amount > 50) SELECT count(*) FROM t", 1),
        ("SELECT id, row_number() OVER (PARTITION BY country ORDER BY amount) FROM orders", 200), ("SELECT id, sum(amount) OVER w, lag(id) OVER (ORDER BY id) FROM orders WINDOW w AS (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", 200), ("SELECT sum(id) OVER (ORDER BY id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) FROM orders", 200),
        ("SELECT * FROM orders WHERE amount > (SELECT avg(amount) FROM orders) LIMIT 5", 5), ("SELECT id FROM orders UNION SELECT id FROM users", 200), ("SELECT count(*) FROM orders o1 JOIN orders o2 ON o1.country = o2.country", 1), ("SELECT id FROM orders WHERE id IN (SELECT id FROM users WHERE id < 3) AND EXISTS (SELECT 1 FROM users)", 3),
        ("SELECT 'current_user' AS word, version FROM orders LIMIT 1", 1), ("SELECT * FROM ORDERS LIMIT 1", 1), ("/*DROP*/ SELECT * FROM orders -- DROP TABLE orders", 200), ("SELECT 'DROP TABLE orders' AS text FROM orders LIMIT 1", 1), ("SELECT * FROM orders;;", 200), ("  ;SELECT * FROM orders", 200),
        ("SELECT country, sum(amount) FROM orders GROUP BY ROLLUP (country)", 5), ("SELECT country, version, count(*) FROM orders GROUP BY GROUPING SETS ((country), (version), ())", 6), ("SELECT * FROM orders PIVOT (count(id) FOR country IN ('RU', 'US')) LIMIT 1", 1), ("SELECT id FROM orders UNPIVOT (v FOR n IN (id, amount)) LIMIT 1", None),
        ("SELECT u.id, x FROM users u LATERAL VIEW explode(many) t AS x", 200), ("SELECT transform(many, x -> x + 1)[0], CAST(id AS string) || 'a', id::double, DATE '2020-01-01', INTERVAL 1 DAY FROM users", 200), ("SELECT * EXCEPT (many) FROM users WHERE name LIKE 'u1%' AND name NOT ILIKE '%9' AND name RLIKE 'u[0-9]+'", None),
        ("SELECT id FROM orders WHERE id BETWEEN 1 AND 3 AND country IS NOT NULL AND (id, country) NOT IN (SELECT 1, 'RU')", 3), ("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(x, y) JOIN orders ON x = id", 2), ("FROM orders |> WHERE id < 5 |> SELECT id |> LIMIT 3", 3), ("SELECT current_date, extract(YEAR FROM DATE '2020-01-01'), trim(BOTH ' ' FROM version), substring(version FROM 1 FOR 1) FROM orders LIMIT 2", 2),
        ("SELECT o.id, x.n FROM orders o, LATERAL (SELECT count(*) AS n FROM users u WHERE u.id = o.id) x LIMIT 2", 2), ("SELECT /*+ BROADCAST(u) */ count(*) FROM orders o LEFT ANTI JOIN users u ON o.id = u.id", 1), ("SELECT first(id), any_value(id), max_by(id, amount), percentile_cont(0.5) WITHIN GROUP (ORDER BY id) FROM orders", 1),
    ],
)
def test_allowed(spark, tables, sql, rows):
    try:
        got = sql_window.run(spark, sql, tables)
    except Exception as e:
        if rows is None and not isinstance(e, PreparationError):
            return  # admitted, and wrong for another reason
        raise
    assert rows is None or len(got.rows) == rows


def test_a_view_of_the_session_is_not_reachable(spark, tables):
    spark.range(3).createOrReplaceTempView("private")
    try:
        with pytest.raises(PreparationError, match="no table"):
            sql_window.query(spark, "SELECT * FROM orders, private", tables)
    finally:
        spark.catalog.dropTempView("private")


def test_a_function_of_the_session_cannot_stand_in_for_a_built_in_one(spark, tables):
    other = spark.newSession()
    other.udf.register("lower", lambda x: "mine")
    assert sql_window.run(other, "SELECT lower(country) FROM orders WHERE id = 0", tables).rows == [("ru",)]


def test_settings_of_the_session_hold(spark, tables):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert sql_window.run(spark, "SELECT CAST('x' AS int) FROM orders LIMIT 1", tables).rows == [(None,)]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_the_audit_refuses_what_no_name_shows(spark, tables):
    """A resolved plan with a leaf or an expression that no list of names caught."""
    spark.range(3).createOrReplaceTempView("private")
    try:
        for sql in ("SELECT * FROM private", f"SELECT * FROM parquet.`{NATION}`", "SELECT * FROM range(3)"):
            with pytest.raises(PreparationError):
                sql_window.audit(spark, spark.sql(sql)._jdf.queryExecution().analyzed(), tuple(tables))
    finally:
        spark.catalog.dropTempView("private")
