"""A guarded, read-only SQL window over named DataFrames.

Spark's own parser reads the query. The guard admits what it knows: each node of the
parsed plan and each expression must be on a list, each function built in and not
BANNED, each table a bound name; whatever else a parser version may produce is refused
before anything is looked up. The plan is then resolved, not run, in a session of its
own that holds the bound views alone, and audited: each leaf must lie inside a bound
view or be made of constants. The audited plan itself is what runs.

Results are Spark's: ascending order puts nulls first unless the query says NULLS LAST.
Forms that Spark reads in silence as something else are refused: POSITIONAL and ASOF
joins (taken for an alias) and ``^`` (bitwise here, a power elsewhere).
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from tidemill.errors import PreparationError

MAX_CHARS, MAX_PERCENTS, ROWS, MAX_ROWS, MAX_BYTES = 20_000, 20, 1000, 10_000, 8 << 20
#: Functions that reach outside the data or tell about the session.
BANNED = frozenset(
    "java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length current_user current_catalog current_database current_schema session_user user "
    "version spark_partition_id raise_error monotonically_increasing_id uuid getbit python_worker_logs".split()
)

#: Names that tell about the session without parentheses, too.
SESSION_NAMES = frozenset("current_user session_user user current_catalog current_database current_schema".split())
#: Join words of other dialects that Spark takes for a table's alias.
JOIN_WORDS = frozenset({"positional", "asof"})


@dataclass(frozen=True)
class SqlResult:
    columns: list[str]
    rows: list[tuple]
    truncated: str | None
    seconds: float


def allowed_functions(spark: SparkSession) -> frozenset[str]:
    """Spark's built-in scalar, aggregate and window functions but for BANNED
    ones and table functions."""
    names = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}
    tables = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "sql_keywords", "variant_explode", "variant_explode_outer", "collations"}
    return frozenset(names - BANNED - (tables - {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}))


def check_text(sql: str) -> None:
    if not sql.strip():
        raise PreparationError("the query is empty")
    if len(sql) > MAX_CHARS:
        raise PreparationError(f"a query has {MAX_CHARS} characters at most")
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", sql):
        raise PreparationError("the query holds control characters")


#: What the parser makes of a query, and nothing that names files, commands, scripts,
#: variables or names computed at run time.
PLAN_NODES = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project RepartitionByExpression "
    "Sample Sort SubqueryAlias Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition".split()
)
EXPRESSIONS = frozenset(
    "Add AggregateExpression Alias And AnyValue AttributeReference BitwiseAnd BitwiseNot BitwiseOr CaseWhen Cast Coalesce Collate Concat CreateNamedStruct CreateStruct Cube CurrentDate CurrentRow CurrentTime "
    "CurrentTimestamp Divide EqualNullSafe EqualTo Exists Extract First GreaterThan GreaterThanOrEqual GroupingSets ILike In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction Last LateralSubquery LessThan "
    "LessThanOrEqual Like LikeAll LikeAny ListQuery Literal LocalTimestamp MultiAlias Multiply NamedArgumentExpression Not NotLikeAll NotLikeAny Or Overlay PipeExpression RLike Remainder Rollup ScalarSubquery ShiftLeft "
    "ShiftRight ShiftRightUnsigned SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimBoth StringTrimLeft StringTrimRight Substring Subtract TimestampAdd TimestampDiff TryCast UnaryMinus UnaryPositive "
    "UnboundedFollowing UnboundedPreceding UnresolvedAlias UnresolvedAttribute UnresolvedCollation UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar "
    "UnresolvedStarExceptOrReplace UnresolvedSubqueryColumnAliases UnresolvedWindowExpression UnspecifiedFrame WindowExpression WindowSpecDefinition WindowSpecReference".split()
)
#: Matches whose pattern must be written out, so that its wildcards can be counted.
PATTERNS = frozenset({"Like", "ILike", "RLike"})
#: Leaves of a resolved query beside the bound views.
CONSTANT_LEAVES = frozenset({"OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"})
#: Resolved expressions that reach outside the data, whatever name led to them.
OUTSIDE = re.compile(r"Reflect|InputFile|CurrentUser|CurrentCatalog|CurrentDatabase|SessionUser|SparkVersion|PythonUDF|ScalaUDF|HiveUDF|PythonUDAF|ScalaAggregator|RaiseError|SparkPartitionID|MonotonicallyIncreasingID|^Uuid|VariableReference|JavaMethod")


def _name(node) -> str:
    """The class name of a parsed node; of a companion object or a variant of a class
    without a name of its own, that of the class."""
    kind = node.getClass()
    while not kind.getSimpleName():
        kind = kind.getSuperclass()
    return kind.getSimpleName().rstrip("$")


def _walk(spark: SparkSession, plan, stop: frozenset[str] = frozenset()) -> list[tuple]:
    """``(node, class name, is a plan)`` of all nodes and expressions of a query,
    subqueries and common table expressions included; not what is below ``stop``."""
    query = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.QueryPlan")
    stack, seen = [plan], []
    while stack:
        node = stack.pop()
        is_plan, name = query.isInstance(node), _name(node)
        seen.append((node, name, is_plan))
        if name in stop:
            continue
        groups = [node.children(), node.innerChildren()] + ([node.expressions()] if is_plan else [])
        stack += [items.apply(i) for items in groups for i in range(items.size())]
    return seen


def _parsed(spark: SparkSession, sql: str):
    check_text(sql)
    # Stray semicolons around one query are a slip of the pen.
    while (trimmed := sql.strip().strip(";")) != sql:
        sql = trimmed
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        if "ParseException" in type(e).__name__ or "PARSE" in str(e) or isinstance(e, ParseException):
            raise PreparationError(f"the query cannot be read: {str(e).splitlines()[0]}") from None
        raise


def check(spark: SparkSession, sql: str, bound: tuple[str, ...]):
    """Refuse whatever is not one read-only query over ``bound`` names; of what is, the
    parsed plan and the bound names (case folded) that it uses."""
    plan = _parsed(spark, sql)
    seen = _walk(spark, plan)
    known, ctes, used, allowed = {b.casefold() for b in bound}, set(), set(), allowed_functions(spark)
    for node, name, is_plan in seen:
        if name not in (PLAN_NODES if is_plan else EXPRESSIONS):
            raise PreparationError("only SELECT queries are allowed" if is_plan else f"{name} is not offered here")
        if name == "UnresolvedWith":
            relations = node.cteRelations()
            ctes |= {relations.apply(i)._1().casefold() for i in range(relations.size())}
    for node, name, is_plan in seen:
        if name == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            if parts.size() != 1 or parts.apply(0).casefold() not in known | ctes or node.isStreaming():
                raise PreparationError(f"there is no table {parts.mkString('.')!r}")
            used |= {parts.apply(0).casefold()} & known
        if name == "UnresolvedFunction":
            parts = node.nameParts()
            function = parts.apply(parts.size() - 1).lower()
            if parts.size() != 1 or function not in allowed:
                raise PreparationError(f"the function {parts.mkString('.')!r} is not allowed")
            if function in ("like", "ilike", "rlike", "regexp", "regexp_like") and node.arguments().size() > 1:
                _check_pattern(node.arguments().apply(1))
        if name == "UnresolvedGenerator" and node.name().funcName().lower() not in allowed:
            raise PreparationError(f"the function {node.name().funcName()!r} is not allowed")
        if name == "UnresolvedAttribute":
            parts = node.nameParts()
            if parts.size() == 1 and parts.apply(0).casefold() in SESSION_NAMES:
                raise PreparationError(f"the name {parts.apply(0)!r} is not allowed")
        if name == "SubqueryAlias" and node.alias().casefold() in JOIN_WORDS:
            raise PreparationError(f"{node.alias()} joins are not offered")
        if name in PATTERNS:
            _check_pattern(node.children().apply(1))
        if name == "Literal" and node.dataType().typeName() == "string" and str(node.value()).count("%") > MAX_PERCENTS:
            raise PreparationError(f"a pattern has {MAX_PERCENTS} wildcards at most")
    if not used:
        raise PreparationError("the query names no table")
    return plan, used


def _check_pattern(pattern) -> None:
    if _name(pattern) != "Literal":
        raise PreparationError("a pattern must be written out")
    if str(pattern.value()).count("%") > MAX_PERCENTS:
        raise PreparationError(f"a pattern has {MAX_PERCENTS} wildcards at most")


def _frame(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _closed_session(spark: SparkSession, tables: dict[str, DataFrame]) -> SparkSession:
    """A session without views or functions but the bound views, with the settings
    of ``spark``."""
    own = spark.newSession()
    ours, theirs = own.conf.getAll, spark.conf.getAll
    for key, value in theirs.items():
        if ours.get(key) != value and own.conf.isModifiable(key):
            own.conf.set(key, value)
    for name, df in tables.items():
        _frame(own, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(f"`{name}`")
    return own


def audit(spark: SparkSession, plan, bound: tuple[str, ...]) -> None:
    """Refuse a resolved plan with a leaf outside the bound views that is not made of
    constants, or with an expression that reaches outside the data."""
    known = {b.casefold() for b in bound}
    for node, name, is_plan in _walk(spark, plan, stop=frozenset({"View"})):
        if name == "View":
            if not node.isTempView() or node.desc().identifier().table().casefold() not in known:
                raise PreparationError("the query reads a view that is not bound")
        elif is_plan and node.children().isEmpty() and name not in CONSTANT_LEAVES:
            raise PreparationError(f"the query reads something that is not bound ({name})")
        elif not is_plan and OUTSIDE.search(name):
            raise PreparationError(f"{name} is not allowed")


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The checked, resolved and audited query as a lazy DataFrame of ``spark``. No
    view is left in the session."""
    parsed, used = check(spark, sql, tuple(tables))
    own = _closed_session(spark, {name: df for name, df in tables.items() if name.casefold() in used})
    skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    state = own._jsparkSession.sessionState()
    resolved = state.executePlan(parsed, skip).analyzed()
    audit(spark, resolved, tuple(tables))
    return _frame(spark, resolved)


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], rows: int = ROWS, seconds: float = 30.0) -> SqlResult:
    """Run a query with limits on rows, bytes and time. One row more than asked
    for is fetched to tell whether the result was cut."""
    rows, began, tag = max(1, min(rows, MAX_ROWS)), time.monotonic(), f"sql-{uuid.uuid4().hex}"
    df = query(spark, sql, tables)
    # The context's tags hold in all threads; a session's are known to the thread that set them only.
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobsWithTag(tag))
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        got = [tuple(r) for r in df.limit(rows + 1).collect()]
    except Exception as e:
        if time.monotonic() - began >= seconds:
            raise PreparationError(f"the query took more than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    cut = "rows" if len(got) > rows else None
    size, out = 0, []
    for row in got[:rows]:
        size += sum(len(str(v)) for v in row)
        if size > MAX_BYTES:
            cut = "bytes"
            break
        out.append(row)
    return SqlResult(df.columns, out, cut, time.monotonic() - began)
