"""Read-only SQL over registered views.

One statement, a query, that reads registered views only. Spark parses it; the
parsed plan is walked before anything of it is resolved or read, so nothing here
parses SQL again. What the plan may hold is listed: kinds of nodes and of
expressions, views that ``register`` named, names that the statement itself
defines, scope by scope, Spark's built-in functions but for those that reach
outside the query, and this module's own. What Spark made of the names is looked
at once more: all that is read lies below a registered view.
Literals compared with a column of known values are checked against them,
because a misspelt kind would give an empty result.
"""

from __future__ import annotations

import difflib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonptr, linear
from ..functions.patterns import recursive, to_java
from ..operators import fuzzy
from ..operators.filters import AccessScope
from ..sources.tables import AUTHORSHIPS, KINDS, PROVIDERS, ROLES

DEFAULT_LIMIT = 100

#: Columns with a fixed vocabulary.
VOCABULARY = {"kind": KINDS, "role": ROLES, "provider": PROVIDERS, "authorship": AUTHORSHIPS, "record_relation": ("original", "mirror", "unknown")}

#: What to know about columns before a query is written.
NOTES = {
    ("messages", "role"): "role user is not always a person; see authorship",
    ("messages", "kind"): "stored in snake_case; harness notices are left out of searches by default",
    ("messages", "tool_call_id"): "not unique",
    ("messages", "seq"): "from 0 within a session",
    ("sessions", "raw_metadata_json"): "its keys differ by provider",
    ("sessions", "parent_session_id"): "null for sessions that a person started",
}


class SqlRefused(ValueError):
    """The statement is not one allowed query."""


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[list]
    truncated: bool


#: Names of registered views by session.
_VIEWS: dict[str, set[str]] = {}

#: Nodes that a query's parsed plan may have; all others are refused.
NODES = set(
    """Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Limit Offset Distinct Deduplicate Union Intersect Except SubqueryAlias
    UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith WithWindowDefinition UnresolvedHaving UnresolvedPivot Pivot Unpivot UnresolvedUnpivot
    Generate OneRowRelation UnresolvedInlineTable ResolvedInlineTable LocalRelation UnresolvedTableValuedFunction UnresolvedTVFAliases Sample Tail Window Expand
    UnresolvedGroupingAnalytics""".split()
)

#: Expressions that it may have; all others are refused.
EXPRESSIONS = set(
    """UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedRegex UnresolvedAlias UnresolvedExtractValue UnresolvedOrdinal UnresolvedNamedLambdaVariable UnresolvedWindowExpression
    UnresolvedFunction UnresolvedGenerator Alias MultiAlias Literal Cast Collate UnresolvedCollation NamedArgumentExpression AttributeReference
    And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In InSubquery Between UnresolvedBetweenExpression IsNull IsNotNull IsUnknown IsNotUnknown
    Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive
    BitwiseAnd BitwiseOr BitwiseXor BitwiseNot ShiftLeft ShiftRight ShiftRightUnsigned Concat CaseWhen If CreateArray CreateMap CreateStruct CreateNamedStruct NamePlaceholder
    Exists ScalarSubquery ListQuery LateralSubquery SortOrder LambdaFunction WindowExpression WindowSpecDefinition WindowSpecReference SpecifiedWindowFrame UnspecifiedFrame
    CurrentRow UnboundedPreceding UnboundedFollowing RowFrame RangeFrame GroupingSets Cube Rollup BaseGroupingSets TimestampAdd TimestampDiff CurrentDate CurrentTimestamp
    Substring StringTrim StringTrimLeft StringTrimRight StringLocate Extract Overlay First Last AnyValue PercentileCont PercentileDisc SemiStructuredExtract TryCast TableSpec""".split()
)

#: Functions that match by a pattern of Java's; where each has it.
PATTERNED = {"rlike": 1, "regexp": 1, "regexp_like": 1, "regexp_extract": 1, "regexp_extract_all": 1, "regexp_replace": 1, "regexp_count": 1, "regexp_instr": 1, "regexp_substr": 1, "split": 1, "text_regexp": 0}

#: Leaves of an analysed query that read nothing, and what stands for a common table.
LEAVES = set("OneRowRelation LocalRelation Range CTERelationRef UnionLoopRef".split())

#: Built-in functions that call code, read session or file state, or tell of the machine.
OUTSIDE = set(
    """reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user current_catalog
    current_database current_schema version spark_partition_id monotonically_increasing_id raise_error assert_true uuid rand randn random randstr shuffle""".split()
)

#: Functions that may stand for a table.
TABLE_FUNCTIONS = set("explode explode_outer posexplode posexplode_outer inline inline_outer stack range json_tuple variant_explode variant_explode_outer".split())

#: This module's functions, see ``register_functions``.
OWN_FUNCTIONS = ("contains_caseless", "text_regexp", "json_pointer", "fuzzy_score")


def register(spark: SparkSession, tables: dict[str, DataFrame], scope: AccessScope = AccessScope()) -> None:
    scope.check_raw_sql()
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    _VIEWS.setdefault(_session(spark), set()).update(n.lower() for n in tables)
    register_functions(spark)


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def register_functions(spark: SparkSession) -> None:
    """Search by SQL: contains_caseless(text, query), text_regexp(pattern, text), json_pointer(pointer, content), fuzzy_score(query, text).

    The first is an expression that Spark inlines, the others work on Arrow
    batches. A pattern of text_regexp is one of the searches' dialect, in linear
    time; where it is a literal it is checked before the query runs.
    """
    folded = "replace(lower({}), 'ς', 'σ')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION contains_caseless(t STRING, q STRING) RETURNS BOOLEAN RETURN coalesce(contains({folded.format('t')}, {folded.format('q')}), false)")

    @F.arrow_udf("boolean")
    def text_regexp(patterns: pa.Array, texts: pa.Array) -> pa.Array:
        return linear.matches(patterns, texts)

    spark.udf.register("text_regexp", text_regexp)

    @F.pandas_udf("string")
    def json_pointer(pointer: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([jsonptr.plain_value(p, c) for p, c in zip(pointer, content)], dtype=object)

    @F.pandas_udf("bigint")
    def fuzzy_score(query: pd.Series, text: pd.Series) -> pd.Series:
        found = [fuzzy.match(q, t) if q else None for q, t in zip(query, text)]
        return pd.Series([f[0] if f else None for f in found], dtype="Int64")

    spark.udf.register("json_pointer", json_pointer)
    spark.udf.register("fuzzy_score", fuzzy_score)


def _mask(sql: str) -> str:
    """The statement with comments blanked and the insides of quotes replaced by x."""
    keep = lambda m: m[0][0] + "x" * (len(m[0]) - 2) + m[0][-1] if m[0][0] in "'\"`" else " " * len(m[0])
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", keep, sql, flags=re.S)


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.length())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _literal(node) -> str | None:
    """The text of a string literal."""
    if _kind(node) != "Literal" or node.dataType().typeName() != "string" or node.value() is None:
        return None
    return node.value().toString()


def check_value(column, value) -> None:
    """Refuses a literal that a column of known values never has."""
    if _kind(column) != "UnresolvedAttribute" or (text := _literal(value)) is None:
        return
    name = str(_items(column.nameParts())[-1]).lower()
    known = VOCABULARY.get(name)
    if known and text not in known:
        close = difflib.get_close_matches(text.lower().replace("-", "_"), known, 1)
        raise SqlRefused(f"{name} has no value {text!r}" + (f"; it is stored as {close[0]!r}" if close else f"; values: {', '.join(known)}"))


def check_pattern(name: str, arguments: list) -> None:
    """Patterns that Java would match by recursion end the executor: they are left to text_regexp."""
    text = _literal(arguments[PATTERNED[name]]) if len(arguments) > PATTERNED[name] else None
    if name == "text_regexp":
        if text is not None:
            to_java(text)
    elif text is None or recursive(text):
        raise SqlRefused(f"{name} takes a literal pattern without repeated groups; text_regexp(pattern, text) takes any")


class _Guard:
    """A walk over a parsed plan that refuses whatever isn't listed.

    Names resolve scope by scope: a common table sees those before it (and
    itself, if the statement is recursive), subqueries see what their place sees.
    """

    def __init__(self, spark: SparkSession):
        self.builtin = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.plan_class = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
        self.subquery_class = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")

    def plan(self, node, names: frozenset[str]) -> None:
        kind = _kind(node)
        if kind not in NODES:
            raise SqlRefused(f"a query may not have {kind}")
        if kind == "UnresolvedWith":
            inner = names
            for pair in _items(node.cteRelations()):
                own = str(pair._1()).lower()
                self.plan(pair._2(), inner | {own} if node.allowRecursion() else inner)
                inner = inner | {own}
            return self.plan(node.child(), inner)
        if kind == "UnresolvedRelation":
            parts = [str(x) for x in _items(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0].lower() not in names:
                raise SqlRefused(f"no registered view {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            parts = [str(x) for x in _items(node.name())]
            if len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS:
                raise SqlRefused(f"no table function {'.'.join(parts)}")
        for child in _items(node.children()):
            self.plan(child, names)
        if kind == "WithWindowDefinition":
            for x in _items(node.windowDefinitions().values().toSeq()):
                self.expression(x, names)
        for x in _items(node.expressions()):
            self.expression(x, names)

    def expression(self, node, names: frozenset[str]) -> None:
        if self.plan_class.isInstance(node):
            return self.plan(node, names)
        kind = _kind(node)
        if kind not in EXPRESSIONS:
            raise SqlRefused(f"a query may not have {kind}")
        if self.subquery_class.isInstance(node):
            self.plan(node.plan(), names)
        elif kind == "UnresolvedFunction":
            self.function([str(x) for x in _items(node.nameParts())], _items(node.arguments()))
            if node.filter().isDefined():
                self.expression(node.filter().get(), names)
        elif kind == "UnresolvedGenerator":
            if node.name().database().isDefined() or node.name().funcName().lower() not in TABLE_FUNCTIONS:
                raise SqlRefused(f"no generator {node.name().unquotedString()}")
        elif kind == "RLike":
            check_pattern("rlike", _items(node.children()))
        elif kind in ("EqualTo", "EqualNullSafe"):
            left, right = _items(node.children())
            check_value(left, right)
            check_value(right, left)
        elif kind == "In":
            for value in _items(node.list()):
                check_value(node.value(), value)
        for child in _items(node.children()):
            self.expression(child, names)

    def function(self, parts: list[str], arguments: list) -> None:
        name = parts[0].lower()
        if len(parts) != 1 or name in OUTSIDE or not (name in OWN_FUNCTIONS or self.builtin.functionExists(self.identifier(name))):
            raise SqlRefused(f"no function {'.'.join(parts)}")
        if name in PATTERNED:
            check_pattern(name, arguments)


def check_plan(spark: SparkSession, plan) -> None:
    """Raises SqlRefused unless all that the parsed plan holds is listed."""
    _Guard(spark).plan(plan, frozenset(_VIEWS.get(_session(spark), ())))


def check_analysed(spark: SparkSession, plan) -> None:
    """The same question once more, of what Spark made of the names: all that is read lies below a registered view."""
    own = _VIEWS.get(_session(spark), set())
    plans = [plan]
    subquery = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    while plans:
        node = plans.pop()
        if _kind(node) == "View":
            if node.desc().identifier().table().lower() not in own:
                raise SqlRefused(f"no registered view {node.desc().identifier().table()}")
            continue
        children = _items(node.children())
        if not children and _kind(node) not in LEAVES:
            raise SqlRefused(f"a query may not read {_kind(node)}")
        plans += children
        held = _items(node.expressions())
        while held:
            x = held.pop()
            if _kind(x) in ("CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength"):
                raise SqlRefused(f"a query may not have {_kind(x)}")
            if subquery.isInstance(x):
                plans.append(x.plan())
            held += _items(x.children())


def checked(spark: SparkSession, sql: str) -> DataFrame:
    """The query as a DataFrame; raises SqlRefused for anything else."""
    body = _mask(sql).strip()
    if not body.rstrip("; \n\t"):
        raise SqlRefused("no statement")
    if ";" in body.rstrip("; \n\t"):
        raise SqlRefused("one statement at a time")
    text = sql.strip().rstrip("; \n\t")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise SqlRefused(f"not a query: {str(e).splitlines()[0][:200]}") from None
    check_plan(spark, plan)
    df = spark.sql(text)
    check_analysed(spark, df._jdf.queryExecution().analyzed())
    return df


def unique_names(df: DataFrame) -> DataFrame:
    """Repeated column names get _2, _3, ..."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c] = seen.get(c, 0) + 1
        names.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return df.toDF(*names)


def _shown(spark: SparkSession, sql: str, offset: int, max_cell_chars: int | None) -> DataFrame:
    df = unique_names(checked(spark, sql))
    df = df.offset(offset) if offset else df
    if max_cell_chars is not None:
        df = df.select(*[F.substring(F.col(f"`{c}`"), 1, max_cell_chars).alias(c) if k == "string" else F.col(f"`{c}`") for c, k in df.dtypes])
    return df


def _cells(row) -> list:
    return [f"<blob {len(v)} bytes>" if isinstance(v, (bytes, bytearray)) else v for v in row]


def query(
    spark: SparkSession, sql: str, limit: int = DEFAULT_LIMIT, offset: int = 0, max_cell_chars: int | None = None, scope: AccessScope = AccessScope(), timeout_seconds: float | None = None
) -> QueryResult:
    """At most ``limit`` rows, and whether there were more; all rows come from ``query_batches``.

    After ``timeout_seconds`` the query's jobs are cancelled and TimeoutError raised.
    """
    scope.check_raw_sql()
    if limit <= 0:
        raise SqlRefused("a page has a limit; all rows come from query_batches")
    df = _shown(spark, sql, offset, max_cell_chars)
    rows = collected(df.limit(limit + 1), timeout_seconds)
    return QueryResult(df.columns, [_cells(r) for r in rows[:limit]], len(rows) > limit)


def collected(df: DataFrame, timeout_seconds: float | None = None) -> list:
    """The rows of a small result; its jobs are cancelled when the time is up."""
    if timeout_seconds is None:
        return df.collect()
    context, group = df.sparkSession.sparkContext, f"threadloom-{uuid.uuid4().hex}"
    out: dict = {}

    def run() -> None:
        context.setJobGroup(group, "query with a time limit", interruptOnCancel=True)
        try:
            out["rows"] = df.collect()
        except Exception as e:  # told to the caller below
            out["error"] = e

    worker = InheritableThread(target=run, session=df.sparkSession)
    worker.start()
    worker.join(timeout_seconds)
    if worker.is_alive():
        context.cancelJobGroup(group)
        worker.join()
        if "rows" not in out:
            raise TimeoutError(f"the query took longer than {timeout_seconds} s")
    if "error" in out:
        raise out["error"]
    return out["rows"]


def query_batches(spark: SparkSession, sql: str, batch_rows: int = 1000, scope: AccessScope = AccessScope()) -> Iterator[list[list]]:
    """All rows in batches; one partition at a time comes to the driver."""
    scope.check_raw_sql()
    held: list[list] = []
    for row in _shown(spark, sql, 0, None).toLocalIterator():
        held.append(_cells(row))
        if len(held) == batch_rows:
            yield held
            held = []
    if held:
        yield held


def schema(spark: SparkSession, tables: list[str] | None = None) -> list[dict]:
    """Registered tables, their columns, types and notes."""
    own = _VIEWS.get(_session(spark), set())
    if unknown := [t for t in tables or () if t.lower() not in own]:
        raise SqlRefused(f"no registered view {', '.join(unknown)}")
    names = tables or sorted(own)
    return [{"table": t, "column": f.name, "type": f.dataType.simpleString(), "note": NOTES.get((t, f.name), "")} for t in names for f in spark.table(t).schema]
