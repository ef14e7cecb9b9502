"""Guarded SQL and the catalog: one reading statement, a row limit, a time limit, and results that name what went wrong."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

MOST_ROWS, MOST_SECONDS = 1000, 5.0
#: Nodes of plans that only read; every node of a statement, common table expressions and subqueries included, is one of them.
READING = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "Join", "UnresolvedWith",
    "UnresolvedHaving", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "SubqueryAlias", "Pivot", "Unpivot", "Generate", "WithWindowDefinition", "UnresolvedRelation", "WithCTE", "UnresolvedSubqueryColumnAliases", "Window", "LateralJoin", "ResolvedInlineTable",
    "UnresolvedHint", "Sample", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Subquery", "ScalarSubquery", "SubqueryAlias", "UnresolvedTVFAliases", "Expand", "DeduplicateWithinWatermark", "Deduplicate", "PipeOperator", "PipeExpression",
}


def statements(sql: str) -> int:
    """How many statements there are, by semicolons outside quotes and comments."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " x ", sql, flags=re.DOTALL)
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", "", bare)
    return sum(bool(part.strip()) for part in bare.split(";"))


#: Nodes of expressions that only compute; what names a function or a column indirectly (the IDENTIFIER clause), parameters and procedures are not among them.
COMPUTING = {
    "Add", "AggregateExpression", "Alias", "And", "ArrayTransform", "AttributeReference", "Between", "BitwiseAnd", "BitwiseNot", "BitwiseOr", "BitwiseXor", "CaseWhen", "Cast", "Concat", "Contains", "CreateNamedStruct",
    "CurrentDate", "CurrentRow", "CurrentTimestamp", "Cube", "Divide", "EndsWith", "EqualNullSafe", "EqualTo", "Exists", "Extract", "First", "GreaterThan", "GreaterThanOrEqual", "GroupingAnalytics", "GroupingSets", "If", "ILike", "In",
    "InSubquery", "IntegralDivide", "IsNotNull", "IsNull", "LambdaFunction", "Last", "LateralSubquery", "LessThan", "LessThanOrEqual", "Like", "LikeAll", "LikeAny", "ListQuery", "Literal", "Lower", "MultiAlias", "Multiply",
    "NamePlaceholder", "Not", "NotLikeAll", "NotLikeAny", "Or", "Overlay", "PipeExpression", "Remainder", "RLike", "Rollup", "ScalarSubquery", "ShiftLeft", "ShiftRight", "ShiftRightUnsigned", "SortOrder", "SpecifiedWindowFrame", "StartsWith", "StringLocate", "StringTrim",
    "StringTrimLeft", "StringTrimRight", "Substring", "Subtract", "TimestampAdd", "TimestampDiff", "UnaryMinus", "UnaryPositive", "UnboundedFollowing", "UnboundedPreceding", "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedExtractValue", "UnresolvedFunction",
    "UnresolvedNamedLambdaVariable", "UnresolvedOrdinal", "UnresolvedRegex", "UnresolvedStar", "UnresolvedWindowExpression", "UnspecifiedFrame", "Upper", "WindowExpression", "WindowSpecDefinition", "WindowSpecReference",
}
#: Built-in functions that reach beyond the rows: any static method, paths of files, the session's user and place, other processes' logs, whole schemas of files.
REACHING = {
    "java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "spark_partition_id", "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema", "current_path", "version",
    "python_worker_logs", "schema_of_avro", "from_avro", "to_avro", "from_protobuf", "to_protobuf",
}
#: Table functions that make rows of their arguments.
ROWS_OF = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"}
#: Classes of an analysed plan that are refused whatever they were called by.
REFUSED = {"CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentUser"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


_methods: dict[str, frozenset[str]] = {}


def hasattr_(node, method: str) -> bool:
    """Whether a JVM object has a method of that name."""
    kind = node.getClass()
    if (name := kind.getName()) not in _methods:
        _methods[name] = frozenset(m.getName() for m in kind.getMethods())
    return method in _methods[name]


def _nodes(plan):
    """(node, whether it is a plan) of a JVM plan: its children, expressions, common table expressions and subqueries, all the way down."""
    todo = [plan]
    while todo:
        node = todo.pop()
        is_plan = hasattr_(node, "maxRows")
        yield node, is_plan
        todo += _items(node.children()) + [x for x in _items(node.innerChildren()) if hasattr_(x, "innerChildren")]
        if is_plan:
            todo += _items(node.expressions())
        elif hasattr_(node, "plan") and hasattr_(node.plan(), "maxRows"):
            todo.append(node.plan())


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def violation(spark: SparkSession, plan) -> str | None:
    """What in a parsed plan (a JVM object) is more than reading registered tables; None if nothing is.

    Everything is refused but what is known to read or compute: kinds of plan nodes, kinds of expressions, built-in functions by one plain name, and tables
    of the catalog or of the statement's own WITH. A table that isn't there is left to the analyser, which names it.
    """
    registry = spark._jsparkSession.sessionState().functionRegistry()
    built_in = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    names, relations = set(), []
    for node, is_plan in _nodes(plan):
        kind = _kind(node)
        if kind == "UnresolvedTableValuedFunction":
            parts = _items(node.name()) if hasattr_(node, "name") else []
            if len(parts) != 1 or parts[0].lower() not in ROWS_OF:
                return f"{'.'.join(parts)} is not allowed"
        elif kind == "UnresolvedGenerator":
            if node.name().funcName().lower() not in ROWS_OF or node.name().database().isDefined():
                return f"{node.name().funcName()} is not allowed"
        elif kind not in (READING if is_plan else COMPUTING):
            return f"{kind} is not a query" if is_plan else f"{kind} is not allowed"
        if kind == "UnresolvedWith":
            names |= {t._1().lower() for t in _items(node.cteRelations())}
        if kind == "UnresolvedRelation":
            relations.append([*_items(node.multipartIdentifier())])
        if kind == "UnresolvedFunction":
            parts = [p.lower() for p in _items(node.nameParts())]
            if len(parts) != 1 or parts[0] in REACHING:
                return f"{'.'.join(parts)} is not allowed"
            own = identifier(parts[0])
            if registry.functionExists(own) and not built_in.functionExists(own):
                return f"{parts[0]} is not a built-in function"
    for parts in relations:
        if len(parts) > 1 and not spark.catalog.tableExists(".".join(f"`{p}`" for p in parts)):
            return f"{'.'.join(parts)} is not a registered table"
    return None


def refused(df: DataFrame) -> str | None:
    """The same question put to the analysed plan, by what its expressions are and not by what they were called."""
    for node, is_plan in _nodes(df._jdf.queryExecution().analyzed()):
        if not is_plan and _kind(node) in REFUSED:
            return f"{_kind(node)} is not allowed"
    return None


def failed(status: str, sql: str, error: str) -> dict:
    return {"status": status, "sql": sql, "error": error, "rows": [], "columns": []}


def run(spark: SparkSession, sql: str, most_rows: int = MOST_ROWS, most_seconds: float = MOST_SECONDS) -> dict:
    """status ok, multiple_statements, read_only_violation, query_timeout or query_failed; columns, rows (dicts), truncated; bytes as their size."""
    if statements(sql) != 1:
        return failed("multiple_statements" if statements(sql) > 1 else "query_failed", sql, "one statement is wanted")
    text = sql.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # the parser's own error, told as such
        return failed("query_failed", sql, str(e).splitlines()[0])
    if why := violation(spark, plan):
        return failed("read_only_violation", sql, why)
    group = f"guarded-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(most_seconds, stop)
    spark.sparkContext.setJobGroup(group, "guarded query", True)
    timer.start()
    try:
        df = spark.sql(text)
        if why := refused(df):
            return failed("read_only_violation", sql, why)
        rows = df.limit(most_rows + 1).collect()
    except (ParseException, AnalysisException) as e:
        return failed("query_failed", sql, str(e).splitlines()[0])
    except Exception as e:  # a cancelled job raises what the cluster says
        return failed("query_timeout" if late.is_set() else "query_failed", sql, str(e).splitlines()[0])
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plain = lambda v: {"_blob": True, "size_bytes": len(v)} if isinstance(v, bytes | bytearray) else v
    return {"status": "ok", "sql": sql, "columns": df.columns, "rows": [{c: plain(v) for c, v in zip(df.columns, r, strict=True)} for r in rows[:most_rows]], "truncated": len(rows) > most_rows}


def catalog(spark: SparkSession, indexes: set[str] = frozenset(), internal: bool = False) -> DataFrame:
    """name and kind (table, virtual for a search index) of the session's tables; names of an index's parts are internal."""
    rows = [(t.name, "virtual" if t.name in indexes else "table") for t in spark.catalog.listTables() if internal or not re.search(r"_(postings|lengths)$", t.name)]
    return spark.createDataFrame(rows, "name string, kind string")


def schema(spark: SparkSession, names: list[str]) -> dict:
    """columns by table, and missing: names that are none; each name once."""
    out: dict = {"tables": {}, "missing": []}
    for name in dict.fromkeys(names):
        if spark.catalog.tableExists(name):
            out["tables"][name] = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in spark.table(name).schema]
        else:
            out["missing"].append(name)
    return out
