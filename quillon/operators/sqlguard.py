"""Ad-hoc read-only SQL: a guard on the parsed plan, a row cap, short cells and a time limit.

The guard doesn't look at the text.  Spark's parser makes a plan of it, and every node,
relation, table function and function of that plan, subqueries included, must be known to
read only: so names such as ``add`` or ``load`` are as good as others, and what a statement
hides in comments or quotes doesn't count.
"""

from __future__ import annotations

import datetime
import decimal
import math
import threading
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import truncate

ROWS, CELL_CHARS, SECONDS = 1000, 500, 15
#: Plan nodes that read, compute or show. Scripts, commands, writes and compound statements aren't here.
NODES = set(
    "Aggregate CTERelationDef CTERelationRef CurrentNamespace Deduplicate Distinct Except Expand ExplainCommand Filter Generate GlobalLimit GroupingSets "
    "Intersect Join LateralJoin LocalLimit LocalRelation NamedParametersHolder Offset OneRowRelation PipeOperator Pivot Project Range Sample ShowColumns "
    "ShowFunctions ShowNamespaces ShowTables ShowViews Sort SubqueryAlias Tail Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedNamespace "
    "UnresolvedPivot UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTable UnresolvedTableOrView UnresolvedTableValuedFunction "
    "UnresolvedUnpivot UnresolvedWith Unpivot Window WithWindowDefinition".split()
)
#: Table functions that make rows of their arguments.
TABLE_FUNCTIONS = set("explode explode_outer inline inline_outer json_tuple posexplode posexplode_outer range stack variant_explode variant_explode_outer".split())
#: Functions that reach outside the data: other code, files, the session.
OUTSIDE = set("input_file_block_length input_file_block_start input_file_name java_method raise_error reflect try_reflect".split())


class Rejected(ValueError):
    """A statement the guard doesn't let through."""


def _each(items) -> Iterator:
    """The elements of a Scala collection."""
    it = items.iterator()
    while it.hasNext():
        yield it.next()


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_expression(spark: SparkSession, e) -> None:
    kind = _name(e)
    if kind == "UnresolvedFunction":
        name = list(_each(e.nameParts()))[-1].lower()
        if name in OUTSIDE:
            raise Rejected(f"{name} is not allowed")
    if kind != "InSubquery" and ("Subquery" in kind or kind in ("Exists", "ListQuery")):  # an IN has its query below it
        _check_plan(spark, e.plan())
    for child in _each(e.children()):
        _check_expression(spark, child)


def _check_plan(spark: SparkSession, plan) -> None:
    kind = _name(plan)
    if kind not in NODES:
        raise Rejected(f"{kind} is not allowed")
    if kind in ("UnresolvedRelation", "UnresolvedTable", "UnresolvedTableOrView"):
        parts = list(_each(plan.multipartIdentifier()))
        # a name of one part is a table, a view or a common table expression; longer ones may be format.`path`
        if len(parts) > 1 and not spark.catalog.tableExists(".".join(f"`{x.replace('`', '``')}`" for x in parts)):
            raise Rejected(f"no table {'.'.join(parts)}")
    if kind == "UnresolvedTableValuedFunction":
        name = list(_each(plan.name()))[-1].lower()
        if name not in TABLE_FUNCTIONS:
            raise Rejected(f"{name} is not allowed")
    if kind == "ExplainCommand":
        _check_plan(spark, plan.logicalPlan())
        return
    for e in _each(plan.expressions()):
        _check_expression(spark, e)
    for part in (plan.children(), plan.innerChildren()):
        for child in _each(part):
            _check_plan(spark, child)


def checked(spark: SparkSession, sql: str | None) -> str:
    """The statement, if it is one that only reads; raises Rejected."""
    if not sql or not sql.strip():
        raise Rejected("the statement is empty")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as wrong:
        raise Rejected(f"the statement can't be parsed: {str(wrong).strip().splitlines()[0]}") from wrong
    _check_plan(spark, plan)
    return sql


def cell(value, most: int = CELL_CHARS):
    """A value as JSON can hold it, short; whether it was cut."""
    if isinstance(value, float):
        return (value if math.isfinite(value) else None), False
    if isinstance(value, decimal.Decimal):
        return str(value), False
    if isinstance(value, (bytes, bytearray)):
        return f"<bytes {len(value)}>", False
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat(), False
    if value is None or isinstance(value, (bool, int)):
        return value, False
    return truncate(value if isinstance(value, str) else str(value), most)


@dataclass
class Answer:
    columns: list[str]
    rows: list[list]
    truncated: bool


def plan(spark: SparkSession, sql: str, rows: int = ROWS) -> DataFrame:
    """The checked statement, limited to one row more than may be shown."""
    return spark.sql(checked(spark, sql)).limit(max(1, min(ROWS, rows)) + 1)


def run(spark: SparkSession, sql: str, rows: int = ROWS, seconds: float = SECONDS) -> Answer:
    """At most so many rows, within so many seconds."""
    rows = max(1, min(ROWS, rows))
    tag = f"sql-{threading.get_ident()}-{id(sql)}"
    frame = plan(spark, sql, rows)
    timer = threading.Timer(seconds, spark.interruptTag, [tag])
    spark.addTag(tag)
    timer.start()
    try:
        found = frame.collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)
    cells = [[cell(v) for v in r] for r in found[:rows]]
    return Answer(frame.columns, [[v for v, _ in r] for r in cells], len(found) > rows or any(cut for r in cells for _, cut in r))


def describe(spark: SparkSession, table: str | None = None) -> list[tuple[str, str, str]]:
    """(table, column, type) of the session's tables and views."""
    names = [t.name for t in spark.catalog.listTables() if table in (None, t.name)]
    return [(n, c.name, c.dataType) for n in names for c in spark.catalog.listColumns(n)]
