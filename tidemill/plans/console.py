"""A read-only SQL console over registered tables.

What may run is decided on the parsed plan, not on the text: a query starts with SELECT, WITH or FROM and no node of its plan,
at any depth, is a statement. No session setting is touched, so threads can't disturb one another.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

from ..errors import InputError
from . import dialect

PREVIEW_ROWS = 100_000
# fixed values: functions that reach outside a query
_DENIED = ("reflect", "java_method", "try_reflect")
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"
#: Everything that acts: commands and statements of any kind, shell scripts, procedural blocks, statements made from text.
_ACTS = (f"{_LOGICAL}.Command", f"{_LOGICAL}.ParsedStatement", f"{_LOGICAL}.ScriptTransformation", f"{_LOGICAL}.CompoundPlanStatement")
_ACTING_NAME = re.compile(r"Insert|Overwrite|AsSelect|Compound|ExecuteImmediate|Transformation|Command|Cache|Merge|Delete|Update")
_TOKENS = re.compile(r"""(?P<raw>\b[rR](?:'[^']*'|"[^"]*"))|(?P<text>'(?:[^'\\]|\\.)*')|(?P<name>"(?:[^"]|"")*")|(?P<quoted>`(?:[^`]|``)*`)|(?P<comment>--[^\n]*|/\*.*?\*/)""", re.S)

_registering = threading.Lock()


def with_backticks(query: str) -> tuple[str, str]:
    """The query with double-quoted names in backticks and without comments but hints, and the same with texts and names blanked."""

    def named(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "name":
            return "`" + m[0][1:-1].replace('""', '"').replace("`", "``") + "`"
        return " " if kind == "comment" and not m[0].startswith("/*+") else m[0]

    shown = _TOKENS.sub(named, query)
    return shown, _TOKENS.sub(lambda m: " " if m.lastgroup == "comment" else "x", shown)


def _nodes(spark: SparkSession, plan: JavaObject) -> Iterator[JavaObject]:
    """Every object below a parsed plan: nodes, expressions, subqueries, common table expressions."""
    gateway, todo = spark.sparkContext._gateway, [plan]
    while todo:
        x = todo.pop()
        if not isinstance(x, JavaObject):
            continue
        if is_instance_of(gateway, x, "scala.collection.Iterable"):
            parts = x.iterator()
        elif is_instance_of(gateway, x, "scala.Product"):
            yield x
            parts = x.productIterator()
        else:
            continue
        while parts.hasNext():
            todo.append(parts.next())


def _strings(names: JavaObject) -> list[str]:
    return [str(names.apply(i)) for i in range(names.size())]


def check_read_only(spark: SparkSession, query: str) -> str:
    """The single statement of ``query``, if all that its parsed plan does is to read tables by name."""
    text, bare = with_backticks(dialect.in_spark(query))
    text, bare = text.strip().rstrip(";").strip(), bare.strip().rstrip(";").strip()
    if not bare:
        raise InputError("the query is empty")
    if not re.match(r"(?i)\(*\s*(select|with|from)\b", bare):
        raise InputError("only SELECT and WITH queries are allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise InputError(f"the query can't be parsed: {str(e).splitlines()[0]}") from e
    gateway = spark.sparkContext._gateway
    for node in _nodes(spark, plan):
        kind = node.getClass().getSimpleName()
        plan_node = is_instance_of(gateway, node, f"{_LOGICAL}.LogicalPlan")
        if plan_node and (_ACTING_NAME.search(kind) or any(is_instance_of(gateway, node, c) for c in _ACTS)):
            raise InputError("only SELECT and WITH queries are allowed")
        if "UnresolvedIdentifier" in kind:
            raise InputError("IDENTIFIER makes names from text, which can't be checked")
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            name = [node.name().funcName()] if kind == "UnresolvedGenerator" else _strings(node.productElement(0))
            if name[-1].lower() in _DENIED:
                raise InputError(f"a function that leaves the query is not allowed: {name[-1]}")
        if kind == "UnresolvedRelation":
            name = _strings(node.multipartIdentifier())
            # a name of several parts may be a format and a path
            if len(name) > 1 and not spark.catalog.tableExists(".".join("`" + p.replace("`", "``") + "`" for p in name)):
                raise InputError(f"no such table: {'.'.join(name)}")
    return text


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None, preview: bool = True) -> DataFrame:
    """The result of a read-only query over ``tables``; a preview is capped at PREVIEW_ROWS + 1 rows, a result to be saved is not."""
    text = check_read_only(spark, query)
    views = spark.catalog
    with _registering:  # names are resolved before another query can take them
        held = {name: spark.table(f"`{name}`") for name in tables or {} if any(t.name.lower() == name.lower() and t.isTemporary for t in views.listTables(pattern=name))}
        try:
            for name, df in (tables or {}).items():
                df.createOrReplaceTempView(name)
            out = spark.sql(text)
        finally:  # the caller's own views are as they were
            for name in tables or {}:
                held[name].createOrReplaceTempView(name) if name in held else views.dropTempView(name)
    return out.limit(PREVIEW_ROWS + 1) if preview else out


def save_as(store, query: str, name: str, current: str | None = None) -> dict:
    """The whole result of a query over a store's datasets as a dataset of its own, below the current one and in its project."""
    listed = store.list()
    parent = current or (listed[0]["id"] if listed else None)
    return store.create(run_sql(store.spark, query, store.views(parent), preview=False), name, parent=parent)
