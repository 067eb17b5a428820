"""Guarded ad-hoc SQL over the analytics objects.

Three walls; the reference had a screen and a read-only database role:
 1. the screen (``mercato.operators.screen``), plus a block on Spark functions
    that call Java code;
 2. a session of its own (``spark.newSession()``) where the nine analytics
    objects are the temp views and SQL on raw file paths is switched off;
 3. a look at the analysed plan before anything runs (analysing a query reads
    no data): every relation in it must be one of the nine views, a CTE of the
    statement or constant rows. Script transformations, table functions and
    relations of other catalogues are refused wherever they stand.

The caller's statement is wrapped with a row cap (``limit``), which is the
feature of this surface, not a shortcut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.text import clean_sql_text
from mercato.operators.access import PERMISSIONS
from mercato.operators.screen import screen_reason
from mercato.plans.model import Warehouse
from mercato.schemas import ANALYTICS_OBJECTS

DEFAULT_MAX_ROWS = 1000  # fixed value: the reference's default row cap
MAX_ROWS = 100_000  # a caller's own cap may not exceed this

# Quoted text and comments are taken whole, so a qualifier inside them stays.
_QUOTED = (r"""[rR]'[^']*'|[rR]"[^"]*"|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`(?!\s*\.)"""
           r"""|--[^\n]*|/\*.*?\*/""")
_QUALIFIER = re.compile(rf"(?is)({_QUOTED})|(?<![\w.`])(?:analytics|`analytics`)\s*\.\s*")


def unqualify(sql: str) -> str:
    """Drop ``analytics.`` qualifiers of identifiers (temp views have no schema)."""
    return _QUALIFIER.sub(lambda m: m.group(1) or "", sql)


class GuardrailError(ValueError):
    """The statement failed the screen."""


@dataclass
class AdhocResult:
    sql: str
    frame: DataFrame


def _one(spark: SparkSession, expr_fn, text: str | None):
    row = spark.range(0, 1, 1, 1).select(expr_fn(F.lit(text).cast("string")).alias("v")).first()
    return row["v"]


def screen_one(spark: SparkSession, sql: str | None, allowed=ANALYTICS_OBJECTS) -> None:
    """Raise GuardrailError with the reason when ``sql`` fails the screen."""
    reason = _one(spark, lambda c: screen_reason(c, allowed, block_code_calls=True), sql)
    if reason is not None:
        raise GuardrailError(reason)


def clean_one(spark: SparkSession, text: str | None) -> str:
    return _one(spark, clean_sql_text, text) or ""


def isolated_session(wh: Warehouse, spark: SparkSession) -> SparkSession:
    """A session whose temp views are the analytics objects.

    Created once per warehouse and reused (statements cannot change it: the
    screen admits SELECT/WITH only, and DDL words are blocked). Registering
    the views runs no job.
    """
    if wh.isolated is not None:
        return wh.isolated
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    iso = wh.in_session(session)
    for name in ANALYTICS_OBJECTS:
        iso[name].createOrReplaceTempView(name)
    wh.isolated = session
    return session


# Catalyst leaf nodes that read no relation.
_CONSTANT_LEAVES = frozenset(("OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef",
                              "EmptyRelation"))


def _sequence(jseq) -> list:
    return [jseq.apply(i) for i in range(jseq.length())]


def refused_part(frame: DataFrame, allowed=ANALYTICS_OBJECTS) -> str | None:
    """What in the analysed plan is not allowed; None if all of it is.

    The plan of an allowed view is not entered. Subqueries are plans inside
    expressions, and CTE definitions are children of the plan, so both are
    looked at like everything else.
    """
    names = {n.lower() for n in allowed}
    todo = [frame._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind == "View":
            name = node.desc().identifier()
            if node.isTempView() and name.database().isEmpty() and name.table().lower() in names:
                continue
            return f"relation {name.unquotedString()}"
        if "ScriptTransformation" in kind:
            return "script transformation"
        children = _sequence(node.children())
        if kind == "Generate" and children[0].getClass().getSimpleName().startswith("OneRowRelation"):
            return "table function"
        if not children and kind not in _CONSTANT_LEAVES:
            return f"relation of kind {kind}"
        todo += children
        todo += _sequence(node.subqueries())
    return None


def run_read_only(wh: Warehouse, spark: SparkSession, sql: str,
                  max_rows: int | None = None, args: dict | None = None) -> AdhocResult:
    """Screen, analyse, check, cap and run ``sql`` on the analytics objects only.

    ``args`` binds named parameter markers (``:name``) instead of pasting
    values into the text. ``max_rows`` is 1 to MAX_ROWS (None or 0: the default).
    """
    cap = int(max_rows or DEFAULT_MAX_ROWS)
    if not 1 <= cap <= MAX_ROWS:
        raise ValueError(f"max_rows must be in 1..{MAX_ROWS}, got {max_rows!r}")
    screen_one(spark, sql)
    inner = sql.strip().rstrip(";")
    session = isolated_session(wh, spark)
    frame = session.sql(unqualify(inner), args=args)
    refused = refused_part(frame)
    if refused is not None:
        raise GuardrailError(f"not allowed here: {refused}")
    return AdhocResult(sql=sql, frame=frame.limit(cap))


def generated_query(wh: Warehouse, spark: SparkSession, question: str,
                    generated_sql: str, max_rows: int | None = None) -> dict:
    """Question + generated SQL text -> cleaned, screened, capped result.

    The SQL generator itself is an external service; its text is an input.
    """
    sql = clean_one(spark, generated_sql)
    result = run_read_only(wh, spark, sql, max_rows)
    return {"question": question, "sql": sql, "frame": result.frame}


@dataclass
class AuditedRun:
    rows: list | None          # at most the row cap; None when denied or failed
    audit: tuple               # one row in the audit schema


NOT_PERMITTED = "role may not use this route"


def active_role(users: DataFrame, username: str) -> str | None:
    """The role of an active user; None for an unknown or inactive one."""
    row = users.where((F.col("username") == username) & F.col("is_active")).select("role").first()
    return row["role"] if row else None


def run_and_audit(wh: Warehouse, spark: SparkSession, request_id: int, username: str,
                  role: str | None, sql: str, created_at, max_rows: int | None = None,
                  action: str = "query") -> AuditedRun:
    """Run one ad-hoc statement and produce its audit row.

    ``allowed`` (detail: the SQL), ``denied`` (detail: SQL -> reason, also for a
    role that may not query) or ``error`` (detail: SQL -> the engine's whole
    message) - the outcomes of the query route. The capped rows are the
    response and are the only data that reaches the driver.
    """
    def outcome(status: str, detail: str, rows: list | None = None) -> AuditedRun:
        return AuditedRun(rows, (request_id, username, role, action, detail, status, created_at))

    if role not in PERMISSIONS["/query"]:
        return outcome("denied", f"{sql} -> {NOT_PERMITTED}")
    try:
        rows = run_read_only(wh, spark, sql, max_rows).frame.collect()
    except GuardrailError as exc:
        return outcome("denied", f"{sql} -> {exc}")
    except Exception as exc:  # noqa: BLE001 - analysis and runtime errors surface here
        return outcome("error", f"{sql} -> {_message(exc)}")
    return outcome("allowed", sql, rows)


def submit_query(wh: Warehouse, spark: SparkSession, users: DataFrame, audit_path: str,
                 request_id: int, username: str, sql: str, created_at,
                 max_rows: int | None = None) -> AuditedRun:
    """The query route as a whole: look the user up, run, store the audit row."""
    from mercato.plans.audit import append_rows

    run = run_and_audit(wh, spark, request_id, username, active_role(users, username), sql,
                        created_at, max_rows)
    append_rows(spark, [run.audit], audit_path)
    return run


def _message(exc: Exception) -> str:
    return str(exc).strip() or type(exc).__name__


def answer_question(wh: Warehouse, spark: SparkSession, question: str, generated_sql: str,
                    max_rows: int | None = None) -> dict:
    """The generated-SQL response: question, cleaned SQL, row count and rows (capped)."""
    out = generated_query(wh, spark, question, generated_sql, max_rows)
    rows = out.pop("frame").collect()
    return {**out, "row_count": len(rows), "rows": rows}


def answer_and_audit(wh: Warehouse, spark: SparkSession, request_id: int, username: str,
                     role: str | None, question: str, generated_sql: str, created_at,
                     max_rows: int | None = None) -> AuditedRun:
    """Answer one question and produce its audit row.

    allowed: ``question => sql``; denied (role, screen or plan) or error (engine
    or generator): ``question -> message``.
    """
    def row(detail: str, status: str) -> tuple:
        return (request_id, username, role, "nl-query", detail, status, created_at)

    if role not in PERMISSIONS["/nl-query"]:
        return AuditedRun(None, row(f"{question} -> {NOT_PERMITTED}", "denied"))
    try:
        answer = answer_question(wh, spark, question, generated_sql, max_rows)
    except GuardrailError as exc:
        return AuditedRun(None, row(f"{question} -> {exc}", "denied"))
    except Exception as exc:  # noqa: BLE001 - analysis or runtime error
        return AuditedRun(None, row(f"{question} -> {_message(exc)}", "error"))
    return AuditedRun(answer["rows"], row(f"{question} => {answer['sql']}", "allowed"))


def submit_question(wh: Warehouse, spark: SparkSession, users: DataFrame, audit_path: str,
                    request_id: int, username: str, question: str, generated_sql: str, created_at,
                    max_rows: int | None = None) -> AuditedRun:
    """The generated-SQL route as a whole: look the user up, answer, store the audit row."""
    from mercato.plans.audit import append_rows

    run = answer_and_audit(wh, spark, request_id, username, active_role(users, username), question,
                           generated_sql, created_at, max_rows)
    append_rows(spark, [run.audit], audit_path)
    return run
