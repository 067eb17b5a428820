"""Audit of a batch of submitted statements, with the errors of those that do not run.

The screen judges every row of the log in one distributed projection. Of the
statements that pass, the distinct texts are analysed (not run) in the isolated
session, where unknown columns and functions, wrong types, missing groupings
and syntax errors surface; the outcomes, one row per text, are joined back to
the log. Analysing is the driver's work, so the number of distinct texts has a
stated bound, and more texts are an error that names it: split the batch.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.text import strip_blanks
from mercato.operators.access import PERMISSIONS
from mercato.operators.screen import TRAILING_SEMICOLONS, screen_queries
from mercato.plans.adhoc import isolated_session, refused_part, unqualify
from mercato.plans.audit import query_audit
from mercato.plans.model import Warehouse

MAX_STATEMENTS = 10_000
OUTCOMES = "_text string, _verdict string, _why string"


class TooManyStatements(ValueError):
    """A batch has more distinct statements than one driver is asked to analyse."""


def engine_error(exc: Exception) -> str:
    """The error's standard state and the engine's name for it, without the text
    that repeats the statement: ``42703 UNRESOLVED_COLUMN.WITH_SUGGESTION``."""
    if isinstance(exc, PySparkException) and exc.getCondition():
        return f"{exc.getSqlState()} {exc.getCondition()}"
    return type(exc).__name__


def analysed(wh: Warehouse, spark: SparkSession, text: str) -> tuple[str, str | None]:
    """Verdict and reason of one screened statement, from its analysis alone."""
    try:
        refused = refused_part(isolated_session(wh, spark).sql(unqualify(text)))
    except Exception as exc:  # noqa: BLE001 - any analysis error is the outcome
        return "error", engine_error(exc)
    return ("denied", f"not allowed here: {refused}") if refused else ("allowed", None)


def audit_statements(wh: Warehouse, spark: SparkSession, log: DataFrame, users: DataFrame,
                     max_statements: int = MAX_STATEMENTS) -> DataFrame:
    """One audit row per statement of an active user whose role may query.

    ``log``: id, username, sql, created_at. ``allowed`` (detail: the SQL),
    ``denied`` (SQL -> the screen's or the plan's reason) or ``error`` (SQL ->
    state and name of the analysis error). More than ``max_statements`` distinct
    texts that pass the screen raise TooManyStatements; nothing is cut off.
    """
    active = users.where(F.col("is_active") & F.col("role").isin(*PERMISSIONS["/query"]))
    screened = screen_queries(log.join(active.select("username", "role"), "username"),
                              block_code_calls=True)
    text = F.regexp_replace(strip_blanks(F.col("sql")), TRAILING_SEMICOLONS, "")
    screened = screened.withColumn("_text", text)
    texts = [r["_text"] for r in screened.where("verdict = 'allowed'").select("_text").distinct()
             .limit(max_statements + 1).collect()]
    if len(texts) > max_statements:
        raise TooManyStatements(f"more than {max_statements} distinct statements in one batch")
    outcomes = spark.createDataFrame([(t, *analysed(wh, spark, t)) for t in texts], OUTCOMES)
    passed = F.col("verdict") == "allowed"
    joined = screened.join(outcomes, "_text", "left").select(
        "id", "username", "role", "sql", "created_at",
        F.when(passed, F.col("_verdict")).otherwise(F.col("verdict")).alias("verdict"),
        F.when(passed, F.col("_why")).otherwise(F.col("reason")).alias("reason"))
    return query_audit(joined)
