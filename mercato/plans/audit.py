"""Audit rows for queries, generated queries and logins, and reading the log.

All jobs are projections over tables of requests, so they scale with the
request volume and need no shared counter: the audit id is the id of the
request the row records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators.access import access_decisions  # noqa: F401  (re-export)
from mercato.operators.screen import screen_queries
from mercato.plans import audit_log
from mercato.schemas import AUDIT_SCHEMA

AUDIT_COLUMNS = [f.name for f in AUDIT_SCHEMA.fields]
LOGIN_ACTION = "POST /auth/login"
BAD_CREDENTIALS = "bad credentials"


def _audit(df: DataFrame, action, detail, status) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), "username", "role",
                     action.alias("action"), detail.alias("detail"),
                     status.alias("status"), "created_at")


def query_audit(screened: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Audit of screened ad-hoc statements (allowed: the SQL; denied: SQL -> reason)."""
    allowed = F.col("verdict") == "allowed"
    detail = F.when(allowed, F.col(sql_col)).otherwise(
        F.concat(F.col(sql_col), F.lit(" -> "), F.col("reason")))
    return _audit(screened, F.lit("query"), detail, F.col("verdict"))


def nl_query_audit(screened: DataFrame, question_col: str = "question",
                   sql_col: str = "sql") -> DataFrame:
    """Audit of generated statements (allowed: question => SQL; denied: question -> reason)."""
    allowed = F.col("verdict") == "allowed"
    detail = F.when(allowed, F.concat(F.col(question_col), F.lit(" => "), F.col(sql_col))) \
              .otherwise(F.concat(F.col(question_col), F.lit(" -> "), F.col("reason")))
    return _audit(screened, F.lit("nl-query"), detail, F.col("verdict"))


def screen_and_audit(log: DataFrame, users: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Screen the statements of users allowed on the query route and audit them."""
    from mercato.operators.access import PERMISSIONS

    roles = list(PERMISSIONS["/query"])
    active = users.where(F.col("is_active") & F.col("role").isin(roles)).select("username", "role")
    return query_audit(screen_queries(log.join(active, "username"), sql_col), sql_col)


def login_audit(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """One row per login attempt.

    ``attempts``: id, username, authenticated (password check result), created_at.
    Success needs a known, active user and a good password; failures carry no role.
    """
    u = users.select("username", F.col("role").alias("_role"), "is_active")
    j = attempts.join(u, "username", "left")
    ok = F.coalesce(F.col("authenticated") & F.col("is_active"), F.lit(False))
    return j.select(
        F.col("id").cast("long").alias("id"), "username",
        F.when(ok, F.col("_role")).alias("role"),
        F.lit(LOGIN_ACTION).alias("action"),
        F.when(~ok, F.lit(BAD_CREDENTIALS)).alias("detail"),
        F.when(ok, F.lit("allowed")).otherwise(F.lit("denied")).alias("status"),
        "created_at")


def latest_audit(audit: DataFrame, limit: int = 100) -> DataFrame:
    """The newest ``limit`` rows by id (each partition keeps at most ``limit``)."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return audit.orderBy(F.col("id").desc()).limit(limit).select(*AUDIT_COLUMNS)


def append_audit(audit: DataFrame, path: str) -> None:
    """Append a batch of audit rows to the stored log (see ``audit_log``)."""
    audit_log.append(audit.select(*AUDIT_COLUMNS), path)


def append_rows(spark, rows: list[tuple], path: str) -> None:
    """Append audit rows that the driver holds (the outcomes of single requests)."""
    append_audit(spark.createDataFrame(rows, AUDIT_SCHEMA), path)


def read_audit(spark, path: str) -> DataFrame:
    """All rows of the stored log, created_at with its zone; empty if there is none."""
    return audit_log.read(spark, path)


def newest_audit(spark, path: str, limit: int = 100) -> DataFrame:
    """The newest ``limit`` rows by id, from the files that can hold them."""
    return audit_log.newest(spark, path, limit)


def without_zone(audit: DataFrame) -> DataFrame:
    """Audit rows with created_at as UTC without a zone, as the requests have it."""
    local = F.col("created_at").cast("timestamp_ntz")
    return audit.withColumn("created_at", F.convert_timezone(F.current_timezone(), F.lit("UTC"), local))
