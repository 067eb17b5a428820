"""Screening of submitted SQL text as column expressions.

The rules fire in a fixed order and the first failing one gives the reason.
They are plain regular-expression column functions, so a table of millions of
submitted statements is screened in one narrow, fully parallel projection, and
a single ad-hoc statement goes through the very same expressions.

Rules (first failure wins):
 1. NULL, empty or blank                        -> "empty query"
 2. a ';' left after trimming trailing ';'      -> "multiple statements are not allowed"
 3. '--' or '/*' anywhere                       -> "SQL comments are not allowed"
 4. does not start with WITH or SELECT          -> "only SELECT/WITH (read-only) queries are allowed"
 5. a blocked word anywhere (whole word)        -> "query contains a forbidden (non-read-only) keyword"
 6. a FROM/JOIN target that is neither an allowed object (optionally written
    as analytics.<name>) nor a CTE name         -> "table not allowed: <target as written>"

Patterns use Java regex semantics with ASCII \\w, \\s and \\b.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.text import strip_blanks
from mercato.schemas import ANALYTICS_OBJECTS

# The words that make a statement non-read-only.
FORBIDDEN_WORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "truncate", "grant",
    "revoke", "merge", "call", "copy", "vacuum", "analyze", "reindex", "comment", "do",
    "set", "begin", "commit", "rollback", "savepoint", "listen", "notify", "prepare",
    "execute", "into", "lock", "refresh",
)
# SQL functions that take FROM inside their parentheses.
FROM_TAKING_FUNCTIONS = ("extract", "substring", "trim", "overlay", "position")
# Spark functions that call arbitrary Java code; blocked for execution only.
CODE_CALLING_FUNCTIONS = ("reflect", "java_method", "try_reflect")

# The reasons, as the reference reports them.
EMPTY = "empty query"
MULTIPLE = "multiple statements are not allowed"
COMMENTS = "SQL comments are not allowed"
NOT_READ_ONLY = "only SELECT/WITH (read-only) queries are allowed"
FORBIDDEN = "query contains a forbidden (non-read-only) keyword"
NOT_ALLOWED = "table not allowed: "

# The schema name and the patterns of the screen's rules.
SCHEMA = "analytics"
STARTS_OK = r"(?i)^\s*(with|select)\b"
TABLE_REFS = r"(?i)\b(?:from|join)\s+([a-zA-Z_][\w.]*)"
CTE_NAMES = r"(?i)([a-zA-Z_]\w*)\s+as\s*\("
TRAILING_SEMICOLONS = r";+$"


def words_pattern(words: Iterable[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


FORBIDDEN_PATTERN = words_pattern(FORBIDDEN_WORDS)
CODE_CALL_PATTERN = words_pattern(CODE_CALLING_FUNCTIONS)
FUNC_FROM_PATTERN = r"(?i)\b(?:" + "|".join(FROM_TAKING_FUNCTIONS) + r")\s*\([^()]*\)"


def statement_body(sql: Column) -> Column:
    """Trimmed text with every trailing ';' removed."""
    return F.regexp_replace(strip_blanks(sql), TRAILING_SEMICOLONS, "")


def table_refs(body: Column) -> Column:
    scan = F.regexp_replace(body, FUNC_FROM_PATTERN, " ")
    return F.regexp_extract_all(scan, F.lit(TABLE_REFS), 1)


def cte_names(body: Column) -> Column:
    """Lower-cased names written as ``name AS (`` (the pattern ignores case).

    The full pattern backtracks over every identifier, so it only runs on
    text that contains ``AS (`` at all.
    """
    lowered = F.lower(body)
    return F.when(lowered.rlike(r"\sas\s*\("),
                  F.regexp_extract_all(lowered, F.lit(CTE_NAMES), 1)) \
            .otherwise(F.array().cast("array<string>"))


def disallowed_refs(refs: Column, ctes: Column, allowed: Iterable[str]) -> Column:
    """FROM/JOIN targets that are not allowed, in order of appearance."""
    allowed_arr = F.array(*[F.lit(a.lower()) for a in sorted(set(allowed))])

    def known(name: Column) -> Column:
        return F.array_contains(allowed_arr, name) | F.array_contains(ctes, name)

    def ok(ref: Column) -> Column:
        name = F.lower(ref)
        dot = F.instr(name, ".")
        schema = F.substring_index(name, ".", 1)
        rest = F.substring(name, dot + 1, F.length(name))
        return F.when(dot > 0, (schema == SCHEMA) & known(rest)).otherwise(known(name))

    return F.filter(refs, lambda r: ~ok(r))


def _text_reason(stripped: Column, body: Column, forbidden: Column) -> Column:
    """Reason of rules 1-5 (NULL when they all pass)."""
    return (F.when(F.coalesce(stripped, F.lit("")) == "", F.lit(EMPTY))
            .when(body.contains(";"), F.lit(MULTIPLE))
            .when(body.contains("--") | body.contains("/*"), F.lit(COMMENTS))
            .when(~body.rlike(STARTS_OK), F.lit(NOT_READ_ONLY))
            .when(forbidden, F.lit(FORBIDDEN)))


def _ref_reason(bad: Column) -> Column:
    """Reason of rule 6 from the list of disallowed references."""
    return F.when(F.size(bad) > 0, F.concat(F.lit(NOT_ALLOWED), F.element_at(bad, 1)))


def _reason(stripped: Column, body: Column, bad: Column, forbidden: Column) -> Column:
    return F.coalesce(_text_reason(stripped, body, forbidden), _ref_reason(bad))


def _forbidden(body: Column, block_code_calls: bool) -> Column:
    hit = body.rlike(FORBIDDEN_PATTERN)
    return hit | body.rlike(CODE_CALL_PATTERN) if block_code_calls else hit


def screen_reason(sql: Column, allowed: Iterable[str] = ANALYTICS_OBJECTS,
                  block_code_calls: bool = False) -> Column:
    """NULL when the statement passes, else the reason of the first failed rule.

    A single expression (used for one statement at a time); tables of
    statements go through ``screen_queries``, which stages the same steps.
    """
    body = statement_body(sql)
    bad = disallowed_refs(table_refs(body), cte_names(body), allowed)
    return _reason(strip_blanks(sql), body, bad, _forbidden(body, block_code_calls))


def screen_queries(df: DataFrame, sql_col: str = "sql",
                   allowed: Iterable[str] = ANALYTICS_OBJECTS,
                   block_code_calls: bool = False) -> DataFrame:
    """``df`` plus ``verdict`` ('allowed' / 'denied') and ``reason`` (NULL if allowed).

    Each intermediate (trimmed text, statement body, references, CTE names)
    is its own column, computed once per row; the optimizer keeps them apart
    because they are used more than once.
    """
    cols = df.columns
    body = F.col("_body")
    staged = (df.withColumn("_stripped", strip_blanks(F.col(sql_col)))
                .withColumn("_body", F.regexp_replace("_stripped", TRAILING_SEMICOLONS, ""))
                .withColumn("_pre", _text_reason(F.col("_stripped"), body,
                                                 _forbidden(body, block_code_calls)))
                # references are only looked at when rules 1-5 pass
                .withColumn("_bad", F.when(F.col("_pre").isNull(), disallowed_refs(
                    table_refs(body), cte_names(body), allowed))))
    reason = F.coalesce(F.col("_pre"), _ref_reason(F.col("_bad")))
    return staged.select(*cols, reason.alias("reason")).withColumn(
        "verdict", F.when(F.col("reason").isNull(), F.lit("allowed")).otherwise(F.lit("denied")))
