"""Access decisions: which requests a user's role may make.

Roles are nested (viewer < analyst < admin). Every protected route family has
a fixed set of permitted roles; routes outside these families are not
guarded and produce no decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("viewer", "analyst", "admin")

# Protected route families and the roles permitted on them.
PERMISSIONS = {
    "/metrics": ("viewer", "analyst", "admin"),
    "/query": ("analyst", "admin"),
    "/nl-query": ("analyst", "admin"),
    "/admin": ("admin",),
}

ROUTE_FAMILY = r"^(/[^/?]+)"


def permissions_frame(spark: SparkSession, permissions: dict | None = None) -> DataFrame:
    """(route, allowed_roles) - a constant table of a handful of rows."""
    perms = permissions or PERMISSIONS
    return spark.createDataFrame(
        [(route, list(roles)) for route, roles in perms.items()],
        "route string, allowed_roles array<string>")


def route_family(path_col: str = "path"):
    return F.regexp_extract(F.col(path_col), ROUTE_FAMILY, 1)


def access_decisions(requests: DataFrame, users: DataFrame,
                     permissions: DataFrame) -> DataFrame:
    """One audit row per request of a known, active user on a protected route.

    ``requests``: id, username, method, path, query_string, created_at.
    ``users``: username, role, is_active. Unknown or inactive users are
    rejected before any role check and leave no row here.

    The user join is a regular equi-join (users grow with the data: shuffle,
    or AQE broadcast when small at run time). Only the constant permission
    table is broadcast.
    """
    active = users.where(F.col("is_active")).select("username", "role")
    req = requests.withColumn("route", route_family("path"))
    decided = (req.join(active, "username")
               .join(F.broadcast(permissions), "route"))
    allowed = F.array_contains(F.col("allowed_roles"), F.col("role"))
    return decided.select(
        F.col("id").cast("long").alias("id"),
        "username", "role",
        F.concat_ws(" ", "method", "path").alias("action"),
        F.nullif(F.col("query_string"), F.lit("")).alias("detail"),
        F.when(allowed, F.lit("allowed")).otherwise(F.lit("denied")).alias("status"),
        "created_at")
