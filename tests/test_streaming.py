"""Streaming access audit: incremental, restartable, no duplicates."""

import datetime as dt

from mercato.plans.audit import read_audit
from mercato.schemas import REQUESTS_SCHEMA
from mercato.streaming.audit_stream import decisions_stream, file_stream, start_audit_stream

T0 = dt.datetime(2024, 1, 1, 12)


def test_stream_appends_each_request_once(spark, scratch):
    users = spark.createDataFrame(
        [("v", "viewer", True), ("a", "analyst", True), ("off", "admin", False)],
        "username string, role string, is_active boolean")
    inbox, audit, ckpt = scratch + "/in", scratch + "/audit", scratch + "/ckpt"

    def arrive(batch, rows):
        spark.createDataFrame(rows, REQUESTS_SCHEMA).coalesce(1).write.parquet(
            f"{inbox}/batch={batch}")

    def run():
        stream = file_stream(spark, inbox, REQUESTS_SCHEMA, glob="*.parquet")
        start_audit_stream(decisions_stream(stream, users, spark), audit, ckpt) \
            .awaitTermination()

    arrive(1, [(1, "v", "GET", "/metrics/aov", "", T0), (2, "v", "POST", "/query", "", T0),
               (3, "off", "GET", "/metrics/aov", "", T0)])
    run()
    first = {r["id"]: r["status"] for r in read_audit(spark, audit).collect()}
    assert first == {1: "allowed", 2: "denied"}

    arrive(2, [(4, "a", "POST", "/query", "", T0 + dt.timedelta(days=1))])
    run()   # restart from the same checkpoint: only the new file is processed
    got = sorted((r["id"], r["status"]) for r in read_audit(spark, audit).collect())
    assert got == [(1, "allowed"), (2, "denied"), (4, "allowed")]


def test_query_audit_stream(spark, scratch):
    from mercato.streaming.audit_stream import query_audit_stream

    users = spark.createDataFrame([("a", "analyst", True), ("v", "viewer", True)],
                                  "username string, role string, is_active boolean")
    schema = "id long, username string, sql string, created_at timestamp_ntz"
    spark.createDataFrame([(1, "a", "SELECT 1", T0), (2, "a", "DROP TABLE x", T0),
                           (3, "v", "SELECT 1", T0)], schema) \
        .coalesce(1).write.parquet(scratch + "/log/b=1")
    stream = file_stream(spark, scratch + "/log", schema)
    start_audit_stream(query_audit_stream(stream, users), scratch + "/audit",
                       scratch + "/ckpt").awaitTermination()
    got = {r["id"]: (r["status"], r["detail"]) for r in read_audit(spark, scratch + "/audit").collect()}
    assert got == {1: ("allowed", "SELECT 1"),
                   2: ("denied", "DROP TABLE x -> only SELECT/WITH (read-only) queries are allowed")}


def test_stream_is_compacted_as_it_goes(spark, scratch):
    """Every second batch compacts; each request stays in the log once."""
    from mercato.plans import audit_log

    users = spark.createDataFrame([("v", "viewer", True)], "username string, role string, is_active boolean")
    inbox, audit, ckpt = scratch + "/in", scratch + "/audit", scratch + "/ckpt"
    for batch in range(6):
        spark.createDataFrame([(batch, "v", "GET", "/metrics/aov", "", T0)], REQUESTS_SCHEMA).coalesce(1) \
            .write.parquet(f"{inbox}/batch={batch}")
    stream = file_stream(spark, inbox, REQUESTS_SCHEMA, max_files_per_trigger=1)
    start_audit_stream(decisions_stream(stream, users, spark), audit, ckpt, compact_every=6).awaitTermination()
    found = audit_log.snapshot(spark, audit)
    assert found.last_batch(ckpt) == 5 and len(found.files) <= audit_log.MOST_FILES
    assert sorted(r["id"] for r in read_audit(spark, audit).collect()) == list(range(6))
