"""Access decisions on a request stream, appended to the audit dataset.

The reference writes one audit row per access decision as requests arrive.
Here the request log is a Structured Streaming source; each micro-batch is
joined with the (static) users table and the constant permission table and
appended to the stored audit log, whose snapshots remember the batch, so each
row is there once across restarts and executor losses. The query's progress
lives in a checkpoint folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mercato.operators.access import access_decisions, permissions_frame
from mercato.plans import audit_log
from mercato.plans.audit import AUDIT_COLUMNS
from mercato.session import scratch_path

COMPACT_EVERY = 100  # batches


def decisions_stream(requests: DataFrame, users: DataFrame, spark: SparkSession) -> DataFrame:
    """Streaming access decisions (stream-static inner joins, no state kept)."""
    return access_decisions(requests, users, permissions_frame(spark))


def start_audit_stream(decisions: DataFrame, audit_path: str,
                       checkpoint_location: str | None = None,
                       available_now: bool = True, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Append streaming audit rows to the log at ``audit_path``.

    Each micro-batch is one commit under the checkpoint's name and its batch
    number, so a batch that is repeated after a failure is not appended twice.
    Every ``compact_every`` batches the days of many files are compacted; where
    another compaction is first, that one stands.
    """
    spark = decisions.sparkSession
    ckpt = checkpoint_location or scratch_path(spark, f"streams/audit-{uuid.uuid4().hex}")

    def write(rows: DataFrame, batch: int) -> None:
        audit_log.append(rows, audit_path, writer=ckpt, batch=batch)
        if (batch + 1) % compact_every == 0:
            try:
                audit_log.compact(rows.sparkSession, audit_path)
            except audit_log.LogConflict:
                pass

    writer = (decisions.select(*AUDIT_COLUMNS).writeStream.foreachBatch(write)
              .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="10 seconds")
    return writer.start()


def file_stream(spark: SparkSession, directory: str, schema, glob: str = "*.parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in ``directory`` as a stream (explicit schema)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def query_audit_stream(statements: DataFrame, users: DataFrame) -> DataFrame:
    """Streaming audit of submitted statements: screen + verdict per statement.

    ``statements``: id, username, sql, created_at (a stream). Only active users
    whose role may use the query route are screened (others were rejected by
    the access decision). Stateless: a projection plus a stream-static join.
    """
    from mercato.plans.audit import screen_and_audit

    return screen_and_audit(statements, users)
