"""The stored audit log: data files, and snapshots that say which of them are live.

Layout under ``path`` (a shared folder on the cluster)::

    path/data/<uuid>/day=.../part-*.parquet   rows as one append or compaction wrote them
    path/_snapshots/<version>.json            the live files of that version

A snapshot names every live file with its day, rows, bytes, smallest and
largest id and format, and the last batch of every stream that appends here.
A commit writes the next version under a name of its own and renames it without
overwriting, so of two writers one succeeds and the other tries again on top of
it (the file system's rename must be atomic, as HDFS's is). Readers take the
newest snapshot and read exactly its files. Compaction replaces the many small
files of a day by a few, each with an id range of its own; the replaced files
stay until their snapshots expire, so a reader in between sees every row once.

Formats: 1 has ``created_at`` without a zone (UTC by convention), 2 with one.
New rows are written in format 2; rows of both kinds are read as format 2.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.dates import MICROS_PER_DAY, microseconds_between
from mercato.schemas import AUDIT_SCHEMA
from mercato.sources.fs import FileExists, child_dirs, child_files, create_new, delete, read_text

ZONELESS, ZONED = 1, 2
LOG_SCHEMA = T.StructType([T.StructField("created_at", T.TimestampType()) if f.name == "created_at" else f
                           for f in AUDIT_SCHEMA.fields])
FORMATS = {ZONELESS: AUDIT_SCHEMA, ZONED: LOG_SCHEMA}
COLUMNS = [f.name for f in AUDIT_SCHEMA.fields]
SNAPSHOTS = "_snapshots"
MOST_FILES = 4  # of a day, before compaction takes it up
FILE_BYTES = 256 * 1024 * 1024  # of a compacted file, about
ATTEMPTS = 50  # of a commit against other writers


class LogConflict(RuntimeError):
    """Files that were to be replaced are no longer live."""


@dataclass(frozen=True)
class LogFile:
    path: str  # below the log's folder
    day: str | None  # of created_at (UTC)
    rows: int
    size: int
    ids: int  # rows with an id
    min_id: int | None
    max_id: int | None
    format: int = ZONED


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    files: tuple[LogFile, ...] = ()
    batches: tuple[tuple[str, int], ...] = ()  # last batch by writer

    def last_batch(self, writer: str) -> int:
        return dict(self.batches).get(writer, -1)

    def text(self) -> str:
        return json.dumps({"files": [asdict(f) for f in self.files], "batches": self.batches})

    @staticmethod
    def parse(version: int, text: str) -> "Snapshot":
        found = json.loads(text)
        return Snapshot(version, tuple(LogFile(**f) for f in found["files"]),
                        tuple((w, b) for w, b in found["batches"]))


# ---- snapshots -----------------------------------------------------------------

def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name.removesuffix(".json"))
                  for name in child_files(spark, f"{path}/{SNAPSHOTS}") if name.endswith(".json"))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest snapshot of the log (or that of ``version``); version 0 of a
    log that does not exist has no files."""
    path = path.rstrip("/")
    if version is None:
        version = max(_versions(spark, path), default=0)
    if not version:
        return Snapshot()
    return Snapshot.parse(version, read_text(spark, f"{path}/{SNAPSHOTS}/{version:020d}.json"))


def commit(spark: SparkSession, path: str, change: Callable[[Snapshot], Snapshot | None]) -> Snapshot:
    """Make ``change(newest snapshot)`` the next one; nothing if it gives None.
    ``change`` is asked again whenever another writer was first."""
    path = path.rstrip("/")
    for _ in range(ATTEMPTS):
        latest = snapshot(spark, path)
        wanted = change(latest)
        if wanted is None:
            return latest
        wanted = replace(wanted, version=latest.version + 1)
        try:
            create_new(spark, f"{path}/{SNAPSHOTS}/{wanted.version:020d}.json", wanted.text())
            return wanted
        except FileExists:
            continue
    raise LogConflict(f"{path}: {ATTEMPTS} other commits came first")


# ---- rows ----------------------------------------------------------------------

def zoned(audit: DataFrame) -> DataFrame:
    """Audit rows with a zone-aware created_at; one without a zone is UTC."""
    if dict(audit.dtypes)["created_at"] == "timestamp_ntz":
        since = microseconds_between(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("created_at"))
        audit = audit.withColumn("created_at", F.timestamp_micros(since))
    return audit.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields])


def _with_day(rows: DataFrame) -> DataFrame:
    """The UTC day, whatever the session's zone."""
    days = F.floor(F.unix_micros("created_at") / F.lit(MICROS_PER_DAY)).cast("int")
    return rows.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), days))


def _described(spark: SparkSession, path: str, folder: str, form: int) -> tuple[LogFile, ...]:
    """The files of ``folder`` (below ``path``, partitioned by day): one row each."""
    schema = T.StructType([*FORMATS[form].fields, T.StructField("day", T.DateType())])
    top = f"{path}/{folder}" if folder else path
    rows = (spark.read.schema(schema).parquet(top)
            .select("id", "day", "_metadata.file_path", "_metadata.file_size", "_metadata.file_name")
            .groupBy("file_path", "file_size", "file_name", "day")
            .agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.min("id").alias("low"),
                 F.max("id").alias("high")).collect())
    below = f"{folder}/" if folder else ""
    return tuple(sorted((LogFile(
        f"{below}{r['file_path'].rsplit('/', 2)[-2]}/{r['file_name']}", str(r["day"]) if r["day"] else None,
        r["n"], r["file_size"], r["ids"], r["low"], r["high"], form) for r in rows), key=lambda f: f.path))


def append(audit: DataFrame, path: str, writer: str | None = None, batch: int | None = None) -> Snapshot:
    """Append audit rows; rebalanced by day, so a day gets few files per batch.

    A stream names itself (``writer``) and its ``batch``: a batch that the
    newest snapshot has already is not written again, so batches repeated after
    a failure change nothing. Files of an append that never committed are in
    no snapshot and are never read.
    """
    spark, path = audit.sparkSession, path.rstrip("/")

    def done(latest: Snapshot) -> bool:
        return writer is not None and latest.last_batch(writer) >= batch

    latest = snapshot(spark, path)
    if done(latest):
        return latest
    folder = f"data/{uuid.uuid4().hex}"
    (_with_day(zoned(audit)).hint("rebalance", "day").sortWithinPartitions("day", "id")
     .write.partitionBy("day").parquet(f"{path}/{folder}"))
    files = _described(spark, path, folder, ZONED)

    def change(newest: Snapshot) -> Snapshot | None:
        if done(newest) or not files and writer is None:
            return None
        batches = {**dict(newest.batches), **({writer: batch} if writer is not None else {})}
        return replace(newest, files=newest.files + files, batches=tuple(sorted(batches.items())))

    return commit(spark, path, change)


def adopt(spark: SparkSession, path: str) -> Snapshot:
    """Take a log of the old layout (``path/day=.../``, no zone, no snapshots) over as it is."""
    path = path.rstrip("/")
    old = any(name.startswith("day=") for name in child_dirs(spark, path))
    files = _described(spark, path, "", ZONELESS) if old else ()
    known = lambda newest: {f.path for f in newest.files}
    return commit(spark, path, lambda newest: replace(newest, files=newest.files + tuple(
        f for f in files if f.path not in known(newest))) if set(f.path for f in files) - known(newest) else None)


def read_files(spark: SparkSession, path: str, files: Iterable[LogFile]) -> DataFrame:
    """The rows of ``files``; none gives an empty table of the log's schema."""
    files, parts = list(files), []
    for form, schema in FORMATS.items():
        paths = [f"{path.rstrip('/')}/{f.path}" for f in files if f.format == form]
        if paths:
            parts.append(zoned(spark.read.schema(schema).parquet(*paths)))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LOG_SCHEMA)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of the newest snapshot (or of ``version``)."""
    return read_files(spark, path, snapshot(spark, path, version).files)


def files_for_newest(files: Iterable[LogFile], n: int) -> list[LogFile]:
    """Files that can hold one of the ``n`` rows with the largest ids.

    Files are taken by their smallest id, largest first, until they hold ``n``
    ids: all of those are at least the last one's smallest id, the bound. Hence
    the n largest are too, and a file whose largest id is below the bound has
    none of them. Whether days and ids agree does not matter.
    """
    files, held = list(files), 0
    for f in sorted((f for f in files if f.ids), key=lambda f: -f.min_id):
        held += f.ids
        if held >= n:
            return [g for g in files if g.ids and g.max_id >= f.min_id]
    return files  # fewer rows with an id than asked for: rows without one may follow


def newest(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """The ``n`` rows with the largest ids, from the files that can hold them."""
    if n < 1:
        raise ValueError("limit must be positive")
    files = files_for_newest(snapshot(spark, path).files, n)
    return read_files(spark, path, files).orderBy(F.col("id").desc()).limit(n)


# ---- compaction ------------------------------------------------------------------

def _goal(files: list[LogFile], most_files: int, file_bytes: int) -> int:
    """Files that a day is rewritten to."""
    return min(most_files, math.ceil(sum(f.size for f in files) / file_bytes)) or 1


def compact(spark: SparkSession, path: str, most_files: int = MOST_FILES,
            file_bytes: int = FILE_BYTES) -> Snapshot:
    """Rewrite every day of more than ``most_files`` files (and more than its
    bytes ask for) to a few files, dealt by id so that their ranges are apart.

    Appends that commit meanwhile are kept. Of two compactions of the same
    files the later one is a LogConflict and changes nothing.
    """
    path = path.rstrip("/")
    days: dict[str | None, list[LogFile]] = {}
    for f in snapshot(spark, path).files:
        days.setdefault(f.day, []).append(f)
    large = lambda files: max(most_files, math.ceil(sum(f.size for f in files) / file_bytes))
    days = {day: files for day, files in days.items() if len(files) > large(files)}
    old = [f for files in days.values() for f in files]
    if not old:
        return snapshot(spark, path)
    plan = []
    for day, files in days.items():
        ids = [x for f in files if f.ids for x in (f.min_id, f.max_id)] or [0]
        many = max(_goal(files, most_files, file_bytes), math.ceil(sum(f.size for f in files) / file_bytes))
        plan.append((day, many, min(ids), float(max(ids) - min(ids) + 1)))
    goals = spark.createDataFrame(plan, "of string, many int, low long, width double")
    rows = _with_day(read_files(spark, path, old))
    place = F.floor((F.coalesce("id", "low") - F.col("low")) / F.col("width") * F.col("many"))
    dealt = (rows.join(goals, rows["day"].cast("string").eqNullSafe(goals["of"]))
             .withColumn("place", F.least(place, F.col("many") - 1)))
    folder = f"data/{uuid.uuid4().hex}"
    # by range, so that a file holds neighbouring places only
    (dealt.repartitionByRange(sum(p[1] for p in plan), "day", "place")
     .select(*COLUMNS, "day").sortWithinPartitions("day", "id")
     .write.partitionBy("day").parquet(f"{path}/{folder}"))
    made, gone = _described(spark, path, folder, ZONED), {f.path for f in old}

    def change(latest: Snapshot) -> Snapshot:
        if not gone <= {f.path for f in latest.files}:
            delete(spark, f"{path}/{folder}")
            raise LogConflict(f"{path}: another compaction was first")
        return replace(latest, files=tuple(f for f in latest.files if f.path not in gone) + made)

    return commit(spark, path, change)


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Drop all but the newest ``keep`` snapshots and the files that only dropped
    ones name. Files of no snapshot are left alone: an append may be about to
    commit them. Returns the deleted data files."""
    if keep < 1:
        raise ValueError("at least one snapshot must be kept")
    path = path.rstrip("/")
    versions = _versions(spark, path)
    live = {f.path for v in versions[-keep:] for f in snapshot(spark, path, v).files}
    gone: list[str] = []
    for version in versions[:-keep]:
        for f in snapshot(spark, path, version).files:
            if f.path not in live and f.path not in gone:
                delete(spark, f"{path}/{f.path}")
                gone.append(f.path)
        delete(spark, f"{path}/{SNAPSHOTS}/{version:020d}.json")
    return gone
