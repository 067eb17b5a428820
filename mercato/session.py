"""SparkSession construction and cluster-level settings.

On a cluster the session is created by the launcher and already names a shared
checkpoint folder in ``spark.checkpoint.dir``; this module only fills settings
that are unset, so local tests get a private scratch folder while production
keeps what the cluster configured.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. They are applied only when the session does not
# already carry a value, so cluster-level configuration always wins.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
}


def get_spark(master: str | None = None, app_name: str = "mercato",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session (or build one) with the engine's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply engine defaults that the session leaves unset, and the checkpoint dir."""
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    checkpoint_dir(spark)
    return spark


_FALLBACK_DIRS: dict[int, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared folder there). Only when it is unset, as in local tests, a scratch
    folder is created once per SparkContext and registered with
    ``setCheckpointDir`` (the setting itself cannot change at run time). Any
    other master without the setting is an error: a folder of the driver's
    machine would be invisible to the executors.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not conf_dir:
        key = id(sc._jsc)
        if key not in _FALLBACK_DIRS:
            _FALLBACK_DIRS[key] = tempfile.mkdtemp(prefix="mercato-ckpt-")
        conf_dir = _FALLBACK_DIRS[key]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for an intermediate table."""
    return os.path.join(checkpoint_dir(spark), name)


# Aim for shuffle partitions of about this size before AQE coalesces them.
SHUFFLE_PARTITION_BYTES = 256 * 1024 * 1024
# Columnar Parquet bytes grow when rows are shuffled (decoded, row format).
SHUFFLE_EXPANSION = 3
_ADVISORY_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int):
    """Start shuffles with enough partitions for ``input_bytes`` of Parquet input.

    Raises AQE's initial partition number (never lowers it) so that each
    shuffle partition of a large job fits an executor's memory; AQE still
    coalesces the small ones. The previous setting is restored afterwards.
    """
    wanted = math.ceil(input_bytes * SHUFFLE_EXPANSION / SHUFFLE_PARTITION_BYTES)
    previous = spark.conf.get(_INITIAL_PARTITIONS, None)
    current = int(previous or spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted <= current:
        yield current
        return
    spark.conf.set(_INITIAL_PARTITIONS, str(wanted))
    try:
        yield wanted
    finally:
        if previous is None:
            spark.conf.unset(_INITIAL_PARTITIONS)
        else:
            spark.conf.set(_INITIAL_PARTITIONS, previous)


def sized_session(spark: SparkSession, input_bytes: int, most_bytes: int | None = None) -> SparkSession:
    """A session like ``spark`` whose shuffles start with enough partitions for
    ``input_bytes`` of Parquet input.

    Raises AQE's initial partition number (never lowers it) so that each
    shuffle partition of a large job fits an executor's memory; AQE still
    coalesces the small ones, to ``most_bytes`` each at most (without it: to
    the session's advisory size). The settings of ``spark`` are copied and stay
    as they are, so jobs that run at once in it are not affected.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and session.conf.isModifiable(key):
            session.conf.set(key, value)
    wanted = math.ceil(input_bytes * SHUFFLE_EXPANSION / SHUFFLE_PARTITION_BYTES)
    current = int(spark.conf.get(_INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set(_INITIAL_PARTITIONS, str(max(wanted, current)))
    if most_bytes is not None:
        given = spark.conf.get(_ADVISORY_BYTES)
        number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", given.strip().lower()).groups()
        size = int(number) * 1024 ** "bkmgtp".index(unit[:1] or "b")
        session.conf.set(_ADVISORY_BYTES, str(min(size, most_bytes)))
    return session
