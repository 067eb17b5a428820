"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import checkpoint_dir, configure

__all__ = ["BoundedMemo", "acyclic", "bounded_batches", "checkpointed", "connected_components", "documents",
           "exact_products", "few_files", "held", "matching", "read", "tidied"]


# Rows and bytes handed to a Python worker at a time, where the session does not say.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
            "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts do not add up in a worker."""
    said = spark.conf.getAll
    for key, value in _BATCHES.items():
        if key not in said:
            spark.conf.set(key, value)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables, through Spark's reader (any store it can open)."""
    configure(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


ROWS_PER_FILE = 20_000


def few_files(df: DataFrame, rows: int, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """``df`` in no more partitions than about ``rows`` rows need (a guess will
    do: every row stays). Each file that a task writes can cost a process of its
    own (``chmod``, on stores without native calls), which for a moment counts
    as much memory as the executor that starts it."""
    return df.coalesce(max(1, -(-rows // per_file)))


def checkpointed(df: DataFrame, name: str, rows: int | None = None,
                 per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write ``df`` under the cluster's shared checkpoint folder and read it back.

    Lineage ends at the written files, so an executor lost later costs no
    recomputation, and every later branch sees the very same rows. ``rows``:
    about how many there are, where that is known (see few_files).
    """
    if rows is not None:
        df = few_files(df, rows, per_file)
    spark = df.sparkSession
    bounded_batches(spark)
    path = os.path.join(checkpoint_dir(spark), "mercato-llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Ids sent to every executor at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def matching(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi",
             rows: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``column`` is (``left_semi``) or is not
    (``left_anti``) in the one-column table ``ids``. The ids are counted first:
    up to BROADCAST_IDS they are broadcast, so that ``df`` is not shuffled.
    ``rows``: about how many ids there are at most, where that is known."""
    ids = checkpointed(ids.distinct(), "ids", rows)
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), column, how)


_HELD: dict = {}


def held(name, make):
    """``make()``, kept in this Python worker until something else is held.

    Workers outlive tasks and serve one operator after the other; holding the
    tables of one at a time keeps their memory from adding up.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def tidied(run):
    """``run`` for ``mapInArrow``, giving freed memory back to the system at the
    end of the task: workers outlive tasks, and their heaps would stay as large
    as the largest task made them (glibc; nothing happens elsewhere)."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            pa.default_memory_pool().release_unused()
            if trim is not None:
                trim(0)

    return task


@contextmanager
def acyclic():
    """Pause the cycle collector while a task fills large memos of plain tuples
    (there are no cycles to find, and every full pass would walk the memos)."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class BoundedMemo(dict):
    """``memo[key]`` computes a missing entry with ``compute`` and remembers it.

    Keeps two generations of at most ``limit`` entries: a full young one
    becomes the old one, and an entry found in the old one moves up. Frequent
    keys thus stay, and memory does not follow the vocabulary of the data.
    Keys longer than ``longest`` are computed every time.
    """

    def __init__(self, compute, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > self.longest:
                return value
        self.age()
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def unknown(self, keys) -> list:
        """Those of ``keys`` that would be computed, and then remembered."""
        old, longest = self.old, self.longest
        return [k for k in keys if k not in self and k not in old and len(k) <= longest]

    def remember(self, entries) -> None:
        """Entries that were computed elsewhere, many at once (they may pass ``limit``)."""
        self.age()
        self.update(entries)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, whole numbers held in
    doubles. Small ones are multiplied as doubles, which hold their sums exactly,
    larger ones as 64-bit integers. Where a product could pass 64 bits the
    result holds Python's integers (and a later cast to long is an error if one
    does)."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0 ** 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return whole(a) @ whole(b).T


def connected_components(links: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable over undirected links.

    Only ids that occur in a link are returned. Each round points every
    larger neighbour at the smallest neighbour of a node ("large star") and
    then every smaller neighbour at the node's minimum ("small star"); the
    number of rounds grows with the logarithm of the component size. A node
    with very many links is reduced by the map-side minimum, and the joins
    back are plain sort-merge joins that AQE may split. Each round is written
    to the shared checkpoint folder; only one (count, checksum) row per round
    reaches the driver. ``rows``: about how many links there are, where that is
    known.
    """
    def state(df):
        row = df.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    edges = (links.select(F.greatest(a, b).cast("long").alias("hi"),
                          F.least(a, b).cast("long").alias("lo"))
             .where("hi > lo").distinct())
    edges = checkpointed(edges, "cc", rows)
    seen = state(edges)
    while seen[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.where("v > u").join(smallest, "u")
                 .select(F.col("v").alias("hi"), F.least("m", "u").alias("lo")).distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").where("lo <> m")
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        edges = checkpointed(small, "cc", seen[0])
        now = state(edges)
        if now == seen:
            break
        seen = now
    return (edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
            .unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")))
            .distinct())
