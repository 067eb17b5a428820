"""Warehouse build: land the raw tables, materialise dimensions and fact, publish.

Layout under ``root`` (a shared folder on the cluster)::

    root/build=<id>/raw/<table>/            Parquet copy of each landing table
    root/build=<id>/<dim>/                  the four dimensions
    root/build=<id>/fct_order_items/order_month=.../   the fact, by month
    root/build=<id>/order_days/order_month=.../        delivered lines by order and date
    root/build=<id>/<view>/                 the four views, aggregated once
    root/build=<id>/_stage/                 inputs of later steps, dropped at the end
    root/build=<id>/_published/             written last: marks a complete build

A build is all-or-nothing: readers only see builds carrying ``_published``,
and it is written after every table (and every key check) succeeded, so a
failed build leaves the previous one in place. Two builds at once do not both
publish: a build notes the newest version under ``root.versions/`` when it
starts and claims the next one, by a file that only one writer can make, before
it writes ``_published``; the other raises BuildConflict and stays invisible.
The newest build is the one with the largest version, whatever its id (builds
made before versions existed come first, by id). Each written table also cuts
the lineage: reports read Parquet, never the CSV parse or the build joins.
"""

from __future__ import annotations

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.keys import assert_primary_key
from mercato.plans.model import (Warehouse, joined_lines, model_tables, order_level,
                                 with_measures)
from mercato.plans.rollup import ORDER_DAYS, monthly_from_days, order_days
from mercato.plans.views import (category_aggregate, category_view, seller_aggregate, seller_view,
                                 vw_delivery_sla)
from mercato.schemas import DIMENSIONS, FACT, PRIMARY_KEYS
from mercato.session import SHUFFLE_EXPANSION, sized_session
from mercato.sources.fs import (FileExists, child_dirs, child_files, create_new, delete, exists,
                                path_bytes, read_text)

PUBLISHED = "_published"
STAGE = "_stage"
VIEWS = ("vw_monthly_revenue", "vw_category_performance", "vw_seller_scorecard", "vw_delivery_sla")


# A joined row in memory, and the shuffled bytes of a partition that one task
# sorts (a fact row takes six to eight times its shuffled size in memory).
JOINED_ROW_BYTES = 128
SORTED_BYTES = 32 * 1024 * 1024


class BuildConflict(RuntimeError):
    """Another build was published since this one started."""


@dataclass
class BuildResult:
    build_id: str
    path: str
    raw_counts: dict[str, int]

    @property
    def raw_total(self) -> int:
        return sum(self.raw_counts.values())


def new_build_id() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")


def _write(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


# Independent writes are submitted from a few driver threads so small tables
# do not leave the cluster idle; results are gathered before publishing.
WRITE_THREADS = 4


def run_all(tasks: dict[str, callable]) -> dict:
    """Run independent Spark jobs concurrently; re-raise the first failure."""
    with ThreadPoolExecutor(max_workers=WRITE_THREADS) as pool:
        futures = {name: pool.submit(task) for name, task in tasks.items()}
        return {name: f.result() for name, f in futures.items()}


def _land_one(df: DataFrame, table: str, build_path: str) -> int:
    obs = Observation(f"rows_{table}")
    _write(df.observe(obs, F.count(F.lit(1)).alias("n")), f"{build_path}/raw/{table}")
    return int(obs.get["n"])


def land_raw(raw: dict[str, DataFrame], build_path: str) -> dict[str, int]:
    """Write each landing table once; its row count is observed on the write."""
    return run_all({table: (lambda df=df, table=table: _land_one(df, table, build_path))
                    for table, df in raw.items()})


def _write_dimension(spark: SparkSession, df: DataFrame, dim: str, path: str) -> None:
    _write(df, f"{path}/{dim}")
    assert_primary_key(spark.read.parquet(f"{path}/{dim}"), PRIMARY_KEYS[dim], dim)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A written table by its known schema (an empty one has no files to infer from)."""
    return spark.read.schema(schema).parquet(path)


def _staged(df: DataFrame, path: str) -> DataFrame:
    _write(df, path)
    return _read(df.sparkSession, path, df.schema)


def _write_views(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Aggregate the fact once per view; ranks read the written aggregates and
    the monthly view the order-level rollup, which is returned."""
    fact = tables[FACT]

    def categories():
        measures = _staged(category_aggregate(fact, tables["dim_product"]), f"{path}/{STAGE}/categories")
        _write(category_view(measures), f"{path}/vw_category_performance")

    def sellers():
        measures = _staged(seller_aggregate(fact, tables["dim_seller"]), f"{path}/{STAGE}/sellers")
        _write(seller_view(measures), f"{path}/vw_seller_scorecard")

    def months():
        days = order_days(fact)
        _write_by_month(days, f"{path}/{ORDER_DAYS}", "order_date")
        days = _read(fact.sparkSession, f"{path}/{ORDER_DAYS}", days.schema)
        _write(monthly_from_days(days), f"{path}/vw_monthly_revenue")
        return days

    return run_all({
        "vw_monthly_revenue": months,
        "vw_category_performance": categories,
        "vw_seller_scorecard": sellers,
        "vw_delivery_sla": lambda: _write(vw_delivery_sla(fact, tables["dim_customer"]),
                                          f"{path}/vw_delivery_sla"),
    })["vw_monthly_revenue"]


def _by_month(df: DataFrame, time: str) -> DataFrame:
    # Rebalance by month (AQE splits big months, merges small ones) so each
    # month is written as a few advisory-sized files, not one per task; rows
    # sorted by purchase time inside each file give tight row-group ranges
    # for the timestamp predicates of bounded trends.
    return (df.hint("rebalance", "order_month")
              .sortWithinPartitions("order_month", time))


def _write_by_month(df: DataFrame, path: str, time: str) -> None:
    _write(_by_month(df, time), path, partition_by="order_month")


def fact_by_month(order_items: DataFrame, order_info: DataFrame) -> DataFrame:
    """The fact as it is written: joined lines are moved and sorted by month,
    and the measures, which follow from each row, are added after that."""
    return with_measures(_by_month(joined_lines(order_items, order_info), "order_purchase_timestamp"))


def _versions(spark: SparkSession, root: str) -> dict[str, int]:
    """The version that each build has claimed."""
    folder = f"{root.rstrip('/')}.versions"
    return {json.loads(read_text(spark, f"{folder}/{name}"))["build_id"]: int(name.removesuffix(".json"))
            for name in sorted(child_files(spark, folder)) if name.endswith(".json")}


def _claim(spark: SparkSession, root: str, version: int, build_id: str) -> None:
    """Make ``version`` this build's; only one build can."""
    path = f"{root.rstrip('/')}.versions/{version:020d}.json"
    try:
        create_new(spark, path, json.dumps({"build_id": build_id}))
    except FileExists:
        winner = json.loads(read_text(spark, path))["build_id"]
        raise BuildConflict(f"build {build_id} under {root} is not published: build {winner} "
                            "was, since this one started") from None


def build(spark: SparkSession, raw: dict[str, DataFrame], root: str,
          analytics: bool = True, build_id: str | None = None) -> BuildResult:
    """Materialise a complete warehouse build under ``root`` and publish it.

    ``raw`` is the nine landing tables (from ``read_raw_csv`` or the test-data
    adapter). With ``analytics=False`` only the landing copy is written.
    """
    build_id = build_id or new_build_id()
    path = f"{root.rstrip('/')}/build={build_id}"
    base = max(_versions(spark, root).values(), default=0)
    counts = land_raw(raw, path)
    if analytics:
        # The fact joins lines, orders and reviews: its shuffles are sized from
        # them, in a session of this build's own, so builds at once do not mix.
        # Well packed Parquet says little of the rows in memory: they count too.
        joined = ("order_items", "orders", "order_reviews")
        join_bytes = max(sum(path_bytes(spark, f"{path}/raw/{t}") for t in joined),
                         sum(counts[t] for t in joined) * JOINED_ROW_BYTES // SHUFFLE_EXPANSION)
        own = sized_session(spark, join_bytes, SORTED_BYTES)
    else:
        own = spark
    landed = {t: own.read.parquet(f"{path}/raw/{t}") for t in raw}
    if analytics:
        # The order-level table (one row per order) is written first, so the
        # fact is one join of two scans: AQE then splits the partition of an
        # order holding a large share of all lines.
        order_info = _staged(order_level(landed["orders"], landed["order_reviews"]),
                             f"{path}/{STAGE}/order_info")
        tables = model_tables(landed, order_info)
        tasks = {dim: (lambda dim=dim: _write_dimension(own, tables[dim], dim, path))
                 for dim in DIMENSIONS}
        tasks[FACT] = lambda: _write(fact_by_month(landed["order_items"], order_info), f"{path}/{FACT}",
                                     partition_by="order_month")
        run_all(tasks)
        written = {name: _read(own, f"{path}/{name}", tables[name].schema) for name in tasks}
        written[ORDER_DAYS] = _write_views(written, path)
    marker = {"build_id": build_id, "analytics": analytics, "raw_rows": sum(counts.values()),
              # the schemas readers open the tables with, so nothing is inferred
              "schemas": json.dumps({**{f"raw/{t}": landed[t].schema.jsonValue() for t in raw},
                                     **({n: tables.get(n, df).schema.jsonValue() for n, df in written.items()}
                                        if analytics else {}),
                                     **({n: spark.read.parquet(f"{path}/{n}").schema.jsonValue()
                                         for n in VIEWS} if analytics else {})})}
    _claim(spark, root, base + 1, build_id)
    spark.createDataFrame([marker], "build_id string, analytics boolean, raw_rows long, schemas string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/{PUBLISHED}")
    delete(spark, f"{path}/{STAGE}")
    return BuildResult(build_id=build_id, path=path, raw_counts=counts)


def retire_builds(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete superseded and failed builds and leftover staging folders.

    The newest ``keep`` published builds stay. An unpublished build older than
    the newest published one has failed, or would lose to it, and goes; a newer
    one may be running, and one that has claimed its version may be about to
    publish: they stay. Returns the deleted paths.
    """
    if keep < 1:
        raise ValueError("at least one published build must be kept")
    published = published_builds(spark, root)
    kept, claimed = set(published[-keep:]), _versions(spark, root)
    gone = []
    for name in sorted(child_dirs(spark, root)):
        build_id = name.removeprefix("build=")
        path = f"{root.rstrip('/')}/{name}"
        if name == build_id or not published:
            continue
        if build_id in kept:
            path = f"{path}/{STAGE}"
        elif build_id not in published and (build_id > published[-1] or build_id in claimed):
            continue
        if delete(spark, path):
            gone.append(path)
    return gone


def published_builds(spark: SparkSession, root: str) -> list[str]:
    """Ids of the published builds, oldest version first."""
    ids = [name.split("=", 1)[1] for name in child_dirs(spark, root)
           if name.startswith("build=")]
    versions = _versions(spark, root)
    return sorted((i for i in ids
                   if exists(spark, f"{root.rstrip('/')}/build={i}/{PUBLISHED}/_SUCCESS")),
                  key=lambda i: (versions.get(i, 0), i))


def load_warehouse(spark: SparkSession, root: str, build_id: str | None = None) -> Warehouse:
    """The newest published build (or ``build_id``) as a Warehouse with its views.

    Objects are opened on first access, so a report lists and reads only the
    tables it uses (the fact's month folders are discovered once per load).
    """
    builds = published_builds(spark, root)
    if build_id is None:
        if not builds:
            raise FileNotFoundError(f"no published warehouse build under {root}")
        build_id = builds[-1]
    elif build_id not in builds:
        raise FileNotFoundError(f"build {build_id} under {root} is not published")
    path = f"{root.rstrip('/')}/build={build_id}"
    marker = spark.read.schema("analytics boolean, schemas string").parquet(f"{path}/{PUBLISHED}").first()
    schemas = {name: T.StructType.fromJson(value)
               for name, value in json.loads(marker["schemas"]).items()}
    names = [*DIMENSIONS, FACT, *VIEWS] if marker["analytics"] else []
    tables: dict = {name: (lambda name=name: _read(spark, f"{path}/{name}", schemas[name])
                           .select(*schemas[name].names)) for name in names}
    rollup = None
    if ORDER_DAYS in schemas:  # builds before it have none
        rollup = lambda: _read(spark, f"{path}/{ORDER_DAYS}", schemas[ORDER_DAYS])
    return Warehouse(
        rollup=rollup, tables=tables, raw={}, stored_views=marker["analytics"],
        loader=lambda session: load_warehouse(session, root, build_id),
        raw_loaders={name.removeprefix("raw/"): (lambda name=name: _read(
            spark, f"{path}/{name}", schemas[name])) for name in schemas if name.startswith("raw/")})


def build_from_csv(spark: SparkSession, src_dir: str, root: str,
                   analytics: bool = True) -> BuildResult:
    """Presence check, CSV read, landing copy, model, publish."""
    from mercato.sources.landing import read_raw_csv

    return build(spark, read_raw_csv(spark, src_dir), root, analytics=analytics)
