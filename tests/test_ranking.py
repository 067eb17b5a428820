"""The distributed rank operators against a brute-force rank."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mercato.operators.ranking import global_rank, top_k_ranked, value_bucket


def brute_rank_desc(values):
    """rank() OVER (ORDER BY v DESC NULLS FIRST) computed by counting."""
    nulls = sum(v is None for v in values)
    out = []
    for v in values:
        if v is None:
            out.append(1)
        else:
            out.append(1 + nulls + sum(1 for w in values if w is not None and w > v))
    return out


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)],
                                 "id long, revenue decimal(23,2)")


@pytest.mark.parametrize("seed", range(1, 5))
def test_global_rank_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    # a hot value holding a third of the rows, ties, NULLs and spread values
    values = ([Decimal("7.00")] * 60 + [None] * 5
              + [Decimal(rnd.randint(0, 50)) for _ in range(60)]
              + [Decimal(rnd.randint(0, 10**6)) / 100 for _ in range(55)]
              + [-Decimal(rnd.randint(0, 10**4)) / 100 for _ in range(20)]
              + [Decimal(2 ** n) for n in range(0, 60, 4)] + [Decimal(2 ** n) - Decimal("0.01") for n in range(0, 60, 4)])
    rnd.shuffle(values)
    got = {r["id"]: r["rk"] for r in
           global_rank(frame(spark, values), "revenue", "rk").collect()}
    expected = brute_rank_desc(values)
    assert [got[i] for i in range(len(values))] == expected


def test_global_rank_all_equal_and_empty(spark):
    got = global_rank(frame(spark, [Decimal(1)] * 9), "revenue", "rk")
    assert {r["rk"] for r in got.collect()} == {1}
    empty = global_rank(frame(spark, []), "revenue", "rk")
    assert empty.count() == 0


def test_top_k_ranked_equals_prefix_of_global_rank(spark):
    rnd = random.Random(7)
    values = [Decimal(rnd.randint(0, 30)) for _ in range(120)]
    df = frame(spark, values)
    top = top_k_ranked(df, "revenue", 15, "rk", "id").collect()
    assert len(top) == 15
    full = {r["id"]: r["rk"] for r in global_rank(df, "revenue", "rk").collect()}
    for r in top:
        assert r["rk"] == full[r["id"]]
    expected_ids = [i for i, _ in sorted(enumerate(values), key=lambda p: (-p[1], p[0]))][:15]
    assert sorted(r["id"] for r in top) == sorted(expected_ids)


def test_global_rank_plan_never_ranks_raw_rows_in_one_task(spark):
    values = [Decimal(i % 37) for i in range(300)]
    plan = global_rank(frame(spark, values), "revenue", "rk")._jdf \
        .queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-") for line in plan.split("\n") if line.strip()]
    singles = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert singles, plan
    for i in singles:
        # only the per-bucket totals (one row per bucket) meet in one task
        assert lines[i + 1].startswith("HashAggregate(keys=[_bucket"), lines[i + 1]
    # the ranking window itself is partitioned by bucket
    assert re.search(r"Window \[.*\], \[_bucket#\d+L\], \[", plan), plan


def test_buckets_keep_the_order_of_values(spark):
    rnd = random.Random(11)
    values = sorted({0.0, *(rnd.uniform(-1, 1) * 10 ** rnd.randint(-6, 12) for _ in range(3000)),
                     *(float(2 ** n) for n in range(-30, 60)), *(2.0 ** n * (1 - 2 ** -52) for n in range(-30, 60))})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", value_bucket(F.col("v")).alias("b")).collect()
    buckets = [b for _, b in sorted((r["v"], r["b"]) for r in rows)]
    assert buckets == sorted(buckets) and len(set(buckets)) > 1000
