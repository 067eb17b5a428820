"""Session helpers: shuffle sizing and the checkpoint folder."""

import pytest

from mercato.session import SHUFFLE_PARTITION_BYTES, checkpoint_dir, sized_shuffles

KEY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_sized_shuffles_raises_and_restores(spark):
    before = spark.conf.get(KEY, None)
    with sized_shuffles(spark, 1000 * SHUFFLE_PARTITION_BYTES) as n:
        assert n == 3000
        assert spark.conf.get(KEY) == "3000"
    assert spark.conf.get(KEY, None) == before
    with sized_shuffles(spark, 1000) as n:          # small input: nothing changes
        assert n == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert spark.conf.get(KEY, None) == before


def test_checkpoint_dir_is_stable(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_elapsed_time_ignores_the_session_time_zone(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from mercato.functions.dates import microseconds_between

    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [(dt.datetime(2017, 3, 11, 12, 0), dt.datetime(2017, 3, 13, 12, 0, 0, 250000)),
            (dt.datetime(2017, 11, 4, 23, 30), dt.datetime(2017, 11, 5, 1, 30)),
            (dt.datetime(2017, 1, 2), dt.datetime(2016, 12, 31, 23))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    try:
        for tz in ("America/New_York", "UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = [r[0] for r in df.select(microseconds_between(F.col("a"), F.col("b"))).collect()]
            assert got == [int((b - a) / dt.timedelta(microseconds=1)) for a, b in rows], tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
