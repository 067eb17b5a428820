"""The stored log: snapshots, repeated batches, compaction under readers, skipping, zones."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from mercato.plans import audit_log as al
from mercato.schemas import AUDIT_SCHEMA

T0 = dt.datetime(2024, 1, 1, 12)


def rows(spark, ids, day=lambda i: 0):
    return spark.createDataFrame(
        [(i, "u", "analyst", "query", f"SELECT {i}", "allowed", T0 + dt.timedelta(days=day(i))) for i in ids],
        AUDIT_SCHEMA)


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def test_an_empty_log_is_an_empty_table(spark, scratch):
    assert al.read(spark, scratch + "/none").collect() == []
    assert al.newest(spark, scratch + "/none", 5).collect() == []
    assert al.read(spark, scratch + "/none").columns == al.COLUMNS
    assert al.append(rows(spark, []), scratch + "/none").version == 0


def test_appends_add_up_and_older_versions_stay(spark, scratch):
    path = scratch + "/log"
    first = al.append(rows(spark, range(10)), path)
    al.append(rows(spark, range(10, 15)), path)
    assert ids(al.read(spark, path)) == list(range(15))
    assert ids(al.read(spark, path, first.version)) == list(range(10))
    (held,) = first.files
    assert (held.rows, held.ids, held.min_id, held.max_id, held.day) == (10, 10, 0, 9, "2024-01-01")
    assert held.size == os.path.getsize(f"{path}/{held.path}")


def test_a_repeated_batch_changes_nothing(spark, scratch):
    path = scratch + "/log"
    al.append(rows(spark, [1, 2]), path, "stream", 0)
    again = al.append(rows(spark, [1, 2]), path, "stream", 0)
    al.append(rows(spark, [3]), path, "stream", 1)
    al.append(rows(spark, [1]), path, "other", 0)
    assert again.version == 1
    assert ids(al.read(spark, path)) == [1, 1, 2, 3]
    assert al.append(rows(spark, []), path, "stream", 2).last_batch("stream") == 2


def test_an_append_without_its_commit_is_not_read(spark, scratch):
    path = scratch + "/log"
    al.append(rows(spark, [1]), path)
    folder = f"{path}/data/{'0' * 32}"
    al._with_day(al.zoned(rows(spark, [2]))).write.partitionBy("day").parquet(folder)
    assert ids(al.read(spark, path)) == [1]
    al.expire(spark, path, 1)
    assert os.path.isdir(folder)  # its append may be about to commit


def test_of_two_commits_one_is_first_and_both_stay(spark, scratch, monkeypatch):
    path = scratch + "/log"
    al.append(rows(spark, [0]), path)
    create, raced = al.create_new, []

    def slower(session, name, text):
        if not raced:  # another writer commits this version first
            raced.append(name)
            monkeypatch.setattr(al, "create_new", create)
            al.append(rows(spark, [1]), path)
        return create(session, name, text)

    monkeypatch.setattr(al, "create_new", slower)
    assert al.append(rows(spark, [2]), path).version == 3
    assert ids(al.read(spark, path)) == [0, 1, 2]


def test_compaction_under_readers(spark, scratch):
    path = scratch + "/log"
    for start in range(0, 60, 5):
        before = al.append(rows(spark, range(start, start + 5), lambda i: i % 2), path)
    reading = al.read(spark, path)  # planned on the snapshot before
    after = al.compact(spark, path, most_files=3)
    per_day = {}
    for f in after.files:
        per_day[f.day] = per_day.get(f.day, 0) + 1
    assert set(per_day) == {"2024-01-01", "2024-01-02"} and max(per_day.values()) <= 3
    assert ids(reading) == ids(al.read(spark, path)) == list(range(60))
    assert ids(al.read(spark, path, before.version)) == list(range(60))
    gone = al.expire(spark, path, keep=1)
    assert set(gone) == {f.path for f in before.files}
    assert ids(al.read(spark, path)) == list(range(60))
    assert al.compact(spark, path, most_files=3) == after  # nothing left to do


def test_compacted_files_have_id_ranges_of_their_own(spark, scratch):
    path = scratch + "/log"
    pick = random.Random(1)
    every = list(range(400))
    pick.shuffle(every)
    for start in range(0, 400, 50):
        al.append(rows(spark, every[start:start + 50]), path)
    size = sum(f.size for f in al.snapshot(spark, path).files)
    after = al.compact(spark, path, most_files=4, file_bytes=size // 4 + 1)
    spans = sorted((f.min_id, f.max_id) for f in after.files)
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert ids(al.read(spark, path)) == list(range(400))


def test_an_append_during_compaction_is_kept_and_a_second_compaction_gives_way(spark, scratch, monkeypatch):
    path = scratch + "/log"
    for i in range(6):
        al.append(rows(spark, [i]), path)
    described, raced = al._described, []

    def between(*args):
        made = described(*args)
        if not raced:
            raced.append(True)
            al.append(rows(spark, [100]), path)
        return made

    monkeypatch.setattr(al, "_described", between)
    al.compact(spark, path, most_files=2)
    assert ids(al.read(spark, path)) == [0, 1, 2, 3, 4, 5, 100]
    for i in range(6):
        al.append(rows(spark, [i + 10]), path)
    raced.clear()

    def other(*args):
        made = described(*args)
        if not raced:
            raced.append(True)
            al.compact(spark, path, most_files=2)
        return made

    monkeypatch.setattr(al, "_described", other)
    with pytest.raises(al.LogConflict):
        al.compact(spark, path, most_files=2)
    assert ids(al.read(spark, path)) == [0, 1, 2, 3, 4, 5, *range(10, 16), 100]


def test_newest_reads_only_files_that_can_hold_them(spark, scratch):
    """Ids and days disagree; the result is that of a full scan all the same."""
    path = scratch + "/log"
    for start in range(0, 100, 10):
        al.append(rows(spark, range(start, start + 10), lambda i: (97 - i) % 7), path)
    every = al.snapshot(spark, path).files
    for n in (1, 3, 10, 11, 55, 100, 500):
        chosen = al.files_for_newest(every, n)
        want = [r["id"] for r in al.read(spark, path).orderBy(F.desc("id")).limit(n).collect()]
        assert [r["id"] for r in al.newest(spark, path, n).collect()] == want
        assert len(chosen) < len(every) or n >= 55
    with pytest.raises(ValueError):
        al.newest(spark, path, 0)


def test_the_choice_of_files_by_brute_force():
    pick = random.Random(7)
    for _ in range(300):
        held = []
        for name in range(pick.randint(1, 8)):
            some = [pick.randint(0, 30) for _ in range(pick.randint(0, 6))]
            held.append((some, al.LogFile(str(name), None, len(some) + 1, 1, len(some),
                                          min(some, default=None), max(some, default=None))))
        n = pick.randint(1, 12)
        chosen = al.files_for_newest([f for _, f in held], n)
        got = sorted((x for some, f in held if f in chosen for x in some), reverse=True)[:n]
        assert got == sorted((x for some, _ in held for x in some), reverse=True)[:n]


def test_rows_without_an_id_come_last(spark, scratch):
    path = scratch + "/log"
    al.append(rows(spark, [None, 5, 7]), path)
    al.append(rows(spark, [None]), path)
    assert [r["id"] for r in al.newest(spark, path, 3).collect()] == [7, 5, None]
    assert [r["id"] for r in al.newest(spark, path, 2).collect()] == [7, 5]


def test_old_rows_without_a_zone_are_read_beside_new_ones(spark, scratch):
    path = scratch + "/log"
    old = rows(spark, [1, 2], lambda i: i)
    old.withColumn("day", F.to_date("created_at")).write.partitionBy("day").parquet(path)
    al.adopt(spark, path)
    assert al.adopt(spark, path).version == 1  # taken over once
    zone = dt.timezone(dt.timedelta(hours=-3))
    new = spark.createDataFrame([(3, "u", "admin", "query", "q", "error", dt.datetime(2024, 1, 5, 9, tzinfo=zone))],
                                al.LOG_SCHEMA)
    al.append(new, path)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Sao_Paulo", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = {r["id"]: r["s"] for r in al.read(spark, path).select(
                "id", F.unix_seconds("created_at").alias("s")).collect()}
            noon = int(dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc).timestamp())
            assert got == {1: noon + 86400, 2: noon + 2 * 86400, 3: noon + 4 * 86400}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {f.format for f in al.snapshot(spark, path).files} == {al.ZONELESS, al.ZONED}
    al.append(rows(spark, [4, 5], lambda i: i - 3), path)  # a second file on either old day
    al.compact(spark, path, most_files=1)
    assert {f.format for f in al.snapshot(spark, path).files} == {al.ZONED}
    assert ids(al.read(spark, path)) == [1, 2, 3, 4, 5]


def test_snapshots_are_plain_json(spark, scratch):
    path = scratch + "/log"
    al.append(rows(spark, [1]), path, "w", 4)
    (name,) = os.listdir(f"{path}/_snapshots") if not any(
        n.startswith(".") for n in os.listdir(f"{path}/_snapshots")) else [
        n for n in os.listdir(f"{path}/_snapshots") if not n.startswith(".")]
    found = json.load(open(f"{path}/_snapshots/{name}", encoding="utf-8"))
    assert found["batches"] == [["w", 4]] and len(found["files"]) == 1
