"""CSV landing edge cases and the all-or-nothing warehouse build."""

import os

import pytest

from mercato.plans import reports
from mercato.plans.build import build, build_from_csv, load_warehouse, published_builds
from mercato.plans.model import lazy_warehouse
from mercato.schemas import RAW_FILES, RAW_SCHEMAS
from mercato.sources.landing import MissingInputError, read_csv_table, read_raw_csv
from mercato.sources.testdata import raw_from_testdata
from tests.conftest import SF_SMALL


def write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def header(table):
    return ",".join(f.name for f in RAW_SCHEMAS[table].fields)


def test_csv_nulls_quotes_and_newlines(spark, scratch):
    body = (header("product_category_name_translation") + "\n"
            '1,\n'
            '"x ""q"" y",""\n'
            '3,abc\n')
    write(scratch + "/t.csv", body)
    got = read_csv_table(spark, scratch + "/t.csv", "product_category_name_translation")
    rows = [tuple(r) for r in got.collect()]
    assert rows == [("1", None), ('x "q" y', ""), ("3", "abc")]


def test_review_file_reads_multiline(spark, scratch):
    body = (header("order_reviews") + "\n"
            'r1,o1,5,,"first line\nsecond ""quoted"" line",2017-01-01 00:00:00,\n'
            'r2,o2,4,"",,2017-01-02 00:00:00,2017-01-03 10:00:00\n')
    write(scratch + "/r.csv", body)
    rows = read_csv_table(spark, scratch + "/r.csv", "order_reviews").orderBy("review_id").collect()
    assert len(rows) == 2
    assert rows[0]["review_comment_message"] == 'first line\nsecond "quoted" line'
    assert rows[0]["review_comment_title"] is None
    assert rows[1]["review_comment_title"] == ""
    assert rows[1]["review_answer_timestamp"].hour == 10


def test_bad_value_fails_the_load(spark, scratch):
    write(scratch + "/o.csv", header("order_payments") + "\no1,xx,card,1,10.00\n")
    with pytest.raises(Exception):
        read_csv_table(spark, scratch + "/o.csv", "order_payments").collect()


def test_wrong_header_fails_the_load(spark, scratch):
    write(scratch + "/s.csv", "a,b,c,d\n1,2,3,4\n")
    with pytest.raises(Exception):
        read_csv_table(spark, scratch + "/s.csv", "sellers").collect()


def test_missing_files_are_all_named(spark, scratch):
    write(scratch + "/" + RAW_FILES["sellers"], header("sellers") + "\n")
    with pytest.raises(MissingInputError) as exc:
        read_raw_csv(spark, scratch)
    assert len(exc.value.missing) == 8
    assert RAW_FILES["sellers"] not in exc.value.missing


def export_csv(spark, raw, folder):
    """Write the raw tables as CSV files named like the source export."""
    for table, df in raw.items():
        out = f"{folder}/_{table}"
        df.coalesce(1).write.option("header", True).option("escape", '"').csv(out)
        part = [f for f in os.listdir(out) if f.endswith(".csv")][0]
        os.link(f"{out}/{part}", f"{folder}/{RAW_FILES[table]}")


def test_csv_build_round_trip_and_failed_build_keeps_old(spark, scratch):
    raw = raw_from_testdata(spark, SF_SMALL)
    src = scratch + "/csv"
    os.makedirs(src)
    export_csv(spark, raw, src)
    root = scratch + "/wh"
    first = build_from_csv(spark, src, root)
    assert first.raw_counts["order_items"] == raw["order_items"].count()
    wh = load_warehouse(spark, root)
    direct = {tuple(r) for r in reports.revenue_trend(lazy_warehouse(raw)).collect()}
    assert {tuple(r) for r in reports.revenue_trend(wh).collect()} == direct

    # A duplicated product id makes the next build fail before it is published.
    bad = dict(raw)
    bad["products"] = raw["products"].unionByName(raw["products"].limit(1))
    with pytest.raises(Exception):
        build(spark, bad, root)
    assert published_builds(spark, root) == [first.build_id]
    assert load_warehouse(spark, root).fact.count() == wh.fact.count()
    failed = [d.split("=", 1)[1] for d in os.listdir(root) if d != f"build={first.build_id}"]
    assert len(failed) == 1
    with pytest.raises(FileNotFoundError):
        load_warehouse(spark, root, failed[0])


def test_raw_only_build(spark, scratch):
    res = build(spark, raw_from_testdata(spark, SF_SMALL), scratch + "/wh", analytics=False)
    assert res.raw_total == sum(res.raw_counts.values()) > 0
    assert not os.path.exists(res.path + "/fct_order_items")


def test_cli_build_and_report(spark, scratch, capsys):
    from mercato.cli import main

    raw = raw_from_testdata(spark, SF_SMALL)
    src = scratch + "/csv"
    os.makedirs(src)
    export_csv(spark, raw, src)
    assert main(["build", "--src", src, "--root", scratch + "/wh"]) == 0
    out = capsys.readouterr().out
    assert "landed 10 rows in sellers" in out and "is published at" in out
    assert main(["report", "--root", scratch + "/wh", "top_categories", "--limit", "3"]) == 0
    assert "revenue_rank" in capsys.readouterr().out
    assert main(["build", "--src", scratch + "/nothing", "--root", scratch + "/wh2"]) == 1
    assert main(["report", "--root", scratch + "/wh", "sample_states"]) == 0
    assert main(["report", "--root", scratch + "/wh", "revenue_trend", "--from", "1997-01-01",
                 "--explain"]) == 0
    assert "PartitionFilters" in capsys.readouterr().out
    assert main(["sql", "--root", scratch + "/wh", "SELECT count(*) AS n FROM dim_date"]) == 0
    assert capsys.readouterr().out.startswith("n\n")
    assert main(["report", "--root", scratch + "/wh", "revenue_trend", "--granularity", "day"]) == 0
    days = len(capsys.readouterr().out.splitlines()) - 2
    assert days == reports.revenue_trend(lazy_warehouse(raw), "day").count() > 20
    with pytest.raises(ValueError, match="limit"):
        main(["report", "--root", scratch + "/wh", "top_categories", "--limit", "0"])
    assert main(["report", "--root", scratch + "/wh", "aov", "--out", scratch + "/aov"]) == 0
    assert spark.read.parquet(scratch + "/aov/overall").count() == 1
    assert main(["sql", "--root", scratch + "/wh", "DROP TABLE dim_date"]) == 2


def test_table_delivered_as_a_folder_of_parts(spark, scratch):
    src = scratch + "/csv"
    os.makedirs(src)
    for table, name in RAW_FILES.items():
        os.makedirs(f"{src}/{name}")
        for part in range(2):
            rows = "" if table != "sellers" else f"s{part},0100{part},c,SP\n"
            write(f"{src}/{name}/part-{part}.csv", header(table) + "\n" + rows)
    raw = read_raw_csv(spark, src)
    assert sorted(r["seller_id"] for r in raw["sellers"].collect()) == ["s0", "s1"]


def test_built_warehouse_equals_lazy_plans(spark, scratch):
    """Every view and report gives the same rows from the Parquet build as from plans."""
    raw = raw_from_testdata(spark, SF_SMALL)
    build(spark, raw, scratch + "/wh")
    built, lazy = load_warehouse(spark, scratch + "/wh"), lazy_warehouse(raw)

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    checks = {
        "views": lambda wh: [wh[v] for v in ("vw_monthly_revenue", "vw_category_performance",
                                             "vw_seller_scorecard", "vw_delivery_sla")],
        "reports": lambda wh: [reports.revenue_trend(wh, "week", "1996-01-01", "1997-12-31"),
                               reports.top_categories(wh, 3), reports.seller_scorecard(wh, 7),
                               reports.repeat_customers(wh), reports.object_counts(wh),
                               reports.delivery_sla_overall(wh),
                               *reports.aov(wh).values()],
        "dims": lambda wh: [wh[d] for d in ("dim_product", "dim_customer", "dim_seller",
                                            "dim_date", "fct_order_items")],
    }
    for name, make in checks.items():
        for a, b in zip(make(built), make(lazy)):
            assert a.columns == b.columns, name
            assert rows(a) == rows(b), name


def test_empty_tables_build_and_load(spark, scratch):
    raw = {t: df.limit(0) if t in ("order_items", "order_reviews") else df
           for t, df in raw_from_testdata(spark, SF_SMALL).items()}
    build(spark, raw, scratch + "/wh")
    wh = load_warehouse(spark, scratch + "/wh")
    assert wh.fact.count() == 0 and dict(wh.fact.dtypes)["order_month"] == "date"
    assert wh["vw_seller_scorecard"].count() == 0 and reports.revenue_trend(wh).count() == 0
    assert wh["dim_seller"].count() == raw["sellers"].count()


def test_retiring_builds(spark, scratch):
    from mercato.plans.build import retire_builds

    raw = raw_from_testdata(spark, SF_SMALL)
    root = scratch + "/wh"
    for build_id in ("1", "2", "3"):
        build(spark, raw, root, analytics=False, build_id=build_id)
    for failed in ("0", "25", "9"):  # unpublished: older than the newest, and one that may be running
        spark.range(1).write.parquet(f"{root}/build={failed}/raw/x")
    spark.range(1).write.parquet(f"{root}/build=3/_stage/x")
    with pytest.raises(ValueError):
        retire_builds(spark, root, 0)
    gone = [os.path.relpath(p, root) for p in retire_builds(spark, root, 2)]
    assert sorted(gone) == ["build=0", "build=1", "build=25", "build=3/_stage"]
    assert published_builds(spark, root) == ["2", "3"] and os.path.exists(f"{root}/build=9")
    assert load_warehouse(spark, root).raw_loaders["sellers"]().count() == raw["sellers"].count()


def test_reviews_are_read_by_many_tasks(spark, scratch):
    """Equal to Spark's one-task multi-line reader, with records across many splits."""
    import random

    from mercato.schemas import RAW_SCHEMAS
    from mercato.sources.landing import EMPTY_MARKER, read_csv_table

    pick = random.Random(4)
    bits = ["plain", 'a ""quoted"" word', "line one\nline two", "\n\n", "comma, here", "é漢", "", "x" * 300]
    lines = [header("order_reviews")]
    for i in range(400):
        text = "".join(pick.choice(bits) for _ in range(pick.randint(0, 4)))
        title = pick.choice(['""', "", '"t, 1"', "t"])
        lines.append(f'r{i},o{i},{pick.randint(1, 5)},{title},"{text}",2018-01-02 03:04:05,2018-01-03 00:00:00')
    os.makedirs(scratch + "/many")
    write(scratch + "/many/a.csv", "\n".join(lines[:250]) + "\n")
    write(scratch + "/many/b.csv", "\n".join([lines[0], *lines[250:]]))
    reader = (spark.read.schema(RAW_SCHEMAS["order_reviews"]).option("header", True).option("multiLine", True)
              .option("quote", '"').option("escape", '"').option("nullValue", "")
              .option("emptyValue", EMPTY_MARKER).option("mode", "FAILFAST"))
    want = sorted(tuple("" if v == EMPTY_MARKER else v for v in r)
                  for r in reader.csv(scratch + "/many").collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "700")
    try:
        frame = read_csv_table(spark, scratch + "/many", "order_reviews")
        got = sorted(tuple(r) for r in frame.collect())
        splits = spark.read.text(scratch + "/many").rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = lambda r: r[0]
    assert splits > 50 and len(got) == 400
    assert sorted(got, key=key) == sorted(want, key=key)


def test_two_builds_at_once_one_is_published(spark, scratch, monkeypatch):
    """The one that claims first wins, whether it started first or last."""
    from mercato.plans import build as module

    raw = raw_from_testdata(spark, SF_SMALL)
    land = module.land_raw

    def race(root, first, last):
        """Build ``last`` wholly while build ``first`` is landing."""
        def landing(tables, path):
            counts = land(tables, path)
            monkeypatch.setattr(module, "land_raw", land)
            build(spark, raw, root, analytics=False, build_id=last)
            return counts

        monkeypatch.setattr(module, "land_raw", landing)
        with pytest.raises(module.BuildConflict, match=f"build {last} was"):
            build(spark, raw, root, build_id=first)

    for first, last in (("1", "2"), ("2", "1")):
        root = f"{scratch}/wh{first}"
        race(root, first, last)
        assert published_builds(spark, root) == [last]
        with pytest.raises(FileNotFoundError):
            load_warehouse(spark, root, first)
        # the loser starts again, on top of the winner: newest whatever its id
        build(spark, raw, root, analytics=False, build_id="0")
        assert published_builds(spark, root) == [last, "0"]
        assert load_warehouse(spark, root).raw_loaders["sellers"]().count() == raw["sellers"].count()


def test_one_claim_of_many_succeeds(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor

    from mercato.plans.build import BuildConflict, _claim, _versions

    def claim(i):
        try:
            _claim(spark, scratch + "/wh", 1, str(i))
            return str(i)
        except BuildConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [w for w in pool.map(claim, range(16)) if w]
    assert len(won) == 1 and _versions(spark, scratch + "/wh") == {won[0]: 1}


def test_claimed_build_is_not_retired(spark, scratch):
    """A build between its claim and its marker stays; builds without a version are the oldest."""
    from mercato.plans.build import _claim, retire_builds

    raw, root = raw_from_testdata(spark, SF_SMALL), scratch + "/wh"
    spark.range(1).write.parquet(f"{root}/build=9/_published")  # of before versions
    spark.range(1).write.parquet(f"{root}/build=0/raw/x")
    _claim(spark, root, 1, "0")
    build(spark, raw, root, analytics=False, build_id="5")
    assert published_builds(spark, root) == ["9", "5"]
    gone = [os.path.relpath(p, root) for p in retire_builds(spark, root, 1)]
    assert gone == ["build=9"] and os.path.exists(f"{root}/build=0/raw/x")


def test_build_leaves_the_session_settings(spark, scratch):
    from mercato.session import SHUFFLE_PARTITION_BYTES, sized_session

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.getAll
    own = sized_session(spark, 1000 * SHUFFLE_PARTITION_BYTES)
    other = sized_session(spark, 0)
    assert int(own.conf.get(name)) == 3000 and int(other.conf.get(name)) < 3000
    assert own.conf.get("spark.sql.ansi.enabled") == spark.conf.get("spark.sql.ansi.enabled")
    assert own.conf.get("spark.sql.session.timeZone") == "UTC" and spark.conf.getAll == before


def test_exported_parts_are_compressed_and_bounded(spark, scratch, monkeypatch):
    """a table becomes several gzip parts of few rows, read back as they were."""
    from mercato.sources import landing

    monkeypatch.setattr(landing, "PART_ROWS", 100)
    frame = spark.range(0, 350, numPartitions=1).selectExpr(
        "concat('s', id) seller_id", "if(id % 3 = 0, null, '00001') seller_zip_code_prefix",
        "if(id % 5 = 0, '', 'a \"q\", b') seller_city", "'SP' seller_state")
    landing.write_csv_table(frame, scratch, "sellers")
    folder = f"{scratch}/{RAW_FILES['sellers']}"
    parts = [f for f in os.listdir(folder) if f.startswith("part-")]
    assert len(parts) == 4 and all(f.endswith(".csv.gz") for f in parts)
    got = read_csv_table(spark, folder, "sellers")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)


def test_one_line_reviews_are_not_shuffled_by_record(spark, scratch):
    """only lines of longer records and the last line of a split are."""
    lines = [header("order_reviews")]
    for i in range(500):
        text = '"a\nb"' if i % 100 == 0 else ""
        lines.append(f"r{i},o{i},3,,{text},2018-01-02 03:04:05,2018-01-03 00:00:00")
    write(scratch + "/r.csv", "\n".join(lines) + "\n")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = read_csv_table(spark, scratch + "/r.csv", "order_reviews")
        rows = frame.collect()
        plan = frame._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted(r["review_id"] for r in rows) == sorted(f"r{i}" for i in range(500))
    assert sorted(r["review_id"] for r in rows if r["review_comment_message"] == "a\nb") == [
        "r0", "r100", "r200", "r300", "r400"]

    def shuffled_by_record(node):
        below = node.children()
        found = [x for i in range(below.size()) for x in shuffled_by_record(below.apply(i))]
        if node.nodeName() == "Exchange" and "key#" in node.simpleString(200):
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        return found

    assert 1 <= max(shuffled_by_record(plan)) <= 11  # the records of two lines, the split's last line


def test_fact_moves_no_measures_and_sorts_small_partitions(spark, scratch):
    """derived measures are added after the rebalance by month; one sort."""
    from mercato.plans.build import fact_by_month
    from mercato.plans.model import fact_from_lines, order_level

    raw = raw_from_testdata(spark, SF_SMALL)
    order_level(raw["orders"], raw["order_reviews"]).write.parquet(scratch + "/orders")
    raw["order_items"].write.parquet(scratch + "/items")
    items, orders = spark.read.parquet(scratch + "/items"), spark.read.parquet(scratch + "/orders")
    fact = fact_by_month(items, orders)
    want = fact_from_lines(items, orders)
    assert fact.schema == want.schema
    assert fact.exceptAll(want).isEmpty() and want.exceptAll(fact).isEmpty()
    plan = fact._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RebalancePartitions"):]
    for measure in ("item_revenue", "delivery_days", "on_time", "order_date#"):
        assert measure in plan and measure not in moved


def test_build_session_bounds_sorted_partitions(spark):
    """a large advisory size of the cluster is not taken over; a small one is."""
    from mercato.session import sized_session

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name, None)
    try:
        for given, want in (("256m", 32 << 20), ("64MB", 32 << 20), ("16777216b", 16 << 20), ("1000", 1000)):
            spark.conf.set(name, given)
            assert int(sized_session(spark, 0, 32 << 20).conf.get(name)) == want
            assert sized_session(spark, 0).conf.get(name) == given
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
