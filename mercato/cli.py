"""Command line: build a warehouse from the landing CSVs, print a report.

    python -m mercato.cli build --src /landing/csv --root /shared/warehouse [--skip-analytics]
    python -m mercato.cli report --root /shared/warehouse revenue_trend --granularity week
    python -m mercato.cli sql --root /shared/warehouse "SELECT * FROM vw_delivery_sla"
    python -m mercato.cli audit --path /shared/audit --limit 100
    python -m mercato.cli compact --path /shared/audit
    python -m mercato.cli retire --root /shared/warehouse --keep 2
"""

from __future__ import annotations

import argparse
import sys
import time

REPORTS = ("revenue_trend", "top_categories", "seller_scorecard", "aov", "delivery_sla",
           "repeat_customers", "object_counts", "sample_monthly", "sample_categories",
           "sample_sellers", "sample_states")


def _build(args, spark) -> int:
    from mercato.plans.build import build_from_csv
    from mercato.sources.landing import MissingInputError

    began = time.time()
    try:
        res = build_from_csv(spark, args.src, args.root, analytics=not args.skip_analytics)
    except MissingInputError as exc:
        print(f"{len(exc.missing)} input(s) not found in {args.src}: {', '.join(exc.missing)}")
        return 1
    for table in sorted(res.raw_counts):
        print(f"landed {res.raw_counts[table]} rows in {table}")
    print(f"build {res.build_id} with {res.raw_total} landed rows is published at {res.path}, "
          f"after {time.time() - began:.0f} s")
    return 0


def _report(args, spark) -> int:
    from mercato.plans import reports
    from mercato.plans.build import load_warehouse

    wh = load_warehouse(spark, args.root)
    if args.name == "revenue_trend":
        out = {"points": reports.revenue_trend(wh, args.granularity, args.date_from, args.date_to)}
    elif args.name in ("top_categories", "seller_scorecard"):
        fn = getattr(reports, args.name)
        out = {args.name: fn(wh) if args.limit is None else fn(wh, args.limit)}
    else:
        result = getattr(reports, args.name)(wh)
        out = result if isinstance(result, dict) else {args.name: result}
    for part, df in out.items():
        print(f"-- {part}")
        if args.explain:
            df.explain(mode="formatted")
        else:
            _deliver(df, args.out and f"{args.out.rstrip('/')}/{part}")
    return 0


def _deliver(df, out: str | None) -> None:
    """Write the whole result as Parquet, or print every row of it.

    Printed rows pass through the driver one partition at a time; reports are
    bounded by their contract (a calendar, a taxonomy, a limit or the row cap).
    """
    if out:
        df.write.mode("errorifexists").parquet(out)
        print(f"written to {out}")
        return
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def _sql(args, spark) -> int:
    from mercato.plans.adhoc import GuardrailError, run_read_only
    from mercato.plans.build import load_warehouse

    wh = load_warehouse(spark, args.root)
    if args.user:
        return _submitted(args, spark, wh)
    try:
        result = run_read_only(wh, spark, args.statement, args.max_rows)
    except GuardrailError as exc:
        print(f"guardrail: {exc}")
        return 2
    _deliver(result.frame, args.out)
    return 0


def _submitted(args, spark, wh) -> int:
    """The statement as its user's request: authorised, run and recorded."""
    import datetime as dt

    from mercato.plans.adhoc import submit_query

    if not (args.users and args.audit and args.request_id is not None):
        print("--user needs --users, --audit and --request-id")
        return 2
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    run = submit_query(wh, spark, spark.read.parquet(args.users), args.audit, args.request_id, args.user,
                       args.statement, now, args.max_rows)
    if run.rows is None:
        print(f"{run.audit[5]}: {run.audit[4]}")
        return 2
    for row in run.rows:
        print("\t".join("" if v is None else str(v) for v in row))
    return 0


def _audit(args, spark) -> int:
    from mercato.plans.audit import newest_audit

    _deliver(newest_audit(spark, args.path, args.limit), None)
    return 0


def _compact(args, spark) -> int:
    from mercato.plans import audit_log

    found = audit_log.compact(spark, args.path)
    gone = audit_log.expire(spark, args.path, args.keep)
    print(f"snapshot {found.version} has {len(found.files)} file(s); {len(gone)} replaced file(s) deleted")
    return 0


def _retire(args, spark) -> int:
    from mercato.plans.build import retire_builds

    for path in retire_builds(spark, args.root, args.keep):
        print(f"retired {path}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mercato")
    sub = parser.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="land the CSVs and build the warehouse")
    b.add_argument("--src", required=True)
    b.add_argument("--root", required=True)
    b.add_argument("--skip-analytics", action="store_true",
                   help="land the raw tables only; skip dimensions, fact and views")
    r = sub.add_parser("report", help="print a report of the newest published build")
    r.add_argument("--root", required=True)
    r.add_argument("name", choices=REPORTS)
    r.add_argument("--granularity", default="month")
    r.add_argument("--from", dest="date_from")
    r.add_argument("--to", dest="date_to")
    r.add_argument("--limit", type=int)
    r.add_argument("--out", help="folder for the whole result as Parquet, one table per part")
    r.add_argument("--explain", action="store_true", help="print the physical plan instead")
    q = sub.add_parser("sql", help="run a screened, capped read-only statement")
    q.add_argument("--root", required=True)
    q.add_argument("statement")
    q.add_argument("--max-rows", type=int)
    q.add_argument("--user", help="run as this user: checked against --users, recorded in --audit")
    q.add_argument("--users", help="table of username, role, is_active (Parquet)")
    q.add_argument("--audit", help="the audit dataset")
    q.add_argument("--request-id", type=int, help="id of the request, which is its audit row's id")
    q.add_argument("--out", help="folder for the whole (capped) result as Parquet")
    a = sub.add_parser("audit", help="print the newest rows of an audit dataset")
    a.add_argument("--path", required=True)
    a.add_argument("--limit", type=int, default=100)
    c = sub.add_parser("compact", help="compact an audit dataset and drop expired snapshots")
    c.add_argument("--path", required=True)
    c.add_argument("--keep", type=int, default=2, help="snapshots to keep (at least 1)")
    t = sub.add_parser("retire", help="delete superseded, failed and staged parts of builds")
    t.add_argument("--root", required=True)
    t.add_argument("--keep", type=int, default=2, help="published builds to keep (at least 1)")
    args = parser.parse_args(argv)

    from mercato.session import get_spark

    spark = get_spark()
    commands = {"build": _build, "report": _report, "sql": _sql, "audit": _audit,
                "retire": _retire, "compact": _compact}
    return commands[args.command](args, spark)


if __name__ == "__main__":
    sys.exit(main())
