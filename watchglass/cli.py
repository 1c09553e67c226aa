"""Command line: triage, metrics, validate, config, doctor and version."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from watchglass.operators import metrics
from watchglass.operators.filters import FilterEvalError, FilterSyntaxError, parse_filter
from watchglass.operators.summaries import narratives
from watchglass.operators.summarizers import Mock, Template
from watchglass.plans.config import as_text, load
from watchglass.plans.schema import Settings
from watchglass.plans.triage import Report, triage
from watchglass.sinks import exports, handover, stix, tickets
from watchglass.sources.readers import read_alerts

VERSION = "0.1.0"
FORMATS = ("text", "report", "json", "csv", "clusters", "stix", "md", "html", "tickets")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="watchglass")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("triage", "metrics", "validate"):
        command = commands.add_parser(name)
        command.add_argument("path", nargs="+", help="files, folders or patterns; - for standard input")
        command.add_argument("--kind", choices=("json", "ndjson", "csv"))
        command.add_argument("--window", type=int, help="minutes")
        command.add_argument("--config", help="settings in TOML or JSON")
        if name == "triage":
            command.add_argument("-f", "--format", choices=FORMATS, default="text")
            command.add_argument("-o", "--output")
            command.add_argument("--filter")
            command.add_argument("--no-dedup", action="store_true")
            command.add_argument("--drop-raw", action="store_true")
            command.add_argument("--redact")
            command.add_argument("--scope", choices=("file", "global"))
            command.add_argument("--max-clusters", type=int)
            command.add_argument("--summary", choices=("none", "template", "mock"), default="none")
            command.add_argument("--include-raw-payload", action="store_true")
    shown = commands.add_parser("config")
    shown.add_argument("--config")
    commands.add_parser("doctor")
    commands.add_parser("version")
    return parser


def settings_of(args: argparse.Namespace) -> Settings:
    """What the command line gives goes before the environment, that before the file."""
    given = {"window_minutes": "window", "scope": "scope", "redact": "redact", "max_clusters": "max_clusters"}
    found = {name: getattr(args, arg, None) for name, arg in given.items()}
    found |= {"dedup": False if getattr(args, "no_dedup", False) else None, "drop_raw": getattr(args, "drop_raw", False) or None}
    return load(args.config, **found)


def doctor(spark: SparkSession) -> list[tuple[str, bool, str]]:
    """(check, whether it is well, what was found)."""
    from watchglass.plans.lineage import shared_folder, stored

    checks = [("python", sys.version_info >= (3, 11), sys.version.split()[0]), ("spark", int(spark.version.split(".")[0]) >= 4, spark.version)]
    for name, check in (("shared folder", lambda: shared_folder(spark)), ("write and read", lambda: f"{stored(spark.range(3), 'doctor').count()} rows"), ("time zone", lambda: spark.conf.get("spark.sql.session.timeZone"))):
        try:
            checks.append((name, True, check()))
        except Exception as e:  # noqa: BLE001
            checks.append((name, False, str(e).splitlines()[0]))
    return checks


def emit(report: Report, args: argparse.Namespace) -> None:
    at = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    raw = args.include_raw_payload
    if args.format in ("text", "md", "html"):
        text = handover.render(report, args.format, ", ".join(args.path), at)
    elif args.format == "report":
        writer = {"template": lambda: Template(at), "mock": Mock}.get(args.summary)
        text = json.dumps(exports.report_document(report, ", ".join(args.path), at, writer().summarize(report) if writer else None, raw), default=str, indent=2)
    elif args.format == "stix":
        text = stix.bundle(stix.objects(report.clusters, at, narratives(report.clusters, report.members)))
    else:
        rows = {
            "json": lambda: exports.cluster_documents(report.members, report.clusters, raw),
            "csv": lambda: exports.alert_rows(report.members, report.clusters, raw),
            "clusters": lambda: exports.cluster_rows(report.clusters),
            "tickets": lambda: tickets.case_payloads(tickets.drafts(report.clusters, report.members, narratives(report.clusters, report.members), raw)),
        }[args.format]()
        if args.output:
            (exports.write_csv if args.format in ("csv", "clusters") else exports.write_json)(rows, args.output)
            return
        text = "\n".join(r["json"] if "json" in rows.columns else ",".join(map(str, r)) for r in rows.toLocalIterator())
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "config":
        print(as_text(load(args.config)))
        return 0
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "doctor":
        checks = doctor(spark)
        print("\n".join(f"{'ok  ' if well else 'FAIL'} {name}: {found}" for name, well, found in checks))
        return int(not all(well for _, well, _ in checks))
    try:
        settings = settings_of(args)
    except ValueError as e:
        print(f"settings: {e}", file=sys.stderr)
        return 2
    try:
        alerts = read_alerts(spark, args.path, args.kind, settings.drop_raw)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"no such path: {', '.join(args.path)}", file=sys.stderr)
        return 2
    if args.command == "validate":
        n = alerts.count()
        print(f"{n} alerts")
        return 0 if n else 2
    if args.command == "metrics":
        report = triage(alerts, settings)
        for frame in (metrics.overview(report.members), metrics.top_categories(report.members), metrics.indicator_types(report.clusters)):
            print("\n".join(str(r.asDict()) for r in frame.collect()))
        return 0
    report = triage(alerts, settings)
    if args.filter:
        try:
            clusters = report.clusters.filter(parse_filter(args.filter))
            report = Report(report.ingested, report.members.join(clusters.select("cluster_id"), "cluster_id", "left_semi"), clusters)
        except (FilterSyntaxError, FilterEvalError) as e:
            print(f"filter left out: {e}", file=sys.stderr)
    emit(report, args)
    return report.exit_code()


if __name__ == "__main__":
    sys.exit(main())
