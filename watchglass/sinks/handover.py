"""Handover documents in Markdown and HTML, and a plain summary for a terminal.

Each cluster's section is rendered where its rows are; the driver only puts sections together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchglass.functions.indicators import encoded_stub
from watchglass.functions.text import escape_html, escape_markdown
from watchglass.plans.triage import Report


def _cells(values: list[Column], row: Callable[[list[Column]], Column]) -> Column:
    return row([F.coalesce(v.cast("string"), F.lit("—")) for v in values])


def _alerts(members: DataFrame, row: Callable[[list[Column]], Column]) -> DataFrame:
    cells = [F.col("severity"), F.col("title"), F.col("source_ip"), F.col("user"), F.date_format("timestamp", "yyyy-MM-dd HH:mm")]
    lines = members.select("cluster_id", "seq", _cells(cells, row).alias("line"))
    return lines.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("alert_lines"))


def markdown_sections(report: Report) -> DataFrame:
    """(cluster_id, section), worst priority first."""
    md = escape_markdown
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *[md(c) for c in cells]), F.lit(" |"))
    both = report.clusters.join(_alerts(report.members, row), "cluster_id")
    iocs = F.array_join(F.transform("iocs_typed", lambda x: F.concat(F.lit("| `"), md(encoded_stub(x["value"])), F.lit("` | "), md(x["type"]), F.lit(" |"))), "\n")
    techniques = F.array_join(F.transform("techniques", lambda t: F.concat(F.lit("- `"), md(t), F.lit("`"))), "\n")
    section = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), md(F.col("label")), F.lit("\n")),
        F.concat(F.lit("**Priority:** "), "priority", F.lit(" | **Score:** "), F.round("score").cast("long").cast("string"), F.lit(" | **Alerts:** "), F.col("alert_count").cast("string"), F.lit("\n")),
        F.concat(F.lit("> "), md(F.col("cluster_reason")), F.lit("\n")),
        F.when(F.size("techniques") > 0, F.concat(F.lit("**ATT&CK Techniques:**\n"), techniques, F.lit("\n"))),
        F.when(F.col("ioc_count") > 0, F.concat(F.lit("**Indicators of Compromise:**\n\n| IOC Value | Type |\n|---|---|\n"), iocs, F.lit("\n"))),
        F.concat(F.lit("**Alerts:**\n\n| Severity | Title | Source IP | User | Timestamp |\n|---|---|---|---|---|\n"), "alert_lines", F.lit("\n\n---")),
    )
    return both.orderBy(F.desc("priority_rank"), F.desc("score"), "cluster_id").select("cluster_id", section.alias("section"))


def html_sections(report: Report) -> DataFrame:
    """(cluster_id, section), worst priority first; every value is escaped."""
    e = escape_html
    row = lambda cells: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[e(c) for c in cells]), F.lit("</td></tr>"))
    both = report.clusters.join(_alerts(report.members, row), "cluster_id")
    iocs = F.array_join(F.transform("iocs_typed", lambda x: F.concat(F.lit("<tr><td><code>"), e(encoded_stub(x["value"])), F.lit("</code></td><td>"), e(x["type"]), F.lit("</td></tr>"))), "\n")
    section = F.concat(
        F.lit('<section class="'), F.lower("priority"), F.lit('"><h3>'), e(F.col("label")), F.lit("</h3><p>"), "priority", F.lit(" · "), F.col("score").cast("string"), F.lit(" · "),
        F.col("alert_count").cast("string"), F.lit(" alerts</p><blockquote>"), e(F.col("cluster_reason")), F.lit("</blockquote><table>"), iocs, F.lit("</table><table>"), "alert_lines", F.lit("</table></section>"),
    )
    return both.orderBy(F.desc("priority_rank"), F.desc("score"), "cluster_id").select("cluster_id", section.alias("section"))


def render(report: Report, kind: str, source: str, at: str) -> str:
    """A whole document for people to read: ``md``, ``html`` or ``text``."""
    stats = report.stats().first()
    if kind == "text":
        rows = report.clusters.filter("priority <> 'NOISE'").select("priority", "score", "alert_count", "label").collect()
        lines = [f"{stats['original']} alerts, {stats['kept']} after dedup ({stats['removed_pct']:.2f} % removed)"]
        return "\n".join([*lines, *(f"{r['priority']:>8} {r['score']:>9.2f} {r['alert_count']:>7}  {r['label']}" for r in rows)])
    sections = [r["section"] for r in (markdown_sections if kind == "md" else html_sections)(report).toLocalIterator()]
    facts = [("Input", source), ("Analyzed", at), ("Clusters", len(sections)), ("Alerts ingested", stats["original"]), ("Alerts after dedup", stats["kept"])]
    if kind == "md":
        return "\n".join(["# Shift handover", "", "| Field | Value |", "|---|---|", *(f"| {k} | {v} |" for k, v in facts), "", "## Clusters", "", *sections])
    import html

    head = "".join(f"<tr><th>{k}</th><td>{html.escape(str(v))}</td></tr>" for k, v in facts)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Shift handover</title></head><body><h1>Shift handover</h1><table>{head}</table>{"".join(sections)}</body></html>'
