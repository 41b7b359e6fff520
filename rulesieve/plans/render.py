"""Reports as JSON, table, CSV or a sentence."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable
from dataclasses import asdict

from rulesieve import schemas as S
from rulesieve.plans.analyze import Report

# Fixed value: the columns of the CSV report.
CSV_COLUMNS = ("rule_a", "rule_b", "source_a", "source_b", "overlap_a_to_b", "overlap_b_to_a", "jaccard", "relationship", "recommendation", "reason", "downstream_label_loss")
SHORT = {S.KEEP_A: "Keep A", S.KEEP_B: "Keep B", S.KEEP_BOTH: "Keep both", S.REVIEW: "Review"}
RULE = "=" * 72


def duration(seconds: float) -> str:
    return f"{seconds:.1f}s" if seconds < 60 else f"{int(seconds // 60)}m {int(seconds % 60)}s"


def grid(title: str, columns: list[tuple[str, int, str]], rows: list[tuple], shown: int | None = None) -> list[str]:
    """A titled block of aligned lines; columns are (heading, width, format)."""
    if not rows:
        return []
    width = sum(w + 1 for _, w, _ in columns)
    heading = " ".join(f"{h:<{w}}" if f == "s" else f"{h:>{w}}" for h, w, f in columns)
    out = [f"  {title}", "  " + "-" * width, "  " + heading, "  " + "-" * width]
    for row in rows[:shown]:
        out.append("  " + " ".join(f"{v:<{w}}" if f == "s" else f"{format(v, f):>{w}}" for v, (_, w, f) in zip(row, columns, strict=True)))
    if shown is not None and len(rows) > shown:
        out.append(f"  ... and {len(rows) - shown} more")
    return [*out, ""]


def as_json(report: Report) -> str:
    d = asdict(report)
    results = {k: d.pop(k) for k in ("duplicates", "subsets", "overlaps", "clusters")}
    quality, summary = d.pop("quality"), d.pop("summary")
    return json.dumps(d | {"results": results, "quality": quality, "summary": summary}, indent=2, default=str) + "\n"


def as_csv(report: Report) -> str:
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(CSV_COLUMNS)
    for p in report.duplicates + report.subsets + report.overlaps:
        writer.writerow([f"{p[c]:.4f}" if isinstance(p[c], float) else str(p[c]).lower() if isinstance(p[c], bool) else p[c] for c in CSV_COLUMNS])
    return out.getvalue()


def as_table(report: Report) -> str:
    n, s = report.input, report.summary
    out = ["", RULE, f"  Rule overlap report — {report.timestamp}"]
    out += [f"  Rules: {n['total_rules']} from {len(n['files'])} file(s) | Corpus: {report.corpus['total_strings']} strings | Time: {duration(report.evaluation['duration_s'])}", RULE, ""]
    advice = lambda p: SHORT[p["recommendation"]]
    ends = [("Rule A", 25, "s"), ("Rule B", 25, "s")]
    out += grid(f"Duplicates ({len(report.duplicates)} pairs)", [*ends, ("Jaccard", 8, ".2f"), ("Recommendation", 14, "s")], [(p["rule_a"], p["rule_b"], p["jaccard"], advice(p)) for p in report.duplicates])
    larger = lambda p: p["overlap_a_to_b"] if p["relationship"] == S.SUBSET else p["overlap_b_to_a"]
    out += grid(f"Subsets ({len(report.subsets)} pairs)", [("Subset Rule", 25, "s"), ("Superset Rule", 25, "s"), ("A->B %", 8, ".0%"), ("Recommendation", 14, "s")], [(p["rule_a"], p["rule_b"], larger(p), advice(p)) for p in report.subsets])
    out += grid(f"Overlaps ({len(report.overlaps)} pairs)", [*ends, ("A->B %", 8, ".0%"), ("B->A %", 8, ".0%")], [(p["rule_a"], p["rule_b"], p["overlap_a_to_b"], p["overlap_b_to_a"]) for p in report.overlaps])
    if report.clusters:
        out.append(f"  Clusters ({len(report.clusters)} groups)")
        for c in report.clusters:
            out += [f"  Cluster {c['id']}: {', '.join(c['rules'])}", f"    Keep: {c['keep']} ({c['reason']})"]
        out.append("")
    q = report.quality
    for title, rows, shown, line in (
        ("Broad patterns", q["broad_patterns"], 10, lambda r: f"{r['name']:<30} overlaps with {r['overlap_count']} rules"),
        ("Low specificity", q["low_specificity"], 5, lambda r: f"{r['name']:<30} specificity: {r['specificity']:.2f}"),
        ("Fully redundant", q["fully_redundant"], 5, lambda r: r["name"]),
    ):
        if rows:
            out += [f"  {title} ({len(rows)}):", *(f"    {line(r)}" for r in rows[:shown])]
            out += [f"    ... and {len(rows) - shown} more"] if len(rows) > shown else []
    told = [
        (s["duplicate_pairs"], f"Drop {s['rules_recommended_drop']} rules"),
        (s["rules_recommended_review"], f"review {s['rules_recommended_review']}"),
        (s["broad_patterns"], f"{s['broad_patterns']} broad patterns"),
        (s["fully_redundant_rules"], f"{s['fully_redundant_rules']} fully redundant"),
    ]
    out.append("  Summary: " + (", ".join(t for n, t in told if n) or "No duplicates or overlaps found"))
    return "\n".join(out) + "\n\n"


def as_summary(report: Report) -> str:
    # fixed values: the sentences of the summary
    s = report.summary
    out = f"Analyzed {report.input['total_rules']} rules from {len(report.input['files'])} file(s). Found {s['duplicate_pairs']} duplicate pair(s), {s['subset_pairs']} subset pair(s), and {s['overlap_pairs']} partial overlap(s) across {s['clusters']} cluster(s). "
    drop, review = s["rules_recommended_drop"], s["rules_recommended_review"]
    out += f"Recommendation: drop {drop} rule(s), review {review} rule(s). " if drop or review else "No duplicates detected. "
    rated = [f"{n} {what}" for n, what in ((s["broad_patterns"], "broad pattern(s)"), (s["fully_redundant_rules"], "fully redundant rule(s)")) if n]
    return out + (f"Quality: {', '.join(rated)}." if rated else "") + "\n"


FORMATS: dict[str, Callable[[Report], str]] = {"json": as_json, "table": as_table, "csv": as_csv, "summary": as_summary}


def render(report: Report, form: str) -> str:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(FORMATS)}")
    return FORMATS[form](report)


def evaluation_json(report: dict) -> str:
    kept = {k: report[k] for k in ("total_entries", "labeled_entries", "rules_evaluated")}
    return json.dumps(kept | {"rule_metrics": [m for m in report["rule_metrics"] if m["matched_count"] > 0], "co_firing": report["co_firing"], "summary": report["summary"]}, indent=2, default=str)


def evaluation_summary(report: dict) -> str:
    s = report["summary"]
    out = f"Evaluated {report['total_entries']} entries against {report['rules_evaluated']} rules. {s['rules_firing']} rules fired, {s['co_firing_pairs']} co-firing pairs.\n"
    return out + (f"Labeled: avg precision={s['avg_precision']:.2f}, avg recall={s['avg_recall']:.2f}.\n" if report["labeled_entries"] else "")


def evaluation_table(report: dict) -> str:
    firing = sorted((m for m in report["rule_metrics"] if m["matched_count"] > 0), key=lambda m: -m["matched_count"])
    out = ["", RULE, "  Rule evaluation report", f"  Entries: {report['total_entries']} ({report['labeled_entries']} labeled) | Rules: {report['rules_evaluated']} | Time: {report['duration_s']}s", RULE, ""]
    title = f"Rules that fired ({len(firing)}):"
    if report["labeled_entries"]:
        out += grid(title, [("Rule", 30, "s"), ("Matches", 8, "d"), ("Prec", 6, ".2f"), ("Recall", 6, ".2f"), ("F1", 6, ".2f")], [(m["name"], m["matched_count"], m["precision"], m["recall"], m["f1"]) for m in firing], 30)
    else:
        out += grid(title, [("Rule", 40, "s"), ("Matches", 8, "d")], [(m["name"], m["matched_count"]) for m in firing], 30)
    pairs = report["co_firing"]
    out += grid(f"Top co-firing pairs ({len(pairs)}):", [("Rule A", 25, "s"), ("Rule B", 25, "s"), ("Count", 6, "d")], [(p["rule_a"], p["rule_b"], p["count"]) for p in pairs[:15]])
    return "\n".join(out) + "\n"


def diff_table(report: dict) -> str:
    a, b = report["name_a"], report["name_b"]
    rows = [(r["rule"], r["rate_a"], r["rate_b"], r["drift"]) for r in report["results"] if r["significant"]]
    out = ["", RULE, "  Coverage drift", f"  {a}: {report['entries_a']} entries | {b}: {report['entries_b']} entries", RULE, ""]
    out += grid(f"Rules with significant drift ({len(rows)}):", [("Rule", 30, "s"), (f"{a} %", 10, ".1%"), (f"{b} %", 10, ".1%"), ("Drift", 8, ".1%")], rows[:30]) or ["  No significant drift detected.", ""]
    return "\n".join(out) + "\n"
