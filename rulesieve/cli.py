"""Command line: scan, compare, validate, generate-corpus, evaluate, evaluate-git, diff.

Exit codes: 0 done, 1 duplicates found where asked to fail on them, 2 bad input, 3 failure at work.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

import rulesieve
from rulesieve.errors import InputError, RuleError, RuleSieveError
from rulesieve.logs import setup

DONE, DUPLICATES, BAD_INPUT, FAILED = 0, 1, 2, 3


def priorities(text: str | None) -> dict[str, int]:
    """'a.json=100,b.json=80' to a mapping; the last equals sign of each part counts."""
    out = {}
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        name, sign, number = part.rpartition("=")
        if not sign or not number.strip().lstrip("-").isdigit():
            raise InputError(f"priority {part!r} is not of the form file=number")
        out[name.strip()] = int(number)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rulesieve", description="Overlap, quality and coverage of regex rule sets.")
    p.add_argument("--version", action="version", version=rulesieve.__version__)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--log-level", default="warning", choices=["debug", "info", "warning", "error"])
    common.add_argument("--log-file")
    common.add_argument("--log-format", default="text", choices=["text", "json"])
    common.add_argument("--skip-invalid", action="store_true")
    common.add_argument("files", nargs="+")
    out = argparse.ArgumentParser(add_help=False)
    out.add_argument("--output", "-o")
    made = argparse.ArgumentParser(add_help=False)
    made.add_argument("--samples", type=int, default=50)
    made.add_argument("--seed", type=int)
    study = argparse.ArgumentParser(add_help=False)
    study.add_argument("--threshold", type=float, default=0.8)
    study.add_argument("--negative-samples", type=int, default=10)
    study.add_argument("--format", default="table", choices=["json", "table", "csv", "summary"])
    study.add_argument("--workers", type=int, default=0)
    study.add_argument("--fail-on-duplicate", action="store_true")
    study.add_argument("--partition-by")
    real = argparse.ArgumentParser(add_help=False)
    real.add_argument("--format", default="table", choices=["json", "table", "summary"])
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("scan", parents=[common, out, made, study])
    sub.add_parser("compare", parents=[common, out, made, study]).add_argument("--priority")
    sub.add_parser("validate", parents=[common])
    sub.add_parser("generate-corpus", parents=[common, made]).add_argument("--output", "-o", required=True)
    e = sub.add_parser("evaluate", parents=[common, out, real])
    e.add_argument("--corpus", required=True)
    e.add_argument("--corpus-field", default="text")
    e.add_argument("--label-field", default="label")
    e.add_argument("--redact-samples", action="store_true")
    g = sub.add_parser("evaluate-git", parents=[common, out, real])
    g.add_argument("--repo", required=True)
    g.add_argument("--max-commits", type=int, default=500)
    d = sub.add_parser("diff", parents=[common, out])
    d.add_argument("--corpus-a", required=True)
    d.add_argument("--corpus-b", required=True)
    d.add_argument("--corpus-field", default="text")
    d.add_argument("--format", default="table", choices=["json", "table"])
    return p


def _session(workers: int = 0):
    """A local session on ``workers`` cores, or on all of them."""
    from rulesieve.session import local_session

    spark = local_session(cores=str(workers) if workers > 0 else os.environ.get("RULESIEVE_CPUS", "*"))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _write(text: str, output: str | None) -> None:
    if output:
        Path(output).write_text(text, encoding="utf-8")
        print(f"Report written to {output}")
    else:
        print(text, end="" if text.endswith("\n") else "\n")


def _study(a: argparse.Namespace) -> int:
    from rulesieve.plans.analyze import analyze
    from rulesieve.plans.render import render

    told = priorities(a.priority) if a.command == "compare" else {}
    report = analyze(_session(a.workers), a.files, a.threshold, samples=a.samples, negative_samples=a.negative_samples, seed=a.seed, workers=a.workers, partition_by=a.partition_by, skip_invalid=a.skip_invalid, priorities=told)
    _write(render(report, a.format), a.output)
    return DUPLICATES if a.fail_on_duplicate and report.duplicates else DONE


def _validate(a: argparse.Namespace) -> int:
    from rulesieve.sources.rules import load_rules

    total = 0
    for path in a.files:
        n = len(load_rules(path, a.skip_invalid))
        total += n
        print(f"OK: {path} — {n} valid rules")
    print(f"\nAll {total} rules valid across {len(a.files)} file(s).")
    return DONE


def _generate(a: argparse.Namespace) -> int:
    from rulesieve.operators.generate import Settings, generate
    from rulesieve.sources.rules import load_files, rules_frame

    loaded = load_files(a.files, a.skip_invalid)
    corpus = generate(rules_frame(_session(), loaded), Settings(samples=a.samples, seed=42 if a.seed is None else a.seed), a.skip_invalid)
    n = 0
    with Path(a.output).open("w", encoding="utf-8") as out:  # row by row: the corpus is never held here
        out.write("[")
        for r in corpus.orderBy("entry_id").toLocalIterator():
            told = json.dumps({"text": r["text"], "source_rule": loaded[r["source_rule_id"]].name, "is_negative": r["is_negative"]})
            out.write(("," if n else "") + "\n  " + told)
            n += 1
        out.write("\n]\n")
    print(f"Generated {n} corpus entries → {a.output}")
    return DONE


def _evaluate(a: argparse.Namespace) -> int:
    from rulesieve.plans import render
    from rulesieve.plans.analyze import evaluate_entries
    from rulesieve.sources.corpus import load_git, load_jsonl
    from rulesieve.sources.rules import load_files, rules_frame

    loaded, spark = load_files(a.files, a.skip_invalid), _session()
    entries = load_git(spark, a.repo, a.max_commits) if a.command == "evaluate-git" else load_jsonl(spark, a.corpus, a.corpus_field, a.label_field)
    report = evaluate_entries(rules_frame(spark, loaded), entries, redact_samples=getattr(a, "redact_samples", False))
    if a.format == "summary":
        print(render.evaluation_summary(report), end="")
    elif a.format == "json":
        _write(render.evaluation_json(report), a.output)
    else:
        print(render.evaluation_table(report), end="")
        if a.output:
            Path(a.output).write_text(render.evaluation_json(report), encoding="utf-8")
            print(f"  Full report written to {a.output}")
    return DONE


def _diff(a: argparse.Namespace) -> int:
    from rulesieve.plans.analyze import diff_entries
    from rulesieve.plans.render import diff_table
    from rulesieve.sources.corpus import load_jsonl
    from rulesieve.sources.rules import load_files, rules_frame

    loaded, spark = load_files(a.files, a.skip_invalid), _session()
    sides = [load_jsonl(spark, c, a.corpus_field) for c in (a.corpus_a, a.corpus_b)]
    report = diff_entries(rules_frame(spark, loaded), *sides, name_a=Path(a.corpus_a).stem, name_b=Path(a.corpus_b).stem)
    told = json.dumps(report, indent=2, default=str)
    if a.format == "json":
        _write(told, a.output)
    else:
        print(diff_table(report), end="")
        if a.output:
            Path(a.output).write_text(told, encoding="utf-8")
    return DONE


RUN = {"scan": _study, "compare": _study, "validate": _validate, "generate-corpus": _generate, "evaluate": _evaluate, "evaluate-git": _evaluate, "diff": _diff}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    setup(a.log_level, a.log_file, a.log_format)
    try:
        return RUN[a.command](a)
    except (InputError, RuleError, ValueError) as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return BAD_INPUT
    except (RuleSieveError, RuntimeError) as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
