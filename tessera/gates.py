"""Gates for scheduled jobs: `python -m tessera.gates validate|drift|compare ...`; the exit code tells the outcome.

0 passed, 2 failed (invalid data, counted warnings, critical drift), 3 too few records, 1 a run that broke.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import drift, rules, surveillance
from tessera.sources import files


def text_of(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def contract_of(text: str) -> rules.Contract:
    """A contract from JSON: columns, ranges, integers, categories, controlled, calendars, amounts."""
    spelled = json.loads(text)
    lists = {k: tuple(spelled.get(k, ())) for k in ("columns", "integers", "controlled", "calendars")}
    maps = {k: {c: tuple(v) for c, v in spelled.get(k, {}).items()} for k in ("ranges", "categories")}
    return rules.Contract(**lists, **maps, amounts=tuple(spelled["amounts"]) if spelled.get("amounts") else None)


def validate(spark: SparkSession, a: argparse.Namespace) -> tuple[int, DataFrame]:
    contract, rows = contract_of(text_of(spark, a.contract)), files.read_input(spark, a.input)
    issues = rules.validate(rows, contract, a.missing_policy, a.unseen_policy)
    return rules.exit_code(issues, a.fail_on_warnings), rules.report(rows, issues, contract, a.model)


def drifted(spark: SparkSession, a: argparse.Namespace) -> tuple[int, DataFrame]:
    keys = [line.encode() for line in text_of(spark, a.keys).splitlines() if line]
    report = surveillance.drift_of(spark, a.baselines, a.telemetry, a.model, keys, a.start, a.end, a.lookback_hours, a.minimum_records, reports=a.reports)
    return surveillance.exit_code(report), report


def compared(spark: SparkSession, a: argparse.Namespace) -> tuple[int, DataFrame]:
    """Two tables without a store."""
    base, now = files.read_input(spark, a.baseline), files.read_input(spark, a.input)
    numeric, categories = ([x for x in c.split(",") if x] for c in (a.numeric, a.categories))
    known = lambda cs: [c for c in cs if c in base.columns]
    found = drift.against(drift.profile_document(base, known(numeric), known(categories)), now)
    ranks = drift.report(found.features, [*numeric, *categories])
    one = drift.gate(drift.roll_up(ranks), found.records, a.minimum_records)
    told = one.crossJoin(drift.listed(ranks.select("feature", "status"), "features"))  # one row each
    return one.first()["exit_code"], told


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="tessera.gates", description=__doc__)
    kinds = made.add_subparsers(dest="kind", required=True)
    v, d, c = (kinds.add_parser(x) for x in ("validate", "drift", "compare"))
    v.add_argument("--contract", required=True)
    v.add_argument("--missing-policy", choices=rules.POLICIES, default="warn")
    v.add_argument("--unseen-policy", choices=rules.POLICIES, default="warn")
    v.add_argument("--fail-on-warnings", action="store_true")
    for x in ("baselines", "telemetry", "keys"):
        d.add_argument(f"--{x}", required=True)
    for x in ("start", "end", "reports"):
        d.add_argument(f"--{x}")
    d.add_argument("--lookback-hours", type=int, default=24)
    c.add_argument("--baseline", required=True)
    c.add_argument("--numeric", default="")
    c.add_argument("--categories", default="")
    for k in (v, c):
        k.add_argument("--input", required=True)
    for k in (d, c):
        k.add_argument("--minimum-records", type=int, default=100)
    for k in (v, d):
        k.add_argument("--model", required=k is d, default="model")
    for k in (v, d, c):
        k.add_argument("--output")
    return made


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.getOrCreate()
        code, told = {"validate": validate, "drift": drifted, "compare": compared}[a.kind](spark, a)
        text = files.write_report(told, a.output)
    except Exception as e:  # noqa: BLE001  whatever breaks a run is told apart from what it finds
        print(f"{a.kind} failed: {type(e).__name__}: {str(e)[:500]}", file=sys.stderr)
        return 1
    if not a.output:
        print(text)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
