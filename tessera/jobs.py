"""Jobs of the model's life: `python -m tessera.jobs features|model-table|baseline|store|contract|synthetic ...`.

0 done, 1 a run that broke. Tables are read from CSV folders or a relational database and written as Parquet, or as CSV
where the output's name ends so; nothing but single-row documents comes to the driver.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features, ml, rules, scoring
from tessera.operators.tables import columns_of_kind, settled
from tessera.sources import files, store

TABLES = ("patients", "visits", "billing")
#: Columns of a model table that say who or when, and those that become 0/1 columns.
DROPPED, CATEGORIES = ("patient_id", "registration_date", "first_visit_date", "last_visit_date"), ("gender", "city", "insurance_provider")
#: The training frame of each kind: its rows, their order in time (which ends in a key), and the target.
FRAMES = {
    "claim": (features.claim_frame, ["billing_date", "bill_id"], "claim_status"),
    "risk": (features.risk_frame, ["visit_date", "visit_id", "bill_id"], "risk_score"),
}


def source_tables(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    if a.jdbc:
        options = {"driver": a.driver} if a.driver else {}
        return {t: files.read_table(spark, a.jdbc, a.schema, t.upper(), **options) for t in TABLES}
    return files.read_training_tables(spark, a.source, TABLES)


def written(df: DataFrame, path: str) -> None:
    (files.write_csv if path.endswith(".csv") else files.write_parquet)(df, path)


def build_features(spark: SparkSession, a: argparse.Namespace) -> str:
    t = source_tables(spark, a)
    written(features.patient_features(*(t[x] for x in TABLES), a.reference_date), a.output)
    return f"features={a.output}"


def build_model_table(spark: SparkSession, a: argparse.Namespace) -> str:
    rows = files.read_input(spark, a.input)
    named = [c for c in CATEGORIES if c in rows.columns]
    seen = {r["feature"]: r["categories"] for r in rules.learn_categories(rows, named).collect()} if named else {}  # the new columns' names
    kept = rows.drop(*DROPPED)
    out = features.model_table(kept, [], [c for c in columns_of_kind(kept, True) if c not in named], {c: seen.get(c, []) for c in named})
    written(out, a.output)
    return f"model_table={a.output} columns={len(out.columns)}"


def build_baseline(spark: SparkSession, a: argparse.Namespace) -> str:
    t = source_tables(spark, a)
    frame, order, target = FRAMES[a.kind]
    train = features.training_split(frame(*(t[x] for x in TABLES)), order)
    model = PipelineModel.load(a.artifact)
    classes = ml.classes_of(model)
    kinds = ml.learned_categories(model)
    asked = {c for s in model.stages for c in (s.reads() if hasattr(s, "reads") else ml.inputs_of(s))}
    inputs = sorted(c for c in asked if c in train.columns and c != target)
    rows = settled(train.select(*order, *[c for c in inputs if c not in order]))  # profiled and scored
    scored = settled(ml.predicted(model, rows, classes).select("predicted", "max_probability"))
    span = train.agg(F.min(order[0]).cast("string"), F.max(order[0]).cast("string")).first()
    digest = lambda path: files.tree_digest(spark, path)
    sources = {x: digest(f"{a.source}/{x}.csv") for x in TABLES} if a.source else {}
    document = scoring.baseline_document(
        rows, scored, a.model, digest(a.artifact), [c for c in inputs if c not in kinds], [c for c in inputs if c in kinds], "predicted", "max_probability", contract_sha256=rules.contract_sha256(kinds), period=tuple(span), sources=sources,
    )
    document = settled(document)
    baseline_id = store.register_baseline(document, a.baselines) if a.baselines else "not-stored"
    if a.output:
        text = json.dumps(json.loads(document.first()["baseline_json"]), indent=2, ensure_ascii=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.output)
    return f"model={a.model} rows={document.first()['record_count']} baseline_id={baseline_id}"


def manage_store(spark: SparkSession, a: argparse.Namespace) -> str:
    if a.command == "purge-expired":
        return f"expired_rows_deleted={store.purge(spark, a.telemetry, a.now or datetime.now().isoformat(sep=' ', timespec='seconds'))}"
    if not store.healthy(spark, a.telemetry):
        raise RuntimeError("the store cannot be read")
    return "monitoring_store=ready"


def export_contract(spark: SparkSession, a: argparse.Namespace) -> str:
    kinds = ml.learned_categories(PipelineModel.load(a.artifact))
    print_ = rules.contract_sha256(kinds)
    one = spark.createDataFrame([(a.model, files.tree_digest(spark, a.artifact), print_, json.dumps(kinds, sort_keys=True))], "model_id string, artifact_sha256 string, category_contract_sha256 string, categories string")
    files.write_report(one.withColumn("categories", F.from_json("categories", "map<string,array<string>>")), a.output)
    return f"model={a.model} features={len(kinds)} contract_sha256={print_} output={a.output}"


def synthetic(spark: SparkSession, a: argparse.Namespace) -> str:
    if not 1 <= a.count <= scoring.MOST:
        raise ValueError(f"count is 1 to {scoring.MOST}")
    made = {"claim": files.synthetic_claims(spark, a.count, a.seed), "risk": files.synthetic_risks(spark, a.count, a.seed + 1)}
    for kind, rows in made.items():
        files.batches_json(rows, a.count, ["id"]).coalesce(1).write.mode("overwrite").text(f"{a.output}/{kind}-batch-{a.count}")
    return f"created={a.output} records={a.count}"


JOBS = {"features": build_features, "model-table": build_model_table, "baseline": build_baseline, "store": manage_store, "contract": export_contract, "synthetic": synthetic}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="tessera.jobs", description=__doc__)
    kinds = made.add_subparsers(dest="job", required=True)
    f, m, b, s, c, y = (kinds.add_parser(x) for x in JOBS)
    for k in (f, b):
        where = k.add_mutually_exclusive_group(required=True)
        where.add_argument("--source")
        where.add_argument("--jdbc")
        k.add_argument("--schema", default="APP")
        k.add_argument("--driver")
    f.add_argument("--reference-date")
    m.add_argument("--input", required=True)
    b.add_argument("--kind", choices=sorted(FRAMES), required=True)
    b.add_argument("--baselines")
    for k in (b, c):
        k.add_argument("--artifact", required=True)
        k.add_argument("--model", required=True)
    s.add_argument("command", choices=["health", "purge-expired"])
    s.add_argument("--telemetry", required=True)
    s.add_argument("--now")
    y.add_argument("--count", type=int, default=100)
    y.add_argument("--seed", type=int, default=20260705)
    for k in (f, m, b, c, y):
        k.add_argument("--output", required=k is not b)
    return made


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        print(JOBS[a.job](spark or SparkSession.builder.getOrCreate(), a))
    except Exception as e:  # noqa: BLE001  whatever breaks a run is told and counted
        print(f"{a.job} failed: {type(e).__name__}: {str(e)[:500]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
