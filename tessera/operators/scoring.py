"""Batch scoring: validate, predict, audit and record; the baseline document of a training population."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import new_id
from tessera.operators import drift, rules
from tessera.operators.ml import predicted
from tessera.operators.tables import settled
from tessera.sources import files, store

#: Rows that one request may have.
LEAST, MOST = 1, 10_000


class Rejected(ValueError):
    """A batch that fails its contract; `issues` tells why, without any value."""

    def __init__(self, issues: DataFrame) -> None:
        super().__init__("the batch fails its contract")
        self.issues = issues


@dataclass(frozen=True)
class Scored:
    rows: DataFrame
    audit: DataFrame
    telemetry: DataFrame


def check_request(batch: DataFrame, contract: rules.Contract, unseen_policy: str = "reject") -> DataFrame:
    """The batch's issues; a batch of no rows, or of more than a request may have, is an error."""
    n = batch.limit(MOST + 1).count()
    if not LEAST <= n <= MOST:
        raise ValueError(f"a request has {LEAST} to {MOST} rows")
    return rules.validate(batch, contract, "reject", unseen_policy)


def score_batch(batch: DataFrame, model, model_id: str, artifact: str, classes: list[str], contract: rules.Contract, key: bytes, retention_days: int = 90, store_path: str | None = None, model_name: str | None = None) -> Scored:
    """Predictions of a batch that holds to its contract, with an audit line and a telemetry row for each.

    Fails closed: a batch with errors is rejected before it is scored, and where a store is given, no prediction comes
    back unless its telemetry has been written. Rows get their id once, and keep it in all three tables.
    """
    issues = check_request(batch, contract)
    if rules.exit_code(issues):
        raise Rejected(issues)
    began = time.monotonic()
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1  # a request's rows are bounded
    asked = batch.withColumns({"request_id": new_id(), "timestamp": F.current_timestamp(), "record_index": place})
    rows = settled(predicted(model, asked, classes))
    size, took = rows.count(), (time.monotonic() - began) * 1000
    features = list(contract.columns)
    payload = F.to_json(F.struct(F.struct(*features).alias("features"), F.col("predicted").alias("prediction"), "probabilities", "max_probability"), {"ignoreNullFields": "false"})
    told = rows.select(F.col("request_id").alias("telemetry_id"), F.lit(model_id).alias("model_id"), F.lit(artifact).alias("artifact"), F.col("timestamp").alias("recorded_at"), payload.alias("payload"))
    sealed = store.telemetry(told, key, retention_days)
    if store_path:
        store.append_telemetry(sealed, store_path)
    named = {"model_id": F.lit(model_id), "model_name": F.lit(model_name or model_id), "artifact_sha256": F.lit(artifact), "prediction": F.col("predicted"), "batch_size": F.lit(size), "duration_ms": F.lit(took)}
    audit = files.audit_events(rows.select("timestamp", "request_id", "record_index", "probabilities", *features, *[v.alias(k) for k, v in named.items()]), key, features)
    return Scored(rows.select("request_id", *features, "predicted", "probabilities", "max_probability"), audit, sealed)


def baseline_document(training: DataFrame, predictions: DataFrame, model_id: str, artifact: str, numeric: list[str], categories: list[str], label: str, confidence: str, low: float = 0.5, contract_sha256: str | None = None, period: tuple[str, str] | None = None, sources: dict[str, str] | None = None) -> DataFrame:
    """One row (model_id, artifact, record_count, baseline_json): profiles of the features, and of the model's predictions
    on the same rows, with where they come from. No rows, or another number of predictions than of rows, is an error."""
    n, m = training.count(), predictions.count()
    if not n:
        raise ValueError("a baseline needs a record")
    if n != m:
        raise ValueError(f"{m} predictions do not align with {n} training rows")
    spark = training.sparkSession
    document = {
        "schema_version": 1, "model_id": model_id, "artifact_sha256": artifact, "category_contract_sha256": contract_sha256, "created_at": datetime.now(UTC).isoformat().replace("+00:00", "Z"),
        "baseline_population": "earliest_80_percent_chronological_training_split", "training_period": dict(zip(("start", "end"), period or (None, None), strict=True)), "record_count": n,
        "source_file_sha256": sources or {}, **drift.profile_document(training, numeric, categories), "prediction_profile": drift.prediction_profile(predictions, label, confidence, low),
    }
    body = json.dumps(document, sort_keys=True, ensure_ascii=True, allow_nan=False)
    return spark.createDataFrame([(model_id, artifact, n, body)], "model_id string, artifact string, record_count long, baseline_json string")


def contract_document(train: DataFrame, model_id: str, features: list[str] | None = None) -> DataFrame:
    """One row (model_id, categories as JSON, contract_sha256): the categories seen in training, for export."""
    learned = settled(rules.learn_categories(train, features))
    lists = learned.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "categories"))))).alias("categories"))
    return lists.crossJoin(rules.fingerprint(learned)).select(F.lit(model_id).alias("model_id"), "categories", "contract_sha256")  # one row each
