"""Drift of a deployed model from the monitoring store: the active baseline against a window of its telemetry."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import drift
from tessera.sources import store

#: Columns beside the features, under names that no feature has.
SAID, SURE, KEYS = "__said__", "__sure__", "__keys__"

def decoded(telemetry: DataFrame, document: dict, keyring: list[bytes]) -> DataFrame:
    """The document's features, prediction, max_probability and the names of the features that each payload has."""
    kinds = {c: "double" if p["type"] == "numeric" else "string" for c, p in document["feature_profiles"].items()}
    spelled = ", ".join(f"`{c}`: {kind}" for c, kind in kinds.items())
    shape = f"features struct<{spelled}>, prediction string, max_probability double" if kinds else "prediction string, max_probability double"
    one = store.decrypted(telemetry, keyring).select(F.from_json("payload", shape).alias("p"), F.json_object_keys(F.get_json_object("payload", "$.features")).alias("k"))
    return one.select(*([F.col(f"p.features.`{c}`").alias(c) for c in kinds]), F.col("p.prediction").alias(SAID), F.col("p.max_probability").alias(SURE), F.col("k").alias(KEYS))


def window_of(start: str | None, end: str | None, lookback_hours: int, now: str | None = None) -> tuple[datetime, datetime]:
    """[start, end): the end is now, and the start so many hours before it, where they are not given."""
    if lookback_hours < 1:
        raise ValueError("lookback hours are at least 1")
    read = lambda x: datetime.fromisoformat(x.replace("Z", "+00:00"))
    stop = read(end) if end else read(now) if now else datetime.now().astimezone()
    begin = read(start) if start else stop - timedelta(hours=lookback_hours)
    if begin >= stop:
        raise ValueError("a window starts before its end")
    return begin, stop


def _at(t: datetime) -> Column:
    return F.lit(t.isoformat()).cast("timestamp")


def drift_of(spark: SparkSession, baselines: str, telemetry: str, model_id: str, keyring: list[bytes], start: str | None = None, end: str | None = None, lookback_hours: int = 24, minimum: int = 100, now: str | None = None, reports: str | None = None, thresholds: drift.Thresholds = drift.Thresholds()) -> DataFrame:
    """The drift report of a window, as one row; it is appended to the reports where their path is given.

    The model's active baseline is read as a document, its training rows never again. Telemetry is pruned by model,
    artifact and time before it is decrypted, and scanned once for all features. A window without rows is too few.
    """
    if minimum < 1:
        raise ValueError("the minimum of records is at least 1")
    begin, stop = window_of(start, end, lookback_hours, now)
    document = json.loads(store.load_active_baseline(spark, baselines, model_id))
    rows = store.unexpired(spark.read.parquet(telemetry), model_id, document["artifact_sha256"], _at(begin), _at(stop), F.lit(now).cast("timestamp") if now else F.current_timestamp())
    current = decoded(rows, document, keyring)
    found = drift.against(document, current, SAID, SURE, thresholds=thresholds, keys=KEYS)
    report = drift.report_row(found, document, _at(begin), _at(stop), minimum, thresholds)
    if reports:
        store.append_report(report, reports)
    return report


def exit_code(report: DataFrame) -> int:
    """0 below critical, 2 critical, 3 too few records."""
    status = report.select("overall_status").first()[0]
    return {"insufficient_data": 3, "critical": 2}.get(status, 0)
