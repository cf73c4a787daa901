"""Feature engineering over patients, visits and bills: per-entity features, training frames, frozen group means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import calendar, equals_ignoring_case, flag, missing_as_null, safe_div, whole_days
from tessera.operators.profile import impute_median
from tessera.operators.tables import first_share, one_hot, small

NOT_LATER = ["avg_length_of_stay_hours", "days_since_first_visit", "days_since_last_visit"]


def provider_rejection(bills: DataFrame, visits: DataFrame, patients: DataFrame) -> DataFrame:
    """Bills and rejected share of each insurance provider."""
    joined = bills.select("bill_id", "visit_id", "claim_status").join(visits.select("visit_id", "patient_id"), "visit_id", "left").join(patients.select("patient_id", "insurance_provider"), "patient_id", "left")
    rejected = equals_ignoring_case("claim_status", "rejected")
    counts = joined.where("insurance_provider is not null").groupBy("insurance_provider").agg(F.count("bill_id").alias("provider_bills"), F.sum(rejected).alias("provider_rejected"))
    return counts.withColumn("provider_rejection_rate", safe_div("provider_rejected", "provider_bills"))


def visit_features(visits: DataFrame, reference: DataFrame) -> DataFrame:
    """Per patient: counts, stay, first and last visit, weekend visits and day gaps to the reference date (one row)."""
    rows = visits.where("patient_id is not null").groupBy("patient_id").agg(
        F.count("visit_id").alias("visit_count"), F.avg(missing_as_null("length_of_stay_hours")).alias("avg_length_of_stay_hours"), F.min("visit_date").alias("first_visit"), F.max("visit_date").alias("last_visit"), F.sum(flag(F.weekday("visit_date") >= 5)).alias("weekend_visits")
    )
    dated = rows.crossJoin(F.broadcast(reference))  # one row
    return dated.select("patient_id", "visit_count", "avg_length_of_stay_hours", "weekend_visits", whole_days("reference_date", "first_visit").alias("days_since_first_visit"), whole_days("reference_date", "last_visit").alias("days_since_last_visit"))


def reference_date(*dates: tuple[DataFrame, str]) -> DataFrame:
    """One row: the latest of all tables' dates, plus a day."""
    latest = reduce(DataFrame.unionByName, [df.agg(F.max(c).alias("m")) for df, c in dates])
    return latest.agg((F.max("m") + F.expr("interval 1 day")).alias("reference_date"))


def patient_features(patients: DataFrame, visits: DataFrame, bills: DataFrame, day: str | None = None) -> DataFrame:
    """Each patient with visit and provider features, up to a day or the day after the latest date; counts and rates are
    filled with 0, averages and gaps are not."""
    if day:
        ref = patients.sparkSession.range(1).select(F.lit(day).cast("date").cast("timestamp_ntz").alias("reference_date"))
    else:
        ref = reference_date((patients, "registration_date"), (visits, "visit_date"), (bills, "billing_date"))
    base = patients.crossJoin(F.broadcast(ref)).withColumn("days_registered", whole_days("reference_date", "registration_date")).drop("reference_date")  # one row
    out = base.join(visit_features(visits, ref), "patient_id", "left").join(small(provider_rejection(bills, visits, patients)), "insurance_provider", "left")
    return out.fillna(0, ["visit_count", "weekend_visits", "provider_bills", "provider_rejected", "provider_rejection_rate"])


def claim_frame(patients: DataFrame, visits: DataFrame, bills: DataFrame) -> DataFrame:
    """Bills with their visit and patient, calendar parts and lags; rows without date or target go."""
    stays = visits.join(patients, "patient_id", "left")  # the few rows meet first, so that bills are moved once
    rows = bills.join(stays, "visit_id", "left")
    rows = rows.withColumns({**calendar("billing_date", "billing"), **calendar("visit_date", "visit")})
    rows = rows.withColumns({"days_from_visit_to_billing": whole_days("billing_date", "visit_date"), "days_since_registration_at_visit": whole_days("visit_date", "registration_date")})
    return rows.dropna(subset=["visit_date", "billing_date", "claim_status"])


def risk_frame(patients: DataFrame, visits: DataFrame, bills: DataFrame) -> DataFrame:
    """Visits with their patient and bills (a row for each bill)."""
    rows = visits.join(patients, "patient_id", "left").join(bills, "visit_id", "left").withColumns(calendar("visit_date", "visit"))
    return rows.withColumn("days_since_registration_at_visit", whole_days("visit_date", "registration_date")).dropna(subset=["visit_date", "risk_score"])


def training_split(frame: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """The chronologically first rows; the order has to end in a unique key."""
    return first_share(frame, share, order)


def model_table(features: DataFrame, drop: list[str], numeric: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """Ids dropped, numbers filled with medians, categories with 'Unknown' and turned to 0/1 columns."""
    out = impute_median(features.drop(*drop), numeric).fillna("Unknown", list(categories))
    for c, values in categories.items():
        out = one_hot(out, c, sorted({*values, "Unknown"}))
    return out


def fit_group_means(train: DataFrame, key: str, values: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """Frozen state: each known key's means, and the means over all rows."""
    v = lambda c: missing_as_null(F.col(c).cast("double"))
    means = train.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(v(c)).alias(f"{key}_mean_{c}") for c in values])
    overall = train.agg(*[F.avg(v(c)).alias(c) for c in values]).first().asDict()
    return means, overall


def apply_group_means(df: DataFrame, key: str, values: list[str], means: DataFrame, overall: dict[str, float]) -> DataFrame:
    """Adds the key's means; unknown keys and keys whose values were all missing get the overall mean."""
    joined = df.join(small(means), key, "left")
    return joined.withColumns({f"{key}_mean_{c}": F.coalesce(f"{key}_mean_{c}", F.lit(overall[c])) for c in values})
