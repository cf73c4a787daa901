"""Feature engineering over the hospital roles of the tables."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tessera.operators import features as f
from tessera.operators.interactions import CLAIM_COLUMNS, RISK_COLUMNS, Interactions
from tessera.operators.tables import fresh_dir, stored
from tessera.plans.fixtures import BILLS, PATIENTS, VISITS, bills, patients, visits


def rejection(s, d):
    return f.provider_rejection(bills(s, d), visits(s, d), patients(s, d)).select("insurance_provider", "provider_bills", "provider_rejected", F.round("provider_rejection_rate", 9).alias("provider_rejection_rate"))


REJECTION = f"(select insurance_provider, count(bill_id) provider_bills, cast(sum(case when upper(claim_status) = 'REJECTED' then 1 else 0 end) as bigint) provider_rejected from {BILLS} b left join {VISITS} v using (visit_id) left join {PATIENTS} p using (patient_id) where insurance_provider is not null group by 1)"


def patient_visits(s, d):
    ref = f.reference_date((visits(s, d), "visit_date"))
    out = f.visit_features(visits(s, d), ref)
    return out.withColumn("avg_length_of_stay_hours", F.round("avg_length_of_stay_hours", 6))


def _visits_sql(ref):
    return f"(select patient_id, count(visit_id) visit_count, avg(length_of_stay_hours) avg_length_of_stay_hours, cast(sum(case when isodow(visit_date) >= 6 then 1 else 0 end) as bigint) weekend_visits, cast(floor(date_diff('second', min(visit_date), {ref}) / 86400) as bigint) days_since_first_visit, cast(floor(date_diff('second', max(visit_date), {ref}) / 86400) as bigint) days_since_last_visit from {VISITS} where patient_id is not null group by 1)"


_VREF = f"(select max(visit_date) + interval 1 day from {VISITS})"
_REF = f"(select greatest((select max(registration_date) from {PATIENTS}), (select max(visit_date) from {VISITS}), (select max(billing_date) from {BILLS})) + interval 1 day)"


def all_patient_features(s, d):
    out = f.patient_features(patients(s, d), visits(s, d), bills(s, d))
    return out.select("patient_id", "insurance_provider", "age", "chronic_flag", "days_registered", "visit_count", F.round("avg_length_of_stay_hours", 6).alias("avg_length_of_stay_hours"), "weekend_visits", "days_since_first_visit", "days_since_last_visit", "provider_bills", "provider_rejected", F.round("provider_rejection_rate", 9).alias("provider_rejection_rate"))


PATIENT_FEATURES = f"select patient_id, insurance_provider, age, chronic_flag, cast(floor(date_diff('second', registration_date, {_REF}) / 86400) as bigint) days_registered, coalesce(visit_count, 0) visit_count, round(avg_length_of_stay_hours, 6) avg_length_of_stay_hours, coalesce(weekend_visits, 0) weekend_visits, days_since_first_visit, days_since_last_visit, coalesce(provider_bills, 0) provider_bills, coalesce(provider_rejected, 0) provider_rejected, round(coalesce(provider_rejected / provider_bills, 0), 9) provider_rejection_rate from {PATIENTS} left join {_visits_sql(_REF)} using (patient_id) left join {REJECTION} using (insurance_provider)"

CLAIM_ORDER = ["billing_date", "bill_id"]
CLAIM_KEEP = ["bill_id", "claim_status", "billing_month", "billing_quarter", "billing_day_of_week", "billing_is_weekend", "visit_month", "days_from_visit_to_billing", "days_since_registration_at_visit"]
CLAIM_FRAME = f"(select *, month(billing_date) billing_month, quarter(billing_date) billing_quarter, isodow(billing_date) - 1 billing_day_of_week, cast(isodow(billing_date) >= 6 as int) billing_is_weekend, month(visit_date) visit_month, cast(floor(date_diff('second', visit_date, billing_date) / 86400) as bigint) days_from_visit_to_billing, cast(floor(date_diff('second', registration_date, visit_date) / 86400) as bigint) days_since_registration_at_visit from {BILLS} left join {VISITS} using (visit_id) left join {PATIENTS} using (patient_id) where visit_date is not null and billing_date is not null and claim_status is not null)"
CLAIM_TRAIN = f"(select * from {CLAIM_FRAME} qualify row_number() over (order by billing_date, bill_id) <= floor(0.8 * count(*) over ()))"


def claim_train(s, d):
    return f.training_split(f.claim_frame(patients(s, d), visits(s, d), bills(s, d)), CLAIM_ORDER)


RISK_ORDER = ["visit_date", "visit_id", "bill_id"]
RISK_FRAME = f"(select *, month(visit_date) visit_month, year(visit_date) visit_year, cast(floor(date_diff('second', registration_date, visit_date) / 86400) as bigint) days_since_registration_at_visit from {VISITS} left join {PATIENTS} using (patient_id) left join {BILLS} using (visit_id) where visit_date is not null and risk_score is not null)"
RISK_TRAIN = f"(select * from {RISK_FRAME} qualify row_number() over (order by visit_date, visit_id, bill_id nulls first) <= floor(0.8 * count(*) over ()))"


def risk_train(s, d):
    return f.training_split(f.risk_frame(patients(s, d), visits(s, d), bills(s, d)), RISK_ORDER)


PROVIDERS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
NUMERIC = ["avg_length_of_stay_hours", "days_since_last_visit"]


def onehot(s, d):
    out = f.model_table(f.patient_features(patients(s, d), visits(s, d), bills(s, d)), ["city", "registration_date", "days_since_first_visit"], NUMERIC, {"insurance_provider": PROVIDERS, "gender": ["F", "M"]})
    return out.select("patient_id", *[F.round(c, 6).alias(c) for c in NUMERIC], *[f"insurance_provider_{v}" for v in [*PROVIDERS, "Unknown"]], "gender_F", "gender_M")


ONEHOT = f"with p as ({PATIENT_FEATURES}), g as (select patient_id, gender from {PATIENTS}) select patient_id, {', '.join(f'round(cast(coalesce({c}, (select median({c}) from p)) as double), 6) {c}' for c in NUMERIC)}, {', '.join(f'cast(coalesce(insurance_provider, {chr(39)}Unknown{chr(39)}) = {chr(39)}{v}{chr(39)} as int) insurance_provider_{v}' for v in [*PROVIDERS, 'Unknown'])}, cast(gender = 'F' as int) gender_F, cast(gender = 'M' as int) gender_M from p join g using (patient_id)"


def with_interactions(frame, order, kind):
    """The frame with the columns of a pipeline that is fitted on the training rows, stored and loaded again.

    What the split, the fit and the columns read of the joined frame is stored first, so that it is joined once."""
    stage, path = Interactions(kind=kind), fresh_dir(frame.sparkSession, "interactions")
    rows = stored(frame.select(*dict.fromkeys([*order, *stage.reads()])), "frame")
    Pipeline(stages=[stage]).fit(f.training_split(rows, order)).write().save(path)
    return PipelineModel.load(path).transform(rows)


#: Amounts over whole hours end after nine digits at most, and would lie on the edge of fewer.
_DIGITS = {"billed_amount_per_stay_hour": 9}


def _rounded(names):
    return [(F.round(F.col(c).cast("double"), _DIGITS.get(c, 4)) + 0.0).alias(c) for c in names]


def claim_columns(s, d):
    frame = f.claim_frame(patients(s, d), visits(s, d), bills(s, d))
    return with_interactions(frame, CLAIM_ORDER, "claim").select("bill_id", *_rounded(CLAIM_COLUMNS))


def risk_columns(s, d):
    frame = f.risk_frame(patients(s, d), visits(s, d), bills(s, d))
    return with_interactions(frame, RISK_ORDER, "risk").select("visit_id", "bill_id", *_rounded(RISK_COLUMNS))


_MEANS = """t as (select * from {train}),
 o as (select avg(billed_amount) ob, avg(length_of_stay_hours) os, avg({lag}) ol from t),
 dm as (select department, avg(billed_amount) gb, avg(length_of_stay_hours) gs, avg({lag}) gl from t where department is not null group by 1),
 pm as (select insurance_provider, avg(billed_amount) hb, avg({lag}) hl from t where insurance_provider is not null group by 1),
 f as (select f.*, coalesce(gb, ob) db, coalesce(gs, os) ds, coalesce(gl, ol) dl, coalesce(hb, ob) pb, coalesce(hl, ol) pl
  from {frame} f left join dm using (department) left join pm using (insurance_provider), o)"""
_SHARED = {
    "department_avg_billed_amount": "db", "bill_vs_department_avg": "billed_amount - db", "bill_to_department_avg_ratio": "billed_amount / nullif(db, 0)",
    "department_avg_length_of_stay": "ds", "los_to_department_avg_ratio": "length_of_stay_hours / nullif(ds, 0)",
    "billed_amount_per_stay_hour": "case when length_of_stay_hours < 1 then billed_amount else billed_amount / length_of_stay_hours end",
    "provider_avg_billed_amount": "pb", "bill_vs_provider_avg": "billed_amount - pb", "bill_to_provider_avg_ratio": "billed_amount / nullif(pb, 0)",
}
_LAG = "days_from_visit_to_billing"
_CLAIM_ONLY = {
    "department_avg_billing_lag": "dl", "billing_lag_vs_department_avg": f"{_LAG} - dl", "billing_lag_to_department_avg_ratio": f"{_LAG} / nullif(dl, 0)",
    "provider_avg_billing_lag": "pl", "billing_lag_vs_provider_avg": f"{_LAG} - pl", "billing_lag_to_provider_avg_ratio": f"{_LAG} / nullif(pl, 0)",
    "age_chronic_interaction": "age * chronic_flag", "los_chronic_interaction": "length_of_stay_hours * chronic_flag", "billed_amount_chronic_interaction": "billed_amount * chronic_flag",
}


def _made(columns):
    return ", ".join(f"round(cast({x} as double), {_DIGITS.get(c, 4)}) + 0.0 as {c}" for c, x in columns.items())


INTERACTIONS = f"with {_MEANS.format(train=CLAIM_TRAIN, frame=CLAIM_FRAME, lag=_LAG)} select bill_id, {_made(_SHARED | _CLAIM_ONLY)} from f"
RISK_INTERACTIONS = f"with {_MEANS.format(train=RISK_TRAIN, frame=RISK_FRAME, lag='null::double')} select visit_id, bill_id, {_made(_SHARED)} from f"


def frozen_fallback(s, d):
    """Means fitted without one department: its rows take the overall mean."""
    v = visits(s, d)
    state = f.fit_group_means(v.where("department <> '1-URGENT'"), "department", ["length_of_stay_hours"])
    return f.apply_group_means(v, "department", ["length_of_stay_hours"], *state).select("visit_id", F.round("department_mean_length_of_stay_hours", 6).alias("mean_stay"))


FROZEN = f"with t as (select * from {VISITS} where department <> '1-URGENT'), m as (select department, avg(length_of_stay_hours) m from t group by 1) select visit_id, round(coalesce(m, (select avg(length_of_stay_hours) from t)), 6) mean_stay from {VISITS} left join m using (department)"

QUERIES = {
    "provider_rejection_rate": (rejection, f"select *, round(provider_rejected / provider_bills, 9) provider_rejection_rate from {REJECTION}"),
    "patient_visit_features": (patient_visits, f"select * replace (round(avg_length_of_stay_hours, 6) as avg_length_of_stay_hours) from {_visits_sql(_VREF)}"),
    "patient_features": (all_patient_features, PATIENT_FEATURES),
    "claim_training_frame": (lambda s, d: claim_train(s, d).select(*CLAIM_KEEP), f"select {', '.join(CLAIM_KEEP)} from {CLAIM_TRAIN}"),
    "risk_training_frame": (lambda s, d: risk_train(s, d).select("visit_id", "bill_id", "risk_score", "visit_year", "visit_month", "days_since_registration_at_visit"), f"select visit_id, bill_id, risk_score, visit_year, visit_month, days_since_registration_at_visit from {RISK_TRAIN}"),
    "model_table_onehot": (onehot, ONEHOT),
    "claim_interactions": (claim_columns, INTERACTIONS),
    "risk_interactions": (risk_columns, RISK_INTERACTIONS),
    "frozen_mean_fallback": (frozen_fallback, FROZEN),
}
