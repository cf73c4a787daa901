"""Data quality, drift and the monitoring store over events and bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import canonical_json, hmac_sha256
from tessera.operators import drift, rules, scoring, surveillance
from tessera.operators.tables import fresh_dir, last_of_share, up_to
from tessera.plans.oracles import hmac_sql
from tessera.plans.fixtures import table
from tessera.sources import files, store

# the bills as requests with defects, all fields as text
DIRTY = """(select l_orderkey, l_partkey, l_suppkey, l_linenumber,
 case when l_partkey % 19 = 0 then '' when l_partkey % 23 = 0 then null when l_partkey % 29 = 0 then 'inf' when l_partkey % 31 = 0 then '5d' else cast(l_quantity as {text}) end quantity,
 case when l_suppkey % 13 = 0 then '1.5' else cast(l_linenumber as {text}) end line,
 case when l_suppkey % 17 = 0 then 'ZZ' else l_returnflag end flag, cast(l_linestatus as {text}) status,
 cast(month(l_shipdate) as {text}) billing_month, cast(case when l_partkey % 37 = 0 then 1 else quarter(l_shipdate) end as {text}) billing_quarter,
 cast({weekday} as {text}) billing_day_of_week, cast(case when l_partkey % 41 = 0 then 0 else cast({weekday} >= 5 as int) end as {text}) billing_is_weekend,
 cast(l_extendedprice as {text}) billed, cast(case when l_partkey % 43 = 0 then l_extendedprice + 1 else l_extendedprice end as {text}) approved from lineitem)"""
SPARK_DIRTY = DIRTY.format(text="string", weekday="weekday(l_shipdate)")
DUCK_DIRTY = DIRTY.format(text="varchar", weekday="(isodow(l_shipdate) - 1)")
CONTRACT = rules.Contract(
    columns=("quantity", "line", "flag", "status", "billing_month", "billing_quarter", "billing_day_of_week", "billing_is_weekend", "billed", "approved", "doctor"),
    ranges={"quantity": (0, 40), "line": (1, 7)}, integers=("line",), categories={"flag": ("A", "N", "R"), "status": ("O",)}, controlled=("status",), calendars=("billing",), amounts=("approved", "billed"),
)


def dirty(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("lineitem")
    return s.sql(f"select quantity, line, flag, status, billing_month, billing_quarter, billing_day_of_week, billing_is_weekend, billed, approved, 1 as extra from {SPARK_DIRTY}")


def issues(s, d, *codes, missing="warn", unseen="warn"):
    out = rules.validate(dirty(s, d), CONTRACT, missing, unseen)
    return (out.where(F.col("code").isin(*codes)) if codes else out).withColumn("rate", F.round("rate", 9))


def quality_event(s, d):
    """The log line of a table's validation."""
    rows = dirty(s, d)
    found = rules.validate(rows, CONTRACT)
    line = files.quality_events(rules.report(rows, found, CONTRACT, "m", "a1"), "r1")
    part = lambda path: F.get_json_object("value", f"$.{path}")
    listed = F.from_json(part("issues"), "array<struct<code:string,feature:string,count:bigint,message:string>>")
    out = line.select(part("event").alias("event"), part("request_id").alias("request_id"), part("row_count").cast("bigint").alias("row_count"), part("valid").cast("boolean").alias("valid"), part("summary.error_count").cast("bigint").alias("error_count"), F.inline(listed))
    return out.withColumnRenamed("count", "failing")


_N = "case when regexp_full_match(trim({c}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then cast(trim({c}) as double) when lower(trim({c})) = 'inf' then 'inf'::double end"


_MESSAGES = {
    "missing_value": "Feature ''{f}'' contains missing or blank values", "invalid_numeric_type": "Feature ''{f}'' contains values that are not numeric", "non_finite_value": "Feature ''{f}'' contains NaN or infinite values",
    "numeric_out_of_range": "Feature ''{f}'' must be between 0 and 40", "integer_required": "Feature ''{f}'' must contain integer values", "unseen_category": "Feature ''{f}'' contains categories absent from the fitted encoder",
    "business_rule_violation": "Feature ''{f}'' cannot exceed ''billed''", "missing_column": "Required feature column ''{f}'' is missing", "unexpected_column": "Unexpected feature column ''{f}'' is not in the model contract",
}


def _issue(code, severity, feature, cond, distinct="null", beside=None):
    message = f"Feature ''{feature}'' is inconsistent with ''{beside}''" if beside else _MESSAGES[code].format(f=feature)
    return f"select '{code}' code, '{severity}' severity, '{feature}' feature, count(*) filter ({cond}) count, round(count(*) filter ({cond}) / count(*), 9) rate, '{message}' message, cast({distinct} as bigint) distinct_count from v"


def _sql(missing="warning", unseen="warning"):
    q, ln = _N.format(c="quantity"), _N.format(c="line")
    fine = lambda x: f"({x}) is not null and not isinf({x})"
    parts = [
        _issue("missing_value", missing, "quantity", "quantity is null or trim(quantity) = ''"),
        _issue("invalid_numeric_type", "error", "quantity", f"trim(quantity) <> '' and ({q}) is null"),
        _issue("non_finite_value", "error", "quantity", f"isinf({q})"),
        _issue("numeric_out_of_range", "error", "quantity", f"{fine(q)} and not ({q}) between 0 and 40"),
        _issue("integer_required", "error", "line", f"{fine(ln)} and ({ln}) % 1 > 1e-8"),
        _issue("unseen_category", unseen, "flag", "flag not in ('A', 'N', 'R')", "count(distinct flag) filter (flag not in ('A', 'N', 'R'))"),
        _issue("unseen_category", "error", "status", "status <> 'O'", "count(distinct status) filter (status <> 'O')"),
        _issue("inconsistent_calendar_field", "error", "billing_quarter", "cast(billing_quarter as int) <> ceil(cast(billing_month as int) / 3)", beside="billing_month"),
        _issue("inconsistent_calendar_field", "error", "billing_is_weekend", "cast(billing_is_weekend as int) <> cast(cast(billing_day_of_week as int) in (5, 6) as int)", beside="billing_day_of_week"),
        _issue("business_rule_violation", "error", "approved", "cast(approved as double) > cast(billed as double)"),
        _issue("missing_column", "error", "doctor", "true"),
        _issue("unexpected_column", "error", "extra", "true"),
    ]
    return f"(with v as (select * from {DUCK_DIRTY}) select * from ({' union all '.join(parts)}) where count > 0)"


def _only(*codes, **policies):
    return f"select * from {_sql(**policies)} where code in ({', '.join(repr(c) for c in codes)})"


def summary(s, d):
    return rules.summary(issues(s, d))


def learned(s, d):
    return rules.learn_categories(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]).select("feature", F.array_join("categories", "|").alias("categories"))


EVENTS = "(select *, row_number() over (order by ts, event_id) n, count(*) over () total from events)"
# the current part is moved, so that there is drift to see
NOW = f"(select event_id, ts, case when event_id % 50 = 0 then 'refund' else event_type end event_type, case when event_id % 20 <> 0 then value * 1.3 end as value, (event_id * 7) % 80 / 100.0 p from {EVENTS} where n > floor(0.8 * total))"
BASE = f"(select event_id, ts, event_type, value, (event_id * 7) % 100 / 100.0 p from {EVENTS} where n <= floor(0.8 * total))"


def parts(s, d):
    """The earliest 80 % of the events, and the rest of them, moved; p is what the model was sure of."""
    events, order = table(s, d, "events").select("event_id", "ts", "event_type", "value"), ["ts", "event_id"]
    last = last_of_share(events, 0.8, order)
    first = F.lit(False) if last is None else up_to(events, order, last)
    moved = {"event_type": F.when(F.col("event_id") % 50 == 0, "refund").otherwise(F.col("event_type")), "value": F.when(F.col("event_id") % 20 != 0, F.col("value") * 1.3), "p": F.pmod(F.col("event_id") * 7, F.lit(80)) / 100.0}
    return events.where(first).withColumn("p", F.pmod(F.col("event_id") * 7, F.lit(100)) / 100.0), events.where(~first).withColumns(moved)


def num_profile(s, d):
    p = drift.numeric_profile(parts(s, d)[1], ["value"])
    return p.select("feature", *[F.round(c, 6).alias(c) for c in ("missing_rate", "mean", "std", "low", "high", "median")], F.array_join(F.transform("cuts", lambda x: F.format_string("%.4f", x)), ",").alias("cuts"))


_DECILES = "quantile_cont({c}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])"
NUM_PROFILE = f"select 'value' feature, round(1 - count(value) / count(*), 6) missing_rate, round(avg(value), 6) mean, round(stddev_pop(value), 6) std, round(min(value), 6) low, round(max(value), 6) high, round(median(value), 6) median, array_to_string(list_transform({_DECILES.format(c='value')}, lambda x: printf('%.4f', x)), ',') cuts from {NOW}"


def cat_profile(s, d):
    p = drift.categorical_profile(parts(s, d)[1], ["event_type"])
    return p.select("feature", F.round("missing_rate", 9).alias("missing_rate"), F.array_join("known", "|").alias("known"), F.array_join(F.transform(F.map_entries("distribution"), lambda e: F.concat_ws("=", e["key"], F.format_string("%.6f", e["value"]))), "|").alias("distribution"))


CAT_PROFILE = f"select 'event_type' feature, 0.0::double missing_rate, string_agg(event_type, '|' order by event_type) known, string_agg(event_type || '=' || printf('%.6f', share), '|' order by event_type) distribution from (select event_type, count(*) / sum(count(*)) over () share from {NOW} group by 1)"


def bins(s, d):
    base, now = parts(s, d)
    return drift.histogram(now, ["value"], drift.numeric_profile(base, ["value"])).select("bin", "n", F.round("share", 9).alias("share"))


def _bins(t, c="value"):
    """Counts of a table's values in the bins that the baseline's distinct deciles make."""
    cuts = f"(select list_sort(list_distinct({_DECILES.format(c=c)})) cuts from {BASE})"
    return f"(select bin, count(v) n from (select unnest(range(len(cuts) + 1)) bin from {cuts}) left join (select {c} v, len(list_filter(cuts, lambda x: x <= {c})) b from {t}, {cuts} where {c} is not null) on b = bin group by 1)"


def _psi(c):
    return f"(select sum((a - e) * ln(a / e)) psi from (select greatest(e.n / sum(e.n) over (), 1e-6) e, greatest(a.n / sum(a.n) over (), 1e-6) a from {_bins(BASE, c)} e join {_bins(NOW, c)} a using (bin)))"


def psi_value(s, d):
    base, now = parts(s, d)
    p = drift.numeric_profile(base, ["value"])
    return drift.psi(drift.histogram(base, ["value"], p), drift.histogram(now, ["value"], p), ["feature", "bin"], ["feature"]).select("feature", F.round("psi", 9).alias("psi"))


def js_type(s, d):
    base, now = (drift.categorical_shares(x, ["event_type"]) for x in parts(s, d))
    return drift.jensen_shannon(base, now, ["feature", "value"], ["feature"]).select("feature", F.round("js", 9).alias("js"))


_SHARES = "(select event_type, count(*) / sum(count(*)) over () share from {t} group by 1)"
_JS = f"(select sum(case when p > 0 then p * ln(p / m) else 0 end) / 2 + sum(case when q > 0 then q * ln(q / m) else 0 end) / 2 js from (select p, q, greatest((p + q) / 2, 1e-12) m from (select coalesce(a.share, 0) p, coalesce(b.share, 0) q from {_SHARES.format(t=BASE)} a full join {_SHARES.format(t=NOW)} b using (event_type))))"

FEATURE_METRICS = ("psi", "js_divergence", "unseen_category_rate", "missing_rate_delta", "standardized_mean_shift")


def channelled(base):
    """A feature that the current rows lack."""
    return base.withColumn("channel", F.lit("web"))


def found(s, d):
    base, now = parts(s, d)
    return drift.against(drift.profile_document(channelled(base), ["value"], ["event_type", "channel"]), now)


def features(s, d):
    return found(s, d).features.select("feature", "rank", "status", *[F.round(c, 9).alias(c) for c in FEATURE_METRICS])


_UNSEEN = f"(select count(*) filter (event_type not in (select event_type from {BASE})) / count(*) u from {NOW})"
_MOVED = f"(select b.m - a.m md, abs(b.v - a.v) / a.s ms from (select 1 - count(value) / count(*) m, avg(value) v, stddev_pop(value) s from {BASE}) a, (select 1 - count(value) / count(*) m, avg(value) v from {NOW}) b)"
_RANKED = "greatest(case when {a} >= {a2} then 2 when {a} >= {a1} then 1 else 0 end, case when {b} >= {b2} then 2 when {b} >= {b1} then 1 else 0 end, case when {c} >= {c2} then 2 when {c} >= {c1} then 1 else 0 end)"
_RANKS = f"""(select 'value' feature, {_RANKED.format(a='psi', a1=.1, a2=.25, b='abs(md)', b1=.02, b2=.05, c='ms', c1=.25, c2=.5)} as rank, psi, null::double js_divergence, null::double unseen_category_rate, md missing_rate_delta, ms standardized_mean_shift from {_psi('value')}, {_MOVED}
 union all select 'event_type', {_RANKED.format(a='js', a1=.1, a2=.2, b='u', b1=.01, b2=.05, c=0, c1=.02, c2=.05)}, class_psi, js, u, 0.0, null from {_JS}, {_UNSEEN}, (select class_psi from PSI_OF_CLASSES)
 union all select 'channel', 2, null, null, null, null, null)"""


def rolled(s, d):
    out = found(s, d)
    return drift.gate(drift.roll_up(out.features), out.records).select("overall", "n_ok", "n_warning", "n_critical", "records", "result", "exit_code")


def predictions(s, d):
    base, now = parts(s, d)
    return drift.prediction_drift(base, now, "event_type", "p").select("rank", *[F.round(c, 6).alias(c) for c in ("class_js", "class_psi", "confidence_psi", "confidence_delta", "low_confidence_rate")])


_CLASS_PSI = f"(select sum((a - e) * ln(a / e)) class_psi from (select greatest(e / sum(e) over (), 1e-6) e, greatest(a / sum(a) over (), 1e-6) a from (select x.share e, coalesce(y.share, 0) a from {_SHARES.format(t=BASE)} x left join {_SHARES.format(t=NOW)} y using (event_type))))"
_RANKS = _RANKS.replace("PSI_OF_CLASSES", _CLASS_PSI)
_SURE = f"(select abs(b.m - a.m) cd, abs(b.m - a.m) / a.s cs, b.l from (select avg(p) m, stddev_pop(p) s from {BASE}) a, (select avg(p) m, avg(cast(p < 0.5 as double)) l from {NOW}) b)"
_SAID = f"""(select js class_js, class_psi, psi confidence_psi, cd confidence_delta, l low_confidence_rate, greatest({_RANKED.format(a='js', a1=.1, a2=.2, b='class_psi', b1=.1, b2=.25, c='cd', c1=.05, c2=.1)},
 case when psi >= .25 or cs >= .5 then 2 when psi >= .1 or cs >= .25 then 1 else 0 end) as rank from {_JS}, {_CLASS_PSI}, {_psi('p')}, {_SURE})"""
PREDICTIONS = f"select rank, round(class_js, 6) class_js, round(class_psi, 6) class_psi, round(confidence_psi, 6) confidence_psi, round(confidence_delta, 6) confidence_delta, round(low_confidence_rate, 6) low_confidence_rate from {_SAID}"


def stored_drift(s, d):
    """A baseline is registered, its window's telemetry is sealed and appended, and the drift job reads both back."""
    base, now = parts(s, d)
    home = fresh_dir(s, "monitoring")
    document = scoring.baseline_document(channelled(base), base, "m", "a1", ["value"], ["event_type", "channel"], "event_type", "p", contract_sha256="c1", period=("2024-01-01", "2024-01-25"))
    store.register_baseline(document.withColumn("baseline_json", F.lit('{"old": 1}')), f"{home}/baselines")
    store.register_baseline(document, f"{home}/baselines")
    payload = F.to_json(F.struct(F.struct("value", "event_type").alias("features"), F.col("event_type").alias("prediction"), F.col("p").alias("max_probability")))
    row = lambda df, tag: df.select(F.concat(F.lit(tag), "event_id").alias("telemetry_id"), F.lit("m").alias("model_id"), F.lit("a1").alias("artifact"), F.col("ts").cast("timestamp").alias("recorded_at"), payload.alias("payload"))
    told = row(base, "b").unionByName(row(now, "n"))
    store.append_telemetry(store.telemetry(told, b"first key", 4000), f"{home}/telemetry")
    begin, last = now.agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.date_format(F.max("ts") + F.expr("interval 1 second"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).first()
    surveillance.drift_of(s, f"{home}/baselines", f"{home}/telemetry", "m", [b"second key", b"first key"], f"{begin}Z", f"{last}Z", now=f"{last}Z", reports=f"{home}/reports")
    one = s.read.parquet(f"{home}/reports").select("overall_status", "record_count", F.from_json("report_json", f"summary struct<prediction_status:string>, feature_drift array<struct<feature:string,status:string,error:string,{','.join(f'{c}:double' for c in FEATURE_METRICS)}>>, prediction_drift struct<class_js:double,confidence_psi:double>").alias("r"))
    each = one.select("overall_status", "record_count", F.col("r.summary.prediction_status").alias("prediction_status"), F.round("r.prediction_drift.class_js", 9).alias("class_js"), F.round("r.prediction_drift.confidence_psi", 9).alias("confidence_psi"), F.inline("r.feature_drift"))
    return each.select("overall_status", "record_count", "prediction_status", "class_js", "confidence_psi", "feature", "status", F.col("error").isNotNull().alias("absent"), *[F.round(c, 9).alias(c) for c in FEATURE_METRICS])


_NAMES = "['ok','warning','critical']"
STORED = f"select {_NAMES}[greatest(max(r.rank) over (), p.rank) + 1] overall_status, (select count(*) from {NOW}) record_count, {_NAMES}[p.rank + 1] prediction_status, round(class_js, 9) class_js, round(confidence_psi, 9) confidence_psi, feature, {_NAMES}[r.rank + 1] status, feature = 'channel' absent, {', '.join(f'round({c}, 9) {c}' for c in FEATURE_METRICS)} from {_RANKS} r, {_SAID} p"


def low_confidence(s, d):
    p = F.pmod(F.col("event_id") * 7, F.lit(100)) / 100.0
    probabilities = F.create_map(F.lit("yes"), p, F.lit("no"), 1 - p)
    top = F.array_max(F.map_values(probabilities))
    return table(s, d, "events").agg(F.round(F.avg((top < 0.6).cast("double")), 9).alias("rate"), F.round(F.max(top), 6).alias("highest"))


def baseline_versions(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("baseline_id"), F.col("event_type").alias("model_id"), (F.col("event_id") * 7919 % 1000003).alias("version"))
    return store.active_baseline(e).select("model_id", "baseline_id", "version")


def rows_of_store(s, d):
    return table(s, d, "events").select(F.col("event_id").cast("string").alias("telemetry_id"), F.col("event_type").alias("model_id"), F.concat(F.lit("a"), F.col("user_id") % 2).alias("artifact"), F.col("ts").cast("timestamp").alias("recorded_at"), (F.col("ts").cast("timestamp") + F.expr("interval 10 days")).alias("expires_at"), "ts", "event_id")


def _types(s, d):
    r = table(s, d, "events").agg(F.min("event_type").alias("t"), F.max("ts").alias("m")).first()
    return r["t"], r["m"]


def window_scan(s, d):
    kind, latest = _types(s, d)
    start, end = latest.replace(hour=0, minute=0, second=0, microsecond=0), latest
    import datetime

    out = store.scan(rows_of_store(s, d), kind, "a1", str(start - datetime.timedelta(days=12)), str(end), str(end - datetime.timedelta(days=0)), 1000)
    return out.select("event_id", "artifact")


WINDOW_SCAN = "with m as (select max(ts) m, min(event_type) t from events) select event_id, 'a1' artifact from events, m where event_type = t and user_id % 2 = 1 and ts >= date_trunc('day', m) - interval 12 day and ts < m and ts + interval 10 day > m order by ts, cast(event_id as varchar) limit 1000"


def retention(s, d):
    latest = table(s, d, "events").agg(F.max("ts")).first()[0]
    return store.survivors(rows_of_store(s, d), F.lit(latest).cast("timestamp_ntz").cast("timestamp")).select("event_id")


def audit(s, d):
    e = table(s, d, "events")
    return e.select("event_id", hmac_sha256(b"audit-key", canonical_json(user="user_id", kind="event_type")).alias("digest"))


def round_trip(s, d):
    rows = table(s, d, "events").select(F.col("event_id").cast("string").alias("telemetry_id"), F.col("event_type").alias("model_id"), F.lit("a1").alias("artifact"), F.col("ts").cast("timestamp").alias("recorded_at"), F.to_json(F.struct("value", "props")).alias("payload"))
    sealed = store.telemetry(rows, b"first key", 30)
    return store.decrypted(sealed, [b"second key", b"first key"]).select(F.col("telemetry_id").cast("bigint").alias("event_id"), F.get_json_object("payload", "$.props").alias("props"))


QUERIES = {
    "dq_missing": (lambda s, d: issues(s, d, "missing_value", missing="reject"), _only("missing_value", missing="error")),
    "dq_range": (lambda s, d: issues(s, d, "numeric_out_of_range", "invalid_numeric_type", "non_finite_value"), _only("numeric_out_of_range", "invalid_numeric_type", "non_finite_value")),
    "dq_integer": (lambda s, d: issues(s, d, "integer_required"), _only("integer_required")),
    "dq_unseen_category": (lambda s, d: issues(s, d, "unseen_category", unseen="reject"), _only("unseen_category", unseen="error")),
    "dq_calendar": (lambda s, d: issues(s, d, "inconsistent_calendar_field"), _only("inconsistent_calendar_field")),
    "dq_business_rule": (lambda s, d: issues(s, d, "business_rule_violation"), _only("business_rule_violation")),
    "dq_report": (issues, f"select * from {_sql()}"),
    "dq_summary": (summary, f"select count(*) filter (severity = 'error') errors, count(*) filter (severity = 'warning') warnings, count(*) filter (severity = 'error') = 0 as valid from {_sql()}"),
    "quality_event": (quality_event, f"select 'data_quality_validation' event, 'r1' request_id, (select count(*) from lineitem) row_count, false as valid, count(*) filter (severity = 'error') over () error_count, code, feature, count failing, message from {_sql()}"),
    "category_contract": (learned, "select 'o_orderstatus' feature, string_agg(v, '|' order by v) categories from (select distinct o_orderstatus v from orders) union all select 'o_orderpriority', string_agg(v, '|' order by v) from (select distinct o_orderpriority v from orders)"),
    "numeric_profile": (num_profile, NUM_PROFILE),
    "categorical_profile": (cat_profile, CAT_PROFILE),
    "histogram_bins": (bins, f"select bin, n, round(n / sum(n) over (), 9) share from {_bins(NOW)}"),
    "psi_numeric": (psi_value, f"select 'value' feature, round(psi, 9) psi from {_psi('value')}"),
    "js_categorical": (js_type, f"select 'event_type' feature, round(js, 9) js from {_JS}"),
    "drift_report": (features, f"select feature, rank, {_NAMES}[rank + 1] status, {', '.join(f'round({c}, 9) {c}' for c in FEATURE_METRICS)} from {_RANKS}"),
    "stored_drift": (stored_drift, STORED),
    "drift_gate": (rolled, f"select ['ok','warning','critical'][max(rank) + 1] overall, count(*) filter (rank = 0) n_ok, count(*) filter (rank = 1) n_warning, count(*) filter (rank = 2) n_critical, (select count(*) from {NOW}) records, case when (select count(*) from {NOW}) < 100 then 'insufficient_data' else ['ok','warning','critical'][max(rank) + 1] end as result, case when (select count(*) from {NOW}) < 100 then 3 when max(rank) = 2 then 2 else 0 end exit_code from {_RANKS}"),
    "prediction_drift": (predictions, PREDICTIONS),
    "low_confidence_rate": (low_confidence, "select round(avg(cast(greatest(p, 1 - p) < 0.6 as double)), 9) rate, round(max(greatest(p, 1 - p)), 6) highest from (select cast((event_id * 7) % 100 as double) / 100.0 p from events)"),
    "active_baseline": (baseline_versions, "select event_type model_id, event_id baseline_id, event_id * 7919 % 1000003 as version from events qualify row_number() over (partition by event_type order by event_id * 7919 % 1000003 desc, event_id desc) = 1"),
    "telemetry_window_scan": (window_scan, WINDOW_SCAN),
    "retention_survivors": (retention, "select event_id from events where ts + interval 10 day > (select max(ts) from events)"),
    "hmac_audit": (audit, "select event_id, " + hmac_sql(b"audit-key", "'{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}'") + " digest from events"),
    "encrypted_roundtrip": (round_trip, "select event_id, props from events"),
}
