"""The same operators over a shop's tables, which have nulls, repeated, late and broken rows, and skewed keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import day_first_time
from tessera.operators import drift, profile, rules
from tessera.operators.tables import fresh_dir, keep_first, last_of_share, top_k, up_to
from tessera.plans.fixtures import table
from tessera.streaming import windows

LINES = rules.Contract(
    columns=("sale_id", "line_no", "item_id", "vendor_id", "quantity", "amount", "discount", "flag", "batch"), ranges={"quantity": (1, 40), "amount": (0, 500), "discount": (0, 0.08), "item_id": (0, 1e12)},
    integers=("quantity",), categories={"flag": ("kept", "returned")}, amounts=("discount", "amount"),
)


def line_quality(s, d):
    found = rules.validate(table(s, d, "sale_lines").drop("shipped_at"), LINES, "reject")
    return found.select("code", "severity", "feature", "count", F.round("rate", 9).alias("rate"), "distinct_count")


def _issue(code, feature, cond, severity="error", distinct="null"):
    return f"select '{code}' code, '{severity}' severity, '{feature}' feature, count(*) filter ({cond}) count, round(count(*) filter ({cond}) / count(*), 9) rate, cast({distinct} as bigint) distinct_count from sale_lines"


_ISSUES = [
    _issue("missing_column", "batch", "true"),
    *[_issue("missing_value", c, f"{c} is null or lower(trim({c}::varchar)) in ('', 'nan')") for c in ("sale_id", "line_no", "item_id", "vendor_id", "quantity", "amount", "discount", "flag")],
    *[_issue("numeric_out_of_range", c, f"{c} is not null and not isnan({c}::double) and not isinf({c}::double) and not {c} between {low} and {high}") for c, (low, high) in LINES.ranges.items()],
    *[_issue("non_finite_value", c, f"isinf({c}::double)") for c in LINES.ranges],
    _issue("unseen_category", "flag", "flag not in ('kept', 'returned')", "warning", "count(distinct flag) filter (flag not in ('kept', 'returned'))"),
    _issue("business_rule_violation", "discount", "discount > amount and not isnan(discount) and not isnan(amount)"),
]
LINE_QUALITY = f"select * from ({' union all '.join(_ISSUES)}) where count > 0"


def hours(s, d):
    """Clicks by the hour of the day, each click once, those without a time left out."""
    once = keep_first(table(s, d, "clicks").select("click_id", "ts", "arrived_at"), ["click_id"], [F.asc_nulls_last("ts"), "arrived_at"])
    return once.where("ts is not null").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def latest_changes(s, d):
    """The last change of each client; of equal times the higher sequence and id."""
    c = table(s, d, "client_changes").select("client_id", "change_id", "seq", "op", "valid_at")
    return keep_first(c, ["client_id"], [F.desc_nulls_last("valid_at"), F.desc_nulls_last("seq"), F.desc("change_id")]).select("client_id", "change_id", "op")


def best_items(s, d):
    """The ten items of most amount; lines without an item are none."""
    out = top_k(table(s, d, "sale_lines"), ["item_id"], F.col("amount").cast("decimal(18,2)"), "amount", 10)
    return out.select("item_id", F.col("amount").cast("double").alias("amount"))


def boxen(s, d):
    out = profile.letter_values(table(s, d, "sale_lines"), "flag", "amount")
    near = lambda c: (F.floor(F.col(c) * 10000 + 0.5) / 10000).alias(c)
    return out.where("depth <= 3").select("flag", "depth", near("low"), near("high"))


_Q = "case when x[floor({p})::bigint + 1] = x[ceil({p})::bigint + 1] then x[floor({p})::bigint + 1] else (ceil({p}) - {p}) * x[floor({p})::bigint + 1] + ({p} - floor({p})) * x[ceil({p})::bigint + 1] end"
BOXEN = f"""with v as (select flag, list_sort(list(amount)) x from sale_lines where amount is not null and not isnan(amount) and not isinf(amount) and flag is not null group by 1),
 t as (select flag, cast(d as int) depth, x, power(0.5, d + 1) * (len(x) - 1) lo, (1 - power(0.5, d + 1)) * (len(x) - 1) hi from v, range(1, 4) r(d) where d <= greatest(1, floor(log2(len(x))) - 3))
 select flag, depth, floor({_Q.format(p='lo')} * 10000 + 0.5) / 10000 low, floor({_Q.format(p='hi')} * 10000 + 0.5) / 10000 high from t"""


def day_first(s, d):
    """How many times of each source can be read as day, month, year and minutes."""
    spelled = F.replace(F.trim("raw"), F.lit("/"), F.lit("-"))
    read = day_first_time(F.when(spelled.rlike(r"^\d\d-\d\d-\d{4} \d\d:\d\d$"), spelled))
    return table(s, d, "stamps").withColumn("read", read).groupBy("source").agg(F.count("*").alias("n"), F.count("read").alias("n_read"), F.min("read").alias("first"), F.max("read").alias("last"))


_SPELLED = "replace(trim(raw, ' '), '/', '-')"
DAY_FIRST = f"select source, count(*) n, count(t) n_read, min(t) as first, max(t) as last from (select source, case when regexp_full_match({_SPELLED}, '\\d\\d-\\d\\d-\\d{{4}} \\d\\d:\\d\\d') then try_strptime({_SPELLED}, '%d-%m-%Y %H:%M') end t from stamps) group by 1"

ORDER = ["sold_at", "sale_id"]


def sales_drift(s, d):
    """The last fifth of the sales against the profile of the others; a sale without a time comes first."""
    sales = table(s, d, "sales").select("sale_id", "sold_at", "total", "priority", "status")
    first = up_to(sales, ORDER, last_of_share(sales, 0.8, ORDER))
    document = drift.profile_document(sales.where(first), ["total"], ["status", "priority"])
    return drift.against(document, sales.where(~first)).features.select("feature", *[F.round(c, 9).alias(c) for c in ("psi", "js_divergence", "unseen_category_rate", "missing_rate_delta", "standardized_mean_shift")])


_SPLIT = "(select *, row_number() over (order by sold_at nulls first, sale_id) <= floor(0.8 * count(*) over ()) early from sales)"
_CUTS = f"(select list_sort(list_distinct(quantile_cont(total, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) cuts from {_SPLIT} where early)"
_BIN = f"(select bin, count(v) n from (select unnest(range(len(cuts) + 1)) bin from {_CUTS}) left join (select total v, len(list_filter(cuts, lambda x: x <= total)) b from {_SPLIT}, {_CUTS} where total is not null and {{which}}) on b = bin group by 1)"
_PSI = "(select sum((a - e) * ln(a / e)) psi from (select greatest(e / sum(e) over (), 1e-6) e, greatest(a / sum(a) over (), 1e-6) a from {t}))"


def _category(c):
    t = f"(select coalesce({c}::varchar, '?') v, count(*) filter (early) e, count(*) filter (not early) a from {_SPLIT} group by 1)"
    js = f"(select sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2 js from (select e / sum(e) over () p, a / sum(a) over () q from {t}))"
    rates = f"(select sum(a) filter (e = 0 and v <> '?') / sum(a) u, coalesce(sum(a) filter (v = '?'), 0) / sum(a) - coalesce(sum(e) filter (v = '?'), 0) / sum(e) m from {t})"
    psi = _PSI.format(t=f"(select e, a from {t} where e > 0)")
    return f"select '{c}' feature, psi, js js_divergence, coalesce(u, 0) unseen_category_rate, m missing_rate_delta, null::double standardized_mean_shift from {psi}, {js}, {rates}"


_TOTAL = f"select 'total' feature, psi, null::double, null::double, m, z from {_PSI.format(t=f'(select e.n e, a.n a from {_BIN.format(which='early')} e join {_BIN.format(which='not early')} a using (bin))')}, (select avg(cast(total is null as double)) filter (not early) - avg(cast(total is null as double)) filter (early) m, abs(avg(total) filter (not early) - avg(total) filter (early)) / stddev_pop(total) filter (early) z from {_SPLIT})"
SALES_DRIFT = f"select feature, {', '.join(f'round({c}, 9) {c}' for c in ('psi', 'js_divergence', 'unseen_category_rate', 'missing_rate_delta', 'standardized_mean_shift'))} from ({_category('status')} union all {_category('priority')} union all {_TOTAL})"


def streamed_clicks(s, d):
    """Clicks read as a stream, repeated ones dropped by the stream's state; counted by day from what the sink was given."""
    schema = table(s, d, "clicks").schema
    home = fresh_dir(s, "clicks")
    # a pattern, as a stream's source may be a folder or match a file, but not be one
    clicks = s.readStream.schema(schema).parquet(f"{d}/clicks.parque[t]").select("click_id", "ts").where("ts is not null")
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")  # noqa: E731  a batch run again replaces itself
    run = windows.once(clicks, "click_id", late="4 days").writeStream.foreachBatch(sink).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return s.read.parquet(f"{home}/out").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


QUERIES = {
    "shop_line_quality": (line_quality, LINE_QUALITY),
    "shop_click_hours": (hours, "select cast(hour(ts) as int) as hour, count(*) n from (select click_id, min(ts) ts from clicks group by 1) where ts is not null group by 1"),
    "shop_latest_changes": (latest_changes, "select client_id, change_id, op from client_changes qualify row_number() over (partition by client_id order by valid_at desc nulls last, seq desc nulls last, change_id desc) = 1"),
    "shop_best_items": (best_items, "select item_id, sum(amount::decimal(18,2))::double amount from sale_lines where item_id is not null group by 1 order by 2 desc, 1 limit 10"),
    "shop_boxen": (boxen, BOXEN),
    "shop_day_first_times": (day_first, DAY_FIRST),
    "shop_sales_drift": (sales_drift, SALES_DRIFT),
    "shop_streamed_clicks": (streamed_clicks, "select strftime(ts, '%Y-%m-%d') as day, count(*) n from (select click_id, min(ts) ts from clicks where ts is not null group by 1) group by 1"),
}
