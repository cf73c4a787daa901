"""Profiling, imputation and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import half_even, row_sum, truncate_int
from tessera.operators import profile as p
from tessera.operators import tables as t
from tessera.plans.fixtures import table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def survey(s, d):
    """Line items with some values missing."""
    return table(s, d, "lineitem").withColumns({"l_quantity": F.when(F.col("l_partkey") % 17 != 0, F.col("l_quantity")), "l_discount": F.when(F.col("l_suppkey") % 7 != 0, F.col("l_discount"))})


SURVEY = "(select * replace (case when l_partkey % 17 <> 0 then l_quantity end as l_quantity, case when l_suppkey % 7 <> 0 then l_discount end as l_discount) from lineitem)"


def group_share(s, d):
    return p.shares_within(table(s, d, "lineitem"), "l_returnflag", "l_linestatus").select("l_returnflag", "l_linestatus", "n", F.round("pct", 6).alias("pct"))


def shares(s, d):
    return p.value_shares(table(s, d, "events"), "event_type").select("value", "n", F.round("share", 9).alias("share"))


AGE_EDGES = [18, 25, 35, 45, 60, 75]


def brackets(s, d):
    rows = table(s, d, "customer").select((F.col("c_custkey") % 80 + 10).alias("age"))
    counts = rows.select(t.interval_label("age", AGE_EDGES).alias("bracket")).where("bracket is not null").groupBy("bracket").agg(F.count("*").alias("n"))
    every = s.createDataFrame([(f"({a:g}, {b:g}]",) for a, b in zip(AGE_EDGES, AGE_EDGES[1:], strict=False)], "bracket string")
    return every.join(counts, "bracket", "left").select("bracket", F.coalesce("n", F.lit(0)).alias("n"))


def missing(s, d):
    return p.missing_profile(survey(s, d), LINE).select("feature", "n_missing", F.round("pct", 6).alias("pct"))


def described(s, d):
    out = p.describe(survey(s, d), LINE)
    return out.select("feature", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mean", "std", "low", "q1", "median", "q3", "high")])


def duplicates(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", "lang")
    return p.repeated_rows(docs, "doc_id", ["text", "lang"]).select("doc_id", "lang")


def correlation(s, d):
    return p.correlations(survey(s, d).withColumn("constant", F.lit(1.0)), [*LINE, "constant"]).select("a", "b", F.round("r", 6).alias("r"))


OUT = ["l_extendedprice", "l_quantity", "l_discount"]


def wide(s, d):
    """Prices squared, so that there are outliers."""
    return table(s, d, "lineitem").withColumns({"l_extendedprice": F.round(F.col("l_extendedprice") * F.col("l_extendedprice") / 1000, 2), "l_quantity": F.round(F.col("l_quantity") * F.col("l_quantity"), 2)})


WIDE = "(select * replace (round(l_extendedprice * l_extendedprice / 1000, 2) as l_extendedprice, round(l_quantity * l_quantity, 2) as l_quantity) from lineitem)"


def iqr_report(s, d):
    r = p.outlier_report(wide(s, d), OUT)
    return r.select("feature", (F.round("low", 2) + 0.0).alias("low"), (F.round("high", 2) + 0.0).alias("high"), "n", "n_out", F.round("pct", 6).alias("pct")).orderBy(F.desc("pct"), "feature")


def _report_sql(c):
    return f"select '{c}' feature, low, high, count({c}) n, count(*) filter ({c} < low or {c} > high) n_out from w, (select q[1] - 1.5 * (q[2] - q[1]) low, q[2] + 1.5 * (q[2] - q[1]) high from (select quantile_cont({c}, [0.25, 0.75]) q from w)) group by all"


IQR_REPORT = f"with w as (select * from {WIDE}) select feature, round(low, 2) + 0.0 low, round(high, 2) + 0.0 high, n, n_out, round(n_out * 100 / n, 6) pct from ({' union all '.join(map(_report_sql, OUT))}) order by pct desc, feature"


def iqr_sequential(s, d):
    return p.drop_outliers_in_turn(wide(s, d), OUT).select(*KEY)


def _sequential_sql():
    steps, last = [f"w0 as (select * from {WIDE})"], "w0"
    for i, c in enumerate(OUT, 1):
        steps.append(f"f{i} as (select q[1] - 1.5 * (q[2] - q[1]) low, q[2] + 1.5 * (q[2] - q[1]) high from (select quantile_cont({c}, [0.25, 0.75]) q from {last}))")
        steps.append(f"p{i} as (select count(*) filter ({c} < low or {c} > high) * 100.0 / count(*) pct from {last}, f{i})")
        steps.append(f"w{i} as (select {last}.* from {last}, f{i}, p{i} where not (pct > 0 and pct < 5) or {c} between low and high)")
        last = f"w{i}"
    return f"with {', '.join(steps)} select {', '.join(KEY)} from {last}"


def mean_impute(s, d):
    cols = ["l_quantity", "l_discount"]
    return p.impute_mean(survey(s, d), cols).select(*KEY, *cols)


MEAN_IMPUTE = f"select {', '.join(KEY)}, cast(trunc(coalesce(l_quantity, (select avg(l_quantity) from {SURVEY}))) as int) l_quantity, cast(trunc(coalesce(l_discount, (select avg(l_discount) from {SURVEY}))) as int) l_discount from {SURVEY}"


def median_impute(s, d):
    return p.impute_median(survey(s, d), ["l_quantity"]).select(*KEY, "l_quantity")


def sum_features(s, d):
    rows = survey(s, d)
    return rows.select(*KEY, F.round(row_sum("l_quantity", "l_discount", "l_tax"), 6).alias("total"))


def box(s, d):
    out = p.box_summary(wide(s, d), "l_returnflag", "l_extendedprice")
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "n_out")


BOX = f"with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.5) median, quantile_cont(l_extendedprice, 0.75) q3 from {WIDE} group by 1) select l_returnflag, round(any_value(q1), 4) q1, round(any_value(median), 4) median, round(any_value(q3), 4) q3, round(min(l_extendedprice) filter (l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) whisker_low, round(max(l_extendedprice) filter (l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) whisker_high, count(*) filter (not l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) n_out from {WIDE} join q using (l_returnflag) group by 1"


def letters(s, d):
    out = p.letter_values(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice")
    # tails are powers of two, so that values often lie on the edge of a rounding, where engines part
    near = lambda c: (F.floor(F.col(c) * 10000 + 0.5) / 10000).alias(c)
    return out.select("l_returnflag", "depth", "tail", near("low"), near("high"), "n_out")


LETTERS = """with n as (select l_returnflag f, count(*) n, greatest(1, cast(floor(log2(count(*))) as int) - 3) k from lineitem group by 1),
 b as (select f, k, cast(d as int) depth, power(0.5, d + 1) tail from n, range(1, 40) r(d) where d <= k),
 v as (select f, k, depth, tail, list_sort(list(l_extendedprice)) x from b join lineitem on l_returnflag = f group by all),
 p as (select *, tail * (len(x) - 1) lo, (1 - tail) * (len(x) - 1) hi from v),
 q as (select f, k, depth, tail, x, case when x[floor(lo)::bigint + 1] = x[ceil(lo)::bigint + 1] then x[floor(lo)::bigint + 1] else (ceil(lo) - lo) * x[floor(lo)::bigint + 1] + (lo - floor(lo)) * x[ceil(lo)::bigint + 1] end low, case when x[floor(hi)::bigint + 1] = x[ceil(hi)::bigint + 1] then x[floor(hi)::bigint + 1] else (ceil(hi) - hi) * x[floor(hi)::bigint + 1] + (hi - floor(hi)) * x[ceil(hi)::bigint + 1] end high from p),
 o as (select f, len(list_filter(x, lambda y: y < low or y > high)) n_out from q where depth = k)
 select f l_returnflag, depth, tail, floor(low * 10000 + 0.5) / 10000 low, floor(high * 10000 + 0.5) / 10000 high, n_out from q join o using (f)"""


def scalar_stats(s, d):
    e = table(s, d, "events")
    q = t.exact_quantiles(t.long_form(e, ["value"]), [0.5, 0.9]).select(F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("p90"))
    return e.agg(F.round(F.avg("value"), 6).alias("mean"), F.mode("event_type", True).alias("mode"), F.round(F.stddev_pop("value"), 6).alias("std0")).crossJoin(q)  # one row each


SCALARS = "select round(avg(value), 6) mean, round(median(value), 6) median, (select event_type from events group by 1 order by count(*) desc, 1 limit 1) mode, round(stddev_pop(value), 6) std0, round(quantile_cont(value, 0.9), 6) p90 from events"


def rounding(s, d):
    return table(s, d, "lineitem").select(*KEY, half_even(F.col("l_quantity") / 8, 2).alias("half_even"), truncate_int(F.col("l_extendedprice") / 7).alias("whole"))


def value_counts(s, d):
    return table(s, d, "orders").where("o_orderpriority is not null").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority")


_described = " union all ".join(f"select '{c}' feature, count({c}) n, avg({c}) mean, stddev_samp({c}) std, min({c}) low, quantile_cont({c}, 0.25) q1, median({c}) median, quantile_cont({c}, 0.75) q3, max({c}) high from {SURVEY}" for c in LINE)
_corr = " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) r from v" if "constant" not in (a, b) else f"select '{a}', '{b}', null::double" for i, a in enumerate([*LINE, "constant"]) for b in [*LINE, "constant"][i:])

QUERIES = {
    "group_share_within": (group_share, "select l_returnflag, l_linestatus, n, round(round_even(n / sum(n) over (partition by l_returnflag), 2) * 100, 6) pct from (select l_returnflag, l_linestatus, count(*) n from lineitem group by all)"),
    "value_shares": (shares, "select event_type as value, count(*) n, round(count(*) / sum(count(*)) over (), 9) share from events group by 1"),
    "age_brackets": (brackets, "select b bracket, count(age) n from (values " + ", ".join(f"('({a}, {b}]', {a}, {b})" for a, b in zip(AGE_EDGES, AGE_EDGES[1:], strict=False)) + ") e(b, lo, hi) left join (select c_custkey % 80 + 10 age from customer) on age > lo and age <= hi group by 1"),
    "missing_profile": (missing, " union all ".join(f"select '{c}' feature, count(*) - count({c}) n_missing, round((count(*) - count({c})) * 100 / count(*), 6) pct from {SURVEY}" for c in LINE)),
    "describe_numeric": (described, f"select feature, n, {', '.join(f'round({c}, 4) + 0.0 {c}' for c in ('mean', 'std', 'low', 'q1', 'median', 'q3', 'high'))} from ({_described})"),
    "duplicate_rows": (duplicates, "select doc_id, lang from (select doc_id, lang, row_number() over (partition by text, lang order by doc_id) n from documents) where n > 1"),
    "corr_matrix": (correlation, f"with v as (select * from {SURVEY}) {_corr}"),
    "iqr_outlier_report": (iqr_report, IQR_REPORT),
    "iqr_sequential_filter": (iqr_sequential, _sequential_sql()),
    "mean_impute_truncate": (mean_impute, MEAN_IMPUTE),
    "median_impute": (median_impute, f"select {', '.join(KEY)}, coalesce(l_quantity, (select median(l_quantity) from {SURVEY})) l_quantity from {SURVEY}"),
    "sum_features": (sum_features, f"select {', '.join(KEY)}, round(coalesce(l_quantity, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0), 6) total from {SURVEY}"),
    "box_summary": (box, BOX),
    "letter_values": (letters, LETTERS),
    "scalar_stats": (scalar_stats, SCALARS),
    "rounding_modes": (rounding, f"select {', '.join(KEY)}, round_even(l_quantity / 8, 2) half_even, cast(trunc(l_extendedprice / 7) as int) whole from lineitem"),
    "value_counts": (value_counts, "select o_orderpriority, count(*) n from orders where o_orderpriority is not null group by 1 order by 2 desc, 1"),
}
