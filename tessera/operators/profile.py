"""Profiling: shares, quantiles, missing values, duplicates, correlation, outliers and imputation."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import finite, half_even, missing_as_null
from tessera.operators.tables import exact_quantiles, long_form, settled, small, spare


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) over the non-null values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def shares_within(df: DataFrame, group: str, column: str) -> DataFrame:
    """Each value's share of its group, rounded half to even at two digits, in per cent."""
    counts = df.where(F.col(group).isNotNull() & F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", half_even(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 2) * 100)


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """Exact count, mean, sample deviation, extremes and quartiles of each feature."""
    known = lambda c: missing_as_null(F.col(c).cast("double"))
    told = [F.struct(F.lit(c).alias("feature"), F.count(known(c)).alias("n"), F.avg(known(c)).alias("mean"), F.stddev_samp(known(c)).alias("std"), F.min(known(c)).alias("low"), F.max(known(c)).alias("high")) for c in features]
    out = df.agg(F.array(*told).alias("x")).select(F.inline("x"))
    out = out.join(F.broadcast(exact_quantiles(long_form(df, features), [0.25, 0.5, 0.75], scanned=True)), "feature", "left")  # a row for each feature
    return out.select("feature", "n", "mean", "std", "low", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "high")


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, n_missing, pct) by one aggregate over all columns."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(gone(c)).alias(c) for c in columns])
    return one.unpivot("__n", columns, "feature", "n_missing").select("feature", "n_missing", (F.col("n_missing") * 100 / F.nullif(F.col("__n"), F.lit(0))).alias("pct"))


def repeated_rows(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Rows equal to an earlier one in all the columns; `order` is unique.

    Equal rows are counted, and the first of them found, by an aggregate that is combined on the map side; only rows that
    have equals are looked up, by the print of their columns, so that a row repeated very often fills no window.
    """
    own, first = spare(df, "print"), spare(df, "first")
    printed = df.withColumn(own, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    heads = printed.groupBy(own).agg(F.min(order).alias(first), F.count("*").alias("n")).where("n > 1").drop("n")
    return printed.join(small(heads), own).where(F.col(order) > F.col(first)).drop(own, first)


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) of each pair, over the rows where both are known; NULL where one is constant."""
    cells = []
    for a, b in combinations_with_replacement(features, 2):
        x, y = missing_as_null(F.col(a).cast("double")), missing_as_null(F.col(b).cast("double"))
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias("r")))
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def _fences(rows: DataFrame, k: float) -> DataFrame:
    """(feature, low, high) of the finite values, from the exact quartiles."""
    q = exact_quantiles(rows, [0.25, 0.75], scanned=True)
    spread = F.col("q")[1] - F.col("q")[0]
    return q.select("feature", (F.col("q")[0] - k * spread).alias("low"), (F.col("q")[1] + k * spread).alias("high"))


def outlier_report(df: DataFrame, features: list[str], k: float = 1.5) -> DataFrame:
    """(feature, low, high, n, n_out, pct), the worst first in the caller's order; quantiles and counts take a job each."""
    rows = long_form(df, features).where(finite("value").isNotNull())
    fences = _fences(rows, k)
    out = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    counts = rows.join(F.broadcast(fences), "feature").groupBy("feature", "low", "high").agg(F.count("*").alias("n"), F.count_if(out).alias("n_out"))
    return counts.withColumn("pct", F.col("n_out") * 100 / F.col("n"))


def drop_outliers_in_turn(df: DataFrame, features: list[str], below_pct: float = 5.0, k: float = 1.5) -> DataFrame:
    """For each feature in turn: if 0 < outliers < below_pct per cent of the rows left, these rows go.

    Each feature's fences depend on the rows that the one before has left, so there is one aggregate for each, whose
    one row comes back as a literal filter; the plan stays a chain of filters over one scan.
    """
    for c in features:
        f = _fences(long_form(df, [c]), k).first()
        if f is None:
            continue
        inside = F.col(c).isNull() | F.col(c).between(f["low"], f["high"])
        n = df.agg(F.count("*").alias("n"), F.count_if(~inside).alias("out")).first()
        if n["n"] and 0 < n["out"] * 100 / n["n"] < below_pct:
            df = df.where(inside)
    return df


def impute_mean(df: DataFrame, columns: list[str], truncate: bool = True) -> DataFrame:
    """Missing values become the column's mean, then all are cut to integers."""
    means = df.agg(*[F.avg(missing_as_null(F.col(c).cast("double"))).alias(f"__m_{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(means))  # one row
    value = lambda c: F.coalesce(missing_as_null(F.col(c).cast("double")), F.col(f"__m_{c}"))
    return filled.withColumns({c: value(c).cast("int") if truncate else value(c) for c in columns}).drop(*[f"__m_{c}" for c in columns])


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the column's median, which is exact; a column without a value stays as it is."""
    medians = {r["feature"]: r["q"][0] for r in exact_quantiles(long_form(df, columns), [0.5]).collect()}  # a row for each column
    known = lambda c: missing_as_null(F.col(c).cast("double"))
    return df.withColumns({c: F.coalesce(known(c), F.lit(medians.get(c)).cast("double")) for c in columns})


def _by_class(df: DataFrame, by: str, column: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).select(F.col(by).alias("feature"), F.col(column).cast("double").alias("value"))


def box_summary(df: DataFrame, by: str, column: str, k: float = 1.5) -> DataFrame:
    """Five numbers and whiskers for each class: what a box plot draws."""
    values = _by_class(df, by, column)
    rows = values.join(small(exact_quantiles(values, [0.25, 0.5, 0.75], scanned=True)), "feature")
    v, spread = F.col("value"), F.col("q")[2] - F.col("q")[0]
    inside = v.between(F.col("q")[0] - k * spread, F.col("q")[2] + k * spread)
    out = rows.groupBy("feature").agg(F.any_value("q").alias("q"), F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("n_out"))
    return out.select(F.col("feature").alias(by), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "whisker_low", "whisker_high", "n_out")


def letter_values(df: DataFrame, by: str, column: str) -> DataFrame:
    """(class, depth, tail, low, high, n_out): what a boxen plot draws.

    Depth 1 is the box of the quartiles, and each depth halves the tail of the one before. A class of n values has
    floor(log2(n)) - 3 depths, but at least one, so that the last tail still holds some values. n_out counts the values
    outside the last box. The quantiles of all classes and depths come from one ranking.
    """
    values = _by_class(df, by, column).where(finite("value").isNotNull())
    sizes = values.groupBy("feature").agg(F.count("*").alias("n")).withColumn("depths", F.greatest(F.lit(1), (F.floor(F.log2("n")) - 3).cast("int")))
    deepest = sizes.agg(F.max("depths")).first()[0] or 1
    tails = [0.5 ** (d + 1) for d in range(1, deepest + 1)]
    q = exact_quantiles(values, [*tails, *[1 - t for t in tails]], scanned=True)
    boxes = F.transform(F.sequence(F.lit(1), "depths"), lambda d: F.struct(d.alias("depth"), F.pow(F.lit(0.5), d + 1).alias("tail"), F.element_at("q", d).alias("low"), F.element_at("q", d + deepest).alias("high")))
    drawn = settled(sizes.join(q, "feature").select("feature", boxes.alias("boxes"), F.element_at(boxes, F.col("depths")).alias("last")))
    # rows meet two numbers of their class; the boxes join the counts alone
    fences = small(drawn.select("feature", F.col("last.low").alias("__low"), F.col("last.high").alias("__high")))
    out = values.join(fences, "feature").groupBy("feature").agg(F.count_if((F.col("value") < F.col("__low")) | (F.col("value") > F.col("__high"))).alias("n_out"))
    return out.join(small(drawn.select("feature", "boxes")), "feature").select(F.col("feature").alias(by), "n_out", F.inline("boxes")).select(by, "depth", "tail", "low", "high", "n_out")
