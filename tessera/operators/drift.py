"""Population drift: profiles of a training population, and the drift of a later one against a stored profile.

A profile document holds, for each feature, all that drift needs of the training rows: deciles and bin shares of numbers,
shares of categories. Rows to be compared are read once: each row gives a cell (a bin, a category) for each feature, cells
are counted with a partial aggregate, and everything else is arithmetic on a few rows for each feature. All of it is
JVM-side.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import canonical_category, finite, status, status_name, to_number
from tessera.operators.tables import exact_quantiles, long_form, settled

MISSING, UNSEEN = "__MISSING__", "__UNSEEN__"
FLOOR = 1e-6
#: Names under which predictions and their confidence go through the same counts as features.
LABEL, CONFIDENCE, LOW, PRESENT = "__label__", "__confidence__", "__low__", "__present__"


@dataclass(frozen=True)
class Thresholds:
    """Where a status becomes a warning, and where critical."""

    psi_warning: float = 0.10
    psi_critical: float = 0.25
    js_warning: float = 0.10
    js_critical: float = 0.20
    missing_delta_warning: float = 0.02
    missing_delta_critical: float = 0.05
    unseen_rate_warning: float = 0.01
    unseen_rate_critical: float = 0.05
    standardized_mean_warning: float = 0.25
    standardized_mean_critical: float = 0.50
    confidence_delta_warning: float = 0.05
    confidence_delta_critical: float = 0.10

    def rank(self, name: str, value: Column) -> Column:
        """0, 1 or 2; an unknown value is no drift."""
        return status(F.coalesce(value, F.lit(0.0)), getattr(self, f"{name}_warning"), getattr(self, f"{name}_critical"))


def numeric_profile(df: DataFrame, features: list[str], digits: int | None = None) -> DataFrame:
    """Per feature: missing rate, moments and the sorted distinct deciles as cut points; all features go together."""
    v = finite("value")
    rows = long_form(df, features)
    out = rows.groupBy("feature").agg(F.count("*").alias("n"), F.count(v).alias("known"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    q = exact_quantiles(rows.withColumn("value", v), [i / 10 for i in range(1, 10)], scanned=True)
    out = out.join(F.broadcast(q), "feature", "left").withColumn("median", F.col("q")[4])  # a row for each feature
    out = out.withColumn("cuts", F.transform("q", lambda x: F.round(x, digits)) if digits is not None else F.col("q")).drop("q")
    empty = F.array().cast("array<double>")
    return out.withColumn("missing_rate", 1 - F.col("known") / F.col("n")).withColumn("cuts", F.coalesce(F.array_sort(F.array_distinct("cuts")), empty))


def histogram(df: DataFrame, features: list[str], profiles: DataFrame) -> DataFrame:
    """(feature, bin, n, share) over the profiles' cut points, empty bins included; a bin counts the cuts up to the value."""
    rows = long_form(df, features).where(finite("value").isNotNull()).join(F.broadcast(profiles.select("feature", "cuts")), "feature")
    counts = rows.groupBy("feature", F.size(F.filter("cuts", lambda c: c <= F.col("value"))).alias("bin")).agg(F.count("*").alias("n"))
    bins = profiles.select("feature", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("bin"))
    full = bins.join(counts, ["feature", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = full.groupBy("feature").agg(F.sum("n").alias("total"), F.count("*").alias("bins"))
    share = F.coalesce(F.col("n") / F.nullif(F.col("total"), F.lit(0)), F.when(F.col("bins") == 1, 1.0).otherwise(0.0))
    return full.join(totals, "feature").select("feature", "bin", "n", share.alias("share"))


def psi(expected: DataFrame, actual: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, psi) of two share tables; shares are normalised (uniform without mass) and floored, not normalised again."""
    e, a = expected.select(*keys, F.col("share").alias("e")), actual.select(*keys, F.col("share").alias("a"))
    both = e.join(a, keys, "left").withColumn("a", F.coalesce("a", F.lit(0.0)))
    totals = both.groupBy(*by).agg(F.sum("e").alias("te"), F.sum("a").alias("ta"), F.count("*").alias("k"))
    part = lambda x, t: F.greatest(F.when(F.col(t) > 0, F.col(x) / F.nullif(F.col(t), F.lit(0.0))).otherwise(1 / F.col("k")), F.lit(FLOOR))
    p = both.join(totals, by).select(*by, part("e", "te").alias("e"), part("a", "ta").alias("a"))
    return p.groupBy(*by).agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))


def jensen_shannon(p: DataFrame, q: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, js) of two share tables over the union of their labels, natural logarithm."""
    both = p.select(*keys, F.col("share").alias("p")).join(q.select(*keys, F.col("share").alias("q")), keys, "full").fillna(0.0, ["p", "q"])
    totals = both.groupBy(*by).agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    n = both.join(totals, by).select(*by, (F.col("p") / F.nullif(F.col("tp"), F.lit(0.0))).alias("p"), (F.col("q") / F.nullif(F.col("tq"), F.lit(0.0))).alias("q"))
    m = F.greatest((F.col("p") + F.col("q")) / 2, F.lit(1e-12))
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)
    return n.groupBy(*by).agg((F.sum(term("p")) / 2 + F.sum(term("q")) / 2).alias("js"))


def categorical_shares(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, n, share), missing values as a value of their own."""
    counts = df.select(*[category(df, c).alias(c) for c in features]).unpivot([], features, "feature", "value").groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy("feature").agg(F.sum("n").alias("t")), "feature").select("feature", "value", "n", (F.col("n") / F.col("t")).alias("share"))


def categorical_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: missing rate, shares as a map sorted by value, known categories."""
    s = categorical_shares(df, features)
    out = s.groupBy("feature").agg(F.sum(F.when(F.col("value") == MISSING, F.col("share")).otherwise(0.0)).alias("missing_rate"), F.array_sort(F.collect_list(F.struct("value", "share"))).alias("d"))
    known = F.filter(F.transform("d", lambda x: x["value"]), lambda v: v != MISSING)
    return out.select("feature", "missing_rate", F.map_from_entries("d").alias("distribution"), known.alias("known"))


def category(df: DataFrame, c: str) -> Column:
    """The category of a value: whole numbers without a point, texts trimmed; blanks and NaN are missing."""
    kind = dict(df.dtypes)[c]
    number = kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))
    value = F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) if kind in ("float", "double") else F.col(c)
    text = canonical_category(value, kind) if number else F.trim(F.col(c).cast("string"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(MISSING))


def number_of(df: DataFrame, c: str) -> Column:
    return to_number(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double")


def cells(df: DataFrame, cuts: dict[str, list[float]], categories: dict[str, Column], low: Column | None = None, present: Column | None = None) -> DataFrame:
    """(feature, cell, n, total) of one pass: numbers by the bin that their cut points make, categories by value."""
    rows = []
    for c, edges in cuts.items():
        v = finite(number_of(df, c))
        at = sum((F.when(v >= float(e), 1).otherwise(0) for e in edges), F.lit(0))  # the cuts up to the value
        rows.append(F.struct(F.lit(c).alias("feature"), F.when(v.isNull(), MISSING).otherwise(at.cast("string")).alias("cell"), v.alias("v")))
    none = F.lit(None).cast("double").alias("v")
    rows += [F.struct(F.lit(c).alias("feature"), value.alias("cell"), none) for c, value in categories.items()]
    if low is not None:
        rows.append(F.struct(F.lit(LOW).alias("feature"), low.cast("string").alias("cell"), none))
    if not rows:
        return df.sparkSession.createDataFrame([], "feature string, cell string, n long, total double")
    every = F.array(*rows)
    if present is not None:  # names of features that the row has
        every = F.concat(every, F.transform(present, lambda k: F.struct(F.lit(PRESENT).alias("feature"), k.alias("cell"), none)))
    return df.select(F.inline(every)).groupBy("feature", "cell").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def _number_profiles(df: DataFrame, features: list[str]) -> dict[str, dict]:
    """Profiles as the document holds them; bins are counted in one pass over all features."""
    if not features:
        return {}
    df = df.select(*[number_of(df, c).alias(c) for c in features])
    rows = {r["feature"]: r for r in numeric_profile(df, features).collect()}  # a row for each feature
    cuts = {c: list(rows[c]["cuts"]) if c in rows else [] for c in features}
    counted = {(r["feature"], r["cell"]): r["n"] for r in cells(df, cuts, {}).collect()}  # at most ten bins a feature
    out = {}
    for c in features:
        r, n = rows.get(c), [counted.get((c, str(k)), 0) for k in range(len(cuts[c]) + 1)]
        names = {"mean": "mean", "std": "std", "minimum": "low", "maximum": "high", "median": "median"}
        shares = [x / sum(n) for x in n] if sum(n) else [1.0] if not cuts[c] else [0.0] * len(n)
        out[c] = {"type": "numeric", "missing_rate": r["missing_rate"] if r else 1.0} | {k: r[v] if r else None for k, v in names.items()} | {"cut_points": cuts[c], "bin_proportions": shares}
    return out


def _category_profiles(df: DataFrame, features: list[str]) -> dict[str, dict]:
    if not features:
        return {}
    found = {r["feature"]: r for r in categorical_profile(df, features).collect()}  # what the document holds
    return {c: {"type": "categorical", "missing_rate": found[c]["missing_rate"], "distribution": dict(sorted(found[c]["distribution"].items())), "known_categories": sorted(found[c]["known"])} for c in features}


def profile_document(df: DataFrame, numeric: list[str], categories: list[str]) -> dict:
    """feature_profiles of a training population; its size follows the features and their categories, not the rows."""
    return {"feature_profiles": _number_profiles(df, numeric) | _category_profiles(df, categories)}


def prediction_profile(df: DataFrame, label: str, confidence: str, low: float = 0.5) -> dict:
    one = df.agg(F.avg(confidence).alias("m"), F.avg((F.col(confidence) < low).cast("double")).alias("l")).first()
    classes = _category_profiles(df, [label])[label]["distribution"]
    return {"class_distribution": classes, "confidence": _number_profiles(df, [confidence])[confidence], "mean_max_probability": one["m"], "low_confidence_rate": one["l"]}


METRICS = "feature string, type string, n long, psi double, js_divergence double, unseen_category_rate double, missing_rate_baseline double, missing_rate_current double, missing_rate_delta double, mean_baseline double, mean_current double, standardized_mean_shift double"


def _known_cells(spark: SparkSession, profiles: dict[str, dict]) -> DataFrame:
    """(feature, cell, share, place) of a document; as many rows as it has bins and categories."""
    rows = []
    for c, p in profiles.items():
        shares = {str(k): x for k, x in enumerate(p["bin_proportions"])} if p["type"] == "numeric" else p["distribution"]
        rows += [(c, cell, float(x)) for cell, x in shares.items()]
    return spark.createDataFrame(rows, "feature string, cell string, share double")


def placed(counts: DataFrame, profiles: dict[str, dict]) -> DataFrame:
    """(feature, cell, n, total, share): the counts beside the profiles' cells, computed once.

    What is unseen is one cell: its cells have no share in the profile, and their divergence adds up. So the table is no
    longer than the document, however many values the rows have.
    """
    both = counts.join(F.broadcast(_known_cells(counts.sparkSession, profiles)), ["feature", "cell"], "full")
    kept = F.col("share").isNotNull() | (F.col("cell") == MISSING) | F.col("feature").isin(LOW, PRESENT)
    own = both.groupBy("feature", F.when(kept, F.col("cell")).otherwise(UNSEEN).alias("cell"))
    return settled(own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"), F.max("share").alias("share")))


def metrics(cells_: DataFrame, profiles: dict[str, dict]) -> DataFrame:
    """One row for each feature of the profiles, with the columns of METRICS, from what `placed` gives."""
    spark = cells_.sparkSession
    told = [(c, p["type"], float(p["missing_rate"]), p.get("mean"), p.get("std")) for c, p in profiles.items()]
    about = F.broadcast(spark.createDataFrame(told, "feature string, type string, missing_rate_baseline double, mean_baseline double, std double"))
    by = Window.partitionBy("feature")  # no more cells than the document has
    rows = cells_.join(about, "feature").withColumn("e", F.coalesce("share", F.lit(0.0)))
    # bins are the cells that the profile has; a class that it lacks, and what is missing, has no bin
    binned, number = F.col("share").isNotNull(), F.col("type") == "numeric"
    rows = rows.withColumns({"records": F.sum("n").over(by), "in_bins": F.sum(F.when(binned, F.col("n")).otherwise(0)).over(by), "mass": F.sum("e").over(by), "bins": F.sum(binned.cast("int")).over(by)})
    over = lambda x, t: F.col(x) / F.nullif(F.col(t).cast("double"), F.lit(0.0))
    # shares on either side are normalised alike, so that equal ones stay equal to the last digit
    rows = rows.withColumn("s", F.when(binned, F.coalesce(over("n", "in_bins"), F.lit(0.0)))).withColumn("s_mass", F.sum("s").over(by))
    e, a = (F.greatest(F.coalesce(over(x, t), 1 / F.col("bins")), F.lit(FLOOR)) for x, t in (("e", "mass"), ("s", "s_mass")))
    p, q = (F.coalesce(over(x, t), F.lit(0.0)) for x, t in (("e", "mass"), ("n", "records")))
    middle = F.greatest((p + q) / 2, F.lit(1e-12))
    term = lambda x: F.when(x > 0, x * F.ln(x / middle)).otherwise(0.0)
    rate = lambda cell: F.coalesce(F.sum(F.when(F.col("cell") == cell, over("n", "records"))), F.lit(0.0))
    out = rows.groupBy("feature", "type", "missing_rate_baseline", "mean_baseline", "std").agg(
        F.max("records").alias("n"), F.sum(F.when(binned, (a - e) * F.ln(a / e))).alias("psi"), F.when(~number, F.sum(term(p) + term(q)) / 2).alias("js_divergence"),
        F.when(~number, rate(UNSEEN)).alias("unseen_category_rate"), rate(MISSING).alias("missing_rate_current"), (F.sum("total") / F.nullif(F.max("in_bins").cast("double"), F.lit(0.0))).alias("mean_current"),
    )
    scale = F.when(F.col("std") > 1e-12, F.col("std")).otherwise(1.0)
    full = out.withColumns({"missing_rate_delta": F.col("missing_rate_current") - F.col("missing_rate_baseline"), "standardized_mean_shift": F.abs(F.col("mean_current") - F.col("mean_baseline")) / scale})
    return full.select(*[c.split()[0] for c in METRICS.split(", ")])


def feature_ranks(found: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Metrics with the rank of the worst of them."""
    number = F.greatest(t.rank("psi", F.col("psi")), t.rank("standardized_mean", F.col("standardized_mean_shift")))
    other = F.greatest(t.rank("js", F.col("js_divergence")), t.rank("unseen_rate", F.col("unseen_category_rate")))
    own = F.when(F.col("type") == "numeric", number).otherwise(other)
    return found.withColumn("rank", F.greatest(own, t.rank("missing_delta", F.abs("missing_rate_delta"))))


@dataclass(frozen=True)
class Drift:
    """What one pass over the rows has found: feature rows with ranks, and one row about the predictions (if asked)."""

    features: DataFrame
    predictions: DataFrame | None
    records: DataFrame


def against(document: dict, current: DataFrame, label: str | None = None, confidence: str | None = None, low: float = 0.5, thresholds: Thresholds = Thresholds(), keys: str | None = None) -> Drift:
    """The drift of rows against a profile document. The rows are scanned once.

    A feature of the document that the rows lack is critical; where rows come from records, `keys` is the column of names
    that each record has, and a feature is lacking if no record has it. Where `label` and `confidence` are given, the document's
    prediction_profile is compared too.
    """
    spark, t = current.sparkSession, thresholds
    profiles = dict(document["feature_profiles"])
    there = {c: p for c, p in profiles.items() if c in current.columns}
    cuts = {c: p["cut_points"] for c, p in there.items() if p["type"] == "numeric"}
    kinds = {c: category(current, c) for c, p in there.items() if p["type"] != "numeric"}
    low_ = None
    if label:
        about = document["prediction_profile"]
        current = current.withColumn(CONFIDENCE, F.col(confidence).cast("double"))
        cuts[CONFIDENCE], kinds[LABEL], low_ = about["confidence"]["cut_points"], category(current, label), F.col(CONFIDENCE) < low
        there |= {CONFIDENCE: about["confidence"], LABEL: {"type": "categorical", "missing_rate": 0.0, "distribution": about["class_distribution"]}}
    present = None if keys is None else F.array_intersect(F.coalesce(F.col(keys), F.array().cast("array<string>")), F.array(*[F.lit(c) for c in profiles]).cast("array<string>"))
    counted = placed(cells(current, cuts, kinds, low_, present), there)
    if keys is not None:
        seen = {r["cell"] for r in counted.where(F.col("feature") == PRESENT).collect()}  # names that the document has
        there = {c: p for c, p in there.items() if c in seen or c not in profiles}
    found = feature_ranks(metrics(counted, there), t)
    gone = spark.createDataFrame([(c, p["type"]) for c, p in profiles.items() if c not in there], "feature string, type string")
    features = found.where(~F.col("feature").isin(CONFIDENCE, LABEL)).unionByName(gone.withColumn("rank", F.lit(2)), allowMissingColumns=True)
    absent = F.when(F.col("feature").isin([c for c in profiles if c not in there]), "feature_missing_from_production_telemetry")
    features = features.withColumns({"status": status_name(F.col("rank")), "error": absent})
    every = [*cuts, *kinds]
    records = counted.where(F.col("feature") == every[0]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records")) if every else current.agg(F.count("*").alias("records"))
    if not label:
        return Drift(features, None, records)
    low_rows = counted.where((F.col("feature") == LOW) & F.col("cell").isNotNull())
    share = low_rows.agg((F.sum(F.when(F.col("cell") == "true", F.col("n")).otherwise(0)) / F.sum("n")).alias("low_confidence_rate"))
    one = lambda name: found.where(F.col("feature") == name)
    sure = one(CONFIDENCE).select(F.col("psi").alias("confidence_psi"), F.col("mean_current").alias("mean_confidence"), (F.col("mean_current") - F.lit(about["mean_max_probability"])).alias("mean_delta"), F.col("rank").alias("confidence_rank"))
    said = one(LABEL).select(F.col("js_divergence").alias("class_js"), F.col("psi").alias("class_psi")).crossJoin(sure).crossJoin(share)  # one row each
    ranks = F.greatest(t.rank("js", F.col("class_js")), t.rank("psi", F.col("class_psi")), t.rank("confidence_delta", F.abs("mean_delta")), "confidence_rank")
    return Drift(features, said.withColumns({"confidence_delta": F.abs("mean_delta"), "rank": ranks}).drop("confidence_rank"), records)


def numeric_drift(baseline: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """Drift of numbers between two tables: metrics and ranks."""
    return against(profile_document(baseline, features, []), current).features


def categorical_drift(baseline: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """Drift of categories between two tables: metrics and ranks."""
    return against(profile_document(baseline, [], features), current).features


def prediction_drift(baseline: DataFrame, current: DataFrame, label: str, confidence: str, low: float = 0.5) -> DataFrame:
    """One row: class js and psi (over the baseline's classes), confidence delta and psi, low-confidence rate, rank."""
    document = {"feature_profiles": {}, "prediction_profile": prediction_profile(baseline, label, confidence, low)}
    return against(document, current, label, confidence, low).predictions


def report(features: DataFrame, expected: list[str]) -> DataFrame:
    """(feature, rank, status) of every baseline feature; one that the current data lack is critical."""
    spark = features.sparkSession
    names = spark.createDataFrame([(f,) for f in expected], "feature string")
    out = names.join(features.select("feature", "rank"), "feature", "left").withColumn("rank", F.coalesce("rank", F.lit(2)))
    return out.withColumn("status", status_name(F.col("rank")))


def listed(rows: DataFrame, name: str) -> DataFrame:
    """One row: a sorted list of the few rows given."""
    return rows.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name))


def roll_up(ranks: DataFrame) -> DataFrame:
    """One row: the worst status and how many features have each."""
    counts = [F.count_if(F.col("rank") == r).alias(n) for r, n in enumerate(("n_ok", "n_warning", "n_critical"))]
    return ranks.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("rank"), *counts).select(status_name(F.col("rank")).alias("overall"), "n_ok", "n_warning", "n_critical")


def gate(overall: DataFrame, records: DataFrame, minimum: int = 100) -> DataFrame:
    """The overall status, or insufficient_data under the minimum of records, with the exit code of a job; both tables
    have one row."""
    said = F.when(F.col("records") < minimum, "insufficient_data").otherwise(F.col("overall"))
    out = overall.crossJoin(records.select("records")).withColumn("result", said)  # one row each
    return out.withColumn("exit_code", F.when(F.col("result") == "insufficient_data", 3).when(F.col("result") == "critical", 2).otherwise(0))


def report_row(found: Drift, document: dict, start: Column, end: Column, minimum: int = 100, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row: model_id, artifact, window, record_count, overall_status, summary, thresholds, feature_drift and
    prediction_drift. Under the minimum of records nothing is told but that they are too few."""
    lists = found.features.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("feature_drift"), F.max("rank").alias("worst"), F.count_if(F.col("rank") == 1).alias("warning_features"), F.count_if(F.col("rank") == 2).alias("critical_features"))
    said = found.predictions.select(F.col("rank").alias("said"), F.struct("*").alias("prediction_drift")) if found.predictions is not None else found.records.select(F.lit(0).alias("said"))
    rows = lists.crossJoin(said).crossJoin(found.records)  # one row each
    enough = F.col("records") >= minimum
    told = lambda c: F.when(enough, c)
    text = lambda key: F.lit(document.get(key)).cast("string")
    summary = F.struct(told(F.col("warning_features")).alias("warning_features"), told(F.col("critical_features")).alias("critical_features"), told(status_name(F.col("said"))).alias("prediction_status"), F.when(~enough, "Not enough telemetry records for reliable drift metrics").alias("message"))
    drifts = [told(F.col(c)).alias(c) for c in ("feature_drift", "prediction_drift") if c in rows.columns]
    return rows.select(
        F.lit(1).alias("schema_version"), F.current_timestamp().alias("generated_at"), text("model_id").alias("model_id"), text("artifact_sha256").alias("artifact"), text("created_at").alias("baseline_created_at"), start.alias("window_start"), end.alias("window_end"),
        F.col("records").alias("record_count"), F.lit(minimum).alias("minimum_records"), F.when(enough, status_name(F.greatest("worst", "said"))).otherwise("insufficient_data").alias("overall_status"),
        summary.alias("summary"), F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in asdict(thresholds).items()])).alias("thresholds"), *drifts,
    )


def window(df: DataFrame, time: str, start: str | None = None, end: str | None = None, lookback_hours: int = 24) -> DataFrame:
    """Rows in [start, end); without a start, the last hours before the end, or before the latest row."""
    stop = F.lit(end).cast("timestamp_ntz") if end else None
    if stop is None:
        latest = df.agg(F.max(time)).first()[0]
        stop = F.lit(latest).cast("timestamp_ntz") + F.expr("interval 1 microsecond")
    begin = F.lit(start).cast("timestamp_ntz") if start else stop - F.make_interval(hours=F.lit(lookback_hours))
    return df.where((F.col(time) >= begin) & (F.col(time) < stop))
