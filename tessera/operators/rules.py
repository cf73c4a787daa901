"""Data-quality rules as data: one wide aggregate evaluates all of them, and issues are its non-zero counts.

Rules of one table make one job whatever their number. Severities follow two policies, `warn` or `reject`.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import quarter_of_month, to_number
from tessera.operators.tables import columns_of_kind

POLICIES = ("warn", "reject")
# The codes of issues.
CODES = (
    "empty_dataset", "missing_column", "unexpected_column", "missing_value", "invalid_numeric_type", "non_finite_value", "numeric_out_of_range", "integer_required", "unseen_category",
    "inconsistent_calendar_field", "business_rule_violation",
)
ISSUE = "code string, severity string, feature string, count long, rate double, message string, distinct_count long"


@dataclass(frozen=True)
class Contract:
    columns: tuple[str, ...]
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    integers: tuple[str, ...] = ()
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    controlled: tuple[str, ...] = ()
    calendars: tuple[str, ...] = ()
    amounts: tuple[str, str] | None = None


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _read(c: Column) -> Column:
    """The number that a trimmed text says."""
    special = F.lower(c)
    return F.when(special.isin("inf", "+inf", "infinity"), float("inf")).when(special.isin("-inf", "-infinity"), float("-inf")).otherwise(to_number(c))


#: Names of what is made of a feature, once for all rules: its trimmed text, whether it is missing, its number.
TEXT, GONE, READ = "__text__", "__gone__", "__read__"


def _missing(c: str) -> Column:
    return F.col(f"`{GONE}{c}`")


def _number(c: str) -> Column:
    return F.col(f"`{READ}{c}`")


def _trimmed(c: str) -> Column:
    return F.col(f"`{TEXT}{c}`")


def prepared(df: DataFrame, contract: Contract) -> DataFrame:
    """What the rules ask of each feature that is there; every text is trimmed and read once, whatever their number."""
    own = [c for c in dict.fromkeys([*contract.columns, *[f"{p}_{x}" for p in contract.calendars for x in ("month", "quarter", "day_of_week", "is_weekend")], *(contract.amounts or ())]) if c in df.columns]
    texts = df.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(f"{TEXT}{c}") for c in own])
    gone = lambda c: _trimmed(c).isNull() | (_trimmed(c) == "") | (F.lower(_trimmed(c)) == "nan")
    return texts.select(*[_trimmed(c) for c in own], *[gone(c).alias(f"{GONE}{c}") for c in own], *[_read(_trimmed(c)).alias(f"{READ}{c}") for c in own])


@dataclass(frozen=True)
class Rule:
    """Rows that fail, what is told of them, and the value whose distinct number is told too."""

    code: str
    feature: str
    fails: Column
    message: str
    value: Column | None = None


def conditions(contract: Contract, present: set[str]) -> list[Rule]:
    """The rules whose columns are there, over the rows that `prepared` gives."""
    out = []
    for c in (c for c in contract.columns if c in present):
        known, number, of = ~_missing(c), _number(c), f"Feature '{c}'"
        out.append(Rule("missing_value", c, _missing(c), f"{of} contains missing or blank values"))
        if c in contract.ranges:
            low, high = contract.ranges[c]
            finite = number.isNotNull() & (F.abs(number) != float("inf"))
            out.append(Rule("invalid_numeric_type", c, known & number.isNull(), f"{of} contains values that are not numeric"))
            out.append(Rule("non_finite_value", c, known & (F.abs(number) == float("inf")), f"{of} contains NaN or infinite values"))
            out.append(Rule("numeric_out_of_range", c, finite & ((number < low) | (number > high)), f"{of} must be between {low:g} and {high:g}"))
            if c in contract.integers:
                out.append(Rule("integer_required", c, finite & (F.pmod(number, F.lit(1.0)) > 1e-8), f"{of} must contain integer values"))
        if c in contract.categories:
            value = _trimmed(c)
            unseen = known & ~value.isin(*contract.categories[c])
            out.append(Rule("unseen_category", c, unseen, f"{of} contains categories absent from the fitted encoder", F.when(unseen, value)))
    for prefix in contract.calendars:
        month, quarter, day, weekend = (f"{prefix}_{x}" for x in ("month", "quarter", "day_of_week", "is_weekend"))
        unlike = lambda a, b: f"Feature '{a}' is inconsistent with '{b}'"
        if {month, quarter} <= present:
            out.append(Rule("inconsistent_calendar_field", quarter, _number(quarter) != quarter_of_month(_number(month)), unlike(quarter, month)))
        if {day, weekend} <= present:
            out.append(Rule("inconsistent_calendar_field", weekend, _number(weekend) != _number(day).isin(5, 6).cast("double"), unlike(weekend, day)))
    if contract.amounts and set(contract.amounts) <= present:
        approved, billed = contract.amounts
        out.append(Rule("business_rule_violation", approved, _number(approved) > _number(billed), f"Feature '{approved}' cannot exceed '{billed}'"))
    return out


def validate(df: DataFrame, contract: Contract, missing_policy: str = "warn", unseen_policy: str = "warn") -> DataFrame:
    """The issues: code, severity, feature, count, rate, message, distinct_count; values themselves are never told."""
    if missing_policy not in POLICIES or unseen_policy not in POLICIES:
        raise ValueError(f"a policy is one of {POLICIES}")
    spark, present, expected = df.sparkSession, set(df.columns), set(contract.columns)
    rules = conditions(contract, present)
    policy = {"missing_value": missing_policy, "unseen_category": unseen_policy}

    def severity(code: str, feature: str) -> str:
        strict = code not in policy or policy[code] == "reject" or (code == "unseen_category" and feature in contract.controlled)
        return "error" if strict else "warning"

    # (place, rule as told, failing rows) of every rule; rules about columns concern all rows
    shape = [("missing_column", c, f"Required feature column '{c}' is missing") for c in sorted(expected - present)]
    shape += [("unexpected_column", c, f"Unexpected feature column '{c}' is not in the model contract") for c in sorted(present - expected)]
    told = [(code, "error", c, message, F.lit(True)) for code, c, message in shape] + [(r.code, severity(r.code, r.feature), r.feature, r.message, r.fails) for r in rules]
    cell = lambda i, code, said, feature, message, count: F.struct(F.lit(i).alias("i"), F.lit(code).alias("code"), F.lit(said).alias("severity"), F.lit(feature).cast("string").alias("feature"), count.alias("count"), F.lit(message).alias("message"), F.lit(code in ("empty_dataset", "missing_column", "unexpected_column")).alias("always"))
    empty = cell(-1, "empty_dataset", "error", None, "Input contains no records", F.count(F.lit(1)))
    ready = prepared(df, contract)
    one = ready.agg(F.count(F.lit(1)).alias("n"), F.array(empty, *[cell(i, *x[:4], F.count_if(x[4])) for i, x in enumerate(told)]).alias("cells"))
    rows = one.select("n", F.explode("cells").alias("c")).select("c.*", "n").where("count > 0 and code <> 'empty_dataset' or always and (code <> 'empty_dataset' or n = 0)")
    # distinct values are counted apart, from each value's rows combined on the map side
    valued = [F.struct(F.lit(len(shape) + i).alias("i"), r.value.alias("value")) for i, r in enumerate(rules) if r.value is not None]
    if valued:
        unlike = ready.where(reduce(lambda a, b: a | b, [r.fails for r in rules if r.value is not None])).select(F.explode(F.filter(F.array(*valued), lambda x: x["value"].isNotNull())).alias("x")).groupBy("x.i", "x.value").agg(F.lit(1)).groupBy("i").agg(F.count("*").alias("distinct_count"))
        rows = rows.join(F.broadcast(unlike), "i", "left")  # a row for each rule
    else:
        rows = rows.withColumn("distinct_count", F.lit(None).cast("long"))
    return rows.orderBy("i").select("code", "severity", "feature", "count", (F.col("count") / F.greatest("n", F.lit(1))).alias("rate"), "message", "distinct_count")


def report(df: DataFrame, issues: DataFrame, contract: Contract, model_id: str, artifact: str | None = None) -> DataFrame:
    """One row: what was checked against what, whether it passes, the summary and the issues."""
    listed = issues.agg(F.collect_list(F.struct("*")).alias("issues"))
    whole = listed.crossJoin(summary(issues)).crossJoin(df.agg(F.count(F.lit(1)).alias("row_count")))  # one row each
    names = lambda cs: F.array(*[F.lit(c) for c in cs])
    return whole.select(
        F.lit(model_id).alias("model_id"), F.current_timestamp().alias("generated_at"), F.lit(artifact).cast("string").alias("artifact_sha256"), F.lit(contract_sha256(contract.categories)).alias("category_contract_sha256"), "row_count",
        names(contract.columns).alias("expected_columns"), names(df.columns).alias("observed_columns"), "valid", F.struct(F.col("errors").alias("error_count"), F.col("warnings").alias("warning_count")).alias("summary"), "issues",
    )


def contract_sha256(categories: dict[str, tuple[str, ...]]) -> str:
    """SHA-256 of the categories as compact JSON with sorted keys and values."""
    spelled = json.dumps({k: sorted(v) for k, v in categories.items()}, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return hashlib.sha256(spelled.encode()).hexdigest()


def summary(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether the data pass."""
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("valid", F.col("errors") == 0)


def outcome(issues: DataFrame, fail_on_warnings: bool = False) -> DataFrame:
    """The summary with the exit code of a job: 0 passed, 2 failed, by errors or by warnings that count. (1 is left to runs
    that break.)"""
    fails = (F.col("errors") > 0) | (F.lit(fail_on_warnings) & (F.col("warnings") > 0))
    return summary(issues).withColumn("code", F.when(fails, 2).otherwise(0))


def exit_code(issues: DataFrame, fail_on_warnings: bool = False) -> int:
    return outcome(issues, fail_on_warnings).first()["code"]


def learn_categories(train: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature, categories) seen in training, sorted; all features in one job."""
    features = features or columns_of_kind(train, numeric=False)
    long = train.select(*[F.trim(_text(c)).alias(c) for c in features]).unpivot([], features, "feature", "value")
    return long.where("value is not null").groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("categories"))


def fingerprint(categories: DataFrame) -> DataFrame:
    """SHA-256 over the contract's canonical text."""
    lines = F.array_sort(F.collect_list(F.concat_ws("=", "feature", F.array_join("categories", ","))))
    return categories.agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("contract_sha256"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """A print of the rows that depends neither on their order nor on the columns' order: count and sum of row hashes."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s")).select(F.sha2(F.concat_ws(":", "n", "s").cast("binary"), 256).alias("fingerprint"))
