"""Group-mean interaction features as stages of a machine-learning pipeline, with a reader and writer of their own.

`Interactions` learns the means of each department and provider, and those of all rows, from one aggregate over grouping
sets of the training rows; `InteractionsModel` holds them as a table (a row for each group, never collected) and adds
the columns to any later rows. Groups that training did not have, missing groups, and groups without a known value take
the mean of all rows. Numbers written as text are read; what is no number is missing, and stays so in what is made of it.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import missing_as_null, safe_div, to_number
from tessera.operators.tables import settled, small, spare

# The columns that the two kinds add, in their order.
RISK_COLUMNS = (
    "department_avg_billed_amount", "bill_vs_department_avg", "bill_to_department_avg_ratio", "department_avg_length_of_stay", "los_to_department_avg_ratio",
    "billed_amount_per_stay_hour", "provider_avg_billed_amount", "bill_vs_provider_avg", "bill_to_provider_avg_ratio",
)
CLAIM_COLUMNS = (
    "department_avg_billed_amount", "bill_vs_department_avg", "bill_to_department_avg_ratio", "provider_avg_billed_amount", "bill_vs_provider_avg", "bill_to_provider_avg_ratio",
    "department_avg_length_of_stay", "los_to_department_avg_ratio", "billed_amount_per_stay_hour", "department_avg_billing_lag", "billing_lag_vs_department_avg", "billing_lag_to_department_avg_ratio",
    "provider_avg_billing_lag", "billing_lag_vs_provider_avg", "billing_lag_to_provider_avg_ratio", "age_chronic_interaction", "los_chronic_interaction", "billed_amount_chronic_interaction",
)
KINDS = {"risk": RISK_COLUMNS, "claim": CLAIM_COLUMNS}
MEASURES = ("billed", "stay", "lag")


def _text(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toString)


class _Roles(Params):
    """The columns that play the parts, and the kind of columns to make."""

    kind = _text("kind", "risk or claim")
    departmentCol = _text("departmentCol", "group of the stay")
    providerCol = _text("providerCol", "group of the payer")
    billedCol = _text("billedCol", "amount billed")
    stayCol = _text("stayCol", "hours of the stay")
    lagCol = _text("lagCol", "days to the bill (claim)")
    ageCol = _text("ageCol", "age (claim)")
    chronicCol = _text("chronicCol", "0 or 1 (claim)")

    def __init__(self, **given: str) -> None:
        super().__init__()
        self._setDefault(kind="claim", departmentCol="department", providerCol="insurance_provider", billedCol="billed_amount", stayCol="length_of_stay_hours", lagCol="days_from_visit_to_billing", ageCol="age", chronicCol="chronic_flag")
        if given.get("kind", "claim") not in KINDS:
            raise ValueError(f"kind is one of {sorted(KINDS)}")
        self._set(**given)

    def column(self, role: str) -> str:
        return self.getOrDefault(f"{role}Col")

    def measures(self) -> tuple[str, ...]:
        return MEASURES if self.getOrDefault("kind") == "claim" else MEASURES[:2]

    def reads(self) -> list[str]:
        """Columns that have to be there."""
        more = ("age", "chronic") if self.getOrDefault("kind") == "claim" else ()
        return [self.column(r) for r in ("department", "provider", *self.measures(), *more)]

    def makes(self) -> list[str]:
        return list(KINDS[self.getOrDefault("kind")])

    def _checked(self, df: DataFrame) -> None:
        lacking = sorted(set(self.reads()) - set(df.columns))
        if lacking:
            raise ValueError(f"missing source columns of the interactions: {lacking}")

    def _number(self, df: DataFrame, role: str) -> Column:
        name = self.column(role)
        quoted = F.col(f"`{name}`")
        return to_number(quoted) if dict(df.dtypes)[name] == "string" else missing_as_null(quoted.cast("double"))


class Interactions(_Roles, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the means of the groups."""

    def _fit(self, df: DataFrame) -> InteractionsModel:
        self._checked(df)
        group = lambda role: F.col(f"`{self.column(role)}`").cast("string")
        rows = df.select(group("department").alias("d"), group("provider").alias("p"), *[self._number(df, m).alias(m) for m in self.measures()])
        means = [F.avg(m).alias(m) if m in self.measures() else F.lit(None).cast("double").alias(m) for m in MEASURES]
        sets = rows.groupingSets([["d"], ["p"], []], "d", "p").agg(F.grouping_id().alias("g"), *means)
        role = F.element_at(F.array(F.lit("department"), F.lit("provider"), F.lit("all")), F.col("g").cast("int"))
        table = sets.select(role.alias("role"), F.coalesce("d", "p").alias("value"), *MEASURES).where("role = 'all' or value is not null")
        return self._copyValues(InteractionsModel(settled(table)))


class InteractionsModel(_Roles, Model, MLReadable, MLWritable):
    """Adds the columns from frozen means: (role, value, billed, stay, lag)."""

    def __init__(self, means: DataFrame | None = None) -> None:
        super().__init__()
        self.means = means

    def _with_means(self, df: DataFrame, role: str, overall: dict[str, float | None]) -> tuple[DataFrame, dict[str, Column]]:
        key, *names = (spare(df, f"{role}_{x}") for x in ("value", *MEASURES))
        own = self.means.where(F.col("role") == role).select(F.col("value").alias(key), *[F.col(m).alias(n) for m, n in zip(MEASURES, names, strict=True)])
        joined = df.join(small(own), F.col(f"`{self.column(role)}`").cast("string") == F.col(key), "left")
        return joined, {m: F.coalesce(n, F.lit(overall[m])) for m, n in zip(MEASURES, names, strict=True)}

    def _transform(self, df: DataFrame) -> DataFrame:
        self._checked(df)
        overall = self.means.where("role = 'all'").first().asDict()
        joined, department = self._with_means(df, "department", overall)
        joined, provider = self._with_means(joined, "provider", overall)
        billed, stay = self._number(df, "billed"), self._number(df, "stay")
        made = {
            "department_avg_billed_amount": department["billed"],
            "bill_vs_department_avg": billed - department["billed"],
            "bill_to_department_avg_ratio": safe_div(billed, department["billed"]),
            "provider_avg_billed_amount": provider["billed"],
            "bill_vs_provider_avg": billed - provider["billed"],
            "bill_to_provider_avg_ratio": safe_div(billed, provider["billed"]),
            "department_avg_length_of_stay": department["stay"],
            "los_to_department_avg_ratio": safe_div(stay, department["stay"]),
            # a stay under an hour counts as one; a missing one stays missing
            "billed_amount_per_stay_hour": F.when(stay.isNotNull(), billed / F.greatest(stay, F.lit(1.0))),
        }
        if self.getOrDefault("kind") == "claim":
            lag, age, chronic = (self._number(df, r) for r in ("lag", "age", "chronic"))
            for name, of in (("department", department), ("provider", provider)):
                made[f"{name}_avg_billing_lag"] = of["lag"]
                made[f"billing_lag_vs_{name}_avg"] = lag - of["lag"]
                made[f"billing_lag_to_{name}_avg_ratio"] = safe_div(lag, of["lag"])
            made |= {"age_chronic_interaction": age * chronic, "los_chronic_interaction": stay * chronic, "billed_amount_chronic_interaction": billed * chronic}
        kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
        return joined.select(*kept, *[made[c].alias(c) for c in self.makes()])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: InteractionsModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.means.write.parquet(f"{path}/means")


class _Reader(MLReader):
    def load(self, path: str) -> InteractionsModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = InteractionsModel(self.sparkSession.read.parquet(f"{path}/means"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
