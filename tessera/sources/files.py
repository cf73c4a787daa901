"""Readers and writers chosen by suffix, relational tables by JDBC, word vectors, reports and audit lines."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.scalars import canonical_json, hmac_sha256, iso_utc, quarter_of_month
from tessera.operators.tables import lower_names, numbered_rows

# Fixed value: what the databases' unquoted names may be, a letter and up to 29 letters, digits or signs.
IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_$#]{0,29}")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def _with_schema(spark: SparkSession, schema):
    return spark.read.schema(schema) if schema else spark.read


READERS = {
    ".csv": read_csv,
    ".json": lambda spark, path, schema=None: _with_schema(spark, schema).option("multiLine", True).json(path),
    ".jsonl": lambda spark, path, schema=None: _with_schema(spark, schema).json(path),
    ".ndjson": lambda spark, path, schema=None: _with_schema(spark, schema).json(path),
    ".parquet": lambda spark, path, schema=None: _with_schema(spark, schema).parquet(path),
    ".pq": lambda spark, path, schema=None: _with_schema(spark, schema).parquet(path),
}


def read_input(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Reads a file by its suffix; an unknown one is an error."""
    suffix = Path(path).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported input {suffix!r}; known: {', '.join(sorted(READERS))}")
    return READERS[suffix](spark, path, schema)


def read_table(spark: SparkSession, url: str, schema: str, table: str, partition: tuple | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """A relational table, of it the columns named; names in lower case.

    Reads are split in ranges of a number column if `partition` is (column, lower, upper, parts), or (column, parts):
    then the database is asked for the least and greatest value, in one row, first. Rows without a value of it are in the
    first range.
    """
    for name in (schema, table, *(columns or ()), *((partition[0],) if partition else ())):
        if not IDENTIFIER.fullmatch(name):
            raise ValueError(f"not an identifier: {name!r}")
    source = lambda: spark.read.format("jdbc").option("url", url).options(**options)
    reader = source().option("dbtable", f"(select {', '.join(columns)} from {schema}.{table}) t" if columns else f"{schema}.{table}")
    if partition and len(partition) == 2:
        column, parts = partition
        ends = source().option("query", f"select min({column}) lo, max({column}) hi from {schema}.{table}").load().first()
        partition = (column, ends[0], ends[1], parts) if ends[0] is not None else None
    if partition:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return lower_names(reader.load())


def read_training_tables(spark: SparkSession, root: str, names: tuple[str, ...] = ("patients", "visits", "billing"), schemas: dict | None = None) -> dict[str, DataFrame]:
    """The tables as CSV files under a folder; a file that is missing is an error that names it."""
    out = {}
    for n in names:
        try:
            out[n] = lower_names(read_csv(spark, f"{root}/{n}.csv", (schemas or {}).get(n)))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise FileNotFoundError(f"{root}/{n}.csv") from e
    return out


def from_records(spark: SparkSession, records: list[dict], columns: dict[str, str]) -> DataFrame:
    """Inline records with exactly these columns, in order; what a record lacks is null."""
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in records], ", ".join(f"{c} {t}" for c, t in columns.items()))


def read_word_vectors(spark: SparkSession, path: str, size: int = 100) -> DataFrame:
    """(word, vector) from lines of a word and its numbers."""
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).where(F.size(parts) == size + 1).select(parts[0].alias("word"), F.slice(parts, 2, size).cast("array<float>").alias("vector"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def report_json(one_row: DataFrame) -> str:
    """A one-row report as indented ASCII JSON."""
    rows = one_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).take(2)
    if len(rows) != 1:
        raise ValueError("a report has one row")
    return json.dumps(json.loads(rows[0]["j"]), indent=2, ensure_ascii=True)


def write_report(one_row: DataFrame, path: str | None = None) -> str:
    """The report's JSON, written as one text file where a path is given."""
    text = report_json(one_row)
    if path:
        one_row.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file under a path, by the executors."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def tree_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of all files under a path, in the order of their names below it."""
    lines = file_digests(spark, path).select(F.concat_ws(" ", F.element_at(F.split("path", "/"), -1), "sha256").alias("line"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)).first()[0]  # a line for each file


def batches_json(df: DataFrame, size: int = 100, order: list[str] | None = None) -> DataFrame:
    """{"instances": [...]} lines of `size` rows each, the last one of what is left, in the order of the columns named."""
    made = numbered_rows(df.withColumn("__r", F.struct("*")), order or df.columns, "__at").select(F.col("__r").alias("r"), F.floor(F.col("__at") / size).alias("b"), F.col("__at").alias("i"))
    lists = made.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("x"))
    return lists.select(F.to_json(F.struct(F.transform("x", lambda e: e["r"]).alias("instances"))).alias("value"))


def audit_events(predictions: DataFrame, key: bytes, features: list[str]) -> DataFrame:
    """One JSON line for each prediction, with an HMAC of its features in place of them.

    Besides the features, rows have timestamp, request_id, model_id, model_name, artifact_sha256, prediction,
    probabilities, record_index, batch_size and duration_ms; those that they lack are null.
    """
    digest = hmac_sha256(key, canonical_json(**{f: f for f in features}))
    there = {c: F.col(c) if c in predictions.columns else F.lit(None).cast("string") for c in ("request_id", "model_id", "model_name", "artifact_sha256", "prediction", "probabilities", "record_index", "batch_size")}
    when = iso_utc("timestamp") if "timestamp" in predictions.columns else F.lit(None).cast("string")
    took = F.bround("duration_ms", 2) if "duration_ms" in predictions.columns else F.lit(None).cast("double")
    first = ("request_id", "model_id", "model_name", "artifact_sha256")
    body = [F.lit("model_prediction").alias("event"), when.alias("timestamp"), *[there[c].alias(c) for c in first], digest.alias("input_feature_hash"), *[c.alias(n) for n, c in there.items() if n not in first], took.alias("duration_ms")]
    return predictions.select(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("value"))


def quality_events(report: DataFrame, request_id: str) -> DataFrame:
    """One JSON line for a validation report (one row) with issues, none for one without."""
    kept = ("model_id", "artifact_sha256", "category_contract_sha256", "row_count", "valid", "summary", "issues")
    body = F.struct(F.lit("data_quality_validation").alias("event"), iso_utc("generated_at").alias("timestamp"), F.lit(request_id).alias("request_id"), *kept)
    return report.where(F.size("issues") > 0).select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def _visitors(spark: SparkSession, n: int, seed: int) -> tuple[DataFrame, Callable[[int], Column], Callable]:
    """Seeded patients at a visit, a source of uniform numbers for further columns, and a weighted choice."""
    u = lambda k: F.rand(seed + k)
    pick = lambda k, pairs: F.element_at(F.array(*[F.lit(v) for v, w in pairs for _ in range(w)]), (F.floor(u(k) * sum(w for _, w in pairs)) + 1).cast("int"))
    age = F.when(u(0) < 0.375, 18 + F.sqrt(u(1)) * 27).otherwise(90 - F.sqrt(u(1)) * 45)  # triangular, most at 45
    stay = F.least(F.lit(120.0), -8 * (F.log(1 - u(3)) + F.log(1 - u(4)) + 0.3 * F.log(1 - u(5))))  # close to a gamma of shape 2.3
    base = spark.range(n).select(
        "id", age.cast("int").alias("age"), (u(2) < 0.42).cast("int").alias("chronic_flag"), F.bround(stay, 2).alias("length_of_stay_hours"), F.bround(F.least(F.lit(100_000.0), F.exp(9.7 + 0.55 * F.randn(seed + 6))), 2).alias("billed_amount"),
        (5 + F.floor(u(7) * 726)).cast("int").alias("days_since_registration_at_visit"), pick(8, [("F", 1), ("M", 1)]).alias("gender"), pick(9, [(x, 1) for x in ("Delhi", "Mumbai", "Chennai")]).alias("city"), pick(10, [(x, 1) for x in ("CareOne", "HealthPlus", "MediCareX", "SecureLife")]).alias("insurance_provider"),
        pick(11, [(x, 1) for x in ("Cardiology", "ER", "General", "ICU", "Neurology", "Orthopedics")]).alias("department"), pick(12, [(x, 1) for x in ("ER", "ICU", "OPD")]).alias("visit_type"), (100 + F.floor(u(13) * 101)).cast("int").alias("doctor_id"),
    )
    return base, u, pick


def _months(df: DataFrame, u, at: int, prefix: str) -> DataFrame:
    """Calendar columns that agree with each other."""
    drawn = df.withColumns({f"{prefix}_month": (1 + F.floor(u(at) * 12)).cast("int"), f"{prefix}_day_of_week": F.floor(u(at + 1) * 7).cast("int")})
    return drawn.withColumns({f"{prefix}_quarter": quarter_of_month(f"{prefix}_month"), f"{prefix}_is_weekend": (F.col(f"{prefix}_day_of_week") >= 5).cast("int")})


def synthetic_claims(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Seeded claim records: patients at a visit, the lag to billing, a risk score and two calendars."""
    base, u, pick = _visitors(spark, n, seed)
    out = base.withColumns({"days_from_visit_to_billing": F.floor(u(20) * 121).cast("int"), "risk_score": pick(21, [("Low", 9), ("Medium", 7), ("High", 4)])})
    return _months(_months(out, u, 22, "billing"), u, 24, "visit")


def synthetic_risks(spark: SparkSession, n: int, seed: int = 43) -> DataFrame:
    """Seeded risk records: patients at a visit with what became of the claim; the approved amount follows its status."""
    base, u, pick = _visitors(spark, n, seed)
    out = base.withColumns({"claim_status": pick(30, [("Paid", 9), ("Pending", 5), ("Rejected", 6)]), "payment_days": F.bround(u(31) * 90, 1), "visit_year": pick(32, [(2025, 1), (2026, 1)])})
    share = F.when(F.col("claim_status") == "Paid", 0.7 + 0.3 * u(33)).when(F.col("claim_status") == "Pending", 0.6 * u(34)).otherwise(0.0)
    return _months(out.withColumn("approved_amount", F.bround(F.col("billed_amount") * share, 2)), u, 35, "visit")
