"""Append-only monitoring store: encrypted telemetry, versioned baselines, range scans and retention.

Telemetry lies in partitions of model and expiry day, so that scans prune by model and a purge drops whole days; within
a partition the filters on artifact and time reach the Parquet scan.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import expiry, sha256_hex

MAX_SCAN = 1_000_000

#: The store's tables: columns, the ones that may not be null, and what has to hold of every row.
TABLES = {
    "telemetry": (
        "telemetry_id string, model_id string, artifact string, recorded_at timestamp, expires_at timestamp, key_id string, encrypted_payload binary, payload_sha256 string",
        {"expires after it was recorded": "expires_at > recorded_at", "id of 36 characters at most": "length(telemetry_id) <= 36", "digest of 64 characters": "length(payload_sha256) = 64"},
    ),
    "baseline": ("baseline_id string, model_id string, artifact string, baseline_json string, version long, created_at timestamp", {"baseline is JSON": "try_parse_json(baseline_json) is not null"}),
    "report": (
        "report_id string, model_id string, artifact string, window_start timestamp, window_end timestamp, record_count long, overall_status string, report_json string, created_at timestamp",
        {"window ends after its start": "window_end > window_start", "report is JSON": "try_parse_json(report_json) is not null"},
    ),
}


def broken(rows: DataFrame, table: str) -> tuple[DataFrame, Column]:
    """The rows with the table's types, and what each first breaks of the table's conditions (null: nothing). Missing
    columns are an error at once."""
    ddl, conditions = TABLES[table]
    columns = [c.split()[0] for c in ddl.split(", ")]
    lacking = set(columns) - set(rows.columns)
    if lacking:
        raise ValueError(f"{table} lacks {sorted(lacking)}")
    out = rows.withColumns({c: F.col(c).cast(t) for c, t in (x.split() for x in ddl.split(", "))})
    tests = {f"{c} is null": f"{c} is not null" for c in columns} | conditions
    return out, F.coalesce(*[F.when(~F.coalesce(F.expr(holds), F.lit(False)), F.lit(name)) for name, holds in tests.items()])


def checked(rows: DataFrame, table: str) -> DataFrame:
    """The rows as the table has them; a null or a broken condition fails the write.

    The check is part of the id's column: as a filter it would go below what makes the rows, and seal them once more for
    each condition."""
    out, wrong = broken(rows, table)
    own = TABLES[table][0].split()[0]
    return out.withColumn(own, F.when(wrong.isNull(), F.col(own)).otherwise(F.raise_error(F.concat(F.lit(f"{table}: "), wrong)).cast("string")))


PAYLOAD = "features string, prediction string, probabilities map<string,double>, max_probability double"


#: Files that a day's telemetry of a model may be dealt to at a time; columns of sealed rows.
DEALS = 8
SEALED = ("telemetry_id", "model_id", "artifact", "recorded_at", "expires_at", "key_id", "encrypted_payload", "payload_sha256", "expires_day")


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:16]


def _encrypt(payload: Column, key: bytes, bound_to: Column) -> Column:
    """AES-GCM with the telemetry id as authenticated data; a key of any length is hashed to 32 bytes."""
    return F.call_function("aes_encrypt", payload.cast("binary"), F.lit(bytearray(hashlib.sha256(key).digest())), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), bound_to.cast("binary"))


def _decrypt(payload: Column, key: bytes, bound_to: Column) -> Column:
    return F.call_function("try_aes_decrypt", payload, F.lit(bytearray(hashlib.sha256(key).digest())), F.lit("GCM"), F.lit("DEFAULT"), bound_to.cast("binary")).cast("string")


def telemetry(predictions: DataFrame, key: bytes, retention_days: int = 90) -> DataFrame:
    """Rows to append: telemetry_id, model_id, artifact, recorded_at and payload (JSON) become encrypted rows with a checksum."""
    kept = predictions.select("telemetry_id", "model_id", "artifact", "recorded_at", expiry("recorded_at", retention_days).alias("expires_at"), F.lit(key_id(key)).alias("key_id"), "payload").withColumn("expires_day", F.to_date("expires_at"))
    # sealing is spread over all tasks, however few the rows come from, and a day's rows lie in few files
    dealt = kept.repartition("model_id", "expires_day", F.pmod(F.xxhash64("telemetry_id"), F.lit(DEALS)))
    out = dealt.withColumn("encrypted_payload", _encrypt(F.col("payload"), key, F.col("telemetry_id")))
    return out.withColumn("payload_sha256", sha256_hex("encrypted_payload")).select(*SEALED)


def append_telemetry(rows: DataFrame, path: str) -> None:
    checked(rows, "telemetry").write.mode("append").partitionBy("model_id", "expires_day").parquet(path)


def decrypted(rows: DataFrame, keyring: list[bytes]) -> DataFrame:
    """Adds the payload; a wrong checksum, an unknown key or a payload that was tampered with fails the job."""
    plain = F.lit(None).cast("string")
    for k in keyring:
        plain = F.when(F.col("key_id") == key_id(k), _decrypt(F.col("encrypted_payload"), k, F.col("telemetry_id"))).otherwise(plain)
    intact = sha256_hex("encrypted_payload") == F.col("payload_sha256")
    told = F.when(~intact, F.raise_error(F.lit("telemetry checksum mismatch"))).otherwise(F.coalesce(plain, F.raise_error(F.lit("telemetry cannot be decrypted")).cast("string")))
    return rows.withColumn("payload", told)


def unexpired(rows: DataFrame, model_id: str, artifact: str, start: Column, end: Column, now: Column) -> DataFrame:
    """Unexpired rows of a model and artifact in [start, end)."""
    at = F.col("recorded_at")
    return rows.where((F.col("model_id") == model_id) & (F.col("artifact") == artifact) & (at >= start) & (at < end) & (F.col("expires_at") > now))


def scan(rows: DataFrame, model_id: str, artifact: str, start: str, end: str, now: str, limit: int = MAX_SCAN) -> DataFrame:
    """Those rows by time and id, at most `limit` of them."""
    if not 0 < limit <= MAX_SCAN:
        raise ValueError(f"limit is 1 to {MAX_SCAN}")
    t = lambda s: F.lit(s).cast("timestamp")
    return unexpired(rows, model_id, artifact, t(start), t(end), t(now)).orderBy("recorded_at", "telemetry_id").limit(limit)


def survivors(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(F.col("expires_at") > now)


def purge(spark: SparkSession, path: str, now: str) -> int:
    """Deletes expired rows and returns how many.

    The day that `now` falls in is rewritten first: its survivors are written aside, whole, and then take the place of
    its partitions by a dynamic overwrite, so a run that is cut short at any point loses no unexpired row and can be
    started again. Days that have passed are dropped after that, by the names their folders have.
    """
    rows = spark.read.parquet(path)
    moment, today = F.lit(now).cast("timestamp"), F.to_date(F.lit(now).cast("timestamp"))
    gone = rows.where(F.col("expires_at") <= moment).count()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    today_rows = rows.where(F.col("expires_day") == today)
    kept = survivors(today_rows, moment)
    emptied = today_rows.groupBy("model_id").agg(F.count_if(F.col("expires_at") > moment).alias("left"), F.count("*").alias("all"))
    changed = emptied.where("left < all").select("model_id", "left").collect()  # a row for each model
    if any(r["left"] for r in changed):
        aside = f"{path.rstrip('/')}_aside-{uuid.uuid4().hex}"
        some = kept.join(F.broadcast(spark.createDataFrame([(r["model_id"],) for r in changed if r["left"]], "model_id string")), "model_id")
        some.write.parquet(aside)
        spark.read.schema(rows.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id", "expires_day").parquet(path)
        fs.delete(hadoop.Path(aside), True)
    empty = {r["model_id"] for r in changed if not r["left"]}
    day = now[:10]
    for model in fs.listStatus(hadoop.Path(path)):
        name = model.getPath().getName()
        if not name.startswith("model_id="):
            continue
        for folder in fs.listStatus(model.getPath()):
            own = folder.getPath().getName().removeprefix("expires_day=")
            if own < day or (own == day and unquote(name.removeprefix("model_id=")) in empty):
                fs.delete(folder.getPath(), True)
    return gone


def active_baseline(versions: DataFrame) -> DataFrame:
    """The highest version of each model; older ones are inactive by construction. Of equal versions, which the store does
    not give but other tables may hold, the one of the highest baseline_id."""
    return versions.groupBy("model_id").agg(F.max_by(F.struct("*"), F.struct("version", "baseline_id")).alias("active")).select("active.*")


def _created(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if it is there, whoever made it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then, which is two steps
        try:
            os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(at, False).close()
    except Exception:
        if fs.exists(at):
            return False
        raise
    return True


def claimed_version(spark: SparkSession, path: str, model_id: str) -> int:
    """A version of the model that no other writer has: the first number whose file this writer created."""
    home = f"{path.rstrip('/')}/_versions/{quote(model_id, safe='')}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(home)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = [int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()] if fs.exists(at) else []
    version = max(taken, default=0) + 1
    while not _created(spark, f"{home}/{version:012d}"):
        version += 1
    return version


def register_baseline(document: DataFrame, path: str) -> str:
    """Appends one baseline (model_id, artifact, baseline_json) as a new version and returns its id.

    A version is never changed, and its number is claimed before its row is written, so writers at the same time get
    different ones and exactly one is the highest, the active one, whatever their clocks say. A writer that stops
    between the two leaves a number unused.
    """
    one = document.select("model_id").take(2)
    if len(one) != 1:
        raise ValueError("one baseline at a time")
    baseline_id, version = str(uuid.uuid4()), claimed_version(document.sparkSession, path, one[0]["model_id"])
    rows = document.select(F.lit(baseline_id).alias("baseline_id"), "model_id", "artifact", "baseline_json", F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("created_at"))
    checked(rows, "baseline").write.mode("append").partitionBy("model_id").parquet(path)
    return baseline_id


def load_active_baseline(spark: SparkSession, path: str, model_id: str) -> str:
    """The JSON of a model's active baseline; none is an error."""
    found = active_baseline(spark.read.parquet(path).where(F.col("model_id") == model_id)).select("baseline_json").take(1)
    if not found:
        raise LookupError(f"no active baseline of {model_id!r}")
    return found[0]["baseline_json"]


def append_report(report: DataFrame, path: str) -> str:
    """Appends one drift report (model_id, artifact, window_start, window_end, record_count, overall_status and what else
    it tells): the named columns stay columns, and all of it is kept as JSON."""
    if report.count() != 1:
        raise ValueError("one report at a time")
    report_id = str(uuid.uuid4())
    whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report_json")
    rows = report.select(F.lit(report_id).alias("report_id"), "model_id", "artifact", "window_start", "window_end", "record_count", "overall_status", whole, F.current_timestamp().alias("created_at"))
    checked(rows, "report").write.mode("append").partitionBy("model_id").parquet(path)
    return report_id


def healthy(spark: SparkSession, path: str) -> bool:
    """Whether the store can be read; no rows are."""
    try:
        spark.read.parquet(path).limit(0).collect()
    except Exception:  # noqa: BLE001  any failure to read is the answer
        return False
    return True
