"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new one, if all run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tessera-")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage with a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a table of a few numbers that may be sent to every task.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """Marks a small table for a broadcast join if a count of its rows allows it; larger ones are joined by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


def thinned(df: DataFrame, by: str, most: int) -> DataFrame:
    """About `most` rows at most of each of the few values of `by`; rows alike are thinned out as others are."""
    n = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()}
    if not n:
        return df
    share = F.create_map(*[x for value, rows in n.items() for x in (F.lit(value), F.lit(most / rows))])
    return df.where(F.rand(7) < F.coalesce(share[F.col(by)], F.lit(1.0)))


def numbered(source: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Texts (id, t) with a number of their own in place of an id that several texts have, and the numbers' ids.

    Where ids do not repeat, they stay and there is no table. Else the distinct texts of all ids are numbered in the
    order of id and text hash, by range, so that no id's rows need fit one task; rows alike get the same number.
    """
    known = source.where("id is not null")
    if known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return source, None
    printed = source.withColumn("print", F.xxhash64("t"))
    names = cut(printed.where("id is not null").select("id", "print").distinct().orderBy("id", "print").withColumn("number", F.monotonically_increasing_id()))
    return printed.join(names, ["id", "print"], "left").select(F.col("number").alias("id"), "t"), names.select("number", "id")


def named(result: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """A result with its numbers (id, or the columns named) turned into ids again."""
    if names is None:
        return result
    for c in columns or ("id",):
        own = names.select(F.col("number").alias(f"{c}_number"), F.col("id").alias(f"{c}_name"))
        result = result.join(own, result[c] == own[f"{c}_number"], "left").withColumn(c, F.col(f"{c}_name")).drop(f"{c}_number", f"{c}_name")
    return result


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def crc_mod(column, n: int):
    """crc32 of a column's text form, modulo n; null where the column is null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


#: Rows and bytes of an Arrow batch; whole texts can be long, and a worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get, unless the session asks for smaller ones."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(name, str(most))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
