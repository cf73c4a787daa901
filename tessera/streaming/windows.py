"""Streaming extension: windowed class counts of telemetry, and drift reports of it, with late data bounded by a watermark.

Batch and stream share `class_counts` and `drift.against`; the stream adds the watermark, and a sink that is given each
micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import drift
from tessera.operators.tables import fresh_dir, last_of_share, settled, up_to
from tessera.plans.fixtures import table


def class_counts(events: DataFrame, time: str = "ts", label: str = "event_type", width: str = "24 hours") -> DataFrame:
    """(window_start, label, n, total) of tumbling windows."""
    w = F.window(F.col(time).cast("timestamp"), width)
    return events.groupBy(w.alias("w"), label).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), label, "n", "total")


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_counts(events: DataFrame, late: str = "1 hour", width: str = "24 hours") -> DataFrame:
    """class_counts of a stream; a window is final once the watermark has passed it. NTZ times are cast first."""
    return class_counts(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width=width)


def start(counts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Runs a query over what there is and stops; each micro-batch goes to the sink, for example a drift job."""
    return counts.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(events: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The stream's events without those that repeat a key within the watermark, and without those later than it."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drift_sink(document: dict, reports: str, time: str = "ts", label: str | None = None, confidence: str | None = None, minimum: int = 100) -> Callable[[DataFrame, int], None]:
    """A sink that compares each micro-batch with a profile document and writes one report of it.

    A report lies in a folder of its batch's number, so that a batch that is run again after a failure replaces its
    report and adds none. A micro-batch without rows has no report.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = settled(batch)  # what the state lets through is asked once
        span = batch.agg(F.min(time).alias("a"), (F.max(time) + F.expr("interval 1 microsecond")).alias("b")).first()
        if span["a"] is None:
            return
        found = drift.against(document, batch, label, confidence)
        report = drift.report_row(found, document, F.lit(span["a"]), F.lit(span["b"]), minimum)
        report.write.mode("overwrite").parquet(f"{reports}/batch={number}")

    return write


def reported(s, d):
    """The events come in three files in the order of time, every tenth of them twice; some of the
    first quarter come with the last and are too late. One report for each file, against the profile of the first."""
    e = table(s, d, "events").select("event_id", "ts", "event_type", "value")
    home = fresh_dir(s, "stream")
    quarter, first, second = (up_to(e, ["ts"], last_of_share(e, share, ["ts"])) for share in (1 / 4, 1 / 3, 2 / 3))
    part = F.when(quarter & (F.col("event_id") % 97 == 0), 2).when(first, 0).when(second, 1).otherwise(2)
    dealt = settled(e.withColumn("part", part))
    for k in range(3):
        own = dealt.where(F.col("part") == k).drop("part")
        own.unionByName(own.where("event_id % 10 = 0")).coalesce(1).write.parquet(f"{home}/in/{k}")  # the files of one arrival
    document = drift.profile_document(dealt.where("part = 0"), ["value"], ["event_type"])
    stream = s.readStream.schema("event_id long, ts timestamp_ntz, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(f"{home}/in/*")
    run = once(stream, "event_id").writeStream.foreachBatch(drift_sink(document, f"{home}/reports")).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    told = s.read.parquet(f"{home}/reports").select("batch", "record_count", F.explode("feature_drift").alias("f")).where("f.feature = 'event_type'")
    return told.select(F.col("batch").cast("int").alias("batch"), "record_count", F.round("f.js_divergence", 9).alias("js_divergence"))


REPORTED = """with r as (select *, row_number() over (order by ts) i, count(*) over () n from events), p as (select event_type, case when i <= floor(n / 3.0) then 0 when i <= floor(2 * n / 3.0) then 1 else 2 end as batch, event_id, i <= floor(n / 4.0) early from r),
 k as (select * from p where not early or event_id % 97 <> 0), c as (select batch, event_type, count(*) m, sum(count(*)) over (partition by batch) total from k group by 1, 2),
 s as (select b.batch, b.event_type, coalesce(x.m / x.total, 0) q, coalesce(y.m / y.total, 0) p from (select distinct c.batch, t.event_type from c, (select distinct event_type from c) t) b left join c x on x.batch = b.batch and x.event_type = b.event_type left join c y on y.batch = 0 and y.event_type = b.event_type)
 select batch, (select max(total)::bigint from c where c.batch = s.batch) record_count, round(sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2, 9) js_divergence from s group by batch"""


def daily(s, d):
    return class_counts(table(s, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"streamed_drift": (reported, REPORTED), "daily_class_counts": (daily, "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) n, round(sum(value), 4) total from events group by all")}
