"""Late session merging: a driver loop over batches that keeps a persisted table of standing sessions.

Events of a user no more than `gap` apart in time share a session. Batches are taken in ascending order. A batch's events
are first joined into micro-sessions; these are united with the users' standing sessions and split into islands anew.
An island with an event of the batch is a new version; the standing sessions inside it are retracted by it, and an
island without one is a standing session as before. The state after each batch (the standing sessions, and the versions
that this batch closed, appended) is a written table, so a batch reads only its own events and the last state, and a
lost executor costs the tasks of one batch.

Scale: events that lie in one slot of `gap` seconds always share a session, so they are summed by user, batch and slot
on the map side; a user with a third of all events costs one row a task and slot. A session that no later batch can
reach any more (later batches hold no event within `gap` of it) is closed and leaves the state, so the state holds the
sessions of the time still open and not the history. The driver holds one number for each batch, never rows.

Defined cases: an event without a user, time or batch takes no part; a missing weight counts as 0; repeated rows are
events each; events at the same time share a session; an empty table gives no versions; batches without events are
not made; other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import fresh_dir

MICRO = "user long, start_s long, end_s long, n_events long, h_sum long"
VERSION = "user long, batch long, start_s long, end_s long, n_events long, n_new long, n_retracted long, h_sum long, retracted_batch long, retracted_start_s long"
_COLUMNS = [c.split()[0] for c in VERSION.split(", ")]


def floor_div(x: Column, n: int) -> Column:
    """Whole quotient of an integer column, rounded down, in integers."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def micro_sessions(events: DataFrame, gap: int) -> DataFrame:
    """Events (user, at_s, batch, weight) summed by user, batch and slot of time."""
    slot = floor_div(F.col("at_s"), gap + 1)
    known = events.where("user is not null and at_s is not null and batch is not null").withColumn("slot", slot)
    sums = F.min("at_s").alias("start_s"), F.max("at_s").alias("end_s"), F.count("*").alias("n_events"), F.sum(F.coalesce("weight", F.lit(0))).alias("h_sum")
    return known.groupBy("user", "batch", "slot").agg(*sums).drop("slot")


def advance(standing: DataFrame, micro: DataFrame, batch: int, gap: int, horizon: int | None) -> DataFrame:
    """The state after a batch: versions that stand, and those that are closed now (`open` false).

    `horizon` is the earliest time of any event in later batches, or None after the last one.
    """
    none = F.lit(None).cast("long")
    fresh = micro.select("user", F.lit(batch).cast("long").alias("batch"), "start_s", "end_s", "n_events", F.col("n_events").alias("n_new"), F.lit(0).cast("long").alias("n_retracted"), "h_sum", F.lit(True).alias("fresh"))
    rows = standing.select(*fresh.columns[:-1], F.lit(False).alias("fresh")).unionByName(fresh)
    by_user = Window.partitionBy("user").orderBy("start_s", "end_s")
    reach = F.max("end_s").over(by_user.rowsBetween(Window.unboundedPreceding, -1))
    heads = rows.withColumn("head", F.when(F.col("start_s") <= reach + gap, 0).otherwise(1))
    islands = heads.withColumn("island", F.sum("head").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("user", "island")
    first = F.row_number().over(Window.partitionBy("user", "island").orderBy(F.col("fresh").desc(), "start_s", "end_s")) == 1
    seen = islands.select("*", first.alias("first"), F.max("fresh").over(whole).alias("touched"), *(f.over(whole).alias(f"all_{c}") for c, f in (("start_s", F.min("start_s")), ("end_s", F.max("end_s")), ("n_events", F.sum("n_events")), ("n_new", F.sum(F.when(F.col("fresh"), F.col("n_new")).otherwise(0))), ("n_retracted", F.sum((~F.col("fresh")).cast("long"))), ("h_sum", F.sum("h_sum")))))
    gone = F.col("touched") & ~F.col("fresh")
    made = {c: F.when(F.col("fresh"), F.col(f"all_{c}")).otherwise(F.col(c)) for c in ("start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum")}
    retracted = F.when(gone, F.lit(batch).cast("long")).otherwise(none), F.when(gone, F.col("all_start_s")).otherwise(none)
    state = seen.where("not fresh or first").select("user", "batch", *(v.alias(c) for c, v in made.items()), retracted[0].alias("retracted_batch"), retracted[1].alias("retracted_start_s"))
    stays = F.lit(False) if horizon is None else F.col("retracted_batch").isNull() & (F.col("end_s") + gap >= F.lit(horizon))
    return state.withColumn("open", stays)


def versions(events: DataFrame, gap: int = 240) -> DataFrame:
    """Every version of every session: user, batch, start_s, end_s, n_events, n_new, n_retracted (0 creation, 1
    extension, more merge), h_sum, retracted_batch, retracted_start_s (null where the version is final).

    `events` has user, at_s (whole seconds), batch and weight, all integers.
    """
    spark = events.sparkSession
    home = fresh_dir(spark, "sessions")
    found = micro_sessions(events, gap).hint("rebalance", "batch")
    found.select("batch", "user", "start_s", "end_s", "n_events", "h_sum").write.partitionBy("batch").parquet(f"{home}/micro")
    batches = sorted(tuple(r) for r in spark.read.schema(f"{MICRO}, batch long").parquet(f"{home}/micro").groupBy("batch").agg(F.min("start_s")).collect())
    horizon: list[int | None] = [None] * min(1, len(batches))
    for _, earliest in reversed(batches[1:]):
        horizon.append(earliest if horizon[-1] is None else min(earliest, horizon[-1]))
    standing = spark.createDataFrame([], f"{VERSION}, open boolean")
    for turn, ((batch, _), later) in enumerate(zip(batches, reversed(horizon), strict=True)):
        micro = spark.read.schema(MICRO).parquet(f"{home}/micro/batch={batch}")
        out = f"{home}/state/turn={turn}"
        advance(standing, micro, batch, gap, later).write.parquet(out)
        standing = spark.read.schema(f"{VERSION}, open boolean").parquet(out).where("open")
    if not batches:
        return standing.select(*_COLUMNS)
    return spark.read.schema(f"{VERSION}, open boolean").parquet(*(f"{home}/state/turn={k}" for k in range(len(batches)))).where("not open").select(*_COLUMNS)


def conversation_events(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The events of a table of conversations; times, users and batches are derived from hashes of its keys."""
    crc = lambda x: F.crc32(x.cast("string").cast("binary"))
    keyed = conversations.where(F.col(turn).isNotNull() & F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("v"), F.col(turn).cast("long").alias("t"))
    hashed = keyed.select("v", "t", crc(F.col("v")).alias("c"), crc(F.concat_ws(":", F.col("v").cast("string"), F.col("t").cast("string"))).alias("weight"))
    timed = hashed.select("weight", (2 * F.shiftright("v", 3) + F.col("c") % 2).alias("user"), (floor_div(F.col("c"), 2) % 7200 + 300 * F.col("t") + F.col("weight") % 600).alias("at_s"), floor_div(F.col("weight"), 600).alias("g"))
    return timed.select("user", "at_s", (floor_div(F.col("at_s"), 1800) + F.when(F.col("g") % 5 == 0, F.col("g") % 4).otherwise(0)).alias("batch"), "weight")
