"""Projection, joins, ordering and reshaping of tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it has at most so many rows; a larger one is left to the optimiser's shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new one, if all run on this machine."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if where:
        return where
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tessera-")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once, by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df computed once and written as a table by columns, for steps that each read a few of these."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def columns_of_kind(df: DataFrame, numeric: bool) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, t in df.dtypes if t.startswith(kinds) == numeric]


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the given order (which has to be total)."""
    one, n = Window.partitionBy(*keys).orderBy(*order), spare(df, "n")
    return df.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).drop(n)


def top_k(df: DataFrame, keys: list[str], value: Column, name: str, k: int) -> DataFrame:
    """The k groups with the largest sums; ties go to the smaller key."""
    return df.where(" and ".join(f"{c} is not null" for c in keys)).groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias(name)).orderBy(F.desc(name), *keys).limit(k)


def in_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def not_in_keys(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose key the other table lacks; a null key matches a null key."""
    key = spare(df, "key")
    return df.join(other.select(F.col(right).alias(key)).distinct(), F.col(left).eqNullSafe(F.col(key)), "left_anti")


def pivot_sum(df: DataFrame, rows: str, columns: str, value: str, values: list) -> DataFrame:
    return df.groupBy(rows).pivot(columns, values).agg(F.sum(value)).fillna(0)


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """A 0/1 column for each value, named column_value, in sorted order."""
    made = {f"{column}_{v}": F.coalesce((F.col(column) == v), F.lit(False)).cast("int") for v in sorted(values)}
    return df.withColumns(made).drop(column)


def interval_label(c: str, edges: list[float]) -> Column:
    """The right-closed interval that holds the value; the lowest edge itself is outside."""
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when((F.col(c) > low) & (F.col(c) <= high), F.lit(f"({low:g}, {high:g}]")).otherwise(out)
    return out


def long_form(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, feature, value) of numeric columns, so that all features go through one job."""
    cast = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features])
    return cast.unpivot(list(keys), features, "feature", "value")


def numbered_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Adds each row's place, from 0, in an order: by a range-partitioned sort and the offsets of the partitions, so that
    no task holds all rows. The order has to be total for the numbers to be."""
    m, p, i, n, before = (spare(df, f"{name}_{c}") for c in ("m", "p", "i", "n", "before"))
    placed = settled(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn(m, F.monotonically_increasing_id()))
    split = placed.withColumns({p: F.shiftright(m, 33), i: F.col(m).bitwiseAND((1 << 33) - 1)})
    sizes = split.groupBy(p).agg(F.count("*").alias(n))  # a row for each partition
    starts = sizes.select(p, F.coalesce(F.sum(n).over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return split.join(small(starts), p).withColumn(name, F.col(before) + F.col(i)).drop(m, p, i, n, before)


#: So many distinct values of a feature one aggregate may hold.
DISTINCT = 1_000_000


def exact_quantiles(rows: DataFrame, probabilities: list[float], by: str = "feature", value: str = "value", most: int = DISTINCT, scanned: bool = False) -> DataFrame:
    """(by, q): exact quantiles, interpolated, of each group's known values, in the order of the probabilities.

    Where no group has more than about `most` distinct values, each is counted, spread over all tasks, and one aggregate
    holds the counts, however many rows there are. Beyond that, estimates bracket
    each quantile, what lies below is counted, and only the rows inside are sorted, by range, to pick the two around it.
    Groups of few distinct values keep to the counts then. Rows that are no more than a scan (`scanned`) are read again for
    each of these steps; others are computed once.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(by), F.col(value).alias("value"))
    seen = rows.groupBy(by).agg(F.approx_count_distinct("value").alias("d"))
    top = seen.agg(F.max("d"), F.min("d"), F.count("*")).first()
    if not top[0] or top[0] <= 0.9 * most:
        alike = rows.groupBy(by, "value").agg(F.count("*").alias("n"))
        return alike.groupBy(by).agg(F.percentile("value", F.array(*[F.lit(float(p)) for p in probabilities]), F.col("n")).alias("q"))
    if not scanned:
        rows = settled(rows)
    if top[1] <= 0.9 * most and top[2] <= 1000:
        many = [r[by] for r in seen.where(F.col("d") > 0.9 * most).collect()]  # a row for each of few groups
        wide = F.coalesce(F.col(by).isin(many), F.lit(False))
        ways = [exact_quantiles(rows.where(c).withColumnRenamed("value", value), probabilities, by, value, m, True) for c, m in ((wide, most), (~wide, 1 << 62))]
        return ways[0].unionByName(ways[1])
    ends = [min(1.0, max(0.0, p + e)) for p in probabilities for e in (-1e-3, 1e-3)]
    groups = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("top"), F.percentile_approx("value", F.array(*[F.lit(e) for e in ends]), 10_000).alias("a"))
    brackets = [F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at"), (F.col("least") if ends[2 * i] == 0 else F.col("a")[2 * i]).alias("low"), (F.col("top") if ends[2 * i + 1] == 1 else F.col("a")[2 * i + 1]).alias("high")) for i, p in enumerate(probabilities)]
    wanted = groups.select(by, F.array(*brackets).alias("xs"))
    joined, x = rows.join(small(wanted), by), F.col("xs")
    # one pass counts what lies below and inside each bracket; only rows inside one are made longer
    counts = [F.struct(F.lit(i).alias("i"), F.max(x[i]["at"]).alias("at"), F.count_if(F.col("value") < x[i]["low"]).alias("below"), F.count_if(F.col("value") <= x[i]["high"]).alias("upto")) for i in range(len(probabilities))]
    below = settled(joined.groupBy(by).agg(F.array(*counts).alias("c")).select(by, F.inline("c")))
    if not below.where((F.col("below") > F.floor("at")) | (F.col("upto") <= F.ceil("at"))).isEmpty():
        return exact_quantiles(rows.withColumnRenamed("value", value), probabilities, by, value, 1 << 62, True)  # an estimate beyond its error
    inside = joined.select(by, "value", F.explode(F.filter("xs", lambda e: F.col("value").between(e["low"], e["high"]))).alias("x")).select(by, "x.i", "value")
    near = numbered_rows(inside, [by, "i", "value"], "place")
    first = near.groupBy(by, "i").agg(F.min("place").alias("first"))
    placed = near.join(small(first.join(below, [by, "i"])), [by, "i"]).withColumn("k", F.col("place") - F.col("first") + F.col("below"))
    around = placed.where((F.col("k") == F.floor("at")) | (F.col("k") == F.ceil("at"))).groupBy(by, "i", "at").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    read = F.when(F.floor("at") == F.ceil("at"), F.col("lo")).otherwise((F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi"))
    return around.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", read.alias("v")))), lambda x: x["v"]).alias("q"))


#: Kinds of columns whose quantiles Spark estimates in one pass with bounded memory.
_MEASURED = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")


def last_of_share(keys: DataFrame, share: float, order: list[str]) -> dict[str, str | None] | None:
    """The order columns, as text, of the last of the first floor(share * n) rows; None where these are no rows.

    Only the order columns are read. Estimated quantiles of the leading one bracket the last row, and only the keys
    between them are sorted, by range.
    """
    keys, lead = keys.select(*order), order[0]
    kind = dict(keys.dtypes)[lead]
    near = F.lit(None)
    if kind.startswith(_MEASURED):
        near = F.percentile_approx(lead, F.array(*[F.lit(min(1.0, max(0.0, share + e))) for e in (-5e-4, 5e-4)]), 10_000).cast("array<string>")
    one = keys.agg(F.count("*").alias("n"), F.count(lead).alias("known"), near.alias("near")).first()
    wanted, between = int(share * one["n"]), F.lit(True)
    if not wanted:
        return None
    if one["near"] and one["known"] == one["n"]:
        low, high = (F.lit(x).cast(kind) for x in one["near"])
        under, to = keys.agg(F.count_if(F.col(lead) < low), F.count_if(F.col(lead) <= high)).first()
        if under < wanted <= to:
            between, wanted = F.col(lead).between(low, high), wanted - under
    at = spare(keys, "at")
    last = numbered_rows(keys.where(between), order, at).where(F.col(at) == wanted - 1)
    return last.select(*[F.col(c).cast("string").alias(c) for c in order]).first().asDict()


def up_to(df: DataFrame, order: list[str], last: dict[str, str | None]) -> Column:
    """Whether a row stands at or before the given one in the order, in which nulls come first."""
    kinds = dict(df.dtypes)
    value = {c: F.lit(last[c]).cast(kinds[c]) for c in order}
    before = {c: F.lit(False) if last[c] is None else F.col(c).isNull() | (F.col(c) < value[c]) for c in order}
    return reduce(lambda rest, c: before[c] | (F.col(c).eqNullSafe(value[c]) & rest), reversed(order), F.lit(True))


def first_share(df: DataFrame, share: float, order: list[str]) -> DataFrame:
    """The first floor(share * n) rows in a total order, as a filter by the last one's key, so that no row is moved."""
    last = last_of_share(df, share, order)
    return df.limit(0) if last is None else df.where(up_to(df, order, last))


def zip_checked(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by their place in either order; tables of unlike length are an error."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be zipped with {m}")
    at = spare(right, spare(left, "at"))
    return numbered_rows(left, left_order, at).join(numbered_rows(right, right_order, at), at).drop(at)


def concat_columns(frames: list[DataFrame], on: str) -> DataFrame:
    """The frames' columns side by side for each value of a unique key; a key that one frame lacks has nulls there."""
    out = frames[0]
    for f in frames[1:]:
        clash = set(out.columns) & set(f.columns) - {on}
        if clash:
            raise ValueError(f"columns in both: {sorted(clash)}")
        out = out.join(f, on, "full")
    return out


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows of a stated order."""
    return df.orderBy(*order).limit(n)
