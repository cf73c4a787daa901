"""Splits, scaling, classifiers, neighbours, resampling and classification metrics."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import prod
from statistics import fmean, pstdev
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.operators.nearest import bags_of, nearest
from tessera.operators.tables import numbered_rows, settled, small, spare


#: Buckets of a hash, in which rows are counted before the one where a class's last chosen row lies is sorted.
BUCKETS = 1 << 16


def lowest_by_hash(df: DataFrame, label: str, key: str, wanted: DataFrame, seed: int) -> DataFrame:
    """Adds `chosen`: for each class as many rows as `wanted` (label, k) says, those of lowest key hash.

    Rows are counted by class and leading bits of the hash; below the bucket that holds a class's last row all are
    chosen, and only that bucket's rows are ranked, so no window holds a class.
    """
    h, b, c, rest, last, before = (spare(df, x) for x in ("hash", "bucket", "of", "rest", "edge", "before"))
    hashed = df.withColumn(h, F.xxhash64(key, F.lit(seed))).withColumn(b, F.shiftright(h, 48))
    counts = hashed.groupBy(F.col(label).alias(c), b).agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy(c).orderBy(b)) - F.col("n")  # at most BUCKETS rows a class
    asked = wanted.select(F.col(label).alias(c), F.col("k"))
    edge = counts.withColumn(before, below).join(asked, c).where((F.col(before) < F.col("k")) & (F.col(before) + F.col("n") >= F.col("k")))
    edge = small(edge.select(c, F.col(b).alias(last), (F.col("k") - F.col(before)).alias(rest)))
    placed = hashed.join(edge, hashed[label] == edge[c], "left")
    inside = F.coalesce(F.col(b) == F.col(last), F.lit(False))
    sure = placed.where(~inside).withColumn("chosen", F.coalesce(F.col(b) < F.col(last), F.lit(False)))
    ranked = F.row_number().over(Window.partitionBy(label).orderBy(h, key))
    near = placed.where(inside).withColumn("chosen", ranked <= F.col(rest))  # one bucket of each class
    return sure.unionByName(near).drop(h, b, c, last, rest)


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `test`: exactly ceil(share * n) rows of each class, chosen by the hash of their key."""
    sizes = df.groupBy(label).agg(F.ceil(F.count("*") * test_share).alias("k"))
    return lowest_by_hash(df, label, key, sizes, seed).withColumnRenamed("chosen", "test")


def fit_scaler(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature, from one aggregate; a constant feature has scale 1."""
    one = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    return {c: (one[f"m_{c}"] or 0.0, one[f"s_{c}"] or 1.0) for c in features}


def scaled(df: DataFrame, state: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in state.items()})


def classifier(kind: str, classes: int = 2, **options) -> Estimator:
    """logistic, tree, forest, tuned_forest (balanced through weights), or boosted (one against the rest if over two)."""
    made: dict[str, Callable[[], Estimator]] = {
        "logistic": lambda: LogisticRegression(**options),
        "tree": lambda: DecisionTreeClassifier(**{"maxDepth": 3, "impurity": "gini", "seed": 42, **options}),
        "forest": lambda: RandomForestClassifier(**{"numTrees": 100, "seed": 42, **options}),
        "tuned_forest": lambda: RandomForestClassifier(**{"numTrees": 450, "maxDepth": 10, "minInstancesPerNode": 2, "featureSubsetStrategy": "0.75", "weightCol": "weight", "seed": 42, **options}),
        "boosted": lambda: GBTClassifier(**{"seed": 42, **options}) if classes == 2 else OneVsRest(classifier=GBTClassifier(**{"seed": 42, **options})),
    }
    return made[kind]()


def pipeline(numeric: list[str], categories: list[str], label: str, model: Estimator) -> Pipeline:
    """Index and one-hot of categories (unseen ones get a slot of their own), assembly, model; labels in order of name."""
    index = [StringIndexer(inputCols=categories, outputCols=[f"{c}__i" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__i" for c in categories], outputCols=[f"{c}__v" for c in categories], handleInvalid="keep")] if categories else []
    labels = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
    return Pipeline(stages=[labels, *index, VectorAssembler(inputCols=[*numeric, *[f"{c}__v" for c in categories]], outputCol="features", handleInvalid="skip"), model])


def check_model(model, columns: list[str], df: DataFrame, classes: list[str]) -> None:
    """The contract of a loaded model: its input columns are there and its classes are the expected ones."""
    lacking = set(columns) - set(df.columns)
    labels = classes_of(model) or classes
    if lacking or labels != classes:
        raise ValueError(f"model contract: missing {sorted(lacking)}, classes {labels}")


def predicted(model: Model, df: DataFrame, classes: list[str]) -> DataFrame:
    """Adds prediction by name, probabilities by class (0 to 1), and the highest."""
    p = F.transform(vector_to_array(F.col("probability")), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    names = F.array(*[F.lit(c) for c in classes])
    # rows to be scored have no label yet, and the stage that reads it is not needed
    stages = [s for s in getattr(model, "stages", [model]) if not (_indexes_label(s) and set(_named(s, "inputCol")) - set(df.columns))]
    out = PipelineModel(stages).transform(df).withColumn("__p", p)
    return out.withColumns({"predicted": F.element_at(names, (F.col("prediction") + 1).cast("int")), "probabilities": F.map_from_arrays(names, F.slice("__p", 1, len(classes))), "max_probability": F.array_max("__p")}).drop("__p")


def argmax(probabilities: Column) -> Column:
    """Place of the highest value, from 0; the first of equals."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows alike in the columns as one, with their number n. What a model learns from rows it learns from these, weighed by
    n; the work of its passes then follows the distinct rows."""
    return settled(df.groupBy(*columns).agg(F.count("*").alias("n")))


#: Bins of a feature; fewer, by halves, are these joined.
BINS = 64


def binned(train: DataFrame, column: str) -> Column:
    """The bin, 0 to 63, of a value: how many of the training rows' estimated 64-quantiles lie below it."""
    edges = train.agg(F.percentile_approx(column, F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), 10_000)).first()[0] or []
    below = F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(column))
    return F.when(F.col(column).isNotNull(), F.size(below)).cast("int")


def parted(df: DataFrame, n: str, least: int, weight: str = "weight") -> DataFrame:
    """Rows that stand for n each, as at most `least` rows that share n as weight, so that a leaf of so many rows is told as
    it is among single rows."""
    m = F.least(F.col(n), F.lit(least))
    return df.withColumn(weight, F.col(n) / m).select("*", F.explode(F.array_repeat(F.lit(0), m.cast("int"))).alias(spare(df, "i"))).drop(spare(df, "i"))


def bagged_forest(forest: RandomForestClassifier, train: DataFrame, test: DataFrame, n: str = "n", weight: str | None = None, together: int = 25, parallel: int = 8) -> DataFrame:
    """`test` with probabilities (an array) and prediction of the forest, trained on distinct rows that stand for n each.

    A row enters a tree as often as a Poisson number of mean 1 says, so n rows alike enter it as often as one of mean n
    says: the bags are those of the single rows. Trees are grown side by side on their bag, its numbers as weights (times
    `weight`); a row in the bag several times is parted into as many as a leaf needs, so that leaves are allowed as they were.
    """
    trees, least, seed = forest.getNumTrees(), forest.getMinInstancesPerNode(), forest.getSeed()
    ways = forest.getFeatureSubsetStrategy()
    ways = ("sqrt" if trees > 1 else "all") if ways == "auto" else ways
    own = ("features", forest.getLabelCol(), n, *([weight] if weight else []))
    bags = settled(train.select(*own).withColumn("__key", F.xxhash64(vector_to_array("features"), forest.getLabelCol())).withColumn("__bags", bags_of(trees, seed)("__key", n)))
    rows = settled(test.withColumn("__row", F.monotonically_increasing_id()))
    classes = int(bags.agg(F.max(forest.getLabelCol())).first()[0]) + 1
    one = forest.copy({forest.numTrees: 1, forest.bootstrap: False, forest.featureSubsetStrategy: ways, forest.weightCol: "__w", forest.predictionCol: "", forest.rawPredictionCol: ""})

    def some(first: int) -> DataFrame:
        out, names = rows.select("__row", "features"), range(first, min(trees, first + together))
        for t in names:
            times = F.col("__bags")[t]
            bag = bags.where(times > 0).withColumn("__m", F.least(times, F.lit(least))).withColumn("__w", times / F.col("__m") * (F.col(weight) if weight else F.lit(1.0)))
            bag = bag.select(*own[:2], "__w", F.explode(F.array_repeat(F.lit(0), F.col("__m"))))
            out = one.copy({one.seed: seed + t, one.probabilityCol: f"__p{t}"}).fit(bag).transform(out)
        said = [vector_to_array(F.col(f"__p{t}")) for t in names]
        return settled(out.select("__row", *[reduce(lambda a, b: a + b, [F.coalesce(p[c], F.lit(0.0)) for p in said]).alias(f"__c{c}") for c in range(classes)]))

    sums = reduce(DataFrame.unionByName, side_by_side(train.sparkSession, some, list(range(0, trees, together)), parallel))
    shares = sums.groupBy("__row").agg(F.array(*[F.sum(f"__c{c}") / trees for c in range(classes)]).alias("probabilities"))
    return rows.join(shares, "__row").drop("__row").withColumn("prediction", argmax(F.col("probabilities")).cast("double"))


def confusion(df: DataFrame, actual: str, pred: str, classes: list[str], n: str | None = None) -> DataFrame:
    """(actual, predicted, n) over the full grid of classes; a row stands for `n` rows, if named."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in classes for p in classes], "actual string, predicted string")
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(pred).alias("predicted")).agg((F.sum(n) if n else F.count("*")).alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Per class: precision, recall, f1, support; undefined values are 0."""
    rows = matrix.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    cols = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    out = rows.join(cols, "class").select("class", ratio(F.col("hits"), F.col("said")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), "support")
    total = F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / total, F.lit(0.0)))


def overall_metrics(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro and weighted averages."""
    r = classification_report(matrix)
    n = F.sum("support")
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / n)
    return r.agg(w("recall").alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("precision").alias("macro_precision"), F.avg("f1").alias("macro_f1"), w("precision").alias("weighted_precision"), w("f1").alias("weighted_f1"))


def class_weights(df: DataFrame, label: str, softness: float = 1.0, n: str | None = None) -> DataFrame:
    """n / (classes * n_class), drawn towards 1 by 1 + softness * (w - 1); a row stands for `n` rows, if named."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg((F.sum(n) if n else F.count("*")).alias("n"))
    total = Window.partitionBy()  # a row for each class
    w = F.sum("n").over(total) / (F.count("*").over(total) * F.col("n"))
    return counts.withColumn("weight", 1 + softness * (w - 1))


def weighted(df: DataFrame, weights: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Each row with its class's weight; a class that has none weighs 1."""
    own = weights.select(F.col(label).alias(spare(df, "of")), F.col("weight").alias(spare(df, "own")))
    joined = df.join(small(own), df[label] == own[own.columns[0]], "left")
    return joined.select(*df.columns, F.coalesce(own.columns[1], F.lit(1.0)).alias(name))


def resample_targets(df: DataFrame, label: str, share: float = 0.75) -> DataFrame:
    """Per class: rows now, target of oversampling (a share of the largest class), target of undersampling."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # a row for each class
    return counts.select(label, "n", F.greatest("n", F.floor(F.max("n").over(every) * share)).alias("smote_target"), F.min("n").over(every).alias("under_target"))


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class down to the smallest one's size, by the hash of the key."""
    targets = resample_targets(df, label).select(label, F.col("under_target").alias("k"))
    return lowest_by_hash(df, label, key, targets, seed).where("chosen").drop("chosen")


#: Most rows of a block that queries meet; its vectors lie in one task. Few rows are dealt to about so many blocks of 1024 at least.
BLOCK_ROWS = 32768
BLOCKS = 32


def neighbours(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, within: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(query, key, d, rank, carried columns): the k nearest rows of each query; rows with the query's own key are left out.

    A stated set of queries meets all rows (of its own group, if `within` names one) in blocks: a block's rows lie in one
    task, its queries stream past them, and the k best of a block go on as one row for each query, so that no pair of a
    query and a row is a row itself. The bests are then ranked. Nothing is collected. Vectors that are null, hold a null
    or no finite number, or are shorter than the longest have no distance (d is null) and come last, by key.
    """
    group = F.col(within) if within else F.lit(0)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
    per, dim = min(BLOCK_ROWS, max(1024, -(-size["n"] // BLOCKS))), max(1, size["dim"] or 1)
    counts = rows.where(group.isNotNull()).groupBy(group.alias("__g")).agg(F.ceil(F.count("*") / per).cast("int").alias("__blocks"))
    sizes = settled(counts.withColumn("__from", F.sum("__blocks").over(Window.orderBy("__g")).cast("int") - F.col("__blocks")))  # a row for each group
    blocks = max(1, sizes.agg(F.sum("__blocks")).first()[0] or 1)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    numbers = F.when((F.size(vector) == dim) & F.forall(vector, finite), F.col(vector)).alias("vector")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    nulls = [F.lit(None).cast(kinds[c]).alias(f"__{c}") for c in carry]
    of = F.col("__from") + F.pmod(F.xxhash64("key", "vector"), F.col("__blocks"))
    known = rows.where(F.col(key).isNotNull()).select(group.alias("__g"), F.lit(False).alias("asks"), F.col(key).alias("key"), numbers, *[F.col(c).alias(f"__{c}") for c in carry])
    asked = queries.where(F.col(key).isNotNull()).select(group.alias("__g"), F.lit(True).alias("asks"), F.col(key).cast(kinds[key]).alias("key"), numbers, *nulls)
    held = known.join(small(sizes), "__g").withColumn("place", of.cast("int"))
    copied = asked.join(small(sizes), "__g").withColumn("place", F.explode(F.sequence("__from", F.col("__from") + F.col("__blocks") - 1)))
    met = held.unionByName(copied).drop("__g", "__blocks", "__from").repartitionById(blocks, F.col("place")).sortWithinPartitions("place", "asks")
    names = [f"__{c}" for c in carry]
    found = StructType([StructField("d", DoubleType()), StructField("key", kinds[key]), *[StructField(f"__{c}", kinds[c]) for c in carry]])
    near = met.mapInArrow(nearest(names, k, dim), StructType([StructField("query", kinds[key]), StructField("found", ArrayType(found))]))
    best = near.groupBy("query").agg(F.flatten(F.collect_list("found")).alias("xs")).select("query", F.posexplode(F.slice(F.array_sort("xs"), 1, k)).alias("i", "x"))
    return best.select("query", F.col("x.key").alias(key), F.when(~F.isnan("x.d"), F.col("x.d")).alias("d"), (F.col("i") + 1).alias("rank"), *[F.col(f"x.__{c}").alias(c) for c in carry])


def knn_predict(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str, k: int) -> DataFrame:
    """(query, predicted) by the majority of the k nearest; ties go to the smaller label."""
    near = neighbours(queries, rows, key, vector, k, carry=(label,))
    return near.groupBy("query").agg(F.mode(label, True).alias("predicted"))


def fold_of(key: str, folds: int):
    """The fold of a row: by the CRC-32 of its key's text."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def choose_k(rows: DataFrame, key: str, vector: str, label: str, ks: list[int], folds: int = 5, fold: Column | None = None) -> DataFrame:
    """(k, accuracy) by cross-validation over folds, hashed ones unless `fold` gives another number; the neighbours are found once, for the largest k.

    A row is asked once against each other fold, and its nearest of all those are ranked.
    """
    own = (fold_of(key, folds) if fold is None else fold).cast("int")
    asked = rows.select(key, vector, F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda g: g != own)).alias("__fold"))
    known = rows.select(key, vector, label, own.alias("__fold"))
    near = neighbours(asked, known, key, vector, max(ks), "__fold", (label,))
    truth = rows.select(F.col(key).alias("query"), F.col(label).alias("truth"))
    votes = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k").groupBy("k", "query").agg(F.mode(label, True).alias("p")).join(truth, "query")
    return votes.groupBy("k").agg(F.avg((F.col("p") == F.col("truth")).cast("double")).alias("accuracy"))


def smote(df: DataFrame, key: str, vector: str, label: str, share: float = 0.75, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows (label, query, near, u, vector) that lift each class to its target: points between a row and a
    neighbour of its class, u of the way.

    The neighbour is one of the k nearest, or of all where a class has fewer; a class of one row has none and is not
    lifted. Every row of a class is taken equally often, and the rows of lowest key hash once more for what remains.
    """
    wanted = resample_targets(df, label, share).select(label, (F.col("smote_target") - F.col("n")).alias("more"), "n").where("more > 0 and n > 1")
    rows = df.join(small(wanted), label)
    extra = lowest_by_hash(rows, label, key, wanted.select(label, (F.col("more") % F.col("n")).alias("k")), seed)
    times = (F.floor(F.col("more") / F.col("n")) + F.col("chosen").cast("int")).cast("int")
    base = extra.where(times > 0).withColumn("i", F.explode(F.sequence(F.lit(1), times))).select(F.col(key).alias("query"), F.col(vector).alias("qv"), label, "i", "n")
    # neighbours are told by key and print, and only those picked get their vector again
    print_ = spare(rows, "print")
    marked = rows.withColumn(print_, F.xxhash64(vector))
    near = neighbours(marked, marked, key, vector, k, label, (print_,)).select("query", "rank", F.col(key).alias("near"), F.col(print_).alias("np"))
    ends = marked.select(F.col(key).alias("near"), F.col(print_).alias("np"), F.col(vector).alias("nv")).dropDuplicates(["near", "np"])
    u = lambda s: (F.pmod(F.xxhash64("query", "i", F.lit(seed + s)), F.lit(1_000_003)) / 1_000_003.0)
    there = F.least(F.lit(k), F.col("n") - 1)  # a small class has fewer neighbours than k
    picked = base.withColumn("rank", (F.floor(u(1) * there) + 1).cast("int")).join(near, ["query", "rank"]).join(ends, ["near", "np"]).withColumn("u", u(2))
    return picked.select(label, "query", "near", "u", F.zip_with("qv", "nv", lambda a, b: a + (b - a) * F.col("u")).alias(vector))


def expanding_folds(df: DataFrame, order: list[str], folds: int = 4) -> DataFrame:
    """Adds `part` 0 to folds: fold i trains on parts up to i and tests on part i + 1. Cut by quantiles of the row's rank.

    The rank comes from a range-partitioned sort and per-partition offsets, so no task holds all rows.
    """
    n = df.count()
    size = n // (folds + 1)
    first = n - folds * size
    name = spare(df, "at")
    at = F.col(name)
    part = F.when(at < first, 0).otherwise(F.floor((at - first) / max(1, size)) + 1)
    return numbered_rows(df, order, name).withColumn("part", part.cast("int")).drop(name)


def search(df: DataFrame, candidates: list[dict], score: Callable[[dict, DataFrame, DataFrame], float], folds: int = 4, prepared: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> list[tuple[float, dict]]:
    """Mean score of each candidate over the expanding folds of `part`, the best first. `prepared` makes of a fold's training
    and test rows, once, what all candidates are given."""
    pairs = [(df.where(F.col("part") <= i), df.where(F.col("part") == i + 1)) for i in range(folds)]
    if prepared:
        pairs = [prepared(*pair) for pair in pairs]
    out = []
    for c in candidates:
        scores = [score(c, *pair) for pair in pairs]
        out.append((sum(scores) / folds, c))
    return sorted(out, key=lambda x: -x[0])


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold`: the rows of each class, in the order of their key's hash, go to the folds in turn, so that the folds'
    sizes differ by one row a class at most. Rows are numbered by range, so no class is held by a task."""
    h, at, first = (spare(df, x) for x in ("h", "at", "first"))
    placed = numbered_rows(df.withColumn(h, F.xxhash64(key, F.lit(seed))), [label, h, key], at)
    starts = small(placed.groupBy(F.col(label).alias(spare(df, "of"))).agg(F.min(at).alias(first)))
    return placed.join(starts, placed[label].eqNullSafe(starts[starts.columns[0]])).select(*df.columns, ((F.col(at) - F.col(first)) % folds).cast("int").alias("fold"))


def smoted(df: DataFrame, key: str, vector: str, label: str, share: float = 0.75, k: int = 5) -> DataFrame:
    """(key, vector, label): the rows and the synthetic ones that lift small classes; synthetic rows have keys of text."""
    made = smote(df, key, vector, label, share, k)
    new = made.select(F.concat_ws("~", "query", "near", F.format_string("%.9f", "u")).alias(key), F.col(vector), label)
    return df.select(F.col(key).cast("string").alias(key), F.col(vector).cast("array<double>").alias(vector), label).unionByName(new)


def strategies(key: str, vector: str, label: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """How a training table (key, vector, label) is resampled: undersampling, SMOTE, and SMOTE with undersampling after it."""
    plain = lambda df: df.select(F.col(key).cast("string").alias(key), F.col(vector).cast("array<double>").alias(vector), label)
    done, locks, one = {}, {}, Lock()

    def lifted(df: DataFrame) -> DataFrame:
        """Both ways that lift the same table share its rows, which are made once."""
        with one:
            lock = locks.setdefault(id(df), Lock())
        with lock:
            if id(df) not in done:
                done[id(df)] = (df, settled(smoted(df, key, vector, label)))  # df is held, so its id is not given again
            return done[id(df)][1]

    return {
        "Random undersampling": lambda df: undersample(plain(df), label, key),
        "SMOTE": lifted,
        "Hybrid SMOTE + undersampling": lambda df: undersample(lifted(df), label, key),
    }


def side_by_side(spark, work: Callable, tasks: list, parallel: int = 8) -> list:
    """work(task) for each task, so many at a time, each by Spark jobs of its own; results in order."""
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), tasks))


def resampled_folds(df: DataFrame, key: str, vector: str, label: str, folds: int = 5) -> dict[tuple[str, int], tuple[DataFrame, DataFrame]]:
    """(strategy, fold) to its training rows, resampled within the fold alone and computed once, and its test rows as they
    are."""
    parts = settled(stratified_folds(df.select(key, vector, label), label, key, folds))
    trains = [parts.where(F.col("fold") != i).drop("fold") for i in range(folds)]
    ways = strategies(key, vector, label)
    tasks = [(name, i) for name in ways for i in range(folds)]
    made = side_by_side(df.sparkSession, lambda t: settled(ways[t[0]](trains[t[1]])), tasks)
    return {t: (train, parts.where(F.col("fold") == t[1])) for t, train in zip(tasks, made, strict=True)}


def scores_of(df: DataFrame, actual: str, pred: str, classes: list, rows: str | None = None) -> dict[str, float]:
    """Accuracy, balanced accuracy, macro-F1 and each class's recall, from one job that counts the matrix; undefined ones
    are 0. A row stands for `rows` rows, if named."""
    n = {(r["a"], r["p"]): r["n"] for r in df.groupBy(F.col(actual).alias("a"), F.col(pred).alias("p")).agg((F.sum(rows) if rows else F.count("*")).alias("n")).collect()}  # a row for each pair of classes
    ratio = lambda a, b: a / b if b else 0.0
    hits = {c: n.get((c, c), 0) for c in classes}
    recall = {c: ratio(hits[c], sum(v for (a, _), v in n.items() if a == c)) for c in classes}
    precision = {c: ratio(hits[c], sum(v for (_, p), v in n.items() if p == c)) for c in classes}
    f1 = [ratio(2 * recall[c] * precision[c], recall[c] + precision[c]) for c in classes]
    return {"accuracy": ratio(sum(hits.values()), sum(n.values())), "balanced_accuracy": fmean(recall.values()), "macro_f1": fmean(f1), **{f"recall_{c}": x for c, x in recall.items()}}


CV_COLUMNS = "strategy string, cv_accuracy double, cv_macro_f1 double, cv_balanced_accuracy double, cv_recall double, mean_fit_seconds double"


def cross_validated(made: dict[tuple[str, int], tuple[DataFrame, DataFrame]], label: str, classes: list[str], watched: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """One row for each strategy, the best macro-F1 first: means over the folds, recall of the class watched among them.

    `fit` gives a function that adds `predicted`.
    """
    spark, found = next(iter(made.values()))[0].sparkSession, {}
    for (name, _), (train, test) in made.items():
        began = time.monotonic()
        said = fit(train)
        took = time.monotonic() - began
        one = scores_of(said(test), label, "predicted", classes)
        found.setdefault(name, []).append((one["accuracy"], one["macro_f1"], one["balanced_accuracy"], one[f"recall_{watched}"], took))
    rows = [(name, *(sum(x) / len(x) for x in zip(*own, strict=True))) for name, own in found.items()]
    return spark.createDataFrame(rows, CV_COLUMNS).orderBy(F.desc("cv_macro_f1"), "strategy")


def draws(distributions: dict[str, list | tuple], n: int = 30, seed: int = 42) -> list[dict]:
    """n different candidates by seeded draws: from a list each value alike, from (low, high) of whole numbers each number,
    from (low, high) of others uniformly. Fewer where lists have no more combinations."""
    rng, out, seen = random.Random(seed), [], set()
    every = prod(len(d) if isinstance(d, list) else d[1] - d[0] + 1 if isinstance(d[0], int) else 1 << 62 for d in distributions.values())
    while len(out) < min(n, every):
        one = {k: rng.choice(d) if isinstance(d, list) else rng.randint(*d) if isinstance(d[0], int) else rng.uniform(*d) for k, d in sorted(distributions.items())}
        if (mark := repr(one)) not in seen:
            seen.add(mark)
            out.append(one)
    return out


SEARCH_COLUMNS = "rank int, candidate int, mean_test double, std_test double, mean_train double, mean_fit_seconds double, params string"


def randomised_search(parts: DataFrame, candidates: list[dict], fit: Callable[[dict, DataFrame], Callable[[DataFrame], DataFrame]], score: Callable[[DataFrame], float], folds: int = 4, parallel: int = 8, prepared: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """Candidates by their mean test score over the expanding folds of `part`; equal means share the better rank.

    `fit` gives a function that adds predictions, `score` reads them. The folds are filters of one table, which should be
    settled; candidates and folds are fitted side by side, so many at a time, each by Spark jobs of its own. `prepared`
    makes of a fold's training and test rows, once, what all candidates are given.
    """
    pairs = [(parts.where(F.col("part") <= i), parts.where(F.col("part") == i + 1)) for i in range(folds)]
    if prepared:
        pairs = [prepared(*pair) for pair in pairs]

    def one(task: tuple[int, int]) -> tuple[int, float, float, float]:
        c, i = task
        train, test = pairs[i]
        began = time.monotonic()
        said = fit(candidates[c], train)
        took = time.monotonic() - began
        return c, score(said(test)), score(said(train)), took

    tasks = [(c, i) for c in range(len(candidates)) for i in range(folds)]
    done = side_by_side(parts.sparkSession, one, tasks, parallel)
    by = [[x[1:] for x in done if x[0] == c] for c in range(len(candidates))]
    rows = [(c, fmean(x[0] for x in own), pstdev(x[0] for x in own), fmean(x[1] for x in own), fmean(x[2] for x in own), json.dumps(candidates[c], sort_keys=True)) for c, own in enumerate(by)]
    rows = [(1 + sum(o[1] > r[1] for o in rows), *r) for r in rows]
    return parts.sparkSession.createDataFrame(sorted(rows), SEARCH_COLUMNS)


def compare_strategies(train: DataFrame, test: DataFrame, label: str, strategies: dict[str, Callable[[DataFrame], DataFrame]], fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], classes: list[str]) -> DataFrame:
    """(strategy, train_rows, metrics), the best macro-F1 first: each strategy resamples the training rows, `fit` gives a
    function that adds `predicted`, and all are measured on the same test rows. Resampled rows are computed once; `train`
    and `test` should be settled."""
    tables = []
    for name, resample in strategies.items():
        own = resample(train)
        own = own if own is train else settled(own)  # a fit reads it several times
        out = fit(own)(test)
        one = overall_metrics(settled(confusion(out, label, "predicted", classes)))
        tables.append(one.select(F.lit(name).alias("strategy"), F.lit(own.count()).alias("train_rows"), "accuracy", "balanced_accuracy", "macro_f1"))
    return reduce(DataFrame.unionByName, tables).orderBy(F.desc("macro_f1"), "strategy")


def load_model(path: str, columns: list[str], classes: list[str]):
    """A stored pipeline whose contract holds: its label classes are the expected ones, its inputs the expected columns."""
    model = PipelineModel.load(path)
    labels = classes_of(model)
    # stages of this library's own say what they read and make
    made = {c for s in model.stages for c in (s.makes() if hasattr(s, "makes") else _named(s, "outputCol") + _named(s, "outputCols"))}
    asked = {c for s in model.stages for c in (s.reads() if hasattr(s, "reads") else _named(s, "inputCol") + _named(s, "inputCols"))} - made
    wanted = set(columns)
    target = next((c for s in model.stages if _indexes_label(s) for c in _named(s, "inputCol")), None)
    if labels != classes or asked - {target} != wanted:
        raise ValueError(f"model contract: classes {labels}, columns {sorted(asked - {target})}")
    return model


def _indexes_label(stage) -> bool:
    """An indexer of one column names the classes; those of inputs take several."""
    return hasattr(stage, "labelsArray") and bool(_named(stage, "inputCol"))


def classes_of(model) -> list[str] | None:
    """The classes of a pipeline, in the order of its probabilities."""
    return next((list(s.labelsArray[0]) for s in getattr(model, "stages", []) if _indexes_label(s)), None)


def inputs_of(stage) -> list[str]:
    """The columns that a stage reads."""
    return _named(stage, "inputCol") + _named(stage, "inputCols")


def learned_categories(model) -> dict[str, tuple[str, ...]]:
    """The categories that a pipeline's indexers of inputs have seen in training, sorted; a pipeline without one is an
    error."""
    found = {c: tuple(sorted(labels)) for s in model.stages if hasattr(s, "labelsArray") for c, labels in zip(_named(s, "inputCols"), s.labelsArray, strict=False)}
    if not found:
        raise ValueError("the model has no indexer of categories")
    return found


def _named(stage, param: str) -> list[str]:
    if not stage.hasParam(param) or not stage.isDefined(param):
        return []
    value = stage.getOrDefault(param)
    return [value] if isinstance(value, str) else list(value)
