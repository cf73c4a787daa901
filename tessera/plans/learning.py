"""Splits, resampling, neighbours, classifiers and their metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ml, tables
from tessera.plans.fixtures import table


def orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus")


def split_counts(s, d):
    out = ml.stratified_split(orders(s, d), "o_orderstatus", "o_orderkey")
    return out.groupBy("o_orderstatus").agg(F.count_if("test").alias("n_test"), F.count_if(~F.col("test")).alias("n_train"))


def weights(s, d):
    return ml.class_weights(orders(s, d), "o_orderstatus", 0.5).select("o_orderstatus", "n", F.round("weight", 9).alias("weight"))


def targets(s, d):
    return ml.resample_targets(orders(s, d), "o_orderstatus")


def under(s, d):
    return ml.undersample(orders(s, d), "o_orderstatus", "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def said(s, d):
    """Line status against a guess from the return flag."""
    guess = F.when((F.col("l_returnflag") == "N") | (F.col("l_partkey") % 5 == 0), "O").otherwise("F")
    return table(s, d, "lineitem").select(F.col("l_linestatus").alias("actual"), guess.alias("guess"))


SAID = "(select l_linestatus actual, case when l_returnflag = 'N' or l_partkey % 5 = 0 then 'O' else 'F' end guess from lineitem)"


def matrix(s, d):
    return ml.confusion(said(s, d), "actual", "guess", ["F", "O"])


def class_report(s, d):
    return ml.classification_report(matrix(s, d)).select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


_REPORT = f"(select c as class, count(*) filter (actual = c and guess = c) / count(*) filter (guess = c) as precision, count(*) filter (actual = c and guess = c) / count(*) filter (actual = c) recall, count(*) filter (actual = c) support from {SAID}, (values ('F'), ('O')) k(c) group by 1)"


def overall(s, d):
    return ml.overall_metrics(matrix(s, d)).select(*[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])


def vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "embedding", "label")


def knn(s, d):
    rows = vectors(s, d)
    return ml.knn_predict(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", "label", 5).select(F.col("query").alias("vec_id"), "predicted")


def choice(s, d):
    out = ml.choose_k(vectors(s, d), "vec_id", "embedding", "label", list(range(1, 10)), fold=F.col("vec_id") % 5)
    return out.select("k", F.round("accuracy", 9).alias("accuracy"))


_DIST = "round(sqrt(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: (p[1]::double - p[2]) * (p[1]::double - p[2])))), 9)"
KNN = f"with n as (select q.vec_id, r.label from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 100 = 0 qualify row_number() over (partition by q.vec_id order by {_DIST}, r.vec_id) <= 5), c as (select vec_id, label, count(*) k from n group by all) select vec_id, label predicted from c qualify row_number() over (partition by vec_id order by k desc, label) = 1"


CHOICE = f"with n as (select q.vec_id, q.label truth, r.label, row_number() over (partition by q.vec_id order by {_DIST}, r.vec_id) i from embeddings q join embeddings r on q.vec_id % 5 <> r.vec_id % 5 qualify i <= 9), c as (select cast(k as int) k, vec_id, truth, label, count(*) m from n, range(1, 10) t(k) where i <= k group by all), p as (select k, truth, label from c qualify row_number() over (partition by k, vec_id order by m desc, label) = 1) select k, round(avg(cast(label = truth as double)), 9) accuracy from p group by k"


def scale(s, d):
    rows = table(s, d, "customer")
    return ml.scaled(rows, ml.fit_scaler(rows.where("c_custkey % 5 <> 0"), ["c_acctbal"])).select("c_custkey", (F.round("c_acctbal", 6) + 0.0).alias("c_acctbal"))


def folds(s, d):
    return ml.expanding_folds(orders(s, d).select("o_orderkey"), ["o_orderkey"], 4).groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


FOLDS = "with n as (select count(*) n from orders), r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 i from orders) select cast(case when i < n - 4 * (n // 5) then 0 else (i - (n - 4 * (n // 5))) // (n // 5) + 1 end as int) part, count(*) n, min(o_orderkey) low, max(o_orderkey) high from r, n group by 1"


def fitted(kind):
    """Learned from, and measured on, distinct rows that stand for their number of rows each."""

    def run(s, d):
        rows = table(s, d, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
        rows = rows.select("key", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
        split = ml.stratified_split(rows, "l_linestatus", "key")
        alike = ml.counted(split, ["l_quantity", "l_discount", "l_returnflag", "l_linestatus", "test"])
        parts = tables.settled(ml.weighted(alike, ml.class_weights(alike.where("not test"), "l_linestatus", n="n"), "l_linestatus"))
        train, test = parts.where("not test"), parts.where("test")
        inputs, balanced = (["l_quantity", "l_discount"], ["l_returnflag"], "l_linestatus"), kind == "tuned_forest"
        if "forest" in kind:
            ready = Pipeline(stages=ml.pipeline(*inputs, ml.classifier(kind)).getStages()[:-1]).fit(train)
            out = ml.bagged_forest(ml.classifier(kind, labelCol="label"), ready.transform(train), ready.transform(test), "n", "weight" if balanced else None)
            out = out.withColumn("predicted", F.element_at(F.array(F.lit("F"), F.lit("O")), (F.col("prediction") + 1).cast("int")))
        else:
            out = ml.predicted(ml.pipeline(*inputs, ml.classifier(kind, weightCol="n")).fit(train), test, ["F", "O"])
        return ml.overall_metrics(ml.confusion(out, "l_linestatus", "predicted", ["F", "O"], "n"))

    return run


#: The labels regrouped, so that one class outweighs the others; no row is left out.
SKEWED = "case when label < 6 then 0 else label end"


def synthetic(s, d):
    """Rows made for each class, and how many of them lie between their two rows."""
    rows = vectors(s, d).withColumn("label", F.expr(SKEWED))
    made = ml.smote(rows, "vec_id", "embedding", "label")
    ends = lambda c, v: rows.select(F.col("vec_id").alias(c), F.col("embedding").alias(v))
    there = F.zip_with(F.zip_with("qv", "nv", lambda a, b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))), "embedding", lambda e, x: x.between(e["lo"].cast("double") - 1e-6, e["hi"].cast("double") + 1e-6))
    both = made.join(ends("query", "qv"), "query").join(ends("near", "nv"), "near").where("query <> near")
    return both.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.forall(there, lambda x: x)).alias("n_between"))


#: The classes of the skewed labels, by name.
SAID_SKEWED = f"cast({SKEWED} as string)"
CLASSES = ["0", "6", "7", "8", "9"]


def skewed(s, d):
    return vectors(s, d).select("vec_id", "embedding", F.expr(SAID_SKEWED).alias("label"))


def fold_rows(s, d):
    """Training rows of each class in each fold, as each strategy resamples them."""
    made = ml.resampled_folds(skewed(s, d), "vec_id", "embedding", "label", 3)
    each = [train.groupBy("label").agg(F.count("*").alias("n")).select(F.lit(name).alias("strategy"), F.lit(i).alias("fold"), "label", "n") for (name, i), (train, _) in made.items()]
    return reduce(DataFrame.unionByName, each)


FOLD_ROWS = f"""with c as (select {SAID_SKEWED} label, count(*) n from embeddings group by 1),
 f as (select cast(fold as int) fold, label, n - n // 3 - cast(fold < n % 3 as int) n from c, range(3) r(fold)),
 t as (select fold, label, n, min(n) over (partition by fold) low, case when n > 1 then greatest(n, cast(floor(max(n) over (partition by fold) * 0.75) as bigint)) else n end lifted from f)
 select 'Random undersampling' strategy, fold, label, low n from t union all select 'SMOTE', fold, label, lifted from t
 union all select 'Hybrid SMOTE + undersampling', fold, label, min(lifted) over (partition by fold) from t"""


def _as_vector(df):
    return df.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


def compared(s, d):
    """The three strategies by the cross-validated scores of a forest."""
    labels = StringIndexerModel.from_labels(CLASSES, inputCol="label", outputCol="target", handleInvalid="skip")

    def fit(train):
        model = RandomForestClassifier(labelCol="target", numTrees=20, maxDepth=6, seed=42).fit(labels.transform(_as_vector(train)))
        names = F.array(*[F.lit(c) for c in CLASSES])
        return lambda df: model.transform(_as_vector(df)).withColumn("predicted", F.element_at(names, (F.col("prediction") + 1).cast("int")))

    return ml.cross_validated(ml.resampled_folds(skewed(s, d), "vec_id", "embedding", "label", 3), "label", CLASSES, "9", fit)


#: Distributions of a tree's parameters.
TREES = {"maxDepth": (2, 12), "minInstancesPerNode": [1, 2, 4, 8, 16], "maxBins": [16, 32, 64], "impurity": ["gini", "entropy"], "minInfoGain": (0.0, 0.01)}


def searched(s, d):
    """Thirty candidates of a tree over four expanding folds of the orders in time."""
    rows = table(s, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("price"), F.month("o_orderdate").alias("month"), (F.col("o_custkey") % 7).alias("group"), "o_orderstatus")
    labels = StringIndexerModel.from_labels(["F", "O", "P"], inputCol="o_orderstatus", outputCol="target", handleInvalid="skip")
    parts = tables.settled(labels.transform(ml.expanding_folds(rows, ["o_orderdate", "o_orderkey"])).select("part", "price", "month", "group", "target"))

    def prepared(train, test):
        """Distinct rows with the training rows' 64 bins for the price; a tree splits at no other places."""
        price = ml.binned(train, "price")
        both = train.select(F.lit(False).alias("test"), price.alias("price"), "month", "group", "target").unionByName(test.select(F.lit(True).alias("test"), price.alias("price"), "month", "group", "target"))
        alike = ml.counted(both, ["test", "price", "month", "group", "target"])
        return alike.where("not test"), alike.where("test")

    def fit(params, train):
        coarse = lambda df: VectorAssembler(inputCols=["bin", "month", "group"], outputCol="features").transform(df.withColumn("bin", F.floor(F.col("price") * params["maxBins"] / ml.BINS)))
        model = DecisionTreeClassifier(labelCol="target", weightCol="weight", seed=42, **params).fit(coarse(ml.parted(train, "n", params["minInstancesPerNode"])))
        return lambda df: model.transform(coarse(df))

    def score(said):
        return ml.scores_of(said, "target", "prediction", [0.0, 1.0, 2.0], "n")["macro_f1"]

    return ml.randomised_search(parts, ml.draws(TREES), fit, score, prepared=prepared)


QUERIES = {
    "strategy_folds": (fold_rows, FOLD_ROWS),
    "resampling_comparison": (compared, None),
    "randomised_search": (searched, None),
    "stratified_split_counts": (split_counts, "select o_orderstatus, cast(ceil(count(*) * 0.2) as bigint) n_test, count(*) - cast(ceil(count(*) * 0.2) as bigint) n_train from orders group by 1"),
    "class_weights": (weights, "select o_orderstatus, count(*) n, round(1 + 0.5 * (sum(count(*)) over () / (count(*) over () * count(*)) - 1), 9) weight from orders group by 1"),
    "resample_targets": (targets, "select o_orderstatus, count(*) n, greatest(count(*), cast(floor(max(count(*)) over () * 0.75) as bigint)) smote_target, min(count(*)) over () under_target from orders group by 1"),
    "undersample": (under, "select o_orderstatus, min(count(*)) over () n from orders group by 1"),
    "confusion_matrix": (matrix, f"select a as actual, p as predicted, count(guess) n from (values ('F'), ('O')) x(a) cross join (values ('F'), ('O')) y(p) left join {SAID} s on s.actual = a and s.guess = p group by all"),
    "classification_report": (class_report, f"select class, round(precision, 9) as precision, round(recall, 9) recall, round(2 * precision * recall / (precision + recall), 9) f1, support from {_REPORT}"),
    "overall_metrics": (overall, f"select round(sum(recall * support) / sum(support), 9) accuracy, round(avg(recall), 9) balanced_accuracy, round(avg(2 * precision * recall / (precision + recall)), 9) macro_f1, round(sum(2 * precision * recall / (precision + recall) * support) / sum(support), 9) weighted_f1 from {_REPORT}"),
    "knn_vote": (knn, KNN),
    "knn_choose_k": (choice, CHOICE),
    "standard_scale": (scale, "with m as (select avg(c_acctbal) m, stddev_pop(c_acctbal) s from customer where c_custkey % 5 <> 0) select c_custkey, round((c_acctbal - m) / s, 6) + 0.0 c_acctbal from customer, m"),
    "expanding_folds": (folds, FOLDS),
    "smote": (synthetic, f"with c as (select {SKEWED} label, count(*) n from embeddings group by 1), t as (select label, n, greatest(n, cast(floor(max(n) over () * 0.75) as bigint)) - n more from c) select label, more n, more n_between from t where more > 0 and n > 1"),
    **{f"{k}_fit": (fitted(k), None) for k in ("logistic", "tree", "forest", "tuned_forest", "boosted")},
}
