"""Small hand-made cases of the operators' rules."""

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as f
from tessera.operators import drift, ml, profile, rules, tables, text
from tessera.sources import files, store
from tessera.streaming import windows


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, f.half_even(F.lit(0.125), 2)) == 0.12
    assert one(spark, f.to_number(F.lit("5d"))) is None and one(spark, f.to_number(F.lit(" 1e3 "))) == 1000
    assert one(spark, f.safe_div(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, f.weekday(F.lit("2024-01-06").cast("date"))) == 5
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, f.whole_days(t("2024-01-01 00:00:00"), t("2024-01-01 06:00:00"))) == -1
    assert one(spark, f.canonical_category(F.lit(3.0), "double")) == "3"
    assert one(spark, f.clip(F.lit(None).cast("int"), 0, 5)) is None and one(spark, f.clip(F.lit(9), 0, 5)) == 5
    assert [one(spark, f.quarter_of_month(F.lit(m))) for m in (1, 3, 4, 12)] == [1, 1, 2, 4]
    for key in (b"k", b"k" * 100):
        assert one(spark, f.hmac_sha256(key, F.lit("héllo"))) == hmac.new(key, "héllo".encode(), hashlib.sha256).hexdigest()
    assert one(spark, f.canonical_json(b=F.lit(1), a=F.lit(None).cast("string"))) == '{"a":null,"b":1}'


def test_brackets_leave_out_the_lowest_edge(spark):
    got = spark.createDataFrame([(18,), (19,), (25,), (26,)], "age int").select(tables.interval_label("age", [18, 25, 35]).alias("b"))
    assert [r["b"] for r in got.collect()] == [None, "(18, 25]", "(18, 25]", "(25, 35]"]


def test_outliers_in_turn(spark):
    rows = [(float(i % 10), float(i)) for i in range(99)] + [(1000.0, 5000.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert profile.drop_outliers_in_turn(df, ["a", "b"]).count() == 99
    assert profile.drop_outliers_in_turn(df, ["a"], below_pct=0.5).count() == 100


def test_anti_join_with_null_keys(spark):
    left, right = spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(None,), (2,)], "r int")
    assert [r["k"] for r in tables.not_in_keys(left, right, "k", "r").collect()] == [1]


def test_pivot_and_one_hot(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "r string, c string, v int")
    assert sorted(map(tuple, tables.pivot_sum(df, "r", "c", "v", ["x", "y"]).collect())) == [("a", 1, 2), ("b", 3, 0)]
    assert tables.one_hot(df, "c", ["y", "x"]).columns == ["r", "v", "c_x", "c_y"]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(float(20 + i % 50), "Hyderabad" if i % 2 else "Delhi", "Paid" if i % 2 else "Rejected", 0.7) for i in range(100)], "age double, city string, said string, p double")


def test_same_population_has_no_drift(people):
    n, c = drift.numeric_drift(people, people, ["age"]).first(), drift.categorical_drift(people, people, ["city"]).first()
    assert (n["psi"], n["rank"], c["js_divergence"], c["unseen_category_rate"], c["rank"]) == (0.0, 0, 0.0, 0.0, 0)
    assert drift.prediction_drift(people, people, "said", "p").first()["rank"] == 0


def test_moved_population_is_critical(people):
    moved = people.select((F.col("age") + 70).alias("age"), F.lit("New City").alias("city"))
    assert drift.numeric_drift(people, moved, ["age"]).first()["rank"] == 2
    c = drift.categorical_drift(people, moved, ["city"]).first()
    assert c["unseen_category_rate"] == 1.0 and c["rank"] == 2 and math.isclose(c["js_divergence"], math.log(2))
    ranks = drift.report(drift.numeric_drift(people, moved, ["age"]), ["age", "absent"])
    assert {r["feature"]: r["status"] for r in ranks.collect()} == {"age": "critical", "absent": "critical"}
    gate = drift.gate(drift.roll_up(ranks), people.limit(10).agg(F.count("*").alias("records"))).first()
    assert (gate["overall"], gate["result"], gate["exit_code"]) == ("critical", "insufficient_data", 3)


def test_metrics_of_a_known_matrix(spark):
    m = spark.createDataFrame([("a", "a", 8), ("a", "b", 2), ("b", "a", 1), ("b", "b", 9)], "actual string, predicted string, n long")
    o = ml.overall_metrics(m).first()
    assert math.isclose(o["accuracy"], 0.85) and math.isclose(o["balanced_accuracy"], 0.85)
    r = {x["class"]: x for x in ml.classification_report(m).collect()}
    assert math.isclose(r["a"]["precision"], 8 / 9) and math.isclose(r["b"]["recall"], 0.9)


CONTRACT = rules.Contract(columns=("age", "city"), ranges={"age": (0, 120)}, integers=("age",), categories={"city": ("Delhi",)})


def codes(df, **policies):
    return [(r["code"], r["severity"], r["feature"], r["count"]) for r in rules.validate(df, CONTRACT, **policies).collect()]


def test_rules(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "age string, city string")
    assert codes(df(("53", "Delhi"))) == []
    assert codes(df(("53", " "))) == [("missing_value", "warning", "city", 1)]
    assert codes(df(("53", None)), missing_policy="reject") == [("missing_value", "error", "city", 1)]
    assert codes(df(("121", "Delhi"), ("x", "Delhi"), ("inf", "Delhi"), ("1.5", "Delhi"))) == [("invalid_numeric_type", "error", "age", 1), ("non_finite_value", "error", "age", 1), ("numeric_out_of_range", "error", "age", 1), ("integer_required", "error", "age", 1)]
    assert codes(df(("5", "Oslo"), ("5", "Rome"))) == [("unseen_category", "warning", "city", 2)]
    assert codes(spark.createDataFrame([], "age string, extra string")) == [("empty_dataset", "error", None, 0), ("missing_column", "error", "city", 0), ("unexpected_column", "error", "extra", 0)]
    wide = rules.validate(spark.createDataFrame([(1, 2), (3, 4)], "age int, extra int"), CONTRACT).collect()
    assert [(r["code"], r["count"], r["rate"]) for r in wide] == [("missing_column", 2, 1.0), ("unexpected_column", 2, 1.0)] and wide[0]["message"] == "Required feature column 'city' is missing"
    with pytest.raises(ValueError):
        rules.validate(df(("1", "Delhi")), CONTRACT, "ignore")
    assert rules.exit_code(rules.validate(df(("5", "Oslo")), CONTRACT), fail_on_warnings=True) == 2


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "m", "a1", f"2024-01-{i:02d} 10:00:00", '{"age": 5}') for i in range(1, 11)], "telemetry_id string, model_id string, artifact string, t string, payload string").withColumn("recorded_at", F.col("t").cast("timestamp"))
    path = str(tmp_path / "telemetry")
    store.append_telemetry(store.telemetry(rows.where("telemetry_id <= 5"), b"old", 5), path)
    store.append_telemetry(store.telemetry(rows.where("telemetry_id > 5"), b"new", 5), path)
    saved = spark.read.parquet(path)
    assert b"age" not in bytes(saved.first()["encrypted_payload"])
    assert {r["payload"] for r in store.decrypted(saved, [b"new", b"old"]).collect()} == {'{"age": 5}'}
    with pytest.raises(Exception, match="cannot be decrypted"):
        store.decrypted(saved, [b"new"]).collect()
    with pytest.raises(Exception, match="checksum"):
        store.decrypted(saved.withColumn("encrypted_payload", F.unhex(F.lit("00"))), [b"new", b"old"]).collect()
    got = store.scan(saved, "m", "a1", "2024-01-02", "2024-01-04 10:00:00", "2024-01-01").select("telemetry_id").collect()
    assert [r[0] for r in got] == ["2", "3"]
    with pytest.raises(ValueError):
        store.scan(saved, "m", "a1", "2024-01-02", "2024-01-04", "2024-01-01", limit=0)
    assert store.purge(spark, path, "2024-01-08 12:00:00") == 3
    assert spark.read.parquet(path).count() == 7 and store.healthy(spark, path) and not store.healthy(spark, path + "x")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    files.write_csv(df, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, files.read_input(spark, str(tmp_path / "x.csv")).collect())) == [(1, "a"), (2, "b")]
    files.write_parquet(df, str(tmp_path / "x.parquet"))
    assert files.read_input(spark, str(tmp_path / "x.parquet")).count() == 2
    (tmp_path / "x.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert files.read_input(spark, str(tmp_path / "x.json")).count() == files.read_input(spark, str(tmp_path / "x.jsonl")).count() == 2
    with pytest.raises(ValueError):
        files.read_input(spark, "x.xlsx")
    with pytest.raises(ValueError):
        files.read_table(spark, "jdbc:x", "s", "t; drop")
    with pytest.raises(FileNotFoundError):
        files.read_training_tables(spark, str(tmp_path / "none"))
    (tmp_path / "v.txt").write_text("cat 1 2 3\nbad 1\n")
    assert [tuple(r) for r in files.read_word_vectors(spark, str(tmp_path / "v.txt"), 3).collect()] == [("cat", [1.0, 2.0, 3.0])]
    assert '"n": 1' in files.report_json(spark.createDataFrame([(1,)], "n int"))
    assert files.synthetic_claims(spark, 50).exceptAll(files.synthetic_claims(spark, 50)).count() == 0
    assert [len(__import__("json").loads(r[0])["instances"]) for r in files.batches_json(spark.range(5, numPartitions=1), 2).collect()].count(2) == 2


def test_text(spark):
    df = spark.createDataFrame([(1, "Hé @bob see https://x.y/z #Tag, it's NOT é!"), (2, None), (3, "")], "id int, t string")
    got = {r["id"]: (r["c"], r["p"]) for r in df.select("id", text.clean(F.col("t")).alias("c"), text.prepared(F.col("t"), keep_negations=True).alias("p")).collect()}
    assert got[1] == ("hé see tag it s not é", "hé see tag s not é") and got[3] == ("", "") and got[2][0] is None
    v = text.vocabulary(df, text.tokens(F.lower("t")), 5)
    seq = {r["id"]: r["ids"] for r in text.sequences(df, "id", text.tokens(F.lower("t")), v, 4).collect()}
    assert len(seq[1]) == 4 and seq[2] == seq[3] == [0, 0, 0, 0]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-0{1 + i % 2} 05:00:00", "a", 1.0) for i in range(6)], "event_id int, t string, event_type string, value double").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    seen = []
    counts = windows.stream_counts(windows.read_events(spark, str(tmp_path / "in"), schema))
    windows.start(counts, lambda df, _: seen.extend(r["n"] for r in df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(seen) == [3, 3]


def test_smote_lifts_small_classes_to_their_target(spark):
    rows = [(i, [float(i), 1.0], "many") for i in range(40)] + [(100 + i, [float(i), 2.0], "three") for i in range(3)] + [(200 + i, [float(i), 3.0], "five") for i in range(5)] + [(300 + i, [float(i), 4.0], "six") for i in range(6)]
    made = ml.smote(spark.createDataFrame(rows, "id long, v array<double>, label string"), "id", "v", "label")
    assert {r["label"]: r["n"] for r in made.groupBy("label").agg(F.count("*").alias("n")).collect()} == {"three": 27, "five": 25, "six": 24}
    assert all(0 <= r["v"][0] <= 5 and r["v"][1] == {"three": 2, "five": 3, "six": 4}[r["label"]] for r in made.collect())


def test_purge_keeps_what_is_not_expired(spark, tmp_path):
    path = str(tmp_path / "store")
    models = ["a/b:c%d", "plain", "gone"]
    rows = [(f"{m}-{h}", m, h) for m in models for h in (1, 30, 60)]
    df = spark.createDataFrame(rows, "telemetry_id string, model_id string, hours int").select("telemetry_id", "model_id", F.lit("x").alias("artifact"), (F.lit("2024-03-01 06:00:00").cast("timestamp") + F.make_interval(hours=F.col("hours"))).alias("recorded_at"), F.lit("{}").alias("payload"))
    df = df.where("model_id <> 'gone' or hours = 1")
    store.append_telemetry(store.telemetry(df, b"k", 1), path)
    now = "2024-03-03 13:00:00"  # of the day that now falls in, the rows of 30 hours have expired
    left = {r["telemetry_id"] for r in store.survivors(spark.read.parquet(path), F.lit(now).cast("timestamp")).collect()}
    assert store.purge(spark, path, now) == 5 and left == {"a/b:c%d-60", "plain-60"}
    assert {r["telemetry_id"] for r in spark.read.parquet(path).collect()} == left
    assert store.purge(spark, path, now) == 0 and spark.read.parquet(path).count() == 2
    sealed = store.telemetry(df.limit(2).withColumn("recorded_at", F.when(F.col("model_id") == models[0], F.lit("2024-03-02 00:00:00").cast("timestamp")).otherwise(F.lit("2024-03-03 00:00:00").cast("timestamp"))), b"k", 1)
    assert sealed.count() == 2


def test_first_share_zip_and_numbers(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("lead"))
    for df, order in ((rows, ["lead", "k"]), (rows.na.fill(2), ["lead", "k"]), (rows.withColumn("lead", F.col("lead").cast("string")), ["lead", "k"]), (rows, ["k"])):
        want = [tuple(r) for r in df.orderBy(*order).limit(730).collect()]
        got = [tuple(r) for r in tables.first_share(df, 0.73, order).orderBy(*order).collect()]
        assert got == want
    assert tables.first_share(rows.limit(0), 0.5, ["k"]).count() == 0
    assert [r["i"] for r in tables.numbered_rows(rows.repartition(7), ["k"], "i").orderBy("k").collect()] == list(range(1000))
    with pytest.raises(ValueError):
        tables.zip_checked(rows, rows.limit(3), ["k"], ["k"])
    with pytest.raises(ValueError):
        tables.concat_columns([rows, rows], "k")


def test_times_that_are_none_fail(spark):
    assert one(spark, f.day_first_time(F.lit("31-12-2010 08:26"))).isoformat() == "2010-12-31T08:26:00"
    assert one(spark, f.day_first_time(F.lit("2010-12-31"))) is None and one(spark, f.strict_time(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="visit_date is no time"):
        one(spark, f.strict_time(F.lit("soon"), "visit_date"))


def test_hashed_choice_equals_a_window(spark):
    from pyspark.sql import Window

    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 3 == 0, "b").otherwise("c").alias("y"))
    got = {r["id"] for r in ml.stratified_split(rows, "y", "id", 0.13, 5).where("test").collect()}
    order = Window.partitionBy("y").orderBy(F.xxhash64("id", F.lit(5)), "id")
    sizes = Window.partitionBy("y")
    want = {r["id"] for r in rows.withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(sizes)).where("r <= ceil(n * 0.13)").collect()}
    assert got == want


def test_neighbours_and_smote_equal_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(ml, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    data = [(i, [rng.random() for _ in range(3)], "big" if i < 40 else "small" if i < 52 else "two" if i < 54 else "one") for i in range(55)]
    df = spark.createDataFrame(data, "id long, v array<double>, y string")
    d = lambda a, b: round(math.sqrt(sum((x - z) ** 2 for x, z in zip(a, b, strict=True))), 9)
    want = {(i, j) for i, v, _ in data for j in sorted((k for k, _, _ in data if k != i), key=lambda k: (d(v, data[k][1]), k))[:4]}
    assert {(r["query"], r["id"]) for r in ml.neighbours(df, df, "id", "v", 4).collect()} == want
    made = ml.smote(df, "id", "v", "y").collect()
    assert {y: sum(r["y"] == y for r in made) for y in ("small", "two", "one")} == {"small": 18, "two": 28, "one": 0}
    for r in made:
        a, b = data[r["query"]], data[r["near"]]
        own = [k for k, _, y in data if y == a[2] and k != a[0]]
        assert b[2] == a[2] and b[0] in sorted(own, key=lambda k: (d(a[1], data[k][1]), k))[:5]
        assert all(abs(x - (p + (q - p) * r["u"])) < 1e-12 for x, p, q in zip(r["v"], a[1], b[1], strict=True)) and 0 <= r["u"] < 1


def test_scoring_flow_fails_closed(spark, tmp_path):
    from tessera.operators import scoring

    rows = spark.createDataFrame([(float(i), "x" if i % 2 else "y", "Paid" if i % 2 else "Rejected") for i in range(60)], "amount double, kind string, said string")
    model = ml.pipeline(["amount"], ["kind"], "said", ml.classifier("tree")).fit(rows)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = ml.load_model(str(tmp_path / "model"), ["amount", "kind"], ["Paid", "Rejected"])
    for wrong in ((["amount"], ["Paid", "Rejected"]), (["amount", "kind"], ["Paid"])):
        with pytest.raises(ValueError):
            ml.load_model(str(tmp_path / "model"), *wrong)
    contract = rules.Contract(("amount", "kind"), {"amount": (0, 100)}, (), {"kind": ("x", "y")})
    path = str(tmp_path / "telemetry")
    out = scoring.score_batch(rows.drop("said"), loaded, "claim", "a1", ["Paid", "Rejected"], contract, b"key", store_path=path)
    assert out.rows.count() == 60 and {r["predicted"] for r in out.rows.collect()} == {"Paid", "Rejected"}
    told = store.decrypted(spark.read.parquet(path), [b"key"]).select("telemetry_id", F.get_json_object("payload", "$.prediction").alias("p")).collect()
    assert {tuple(r) for r in told} == {(r["request_id"], r["predicted"]) for r in out.rows.collect()} and out.audit.count() == 60
    with pytest.raises(scoring.Rejected) as e:
        scoring.score_batch(rows.drop("said").withColumn("kind", F.lit("new")), loaded, "claim", "a1", ["Paid", "Rejected"], contract, b"key", store_path=path)
    assert [r["code"] for r in e.value.issues.collect()] == ["unseen_category"] and spark.read.parquet(path).count() == 60
    with pytest.raises(ValueError):
        scoring.baseline_document(rows, rows.limit(3), "m", "a", ["amount"], ["kind"], "said", "amount")
    assert files.file_digests(spark, str(tmp_path / "model")).where("length(sha256) = 64").count() > 3


def test_gates(spark, tmp_path, capsys):
    import json

    from tessera import gates

    rows = spark.createDataFrame([(float(i % 50), "x" if i % 2 else "y") for i in range(200)], "amount double, kind string")
    rows.write.parquet(str(tmp_path / "now.parquet"))
    rows.withColumn("amount", F.col("amount") + 500).write.parquet(str(tmp_path / "moved.parquet"))
    (tmp_path / "contract.json").write_text(json.dumps({"columns": ["amount", "kind"], "ranges": {"amount": [0, 100]}, "categories": {"kind": ["x"]}}))
    run = lambda *a: gates.main([str(x) for x in a], spark)
    check = ("validate", "--contract", tmp_path / "contract.json", "--input")
    assert [run(*check, tmp_path / "now.parquet"), run(*check, tmp_path / "now.parquet", "--fail-on-warnings"), run(*check, tmp_path / "moved.parquet", "--output", tmp_path / "out")] == [0, 2, 2]
    told = json.loads(capsys.readouterr().out.split("\n}\n")[0] + "\n}")
    assert told["summary"] == {"error_count": 0, "warning_count": 1} and told["row_count"] == 200 and (tmp_path / "out").exists()
    assert run(*check, tmp_path / "absent.parquet") == 1 and "validate failed" in capsys.readouterr().err
    same, other = (("compare", "--baseline", tmp_path / "now.parquet", "--numeric", "amount,absent", "--categories", "kind", "--input", tmp_path / n) for n in ("now.parquet", "moved.parquet"))
    assert run(*other) == 2 and run(*same) == 2 and run(*same, "--minimum-records", 500) == 3
    assert run("compare", "--baseline", tmp_path / "now.parquet", "--numeric", "amount", "--input", tmp_path / "now.parquet") == 0


def test_drift_of_the_store(spark, tmp_path, capsys):
    import json

    from tessera import gates
    from tessera.operators import scoring, surveillance

    rows = spark.createDataFrame([(i, float(20 + i % 50), "1" if i % 2 else "2", "Paid" if i % 2 else "Rejected", 0.7 if i % 3 else 0.4) for i in range(150)], "id int, age double, ward string, said string, sure double")
    base, reports = f"{tmp_path}/baselines", f"{tmp_path}/reports"
    store.register_baseline(scoring.baseline_document(rows, rows, "m", "a1", ["age"], ["ward"], "said", "sure"), base)

    def seal(df, path, artifact="a1"):
        payload = F.to_json(F.struct(F.struct("age", "ward").alias("features"), F.col("said").alias("prediction"), F.col("sure").alias("max_probability")))
        told = df.select(F.col("id").cast("string").alias("telemetry_id"), F.lit("m").alias("model_id"), F.lit(artifact).alias("artifact"), (F.lit("2024-05-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id"))).alias("recorded_at"), payload.alias("payload"))
        store.append_telemetry(store.telemetry(told, b"key", 9000), path)

    seal(rows, f"{tmp_path}/same")
    seal(rows.withColumn("ward", F.lit("3")).withColumn("age", F.col("age") + 70), f"{tmp_path}/same", "another artifact")
    at = {"end": "2024-05-02T00:00:00Z", "now": "2024-05-02T00:00:00Z", "reports": reports}
    one = surveillance.drift_of(spark, base, f"{tmp_path}/same", "m", [b"key"], **at).first()
    assert (one["overall_status"], one["record_count"], one["summary"]["critical_features"], one["summary"]["prediction_status"]) == ("ok", 150, 0, "ok")
    assert {r["feature"]: (r["psi"], r["status"]) for r in one["feature_drift"]} == {"age": (0.0, "ok"), "ward": (0.0, "ok")} and one["prediction_drift"]["confidence_psi"] == 0
    seal(rows.select("id", (F.col("age") + 70).alias("age"), F.lit("3").alias("ward"), F.lit("Rejected").alias("said"), F.lit(0.99).alias("sure")), f"{tmp_path}/moved")
    moved = surveillance.drift_of(spark, base, f"{tmp_path}/moved", "m", [b"key"], **at).first()
    assert (moved["overall_status"], moved["summary"]["critical_features"], moved["summary"]["prediction_status"]) == ("critical", 2, "critical")
    few = surveillance.drift_of(spark, base, f"{tmp_path}/moved", "m", [b"key"], start="2024-05-01T00:00:00Z", end="2024-05-01T00:50:00Z", now=at["now"], reports=reports)
    assert few.first()["overall_status"] == "insufficient_data" and few.first()["record_count"] == 50 and few.first()["summary"]["message"] and surveillance.exit_code(few) == 3
    none = surveillance.drift_of(spark, base, f"{tmp_path}/moved", "m", [b"key"], start="2023-05-01T00:00:00Z", end="2023-05-01T00:50:00Z", now=at["now"])
    assert none.first()["record_count"] == 0 and surveillance.exit_code(none) == 3
    assert spark.read.parquet(reports).groupBy("overall_status").count().orderBy("overall_status").collect() == [("critical", 1), ("insufficient_data", 1), ("ok", 1)]
    for wrong in ({"start": at["end"], "end": at["end"]}, {"lookback_hours": 0}, {"minimum": 0}):
        with pytest.raises(ValueError):
            surveillance.drift_of(spark, base, f"{tmp_path}/same", "m", [b"key"], **wrong)
    (tmp_path / "keys").write_text("key\n")
    gate = ("drift", "--model", "m", "--baselines", base, "--telemetry", f"{tmp_path}/moved", "--keys", str(tmp_path / "keys"), "--start", "2024-05-01T00:00:00Z", "--end", "2024-05-03T00:00:00Z")
    assert [gates.main([*gate], spark), gates.main([*gate, "--minimum-records", "151"], spark), gates.main([*gate[:4], str(tmp_path / "none"), *gate[5:]], spark)] == [2, 3, 1]
    assert "drift failed" in capsys.readouterr().err
    lacking = json.loads(spark.read.parquet(base).first()["baseline_json"])
    lacking["feature_profiles"]["gone"] = {"type": "categorical", "missing_rate": 0.0, "distribution": {"x": 1.0}, "known_categories": ["x"]}
    store.register_baseline(spark.createDataFrame([("m", "a1", json.dumps(lacking))], "model_id string, artifact string, baseline_json string"), base)
    absent = surveillance.drift_of(spark, base, f"{tmp_path}/same", "m", [b"key"], **at).first()
    assert absent["overall_status"] == "critical" and {r["feature"]: r["error"] for r in absent["feature_drift"]}["gone"] == "feature_missing_from_production_telemetry"


def test_whole_numbers_are_one_category_however_they_are_written(spark):
    df = spark.createDataFrame([(1.0, " a "), (2.5, ""), (float("nan"), None)], "n double, t string")
    assert [tuple(r) for r in df.select(drift.category(df, "n"), drift.category(df, "t")).collect()] == [("1", "a"), ("2.5", drift.MISSING), (drift.MISSING, drift.MISSING)]


def test_interactions_are_pipeline_stages(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    from tessera.operators.interactions import CLAIM_COLUMNS, RISK_COLUMNS, Interactions

    rows = spark.createDataFrame([("A", "p", "100", 0.5, 2, 40, 1, "x"), ("A", "q", "300", 4.0, 4, 50, 0, "y"), ("B", "p", "bad", None, None, 60, 1, "x"), ("B", None, "0", 2.0, 0, 30, 0, "y")], "department string, insurance_provider string, billed_amount string, length_of_stay_hours double, days_from_visit_to_billing int, age int, chronic_flag int, target string")
    later = spark.createDataFrame([("C", None, "50", None, 3, 20, 1), ("A", "q", "10", 0.25, None, 20, 0)], "department string, insurance_provider string, billed_amount string, length_of_stay_hours double, days_from_visit_to_billing int, age int, chronic_flag int")
    model = Interactions(kind="claim").fit(rows)
    got = model.transform(later).orderBy("department").collect()
    assert model.transform(later).columns == [*later.columns, *CLAIM_COLUMNS]
    known, new = got
    assert (known["department_avg_billed_amount"], known["bill_vs_provider_avg"], known["billed_amount_per_stay_hour"], known["billing_lag_vs_department_avg"]) == (200.0, -290.0, 10.0, None)
    assert new["department_avg_billed_amount"] == pytest.approx(400 / 3) and new["los_to_department_avg_ratio"] is None and new["billed_amount_per_stay_hour"] is None and new["age_chronic_interaction"] == 20
    assert Interactions(kind="risk").fit(rows).transform(later).columns == [*later.columns, *RISK_COLUMNS]
    with pytest.raises(ValueError, match="department"):
        Interactions(kind="risk").fit(rows.drop("department"))
    with pytest.raises(ValueError):
        Interactions(kind="other")
    made = ["department_avg_billed_amount", "bill_vs_department_avg"]
    stages = [StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"), Interactions(kind="risk"), VectorAssembler(inputCols=made, outputCol="features", handleInvalid="skip"), LogisticRegression()]
    path = str(tmp_path / "whole")
    Pipeline(stages=stages).fit(rows).write().save(path)
    asked = ["department", "insurance_provider", "billed_amount", "length_of_stay_hours"]
    loaded = ml.load_model(path, asked, ["x", "y"])
    assert ml.predicted(loaded, later, ["x", "y"]).count() == 2 and loaded.stages[1].getOrDefault("kind") == "risk"
    with pytest.raises(ValueError):
        ml.load_model(path, asked[1:], ["x", "y"])


def test_relational_table(spark):
    url = "jdbc:derby:memory:tessera;create=true"
    spark.range(25).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME")).write.format("jdbc").options(url=url, dbtable="APP.PEOPLE", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    got = files.read_table(spark, url, "APP", "PEOPLE", ("ID", 0, 25, 4), driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.columns == ["id", "name"] and got.rdd.getNumPartitions() == 4 and got.count() == 25
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    asked = files.read_table(spark, url, "APP", "PEOPLE", ("ID", 5), ["ID"], **driver)
    sizes = [len(p) for p in asked.rdd.glom().collect()]
    assert asked.columns == ["id"] and len(sizes) == 5 and sum(sizes) == 25 and max(sizes) <= 9
    spark.createDataFrame([], "ID int").write.format("jdbc").options(url=url, dbtable="APP.NOBODY", **driver).save()
    assert files.read_table(spark, url, "APP", "NOBODY", ("ID", 5), **driver).count() == 0
    for bad in ("PEOPLE\n", "PEOPLE;DROP", "1PEOPLE", "P" * 31):
        with pytest.raises(ValueError):
            files.read_table(spark, url, "APP", bad)


def test_exact_quantiles_either_way(spark):
    import random

    rng = random.Random(9)
    rows = [("many", rng.gauss(0, 100)) for _ in range(4001)] + [("ties", float(rng.randrange(3))) for _ in range(700)] + [("few", x) for x in (3.0, 1.0)] + [("one", 7.5), ("none", None), ("many", float("nan"))]
    df = spark.createDataFrame(rows, "feature string, value double")
    p = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    held = {r["feature"]: r["q"] for r in tables.exact_quantiles(df, p).collect()}
    sorted_ = {r["feature"]: r["q"] for r in tables.exact_quantiles(df, p, most=100).collect()}
    assert set(held) == {"many", "ties", "few", "one"} and held == sorted_
    assert held["few"] == pytest.approx([1.0, 1.2, 1.5, 2.0, 2.5, 2.998, 3.0])


def test_versions_of_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "baselines")
    document = lambda i: spark.createDataFrame([("m/1", "a", f'{{"writer": {i}}}')], "model_id string, artifact string, baseline_json string")
    with ThreadPoolExecutor(6) as pool:
        ids = list(pool.map(lambda i: store.register_baseline(document(i), path), range(6)))
    rows = spark.read.parquet(path)
    assert sorted(r["version"] for r in rows.collect()) == [1, 2, 3, 4, 5, 6] and len(set(ids)) == 6
    active = store.active_baseline(rows).collect()
    assert len(active) == 1 and active[0]["version"] == 6
    last = store.register_baseline(document(7), path)
    assert store.active_baseline(spark.read.parquet(path)).first()["baseline_id"] == last and store.load_active_baseline(spark, path, "m/1") == '{"writer": 7}'
    assert store.claimed_version(spark, path, "other") == 1


def test_lemmas(spark):
    words = spark.createDataFrame([(w,) for w in ("running", "tries", "tried", "was", "goes", "bed", "s", "xyzing", "making", "hopings", None, "run")], "word string")
    lexicon = spark.createDataFrame([(w,) for w in ("run", "try", "be", "go", "bed", "make", "runn", "hope")], "word string")
    odd = spark.createDataFrame([("was", "be"), ("goes", "gone")], "word string, lemma string")
    got = {r["word"]: r["lemma"] for r in text.lemma_table(words, lexicon, odd).collect()}
    assert got == {"running": "runn", "tries": "try", "tried": "tried", "was": "be", "goes": "goes", "bed": "be", "s": "s", "xyzing": "xyzing", "making": "make", "hopings": "hope", "run": "run"}
    rows = spark.createDataFrame([(1, "was making it"), (2, ""), (3, None)], "id int, t string")
    said = {r["id"]: r["words"] for r in text.with_lemmas(rows, "id", text.tokens(F.col("t")), text.lemma_table(words, lexicon, odd)).collect()}
    assert said == {1: ["be", "make", "it"], 2: [], 3: []}


def test_draws_and_search(spark):
    space = {"a": [1, 2, 3], "b": (1, 2)}
    assert ml.draws(space, 4, 1) == ml.draws(space, 4, 1) and len(ml.draws(space, 30)) == 6
    assert {repr(x) for x in ml.draws(space, 30)} == {repr({"a": a, "b": b}) for a in (1, 2, 3) for b in (1, 2)}
    assert all(0.5 <= x["c"] < 2 for x in ml.draws({"c": (0.5, 2.0)}, 20))
    parts = ml.expanding_folds(spark.range(60).withColumn("y", F.col("id") % 2), ["id"], 4)
    seen = []
    fit = lambda params, train: seen.append((params["a"], train.count())) or (lambda df: df.withColumn("p", F.col("y") * params["a"]))
    out = ml.randomised_search(tables.settled(parts), [{"a": 0}, {"a": 1}, {"a": 1.0}], fit, lambda said: ml.scores_of(said, "y", "p", [0, 1])["accuracy"]).collect()
    assert [(r["rank"], r["mean_test"], r["std_test"]) for r in out] == [(1, 1.0, 0.0), (1, 1.0, 0.0), (3, 0.5, 0.0)]
    assert sorted(n for a, n in seen if a == 0) == [12, 24, 36, 48]


def test_stratified_folds_are_even(spark):
    df = spark.range(103).select("id", F.when(F.col("id") < 50, "a").when(F.col("id") < 101, "b").alias("label"))
    counts = ml.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    by = {c: sorted(r["count"] for r in counts if r["label"] == c) for c in ("a", "b", None)}
    assert by == {"a": [10] * 5, "b": [10] * 4 + [11], None: [1, 1]}


def test_letter_values(spark):
    df = spark.createDataFrame([("x", float(i)) for i in range(257)] + [("one", 5.0), ("one", None), (None, 1.0), ("gone", None)], "c string, v double")
    got = [tuple(r) for r in profile.letter_values(df, "c", "v").orderBy("c", "depth").collect()]
    assert got == [("one", 1, 0.25, 5.0, 5.0, 0), ("x", 1, 0.25, 64.0, 192.0, 16), ("x", 2, 0.125, 32.0, 224.0, 16), ("x", 3, 0.0625, 16.0, 240.0, 16), ("x", 4, 0.03125, 8.0, 248.0, 16), ("x", 5, 0.015625, 4.0, 252.0, 8)][:1] + [("x", d, 0.5 ** (d + 1), 256 * 0.5 ** (d + 1), 256 * (1 - 0.5 ** (d + 1)), 8) for d in range(1, 6)]


def test_a_very_common_row_is_repeated_without_a_window(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("a"), F.lit(None).cast("string").alias("b"))
    assert profile.repeated_rows(df, "id", ["a", "b"]).count() == 3332


def test_streamed_drift_equals_the_batch(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("event_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), (F.col("id") % 17).cast("double").alias("value"))
    rows.unionByName(rows.where("event_id % 4 = 0")).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    next_ = lambda i: rows.where("event_id = 299").withColumns({"event_id": F.lit(299 + i).cast("long"), "ts": F.col("ts") + F.make_interval(mins=F.lit(i))})
    next_(1).unionByName(rows.where("event_id = 299")).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    late = rows.limit(1).withColumn("event_id", F.lit(9999).cast("long"))
    next_(2).unionByName(late).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    document = drift.profile_document(rows.where("event_id < 100"), ["value"], ["event_type"])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    sink = windows.drift_sink(document, f"{tmp_path}/reports", minimum=1)
    windows.once(stream, "event_id").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/reports").orderBy("batch").collect()
    assert [r["record_count"] for r in got] == [300, 1, 1]  # what repeats is one, what is late is none
    want = {r["feature"]: r["psi"] for r in drift.against(document, rows).features.collect()}
    assert {r["feature"]: r["psi"] for r in got[0]["feature_drift"]} == want
    sink(rows, 0)
    assert spark.read.parquet(f"{tmp_path}/reports").count() == 3  # a batch run again replaces its report


def test_jobs(spark, tmp_path, capsys):
    import json

    from tessera import jobs

    day = lambda c, k: F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("id") % k).cast("int")), "yyyy-MM-dd HH:mm:ss").alias(c)
    one = lambda c, *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.col("id") % len(vs) + 1).cast("int")).alias(c)
    ids = spark.range(60)
    people = ids.select(F.col("id").alias("patient_id"), (F.col("id") % 70).alias("age"), one("gender", "F", "M"), one("city", "Delhi", "Mumbai", None), one("insurance_provider", "A", "B"), (F.col("id") % 2).alias("chronic_flag"), day("registration_date", 3))
    stays = ids.select((F.col("id") + 100).alias("visit_id"), F.col("id").alias("patient_id"), day("visit_date", 20), one("department", "X", "Y"), one("visit_type", "ER", "OPD"), (F.col("id") % 9).cast("double").alias("length_of_stay_hours"), one("risk_score", "Low", "High"), F.lit(101).alias("doctor_id"))
    bills = ids.select((F.col("id") + 500).alias("bill_id"), (F.col("id") + 100).alias("visit_id"), (F.col("id") * 10.0).alias("billed_amount"), (F.col("id") * 9.0).alias("approved_amount"), one("claim_status", "Paid", "Rejected", "Pending"), F.lit(3.0).alias("payment_days"), day("billing_date", 30))
    source = f"{tmp_path}/tables"
    for name, df in (("patients", people), ("visits", stays), ("billing", bills)):
        files.write_csv(df, f"{source}/{name}.csv")
    run = lambda *a: jobs.main([str(x) for x in a], spark)
    made = f"{tmp_path}/features.parquet"
    assert run("features", "--source", source, "--output", made) == 0 and spark.read.parquet(made).count() == 60
    assert run("features", "--source", source, "--output", f"{tmp_path}/later.csv", "--reference-date", "2025-01-01") == 0
    gap = files.read_input(spark, f"{tmp_path}/later.csv").select("patient_id", "days_registered").where("patient_id = 0").first()
    assert gap["days_registered"] == 366
    assert run("model-table", "--input", made, "--output", f"{tmp_path}/model.csv") == 0
    columns = files.read_input(spark, f"{tmp_path}/model.csv").columns
    assert {"city_Delhi", "city_Unknown", "gender_F", "insurance_provider_B"} <= set(columns) and not {"patient_id", "registration_date", "city"} & set(columns)
    tables_ = files.read_training_tables(spark, source)
    train = jobs.features.claim_frame(*(tables_[x] for x in jobs.TABLES))
    artifact = f"{tmp_path}/artifact"
    ml.pipeline(["age", "billed_amount"], ["department", "gender"], "claim_status", ml.classifier("tree")).fit(train).write().save(artifact)
    baselines = f"{tmp_path}/baselines"
    assert run("baseline", "--source", source, "--kind", "claim", "--artifact", artifact, "--model", "claim", "--baselines", baselines, "--output", f"{tmp_path}/baseline") == 0
    document = json.loads(store.load_active_baseline(spark, baselines, "claim"))
    assert document["record_count"] == 48 and set(document["feature_profiles"]) == {"age", "billed_amount", "department", "gender"} and set(document["source_file_sha256"]) == set(jobs.TABLES)
    assert document["training_period"]["start"].startswith("2024-01-01") and set(document["prediction_profile"]["class_distribution"]) <= {"Paid", "Pending", "Rejected"}
    assert run("contract", "--artifact", artifact, "--model", "claim", "--output", f"{tmp_path}/contract") == 0
    told = json.loads(spark.read.text(f"{tmp_path}/contract", wholetext=True).first()[0])
    assert told["categories"] == {"department": ["X", "Y"], "gender": ["F", "M"]} and told["category_contract_sha256"] == document["category_contract_sha256"] and told["artifact_sha256"] == document["artifact_sha256"]
    assert run("synthetic", "--count", 7, "--output", f"{tmp_path}/synthetic") == 0
    assert len(json.loads(spark.read.text(f"{tmp_path}/synthetic/risk-batch-7").first()[0])["instances"]) == 7
    assert [run("synthetic", "--count", 0, "--output", tmp_path), run("store", "health", "--telemetry", f"{tmp_path}/none"), run("store", "health", "--telemetry", made)] == [1, 1, 0]
    assert "count is 1 to" in capsys.readouterr().err


def test_an_unseen_category_has_a_slot_of_its_own(spark):
    rows = spark.createDataFrame([(float(i), "x" if i % 2 else "y", "a" if i % 3 else "b") for i in range(30)], "n double, kind string, said string")
    model = ml.pipeline(["n"], ["kind"], "said", ml.classifier("tree")).fit(rows)
    new = spark.createDataFrame([(1.0, "z"), (1.0, None), (1.0, "x")], "n double, kind string")
    vectors = [tuple(r["features"].toArray()) for r in ml.predicted(model, new, ["a", "b"]).collect()]
    assert len(vectors) == 3 and vectors[0] == vectors[1] != vectors[2]
    assert ml.classes_of(model) == ["a", "b"] and ml.learned_categories(model) == {"kind": ("x", "y")}


def test_neighbours_of_copies_unknown_vectors_and_text_keys(spark, monkeypatch):
    """Vectors without a distance come last; large groups of copies keep their least keys."""
    monkeypatch.setattr(ml, "BLOCK_ROWS", 50)
    vectors = [(f"k{i:03d}", [1.0, 2.0] if i < 120 else [float(i), 0.5]) for i in range(150)]
    odd = [("a", None), ("b", [None, 1.0]), ("c", [float("nan"), 1.0]), ("d", [1.0])]
    df = spark.createDataFrame([*vectors, *odd, (None, [1.0, 2.0])], "id string, v array<double>")
    near = {}
    for r in ml.neighbours(df, df, "id", "v", 3).collect():
        near.setdefault(r["query"], {})[r["rank"]] = (r["d"], r["id"])
    known = dict(vectors)
    dist = lambda a, b: round(math.dist(known[a], known[b]), 9) if a in known and b in known else None
    for q in [*known, "a", "b", "c", "d"]:
        want = sorted(((dist(q, k), k) for k in [*known, "a", "b", "c", "d"] if k != q), key=lambda x: (x[0] is None, x[0] or 0.0, x[1]))[:3]
        assert [near[q][i + 1] for i in range(3)] == want
    assert set(near) == {*known, "a", "b", "c", "d"}


def test_neighbours_keep_no_pair_of_blocks_in_the_plan(spark):
    """Queries stream past a block that lies in its task: no joined row holds a block's vectors."""
    df = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"), (F.col("id") % 3).alias("y"))
    plan = ml.neighbours(df, df, "id", "v", 3, "y", ("y",))._jdf.queryExecution().executedPlan().toString()
    assert "__members" not in plan and "MapInArrow" in plan


def test_strategies_lift_a_fold_once(spark, monkeypatch):
    calls = []
    plain = ml.smoted
    monkeypatch.setattr(ml, "smoted", lambda *a, **k: calls.append(1) or plain(*a, **k))
    df = spark.range(60).select("id", F.array(F.rand(1), F.rand(2)).alias("v"), F.when(F.col("id") % 6 == 0, "b").otherwise("a").alias("y"))
    made = ml.resampled_folds(df, "id", "v", "y", 3)
    assert len(calls) == 3 and len(made) == 9


def test_equal_versions_are_told_by_their_baseline(spark):
    for ids in ([3, 9, 5], [9, 5, 3], [5, 3, 9]):
        rows = spark.createDataFrame([("m", i, 7) for i in ids], "model_id string, baseline_id long, version long").coalesce(1)
        assert [r["baseline_id"] for r in store.active_baseline(rows).collect()] == [9]


def test_models_of_counted_rows(spark):
    """Distinct rows with their number give the tree of all rows; a forest's bags are those of all rows, and leaves keep their least size."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(6000).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), ((F.col("id") % 10 > 4).cast("int") * (F.col("id") % 7 != 0).cast("int")).cast("double").alias("label"))
    alike = ml.counted(rows, ["a", "b", "label"])
    assert alike.agg(F.sum("n")).first()[0] == 6000 and alike.count() < 70
    made = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    tree = ml.classifier("tree", labelCol="label", weightCol="n").fit(made.transform(alike))
    plain = ml.classifier("tree", labelCol="label").fit(made.transform(rows))
    p = lambda m: {(r["a"], r["b"]): tuple(round(x, 9) for x in r["probability"]) for r in m.transform(made.transform(alike)).collect()}
    assert p(tree) == p(plain)
    forest = RandomForestClassifier(labelCol="label", numTrees=30, maxDepth=4, minInstancesPerNode=2, seed=1)
    got = {(r["a"], r["b"]): r["probabilities"][1] for r in ml.bagged_forest(forest, made.transform(alike), made.transform(alike), together=10).collect()}
    whole = {(r["a"], r["b"]): r["probability"][1] for r in forest.fit(made.transform(rows)).transform(made.transform(alike)).collect()}
    assert got.keys() == whole.keys() and max(abs(got[x] - whole[x]) for x in got) < 0.1
    few = made.transform(spark.createDataFrame([(1.0, 1.0, 0.0, 1), (2.0, 1.0, 1.0, 9)], "a double, b double, label double, n long"))
    seen = [r["probabilities"] for r in ml.bagged_forest(RandomForestClassifier(labelCol="label", numTrees=4, minInstancesPerNode=500, seed=1), few, few).collect()]
    assert seen[0] == seen[1] and abs(sum(seen[0]) - 1) < 1e-9
    matrix = ml.confusion(alike.withColumn("y", F.col("label").cast("string")), "y", "y", ["0.0", "1.0"], "n")
    assert matrix.agg(F.sum("n")).first()[0] == 6000


def test_binned_and_parted_rows(spark):
    rows = spark.range(6400).select(F.col("id").cast("double").alias("x"))
    got = {r["b"]: r["n"] for r in rows.groupBy(ml.binned(rows, "x").alias("b")).agg(F.count("*").alias("n")).collect()}
    assert sorted(got) == list(range(64)) and all(90 <= n <= 110 for n in got.values())
    df = spark.createDataFrame([("a", 1), ("b", 40)], "k string, n long")
    parts = {r["k"]: (r["m"], r["w"]) for r in ml.parted(df, "n", 16).groupBy("k").agg(F.count("*").alias("m"), F.round(F.sum("weight"), 9).alias("w")).collect()}
    assert parts == {"a": (1, 1.0), "b": (16, 40.0)}
    said = df.selectExpr("k a", "'a' p", "n")
    assert round(ml.scores_of(said, "a", "p", ["a", "b"], "n")["accuracy"], 9) == round(1 / 41, 9)


def test_search_prepares_each_fold_once(spark):
    df, seen = spark.range(10).select((F.col("id") % 5).alias("part")), []
    found = ml.search(df, [{"a": 1}, {"a": 2}], lambda c, train, test: float(c["a"]), 4, lambda train, test: seen.append(1) or (train, test))
    assert len(seen) == 4 and found == [(2.0, {"a": 2}), (1.0, {"a": 1})]


def test_quantiles_of_few_and_many_distinct_values(spark):
    """Groups of few values keep to their counts, the others are bracketed; both as the plain aggregate says."""
    df = spark.range(6000).selectExpr("if(id % 3 = 0, 'few', 'many') feature", "if(id % 3 = 0, id % 7, (id * 7919) % 6007 - 3000) / 4.0D value")
    ps = [0.0, 0.001, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    want = {r[0]: r[1] for r in df.groupBy("feature").agg(F.percentile("value", F.array(*[F.lit(p) for p in ps]))).collect()}
    for scanned in (False, True):
        got = {r["feature"]: r["q"] for r in tables.exact_quantiles(df, ps, most=1000, scanned=scanned).collect()}
        assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_rules_read_a_text_once(spark):
    """One regular expression for each feature with numbers, however many rules ask for it."""
    df = spark.createDataFrame([(" 5 ", "1"), ("5d", "2"), ("inf", "3"), (None, "1.5"), ("99", " ")], "a string, b string")
    contract = rules.Contract(columns=("a", "b"), ranges={"a": (0, 40), "b": (1, 7)}, integers=("a", "b"))
    out = rules.validate(df, contract)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 2
    assert {(r["code"], r["feature"], r["count"]) for r in out.collect()} == {("missing_value", "a", 1), ("invalid_numeric_type", "a", 1), ("non_finite_value", "a", 1), ("numeric_out_of_range", "a", 1), ("integer_required", "b", 1), ("missing_value", "b", 1)}


def test_bills_are_joined_once(spark):
    """Visits meet their patients first, so that a bill goes through one join; the rows are those of bills first."""
    from tessera.operators import features

    day = "timestamp_ntz'2024-01-01 00:00:00'"
    bills = spark.sql(f"select * from values (1, 1, 'Paid', {day}), (2, 1, 'Paid', {day}), (3, 9, 'Paid', {day}), (4, 2, null, {day}), (5, 3, 'Paid', {day}) t(bill_id, visit_id, claim_status, billing_date)")
    visits = spark.sql(f"select * from values (1, 7, {day}), (2, 7, {day}), (3, null, {day}) t(visit_id, patient_id, visit_date)")
    patients = spark.sql(f"select * from values (7, {day}) t(patient_id, registration_date)")
    frame = features.claim_frame(patients, visits, bills)
    node = frame._jdf.queryExecution().analyzed()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert "Join" not in node.children().head().toString()
    assert sorted((r["bill_id"], r["patient_id"]) for r in frame.collect()) == [(1, 7), (2, 7), (5, None)]


def test_words_that_are_their_own_lemma_join_nothing(spark):
    """Only changed words are in the joined table, which is computed once; rows come out as with the whole one."""
    lemmas = spark.createDataFrame([("cats", "cat"), ("cat", "cat"), ("dog", "dog")], "word string, lemma string")
    df = spark.createDataFrame([(1, ["cats", "dog", "cats"]), (2, []), (3, ["dog"])], "k long, w array<string>")
    out = text.with_lemmas(df, "k", F.col("w"), lemmas)
    assert {r["k"]: r["words"] for r in out.collect()} == {1: ["cat", "dog", "cat"], 2: [], 3: ["dog"]}
    assert "cats" not in out._jdf.queryExecution().optimizedPlan().toString() and "LogicalRDD" in out._jdf.queryExecution().optimizedPlan().toString()


def test_interactions_join_their_frame_once(spark):
    """The joined frame is a stored table for the split, the fit and the columns: only the two joins with means are left."""
    from conftest import DATA

    from tessera.plans import hospital

    for columns in (hospital.risk_columns, hospital.claim_columns):
        plan = columns(spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 2 and "lineitem" not in plan


def test_strategies_read_settled_rows(spark):
    """Neither a fit nor a score splits or resamples the rows again: both get tables computed once."""
    seen = []
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = tables.settled(spark.range(90).select("id", F.when(F.col("id") % 9 == 0, "b").otherwise("a").alias("y")))
    fit = lambda own: seen.append((own.count(), plan(own))) or (lambda df: df.withColumn("predicted", F.col("y")))
    out = ml.compare_strategies(rows, rows, "y", {"all": lambda x: x, "under": lambda x: ml.undersample(x, "y", "id")}, fit, ["a", "b"])
    assert [n for n, _ in seen] == [90, 20] and all("Window" not in p and "Join" not in p for _, p in seen)
    assert {(r["strategy"], r["train_rows"], r["macro_f1"]) for r in out.collect()} == {("all", 90, 1.0), ("under", 20, 1.0)}


def test_rows_are_sealed_once(spark, tmp_path):
    """The checked rows encrypt a payload in one place of the plan, beyond the exchange that spreads them."""
    rows = spark.range(20).selectExpr("cast(id as string) telemetry_id", "'m' model_id", "'a' artifact", "timestamp'2024-03-01 00:00:00' recorded_at", "'{}' payload")
    sealed = store.checked(store.telemetry(rows, b"k", 5), "telemetry")
    plan = sealed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("aesencrypt") == 1 and plan.lower().index("aesencrypt") < plan.index("Repartition")
    with pytest.raises(Exception, match="payload"):
        store.append_telemetry(store.telemetry(rows.withColumn("payload", F.lit(None).cast("string")), b"k", 5), str(tmp_path / "t"))
