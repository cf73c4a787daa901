"""What goes in and out: files, records, reports, the store's tables, gates, identities and row places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as f
from tessera.operators import drift, ml, rules, scoring, tables
from tessera.plans.fixtures import table
from tessera.plans.oracles import hmac_sql
from tessera.sources import files, store


def scratch(spark) -> str:
    return tables.fresh_dir(spark, "interchange")


def nations(s, d):
    return table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


NATIONS = "select n_nationkey, n_name, n_regionkey from nation"
_NATION = "n_nationkey int, n_name string, n_regionkey int"


def csv_back(s, d):
    path = f"{scratch(s)}/nations.csv"
    files.write_csv(nations(s, d), path)
    return files.read_input(s, path, _NATION)


def csv_inferred(s, d):
    path = f"{scratch(s)}/nations.csv"
    files.write_csv(nations(s, d), path)
    return files.read_csv(s, path)


def json_lines_back(s, d):
    path = f"{scratch(s)}/nations.jsonl"
    nations(s, d).write.json(path)
    return files.read_input(s, path, _NATION)


def json_array_back(s, d):
    path = f"{scratch(s)}/nations.json"
    rows = F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias("value")
    nations(s, d).agg(rows).coalesce(1).write.text(path)
    return files.read_input(s, path, _NATION)


def parquet_back(s, d):
    path = f"{scratch(s)}/nations.parquet"
    files.write_parquet(nations(s, d), path, ("n_regionkey",))
    return files.read_input(s, path).select("n_nationkey", "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def records(s, d):
    """A few records whose fields differ, from the reference table."""
    found = [{"name": r["n_name"], "age": r["n_nationkey"]} for r in nations(s, d).collect()]
    given = [{k: v for k, v in r.items() if k != "name" or r["age"] % 3} | ({"more": 1} if r["age"] % 5 == 0 else {}) for r in found]
    return files.from_records(s, given, {"age": "int", "name": "string"})


def word_vectors(s, d):
    path = f"{scratch(s)}/vectors"
    nations(s, d).select(F.concat_ws(" ", F.regexp_replace("n_name", " ", "_"), "n_nationkey", "n_regionkey").alias("value")).write.text(path)
    return files.read_word_vectors(s, path, 2).select("word", F.col("vector")[0].cast("int").alias("first"), F.col("vector")[1].cast("int").alias("second"))


def batches(s, d):
    lines = files.batches_json(nations(s, d), 10, ["n_nationkey"])
    one = F.from_json("value", f"instances array<struct<{', '.join(x.replace(' ', ':') for x in _NATION.split(', '))}>>")
    return lines.select(one.alias("b")).select(F.size("b.instances").alias("n"), F.array_min(F.transform("b.instances", lambda x: x["n_nationkey"])).alias("lowest"))


def names(s, d):
    loud = nations(s, d).select(*[F.col(c).alias(c.upper()) for c in ("n_regionkey", "n_nationkey", "n_name")])
    out = tables.sorted_columns(tables.lower_names(loud))
    return s.createDataFrame([(i, c, c in tables.columns_of_kind(out, True)) for i, c in enumerate(out.columns)], "place int, name string, is_number boolean")


def clipped(s, d):
    return table(s, d, "customer").select("c_custkey", f.clip("c_acctbal", 0.0, 5000.0).alias("bounded"))


def first_rows(s, d):
    return tables.head(table(s, d, "orders").select("o_orderkey", "o_custkey"), 7, ["o_custkey", "o_orderkey"])


def numbered(s, d):
    return tables.numbered_rows(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], "place")


def zipped(s, d):
    left = table(s, d, "supplier").select("s_suppkey")
    right = table(s, d, "supplier").select(F.col("s_suppkey").alias("other"), "s_acctbal")
    return tables.zip_checked(left, right, ["s_suppkey"], ["s_acctbal", "other"]).select("s_suppkey", "other")


def side_by_side(s, d):
    """Names, suppliers and customers of each nation; some nations have no suppliers."""
    count = lambda name, key, out: table(s, d, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(out))
    return tables.concat_columns([nations(s, d).select("n_nationkey", "n_name"), count("supplier", "s_nationkey", "suppliers"), count("customer", "c_nationkey", "customers")], "n_nationkey")


def wide(s, d):
    out = tables.pivot_sum(table(s, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber", ["F", "O"])
    return out.select("l_returnflag", F.col("F").cast("long").alias("f"), F.col("O").cast("long").alias("o"))


def highest(s, d):
    parts = F.array("l_quantity", F.col("l_linenumber") * 10, F.lit(20))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ml.argmax(parts).cast("int").alias("at"))


def times(s, d):
    spelled = F.when(F.col("o_orderkey") % 9 == 0, "no time").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy HH:mm"))
    return table(s, d, "orders").select("o_orderkey", f.day_first_time(spelled).alias("read"), f.strict_time(F.col("o_orderdate").cast("string")).alias("strict"), f.iso_utc("o_orderdate").alias("iso"))


def categories(s, d):
    number, half = f.canonical_category(F.col("c_custkey").cast("double"), "double"), f.canonical_category(F.col("c_custkey") + F.lit(0.5), "double")
    return table(s, d, "customer").select("c_custkey", number.alias("whole"), half.alias("half"), f.canonical_category(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")), "string").alias("text"))


def digests(s, d):
    return table(s, d, "customer").select("c_custkey", f.sha256_hex("c_name").alias("digest"))


def fingerprints(s, d):
    """A table's print does not change with the order of its rows or columns, and does with a value."""
    n = nations(s, d)
    prints = [n, n.orderBy(F.desc("n_name")).select("n_regionkey", "n_name", "n_nationkey"), n.withColumn("n_name", F.lower("n_name"))]
    first, moved, other = (rules.table_fingerprint(x).withColumnRenamed("fingerprint", f"p{i}") for i, x in enumerate(prints))
    return first.crossJoin(moved).crossJoin(other).select((F.col("p0") == F.col("p1")).alias("same"), (F.col("p0") != F.col("p2")).alias("unlike"))  # one row each


def ids(s, d):
    made = tables.settled(nations(s, d).select(f.new_id().alias("id")))
    return made.agg(F.count_distinct("id").alias("n"), F.min(F.length("id")).alias("shortest"), F.max(F.length("id")).alias("longest"))


CONTRACT = rules.Contract(("n_nationkey", "n_name", "n_regionkey"), {"n_nationkey": (0, 20)}, ("n_nationkey",), {"n_name": ("NATION_6",)})


def empty_issues(s, d):
    return rules.validate(nations(s, d).limit(0), CONTRACT).select("code", "severity", "count")


def contract_print(s, d):
    return scoring.contract_document(table(s, d, "orders").select("o_orderstatus", "o_orderpriority"), "m").select("model_id", "categories", "contract_sha256")


def exit_codes(s, d):
    n = nations(s, d)
    cases = {"fine": (n.where("n_name = 'NATION_6'"), True), "warned": (n.where("n_nationkey <= 20"), False), "warned, failing": (n.where("n_nationkey <= 20"), True), "wrong": (n, False)}
    return reduce(DataFrame.unionByName, [rules.outcome(rules.validate(df, CONTRACT), fail).select(F.lit(k).alias("batch"), "errors", "warnings", "code") for k, (df, fail) in cases.items()])


_CASES = " union all ".join(f"select '{k}' batch, {fail} fails, * from nation where {which}" for k, which, fail in (("fine", "n_name = 'NATION_6'", "true"), ("warned", "n_nationkey <= 20", "false"), ("warned, failing", "n_nationkey <= 20", "true"), ("wrong", "true", "false")))
EXIT_CODES = f"""select batch, count(*) filter (bad > 0) errors, count(*) filter (odd > 0) warnings, cast(case when sum(bad) > 0 or (bool_or(fails) and sum(odd) > 0) then 2 else 0 end as int) code
 from (select batch, fails, count(*) filter (n_nationkey > 20) bad, count(*) filter (n_name <> 'NATION_6') odd from ({_CASES}) group by all) group by batch"""


def requests(s, d):
    def of(df):
        try:
            return "issues" if rules.exit_code(scoring.check_request(df, CONTRACT)) else "taken"
        except ValueError:
            return "size"

    n, o = nations(s, d), table(s, d, "lineitem").select(F.col("l_orderkey").alias("n_nationkey"), F.lit("NATION_6").alias("n_name"), F.lit(1).alias("n_regionkey"))
    return s.createDataFrame([("none", of(n.limit(0))), ("unseen", of(n)), ("fine", of(n.where("n_name = 'NATION_6'"))), ("many", of(o.unionByName(o).unionByName(o)))], "batch string, result string")


def windowed(s, d):
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return drift.window(e, "ts", lookback_hours=48).select("event_id")


def events_now(s, d):
    return table(s, d, "events").select("event_id", "event_type", "value", (F.col("event_id") % 100 / 100.0).alias("p"))


def baseline(s, d):
    """The active baseline of two, read back from the store as tables."""
    e = events_now(s, d)
    doc = scoring.baseline_document(e, e.select("event_type", "p"), "m", "a1", ["value"], ["event_type"], "event_type", "p")
    path = f"{scratch(s)}/baselines"
    store.register_baseline(doc.withColumn("baseline_json", F.lit('{"old":1}')), path)
    store.register_baseline(doc, path)
    number = "type:string,missing_rate:double,mean:double,cut_points:array<double>,bin_proportions:array<double>"
    shape = f"record_count bigint, feature_profiles struct<value:struct<{number}>>, prediction_profile struct<class_distribution:map<string,double>,low_confidence_rate:double,confidence:struct<{number}>>"
    one = store.active_baseline(s.read.parquet(path)).select(F.from_json("baseline_json", shape).alias("b"))
    p = one.select("b.record_count", "b.feature_profiles.value", "b.prediction_profile.*")
    told = p.select(F.explode("class_distribution").alias("event_type", "share"), F.col("record_count").alias("records"), F.round("low_confidence_rate", 9).alias("low_confidence_rate"), F.round("value.mean", 6).alias("mean_value"), F.round(F.col("value.cut_points")[8], 6).alias("top_decile"), F.round(F.col("value.bin_proportions")[9], 9).alias("top_bin"), F.size("confidence.cut_points").alias("confidence_cuts"))
    return told.withColumn("share", F.round("share", 9))


BASELINE = """with t as (select quantile_cont(value, 0.9) c, count(*) n, avg(value) m, avg(cast(event_id % 100 / 100.0 < 0.5 as double)) l from events)
 select event_type, round(count(*) / max(n), 9) share, max(n) records, round(max(l), 9) low_confidence_rate, round(max(m), 6) mean_value, round(max(c), 6) top_decile,
 (select round(count(*) filter (value >= c) / count(*), 9) from events, t) top_bin, cast(len(list_distinct((select quantile_cont(event_id % 100 / 100.0, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) from events))) as int) confidence_cuts from events, t group by 1"""


def reports(s, d):
    path = f"{scratch(s)}/reports"
    one = table(s, d, "events").agg(F.count("*").alias("record_count"), F.min("ts").cast("timestamp").alias("window_start"), F.max("ts").cast("timestamp").alias("window_end"))
    told = one.withColumns({"model_id": F.lit("m/1"), "artifact": F.lit("a1"), "overall_status": F.lit("ok"), "worst": F.lit("none")})
    store.append_report(told, path)
    store.append_report(told.withColumn("overall_status", F.lit("critical")), path)
    return s.read.parquet(path).select("model_id", "record_count", "overall_status", F.get_json_object("report_json", "$.worst").alias("worst"))


def audit_lines(s, d):
    p = (F.col("event_id") % 100) / 100.0
    e = table(s, d, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").cast("string").alias("request_id"), F.lit("m").alias("model_id"), F.lit("Model").alias("model_name"), F.lit("a1").alias("artifact_sha256"), F.col("event_type").alias("prediction"), F.create_map(F.lit("yes"), p, F.lit("no"), 1 - p).alias("probabilities"),
        (F.col("event_id") % 10).alias("record_index"), F.lit(10).alias("batch_size"), F.lit(1.005).alias("duration_ms"), F.col("user_id").alias("user"),
    )
    line = files.audit_events(e, b"audit-key", ["user"])
    plain = ("event", "timestamp", "request_id", "model_id", "model_name", "artifact_sha256", "input_feature_hash", "prediction", "record_index", "batch_size", "duration_ms")
    return line.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in plain], F.round(F.get_json_object("value", "$.probabilities.yes").cast("double"), 6).alias("yes"))


AUDIT_LINES = "select 'model_prediction' event, strftime(ts::timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp, event_id::varchar request_id, 'm' model_id, 'Model' model_name, 'a1' artifact_sha256, " + hmac_sql(b"audit-key", "'{\"user\":' || user_id || '}'") + " input_feature_hash, event_type prediction, (event_id % 10)::varchar record_index, '10' batch_size, '1.0' duration_ms, event_id % 100 / 100.0 yes from events"


def quality_lines(s, d):
    n = nations(s, d)
    line = files.quality_events(rules.report(n, rules.validate(n, CONTRACT), CONTRACT, "m"), "r1")
    listed = F.from_json(F.get_json_object("value", "$.issues"), "array<struct<code:string,count:bigint>>")
    return line.select(F.get_json_object("value", "$.event").alias("event"), F.get_json_object("value", "$.request_id").alias("request_id"), F.get_json_object("value", "$.category_contract_sha256").alias("contract"), F.inline(listed)).withColumnRenamed("count", "failing")


QUALITY_LINES = """select 'data_quality_validation' event, 'r1' request_id, sha256('{"n_name":["NATION_6"]}') contract, code, failing from
 (select 'numeric_out_of_range' code, count(*) filter (n_nationkey > 20) failing from nation union all select 'unseen_category', count(*) filter (n_name <> 'NATION_6') from nation) where failing > 0"""


def report_text(s, d):
    path = f"{scratch(s)}/report"
    files.write_report(nations(s, d).agg(F.count("*").alias("n"), F.max("n_name").alias("last")), path)
    one = s.read.text(path, wholetext=True)
    return one.select(F.get_json_object("value", "$.n").cast("int").alias("n"), F.get_json_object("value", "$.last").alias("last"), F.col("value").contains('\n  "n"').alias("indented"))


def health(s, d):
    path = f"{scratch(s)}/store"
    nations(s, d).write.parquet(path)
    return s.createDataFrame([(store.healthy(s, path), store.healthy(s, path + "-none"))], "there boolean, absent boolean")


def refused(s, d):
    """How many rows of the telemetry's table each condition refuses."""
    e = table(s, d, "events")
    rows = e.select(
        F.when(F.col("event_id") % 7 == 0, F.repeat(F.lit("i"), 37)).otherwise(F.col("event_id").cast("string")).alias("telemetry_id"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("model_id"), F.lit("a").alias("artifact"), F.col("ts").cast("timestamp").alias("recorded_at"),
        (F.col("ts").cast("timestamp") + F.make_interval(days=(F.col("event_id") % 5).cast("int"))).alias("expires_at"), F.lit("k").alias("key_id"), F.encode("props", "utf-8").alias("encrypted_payload"), F.sha2("props", 256).alias("payload_sha256"),
    )
    out, wrong = store.broken(rows, "telemetry")
    return out.groupBy(F.coalesce(wrong, F.lit("none")).alias("refusal")).agg(F.count("*").alias("n"))


REFUSED = "select case when event_id % 11 = 0 then 'model_id is null' when event_id % 5 = 0 then 'expires after it was recorded' when event_id % 7 = 0 then 'id of 36 characters at most' else 'none' end refusal, count(*) n from events group by 1"


def made_claims(s, d):
    """Synthetic records, as many of each kind as there are customers."""
    n = table(s, d, "customer").count()
    c, r = files.synthetic_claims(s, n, 5), files.synthetic_risks(s, n, 5)
    sound = lambda x: F.every(F.col("age").between(18, 90) & F.col("length_of_stay_hours").between(0, 120) & (F.col("visit_quarter") == F.ceil(F.col("visit_month") / 3)) & x)
    return c.agg(F.lit("claim").alias("kind"), F.count("*").alias("n"), sound(F.col("days_from_visit_to_billing").between(0, 120)).alias("sound")).unionByName(r.agg(F.lit("risk").alias("kind"), F.count("*").alias("n"), sound((F.col("approved_amount") <= F.col("billed_amount")) & ((F.col("claim_status") != "Rejected") | (F.col("approved_amount") == 0))).alias("sound")))


def tried(s, d):
    """A search over tree depths, scored on expanding folds; the best candidates first."""
    rows = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    folds = tables.settled(ml.expanding_folds(rows, ["o_orderkey"], 4))

    def prepared(train, test):
        """Distinct rows with the training rows' bins for the price, as many as a tree's own 32."""
        price = F.floor(ml.binned(train, "o_totalprice") / 2).cast("int").alias("o_totalprice")
        both = [x.select(F.lit(t).alias("test"), price, "o_orderstatus") for x, t in ((train, False), (test, True))]
        alike = ml.counted(both[0].unionByName(both[1]), ["test", "o_totalprice", "o_orderstatus"])
        return alike.where("not test"), alike.where("test")

    def score(c, train, test):
        model = ml.pipeline(["o_totalprice"], [], "o_orderstatus", ml.classifier("tree", weightCol="n", **c)).fit(train)
        return ml.overall_metrics(ml.confusion(ml.predicted(model, test, ["F", "O", "P"]), "o_orderstatus", "predicted", ["F", "O", "P"], "n")).first()["macro_f1"] or 0.0

    found = ml.search(folds, [{"maxDepth": 1}, {"maxDepth": 2}, {"maxDepth": 3}], score, prepared=prepared)
    return s.createDataFrame([(i + 1, c["maxDepth"], float(x)) for i, (x, c) in enumerate(found)], "rank int, depth int, macro_f1 double")


def strategies(s, d):
    """Resampling strategies compared on one test set, the best macro-F1 first."""
    rows = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    parts = tables.settled(ml.stratified_split(rows, "o_orderstatus", "o_orderkey"))  # read by every fit and score
    train, test, classes = parts.where("not test"), parts.where("test"), ["F", "O", "P"]

    def fit(own):
        model = ml.pipeline(["o_totalprice"], [], "o_orderstatus", ml.classifier("tree")).fit(own)
        return lambda df: ml.predicted(model, df, classes)

    return ml.compare_strategies(train, test, "o_orderstatus", {"as they are": lambda x: x, "undersampled": lambda x: ml.undersample(x, "o_orderstatus", "o_orderkey")}, fit, classes).select("strategy", "train_rows", "macro_f1")


_LINES = "string_agg(f || '=' || c, chr(10) order by f)"

QUERIES = {
    "csv_roundtrip": (csv_back, NATIONS),
    "csv_inferred": (csv_inferred, NATIONS),
    "json_lines_roundtrip": (json_lines_back, NATIONS),
    "json_array_roundtrip": (json_array_back, NATIONS),
    "parquet_roundtrip": (parquet_back, NATIONS),
    "inline_records": (records, "select n_nationkey age, case when n_nationkey % 3 <> 0 then n_name end as name from nation"),
    "word_vectors": (word_vectors, "select replace(n_name, ' ', '_') word, n_nationkey as first, n_regionkey as second from nation"),
    "batch_lines": (batches, "select count(*) n, min(n_nationkey) lowest from nation group by n_nationkey // 10"),
    "column_names": (names, "select * from (values (0, 'n_name', false), (1, 'n_nationkey', true), (2, 'n_regionkey', true)) t(place, name, is_number)"),
    "clipped": (clipped, "select c_custkey, least(greatest(c_acctbal, 0), 5000) bounded from customer"),
    "first_rows": (first_rows, "select o_orderkey, o_custkey from orders order by o_custkey, o_orderkey limit 7"),
    "numbered_rows": (numbered, "select o_orderkey, row_number() over (order by o_orderkey) - 1 place from orders"),
    "zipped_rows": (zipped, "with a as (select s_suppkey, row_number() over (order by s_suppkey) n from supplier), b as (select s_suppkey other, row_number() over (order by s_acctbal, s_suppkey) n from supplier) select s_suppkey, other from a join b using (n)"),
    "column_concat": (side_by_side, "select n_nationkey, n_name, suppliers, customers from nation full join (select s_nationkey n_nationkey, count(*) suppliers from supplier group by 1) using (n_nationkey) full join (select c_nationkey n_nationkey, count(*) customers from customer group by 1) using (n_nationkey)"),
    "wide_pivot": (wide, "select l_returnflag, coalesce(sum(l_linenumber) filter (l_linestatus = 'F'), 0)::bigint f, coalesce(sum(l_linenumber) filter (l_linestatus = 'O'), 0)::bigint o from lineitem group by 1"),
    "argmax_place": (highest, "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity >= greatest(l_linenumber * 10, 20) then 0 when l_linenumber * 10 >= 20 then 1 else 2 end as at from lineitem"),
    "parsed_times": (times, "select o_orderkey, case when o_orderkey % 9 <> 0 then date_trunc('minute', o_orderdate::timestamp) end as read, o_orderdate::timestamp strict, strftime(o_orderdate::timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') iso from orders"),
    "canonical_categories": (categories, "select c_custkey, c_custkey::varchar whole, c_custkey || '.5' half, trim(c_mktsegment) as text from customer"),
    "text_digests": (digests, "select c_custkey, sha256(c_name) digest from customer"),
    "table_prints": (fingerprints, "select true same, true unlike"),
    "unique_ids": (ids, "select count(*) n, 36 shortest, 36 longest from nation"),
    "dq_empty": (empty_issues, "select 'empty_dataset' code, 'error' severity, 0 as count"),
    "contract_export": (contract_print, f"with v as (select 'o_orderstatus' f, o_orderstatus v from orders union select 'o_orderpriority', o_orderpriority from orders), g as (select f, string_agg(v, ',' order by v) c, string_agg('\"' || v || '\"', ',' order by v) j from v group by 1) select 'm' model_id, '{{' || string_agg('\"' || f || '\":[' || j || ']', ',' order by f) || '}}' categories, sha256({_LINES}) contract_sha256 from g"),
    "gate_exit_codes": (exit_codes, EXIT_CODES),
    "request_rules": (requests, "select * from (values ('none', 'size'), ('unseen', 'issues'), ('fine', 'taken'), ('many', 'size')) t(batch, result)"),
    "lookback_window": (windowed, "select event_id from events where ts > (select max(ts) from events) - interval 48 hour"),
    "baseline_assembly": (baseline, BASELINE),
    "report_append": (reports, "select 'm/1' model_id, count(*) record_count, s overall_status, 'none' worst from events, (values ('ok'), ('critical')) t(s) group by s"),
    "audit_lines": (audit_lines, AUDIT_LINES),
    "quality_lines": (quality_lines, QUALITY_LINES),
    "report_text": (report_text, "select count(*) n, max(n_name) as last, true indented from nation"),
    "store_health": (health, "select true there, false absent"),
    "store_conditions": (refused, REFUSED),
    "synthetic_records": (made_claims, "select k kind, count(*) n, true sound from customer, (values ('claim'), ('risk')) t(k) group by k"),
    "search_depths": (tried, None),
    "strategy_comparison": (strategies, None),
}
