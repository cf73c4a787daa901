"""The tables under the roles that the operators name: sales, stock, patients, visits, bills, telemetry, posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("l_orderkey").alias("invoice"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("line"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("sold_at"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("revenue"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")
    )


SALES = """(select l_orderkey invoice, l_partkey item, l_suppkey supplier, l_linenumber line, o_custkey customer, o_orderdate sold_at,
 cast(l_quantity as decimal(18,2)) quantity, cast(l_extendedprice as decimal(18,2)) revenue, l_extendedprice / l_quantity unit_price
 from lineitem left join orders on l_orderkey = o_orderkey)"""


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of even market segments' keys stay; odd ages, a missing insurer and a chronic flag are derived."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("patient_id"), (F.col("c_custkey") % 90 + 5).cast("int").alias("age"), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"), F.col("c_nationkey").cast("string").alias("city"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("insurance_provider"), (F.col("c_custkey") % 3 == 0).cast("int").alias("chronic_flag"), F.lit("1990-01-01").cast("timestamp_ntz").alias("registration_date"))


PATIENTS = """(select c_custkey patient_id, cast(c_custkey % 90 + 5 as int) age, case when c_custkey % 2 = 0 then 'F' else 'M' end gender,
 cast(c_nationkey as varchar) city, case when c_custkey % 11 <> 0 then c_mktsegment end insurance_provider, cast(c_custkey % 3 = 0 as int) chronic_flag,
 timestamp '1990-01-01' registration_date from customer)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders; a patient may have none."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("visit_date"), F.col("o_orderpriority").alias("department"), F.col("o_orderstatus").alias("visit_type"), F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_orderkey") % 240).cast("double")).alias("length_of_stay_hours"), F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("risk_score"), (F.col("o_orderkey") % 101 + 100).cast("int").alias("doctor_id"))


VISITS = """(select o_orderkey visit_id, o_custkey patient_id, o_orderdate visit_date, o_orderpriority department, o_orderstatus visit_type,
 case when o_orderkey % 13 <> 0 then cast(o_orderkey % 240 as double) end length_of_stay_hours, ['Low','Medium','High'][cast(o_orderkey % 3 + 1 as int)] risk_score,
 cast(o_orderkey % 101 + 100 as int) doctor_id from orders)"""


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("bill_id"), F.col("l_orderkey").alias("visit_id"), F.col("l_extendedprice").alias("billed_amount"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("approved_amount"), F.when(F.col("l_returnflag") == "R", "Rejected").when(F.col("l_returnflag") == "A", "Paid").otherwise("Pending").alias("claim_status"), F.when(F.col("l_partkey") % 31 != 0, F.col("l_quantity")).alias("payment_days"), F.col("l_shipdate").alias("billing_date"))


BILLS = """(select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) bill_id, l_orderkey visit_id, l_extendedprice billed_amount,
 round(l_extendedprice * (1 - l_discount), 2) approved_amount, case l_returnflag when 'R' then 'Rejected' when 'A' then 'Paid' else 'Pending' end claim_status,
 case when l_partkey % 31 <> 0 then l_quantity end payment_days, l_shipdate billing_date from lineitem)"""
