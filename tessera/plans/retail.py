"""Retail analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalars import half_even
from tessera.operators import tables as t
from tessera.plans.fixtures import SALES, sales, table


def total_price(s, d):
    return sales(s, d).select("invoice", "item", "supplier", "line", half_even(F.col("quantity").cast("double") * F.col("unit_price"), 2).alias("total_price"))


def top_items(s, d, k=3):
    return t.top_k(sales(s, d), ["item"], F.col("quantity"), "quantity", k).select("item", F.col("quantity").cast("double").alias("quantity"))


def unique_customers(s, d):
    return sales(s, d).agg(F.countDistinct("customer").alias("n_customers"))


def avg_quantity(s, d):
    return sales(s, d).where("customer is not null").groupBy("customer", "invoice").agg(F.round(F.avg(F.col("quantity").cast("double")), 6).alias("avg_quantity"))


def events_per_hour(s, d):
    return table(s, d, "events").groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(F.count("*").alias("n")).orderBy("hour")


def top_customers_share(s, d):
    rows = sales(s, d)
    total = rows.agg(F.sum("revenue").cast("double").alias("total"))
    top = t.top_k(rows, ["customer"], F.col("revenue"), "revenue", 5)
    return top.crossJoin(F.broadcast(total)).select("customer", F.col("revenue").cast("double").alias("revenue"), F.round(F.col("revenue").cast("double") / F.col("total"), 9).alias("share"))  # total is one row


def monthly_revenue(s, d):
    return sales(s, d).where("sold_at is not null").groupBy(F.date_format("sold_at", "yyyy-MM").alias("month")).agg(F.sum("revenue").cast("double").alias("revenue")).orderBy("month")


def top_invoices_pivot(s, d):
    rows = sales(s, d)
    keys = t.top_k(rows, ["invoice"], F.col("revenue"), "r", 5)
    cells = t.in_keys(rows, keys, "invoice").groupBy("invoice", "item").agg(F.sum("quantity").alias("q"))
    # long form of the filled pivot: every top invoice with every item that one of them has; both sides come from five invoices
    grid = cells.select("invoice").distinct().crossJoin(F.broadcast(cells.select("item").distinct()))
    return grid.join(cells, ["invoice", "item"], "left").select("invoice", "item", F.coalesce(F.col("q"), F.lit(0)).cast("double").alias("quantity"))


def best_product(s, d):
    top = t.top_k(sales(s, d), ["item"], F.col("revenue"), "revenue", 1)
    return table(s, d, "part").join(F.broadcast(top), F.col("p_partkey") == F.col("item")).select("item", F.col("p_name").alias("description"), F.col("revenue").cast("double").alias("revenue"))


def mean_unit_price(s, d):
    return sales(s, d).groupBy("invoice").agg(F.avg("unit_price").alias("m")).agg(F.round(F.avg("m"), 4).alias("aov_by_unit_price"))


def true_order_value(s, d):
    return sales(s, d).groupBy("invoice").agg(F.sum("revenue").alias("r")).agg(F.round(F.sum("r").cast("double") / F.count("*"), 4).alias("order_value"))


def busiest_customer(s, d):
    return sales(s, d).where("customer is not null").groupBy("customer").agg(F.count("invoice").alias("n")).orderBy(F.desc("n"), "customer").limit(1)


def without_stock(s, d):
    stock = table(s, d, "part").where("p_size <= 25")
    return t.not_in_keys(sales(s, d), stock, "item", "p_partkey").agg(F.count("*").alias("n_rows"), F.countDistinct("item").alias("n_items"))


def sales_with_stock(s, d):
    stock = table(s, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("item"))
    return t.in_keys(sales(s, d), stock, "item").groupBy("item").agg(F.sum("quantity").cast("double").alias("quantity"))


QUERIES = {
    "sales_total_price": (total_price, f"select invoice, item, supplier, line, round_even(cast(quantity as double) * unit_price, 2) total_price from {SALES}"),
    "top3_items_by_qty": (top_items, f"select item, cast(sum(quantity) as double) quantity from {SALES} group by 1 order by 2 desc, 1 limit 3"),
    "top10_items_by_qty": (lambda s, d: top_items(s, d, 10), f"select item, cast(sum(quantity) as double) quantity from {SALES} group by 1 order by 2 desc, 1 limit 10"),
    "unique_customers": (unique_customers, f"select count(distinct customer) n_customers from {SALES}"),
    "avg_qty_per_customer_invoice": (avg_quantity, f"select customer, invoice, round(avg(cast(quantity as double)), 6) avg_quantity from {SALES} where customer is not null group by all"),
    "events_per_hour": (events_per_hour, "select hour(ts) as hour, count(*) n from events group by 1 order by 1"),
    "top5_customers_revenue_share": (top_customers_share, f"select customer, cast(sum(revenue) as double) revenue, round(cast(sum(revenue) as double) / (select cast(sum(revenue) as double) from {SALES}), 9) share from {SALES} where customer is not null group by 1 order by 2 desc, 1 limit 5"),
    "monthly_revenue_trend": (monthly_revenue, f"select strftime(sold_at, '%Y-%m') as month, cast(sum(revenue) as double) revenue from {SALES} where sold_at is not null group by 1 order by 1"),
    "top5_invoices_item_pivot": (top_invoices_pivot, f"with k as (select invoice from {SALES} group by 1 order by sum(revenue) desc, 1 limit 5), c as (select invoice, item, sum(quantity) q from {SALES} where invoice in (select invoice from k) group by all) select k.invoice, i.item, cast(coalesce(q, 0) as double) quantity from k cross join (select distinct item from c) i left join c on c.invoice = k.invoice and c.item = i.item"),
    "best_revenue_product": (best_product, f"select item, p_name description, cast(r as double) revenue from (select item, sum(revenue) r from {SALES} group by 1 order by 2 desc, 1 limit 1) join part on p_partkey = item"),
    "mean_unit_price_per_invoice": (mean_unit_price, f"select round(avg(m), 4) aov_by_unit_price from (select avg(unit_price) m from {SALES} group by invoice)"),
    "true_order_value": (true_order_value, f"select round(cast(sum(r) as double) / count(*), 4) order_value from (select sum(revenue) r from {SALES} group by invoice)"),
    "busiest_customer": (busiest_customer, f"select customer, count(invoice) n from {SALES} where customer is not null group by 1 order by 2 desc, 1 limit 1"),
    "items_without_stock": (without_stock, f"select count(*) n_rows, count(distinct item) n_items from {SALES} where item not in (select p_partkey from part where p_size <= 25)"),
    "items_with_stock": (sales_with_stock, f"select item, cast(sum(quantity) as double) quantity from {SALES} where item in (select p_partkey from part where p_size <= 25) group by 1"),
}
