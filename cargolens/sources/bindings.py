"""Logical tables read from the star-schema parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scale import nearest_in_time


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def warehouse_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines: date, order_id, sku, quantity; a (date, order, sku) may repeat."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .select("date", F.col("o_orderkey").alias("order_id"),
                    F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("quantity")))


def _nation_regions(spark: SparkSession, folder: str) -> DataFrame:
    """25 nations with their 5 regions: fixed-size dimension tables, safe to broadcast."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)


def _region_lines(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"),
                                                    F.col("l_quantity").alias("quantity"), *columns)
    customer = (table(spark, folder, "customer").select("c_custkey", "c_nationkey")
                .join(F.broadcast(_nation_regions(spark, folder)),
                      F.col("c_nationkey") == F.col("n_nationkey"))
                .select("c_custkey", F.col("r_name").alias("region")))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "region")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def demand(spark: SparkSession, folder: str) -> DataFrame:
    """date, region, sku, quantity with one row for each key."""
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("sku"))
    lines = _region_lines(spark, folder, ["l_partkey"])
    return (lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("date", "region", "sku").agg(F.sum("quantity").alias("quantity")))


def regional_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily demand of each region as series_id, date, quantity."""
    return (_region_lines(spark, folder, []).groupBy(F.col("region").alias("series_id"), "date")
            .agg(F.sum("quantity").alias("quantity")))


def total_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily demand of all regions and SKUs as one series."""
    return (table(spark, folder, "lineitem")
            .groupBy(F.lit("total").alias("series_id"), F.to_date("l_shipdate").alias("date"))
            .agg(F.sum("l_quantity").alias("quantity")))


def order_counts_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded orders of each day; days without orders have no row."""
    return (table(spark, folder, "orders")
            .groupBy(F.lit("orders").alias("series_id"), F.to_date("o_orderdate").alias("date"))
            .agg(F.count(F.lit(1)).cast("double").alias("quantity")))


def warehouse_demand(spark: SparkSession, folder: str) -> DataFrame:
    """warehouse, date, sku, quantity; the warehouse is the region of the supplier."""
    supplier = (table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
                .join(F.broadcast(_nation_regions(spark, folder)),
                      F.col("s_nationkey") == F.col("n_nationkey"))
                .select("s_suppkey", F.col("r_name").alias("warehouse")))
    # Summing before the join keeps a hot supplier's lines from travelling one by one.
    lines = (table(spark, folder, "lineitem")
             .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("sku"))
             .agg(F.sum("l_quantity").alias("quantity")))
    return (lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("warehouse", "date", "sku").agg(F.sum("quantity").alias("quantity")))


def order_quantities(spark: SparkSession, folder: str) -> DataFrame:
    return (table(spark, folder, "lineitem").groupBy("l_orderkey")
            .agg(F.sum("l_quantity").alias("quantity")))


def waybills(spark: SparkSession, folder: str) -> DataFrame:
    """customer_id, waybill_id, date, quantity for orders with at least one line."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"))
    return (orders.join(order_quantities(spark, folder), F.col("o_orderkey") == F.col("l_orderkey"))
            .select(F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("waybill_id"),
                    "date", "quantity"))


def business_volume(spark: SparkSession, folder: str) -> DataFrame:
    """Second source for the same quantity: customer_id, business_volume."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("customer_id"))
            .agg(F.sum("l_quantity").alias("business_volume")))


def click_to_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """order_id, ds, accept_time, delivery_time: a click and the same user's next purchase.

    A user with a third of all events is spread over the hours of those events.
    """
    ev = (table(spark, folder, "events").where(F.col("event_type").isin("click", "purchase"))
          .select("event_id", "user_id", "ts", "event_type"))
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    ev = nearest_in_time(ev, ["user_id"], "ts", bought, "bought", forward=True, inclusive=False)
    second = [F.date_trunc("SECOND", c).cast("timestamp_ntz") for c in ("ts", "bought")]
    return (ev.where(F.col("event_type") == "click")
            .select(F.col("event_id").alias("order_id"), F.date_format("ts", "Mdd").alias("ds"),
                    second[0].alias("accept_time"), second[1].alias("delivery_time")))


def order_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """order_id, line, accept_time (order date), delivery_time (ship date); may be negative."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
                    F.col("o_orderdate").alias("accept_time"), F.col("l_shipdate").alias("delivery_time")))


def cities(spark: SparkSession, folder: str) -> DataFrame:
    """city_id, region, x_km, y_km, demand: the nations on a fixed plane, weighted by orders."""
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    weight = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .groupBy("c_nationkey").agg(F.sum("n").cast("double").alias("demand")))
    nation = table(spark, folder, "nation")
    return (nation.join(weight, F.col("n_nationkey") == F.col("c_nationkey"))
            .select(F.format_string("N%02d", "n_nationkey").alias("city_id"),
                    F.col("n_regionkey").alias("region"),
                    ((F.col("n_nationkey") * 37) % 100).cast("double").alias("x_km"),
                    ((F.col("n_nationkey") * 61) % 100).cast("double").alias("y_km"), "demand"))


def embedding_points(spark: SparkSession, folder: str) -> DataFrame:
    """point_id, label, x_km, y_km, demand from the first two embedding dimensions."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), "label",
                    (F.col("embedding")[0].cast("double") * 100).alias("x_km"),
                    (F.col("embedding")[1].cast("double") * 100).alias("y_km"),
                    (F.col("label") + 1).cast("double").alias("demand"))
