"""Star-schema loads from the two wide files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.operators.lookup import lookup_join, measured
from veriscope.operators.ordering import first_per_key
from veriscope.sources.files import POSITION


def dimension(rows: DataFrame, key: str, attributes: Sequence[str], surrogate: str,
              order: str = POSITION) -> DataFrame:
    """One row per key with the attributes of its first row and a stable surrogate id.

    The id is a hash of the key, so it needs no global numbering and stays the
    same when the load is repeated.
    """
    first = first_per_key(rows.select(key, *attributes, order), [key], [order]).drop(order)
    return first.select(F.xxhash64(key).alias(surrogate), key, *attributes)


def first_wins(rows: DataFrame, key: str, columns: Sequence[str], order: str = POSITION) -> DataFrame:
    """First row per primary key."""
    return first_per_key(rows.select(key, *[c for c in columns if c != key], order), [key], [order]).drop(order)


def load_spend(rows: DataFrame) -> dict[str, DataFrame]:
    """customers, products and orders of the spend file."""
    customers = measured(dimension(
        rows, "customer_name", ["segment", "state", "country", "market", "region"], "customer_id"
    ))
    products = first_wins(rows, "product_id", ["product_name", "category", "sub_category"])
    facts = first_wins(
        rows, "order_id",
        ["order_date", "ship_date", "ship_mode", "customer_name", "product_id", "sales", "quantity",
         "discount", "profit", "shipping_cost", "order_priority", "year"],
    )
    orders = facts.join(customers.select("customer_name", "customer_id"), ["customer_name"])
    return {"customers": customers, "products": products, "orders": orders.drop("customer_name")}


def load_supply(rows: DataFrame) -> dict[str, DataFrame]:
    """products, suppliers, sales and supply_chain of the supply-chain file."""
    products = first_wins(
        rows, "sku", ["product_type", "price", "availability", "stock_levels", "customer_demographics"]
    )
    suppliers = dimension(
        rows, "supplier_name",
        ["location", "lead_time", "shipping_carriers", "transportation_modes", "routes"], "supplier_id",
    ).withColumnsRenamed(
        {"shipping_carriers": "shipping_carrier", "transportation_modes": "transportation_mode",
         "routes": "route"}
    )
    sales = rows.select(
        "sku", F.col("number_of_products_sold").alias("products_sold"), "revenue_generated", "order_quantities"
    )
    chain = lookup_join(
        rows, suppliers.select("supplier_name", "supplier_id"), ["supplier_name"], "inner"
    ).select(
        "sku", "supplier_id", F.col("lead_times").alias("lead_time"),
        F.col("shipping_times").alias("shipping_time"), F.col("shipping_costs").alias("shipping_cost"),
        F.col("production_volumes").alias("production_volume"), "manufacturing_lead_time",
        F.col("manufacturing_costs").alias("manufacturing_cost"),
        F.col("inspection_results").alias("inspection_result"),
        F.col("defect_rates").alias("defect_rate"), F.col("costs").alias("total_cost"),
    )
    return {"products": products, "suppliers": suppliers, "sales": sales, "supply_chain": chain}


def load_counts(rows: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Attempted rows beside the rows that were kept."""
    tried = rows.agg(F.count("*").alias("attempted"), F.count_distinct(key).alias("distinct_keys"))
    return tried.join(loaded.agg(F.count("*").alias("inserted")))


def product_profitability(products: DataFrame, supply_chain: DataFrame) -> DataFrame:
    """Average costs and margin per product."""
    joined = products.join(supply_chain.select("sku", "total_cost", "shipping_cost"), ["sku"])
    averaged = joined.groupBy("sku", "product_type", "price", "stock_levels").agg(
        F.avg("total_cost").alias("avg_total_cost"), F.avg("shipping_cost").alias("avg_shipping_cost")
    )
    profit = F.col("price") - F.col("avg_total_cost")
    return averaged.withColumns(
        {"avg_profit": profit, "profit_margin": F.try_divide(profit, F.nullif("price", F.lit(0.0)))}
    )
