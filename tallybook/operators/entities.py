"""Customers, products, orders and order items out of cleaned lines.

Every dimension is one grouped aggregate. `min_by(value, _ord)` over non-null values combines on the
map side, so a key that holds a third of the lines sends one row per task. Rows without a key are
filtered before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from tallybook.functions import text as tx
from tallybook.operators.cleaning import (
    CUSTOMER_KEY, ORDER_DATE, PRICE, PRODUCT_KEY, QUANTITY, Mapping, column_of, first_present)
from tallybook.operators.mapping_report import coverage_of_targets


def first_value(c: Column, order: str = "_ord") -> Column:
    """First non-null value in file order."""
    return F.min_by(c, F.when(c.isNotNull(), F.col(order)))


def _first_or_null(lines: DataFrame, column: str | None, kind: str) -> Column:
    if column and column in lines.columns:
        return first_value(F.col(column))
    return F.lit(None).cast(kind)


EXACT = 1e15  # amounts below it are summed in decimals, so a sum doesn't depend on the order of its rows


def exact_sum(c: str) -> Column:
    """Sum of amounts, to a millionth; null where none is known."""
    small = F.abs(F.col(c)) < EXACT
    exact = F.sum(F.when(small, F.col(c).cast("decimal(22,6)"))).cast("double")
    rest = F.sum(F.when(~small, F.col(c)))
    return F.coalesce(exact + rest, exact, rest)


def keyed(lines: DataFrame, key: str) -> GroupedData:
    """Lines by dataset and key. Texts among the aggregates make Spark sort by the key; led by its hash, that
    compares numbers instead of texts that all begin alike."""
    return lines.groupBy(F.xxhash64("dataset_id", key).alias("_hash"), "dataset_id", F.col(key).alias("_key"))


def _empty(df: DataFrame) -> DataFrame:
    return df.limit(0)


def products(lines: DataFrame) -> DataFrame:
    key = first_present(lines, *PRODUCT_KEY)
    by_id = F.lit(key == "product_id")
    if "_product_kind" in lines.columns:
        by_id = F.max(F.col("_product_kind") == "product_id")
    source = lines.filter(F.col(key).isNotNull()) if key else \
        _empty(lines.withColumn("product_id", F.lit(None).cast("string")))
    key = key or "product_id"
    grouped = keyed(source, key).agg(
        _first_or_null(source, "product_name", "string").alias("_name"),
        _first_or_null(source, "product_price", "double").alias("price"),
        _first_or_null(source, "product_cost", "double").alias("cost"),
        _first_or_null(source, "product_stock", "double").try_cast("long").alias("stock"),
        _first_or_null(source, "product_description", "string").alias("description"),
        F.min("_ord").alias("_ord"), by_id.alias("_by_id"),
    )
    return grouped.select(
        "dataset_id",
        F.coalesce("_name", "_key", F.lit("Unknown Product")).alias("name"),
        F.when(F.col("_by_id"), F.col("_key")).alias("externalAccId"),
        "price", "cost", "stock", "description", "_ord",
    )


def customer_key(lines: DataFrame) -> str | None:
    return first_present(lines, *CUSTOMER_KEY)


def customers(lines: DataFrame, notes: list[str] | None = None) -> DataFrame:
    """One row per customer. `notes` are the metadata columns to keep (first non-null of each)."""
    key = customer_key(lines)
    source = lines.filter(F.col(key).isNotNull()) if key else \
        _empty(lines.withColumn("customer_id", F.lit(None).cast("string")))
    key = key or "customer_id"
    kind = F.lit(next((t for t in CUSTOMER_KEY if column_of(t) == key), None)).cast("string")
    if "_customer_kind" in lines.columns:
        kind = F.max("_customer_kind")
    note_cols = [first_value(F.col("_notes")[n]).alias(f"_note{i}")
                 for i, n in enumerate(notes or [])]
    grouped = keyed(source, key).agg(
        _first_or_null(source, "customer_fullName", "string").alias("_name"),
        _first_or_null(source, "customer_email", "string").alias("_email"),
        _first_or_null(source, "customer_phoneNumber", "string").alias("phoneNumber"),
        _first_or_null(source, "customer_segment", "string").alias("segment"),
        F.min("_ord").alias("_ord"), kind.alias("_kind"),
        *note_cols,
    )
    is_id, is_email, is_name = (F.col("_kind") == t for t in CUSTOMER_KEY)
    fallback = F.when(is_id, F.concat(F.lit("Customer "), F.col("_key"))).when(is_name, F.col("_key"))
    pairs = [x for i, n in enumerate(notes or []) for x in (F.lit(n), F.col(f"_note{i}"))]
    metadata = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else \
        F.create_map().cast("map<string,string>")
    return grouped.select(
        "dataset_id",
        F.when(is_id, F.col("_key")).alias("clerkId"),
        F.coalesce("_name", fallback).alias("fullName"),
        F.when(is_email, F.col("_key")).otherwise(F.col("_email")).alias("email"),
        "phoneNumber", "segment", metadata.alias("metadata"), "_ord",
    )


def orders(lines: DataFrame, cost_pct: float | None = None,
           profit_from: str = "cost_pct") -> DataFrame:
    """One row per order id; revenue is the sum of line revenues (0.0 when none is known).

    `profit_from="items"` takes the sum of the known item profits instead of a cost share.
    """
    source = lines if "order_id" in lines.columns else \
        _empty(lines.withColumn("order_id", F.lit(None).cast("string")))
    grouped = keyed(source.filter(F.col("order_id").isNotNull()), "order_id").agg(
        F.coalesce(exact_sum("_line_revenue"), F.lit(0.0)).alias("revenue"),
        exact_sum("_item_profit").alias("_items_profit"),
        _first_or_null(source, customer_key(source), "string").alias("customerExternalId"),
        _first_or_null(source, first_present(source, *ORDER_DATE),
                       "timestamp_ntz").alias("createdAt"),
        _first_or_null(source, "order_status", "string").alias("_status"),
        _first_or_null(source, "order_address", "string").alias("address"),
        _first_or_null(source, "order_orderVoucher", "string").alias("orderVoucher"),
        F.min("_ord").alias("_ord"),
        *([F.max("_cost_pct").alias("_cost_pct")] if "_cost_pct" in source.columns else []),
    )
    if profit_from == "items":
        profit = F.col("_items_profit")
    elif "_cost_pct" in source.columns:
        profit = F.bround(F.col("revenue") * (1 - F.col("_cost_pct")), 4)
    elif cost_pct is not None:
        profit = F.bround(F.col("revenue") * F.lit(1 - cost_pct), 4)
    else:
        profit = F.lit(None).cast("double")
    margin = F.when(F.col("revenue") != 0, F.bround(profit / F.col("revenue") * 100, 2))
    return grouped.select(
        "dataset_id", F.col("_key").alias("externalOrderId"), "customerExternalId",
        F.coalesce("_status", F.lit("completed")).alias("status"),
        F.col("revenue").alias("total"), "revenue", profit.alias("profit"),
        margin.alias("profit_margin"), "createdAt", "address", "orderVoucher", "_ord",
    )


def order_items(lines: DataFrame) -> DataFrame:
    """One row per kept line, lines without an order id included."""
    def own(name: str, kind: str) -> Column:
        return F.col(name) if name in lines.columns else F.lit(None).cast(kind)

    price = first_present(lines, *PRICE)
    qty = first_present(lines, *QUANTITY)
    quantity = F.col(qty) if qty else F.lit(None).cast("double")
    present = lambda _, v: v.isNotNull() & ~F.trim(v).isin("", "nan", "None")
    return lines.select(
        "dataset_id",
        own("order_id", "string").alias("orderExternalId"),
        own("product_id", "string").alias("productAccId"),
        own("product_name", "string").alias("productName"),
        F.coalesce(quantity, F.lit(1.0)).try_cast("long").alias("quantity"),
        (F.col(price) if price else F.lit(None).cast("double")).alias("unitPrice"),
        F.coalesce(own("order_item_itemDiscount", "double"), F.lit(0.0)).alias("itemDiscount"),
        F.col("_line_revenue").alias("revenue"),
        F.col("_item_profit").alias("profit"),
        F.map_filter("_attributes", present).alias("attributes"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        "_ord",
    )


LONG_LIMIT = float(2**63)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Kept lines with a value no entity can take: `(dataset_id, _ord, reason)`, one row per reason.

    A text in a date column that its dataset's notation cannot read, or a quantity beyond a 64-bit
    integer. The lines stay in the entities with that value null.
    """
    reasons = []
    for c in ("order_date", "order_item_createdAt"):
        if f"{c}_rejected" in lines.columns:
            bad = F.col(f"{c}_rejected")
            reasons.append(F.when(bad.isNotNull(), F.concat(F.lit(f"{c}: not a date: "), bad)))
    qty = first_present(lines, *QUANTITY)
    if qty:
        reasons.append(F.when(F.abs(qty) >= LONG_LIMIT, F.lit(f"{qty.lstrip('_')}: out of range")))
    if not reasons:
        reasons = [F.lit(None).cast("string")]
    return lines.select(
        "dataset_id", "_ord",
        F.explode(F.filter(F.array(*reasons), lambda r: r.isNotNull())).alias("reason"),
    )


def _count_by_dataset(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias(name))


def clean_summary(counters: DataFrame, lines: DataFrame, entities: dict[str, DataFrame],
                  mapping: Mapping) -> DataFrame:
    """Row counters, entity counts, failed rows and field coverage: one row per dataset."""
    out = counters
    for name, df in entities.items():
        out = out.join(_count_by_dataset(df, f"{name}_found"), "dataset_id", "left")
    failed = rejected_lines(lines).select("dataset_id", "_ord").distinct()
    out = out.join(_count_by_dataset(failed, "failed_rows"), "dataset_id", "left")
    out = out.fillna(0)
    pct, derived, missing = coverage_of_targets(
        [t for c, t in mapping.confirmed.items() if c not in mapping.ignored],
        computed=computed_fields(lines.columns, mapping),
    )
    return out.withColumns({
        "ml_coverage_pct": F.lit(pct),
        "derived_fields": F.lit(",".join(derived)),
        "missing_fields": F.lit(",".join(missing)),
    })


def computed_fields(columns: list[str], mapping: Mapping) -> list[str]:
    """Fields the cleaning itself adds: line revenue, and profit and margin from a cost share."""
    out = []
    present = {c.replace("_", ".", 1) for c in columns} | set(columns)
    if present & {*QUANTITY, "order_item_quantity"} and present & {*PRICE, "order_item_unitPrice"}:
        out.append("revenue")
    if mapping.cost_pct is not None and "order_id" in columns:
        out += ["profit", "profit_margin"]
    return out
