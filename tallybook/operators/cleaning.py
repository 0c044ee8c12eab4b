"""Confirmed mapping, row filters and value cleaning of raw sales lines.

Raw lines are text columns plus `dataset_id` and an order key `_ord` (any sortable type). Everything
up to `clean_lines` is narrow work; only the date-notation vote needs one small grouped count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import text as tx
from tallybook.operators.lookup import lookup_join
from tallybook.registry import ATTRIBUTE_PREFIX, UNMAPPED
from tallybook.session import cut

KEYS = ("dataset_id", "_ord")

# Names of the targets, by kind.
NUMBER_TARGETS = ("order_item.quantity", "quantity", "product.price", "price", "product.cost", "cost",
                  "product.stock", "stock", "revenue", "profit", "profit_margin",
                  "order_item.itemDiscount", "order_item.unitPrice")
ID_TARGETS = ("customer_id", "order_id", "product_id")
DATE_TARGETS = ("order_date", "order_item.createdAt")
TEXT_TARGETS = ("product.name", "product.description", "customer.fullName", "customer.email",
                "customer.phoneNumber", "customer.segment", "order.address", "order.orderVoucher")
KNOWN_TARGETS = (*NUMBER_TARGETS, *ID_TARGETS, *DATE_TARGETS, *TEXT_TARGETS, "order.status")
QUANTITY = ("order_item.quantity", "quantity")
PRICE = ("product.price", "price", "order_item.unitPrice")
COST = ("product.cost", "cost")
PRODUCT_KEY = ("product_id", "product.name")
CUSTOMER_KEY = ("customer_id", "customer.email", "customer.fullName")
ORDER_DATE = ("order_date", "order_item.createdAt")
# Column that holds, where lines of several layouts come together, the first of the targets each dataset has.
ROLES = {QUANTITY: "_quantity", PRICE: "_price", COST: "_cost", PRODUCT_KEY: "_product_key",
         CUSTOMER_KEY: "_customer_key", ORDER_DATE: "_order_date"}


@dataclass(frozen=True)
class Mapping:
    """A person's confirmed reading of the columns of one file layout."""

    confirmed: dict[str, str]
    attributes: dict[str, str] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()
    cost_pct: float | None = None
    cancelled_prefix: str = "C"
    # Notation number for a date target when it is known; otherwise each dataset votes.
    date_format: int | None = None

    def targets(self, columns: list[str]) -> dict[str, str]:
        """Raw column -> target for the mapped columns that are present."""
        out = {}
        for c in columns:
            t = self.confirmed.get(c)
            if c in self.ignored or c in KEYS or not t:
                continue
            if t != UNMAPPED and not t.startswith(ATTRIBUTE_PREFIX):
                out[c] = t
        repeated = sorted({t for t in out.values() if list(out.values()).count(t) > 1})
        if repeated:
            raise ValueError(f"two columns are mapped to the same target: {repeated}")
        return out

    def notes(self, columns: list[str]) -> list[str]:
        """Columns kept as metadata: neither mapped nor ignored (attribute columns included)."""
        mapped = self.targets(columns)
        return [c for c in columns if c not in mapped and c not in self.ignored and c not in KEYS]


def column_of(target: str) -> str:
    return target.replace(".", "_")


def first_present(df: DataFrame, *targets: str) -> str | None:
    """First of the targets that the file has; a choice of column, not of value."""
    if ROLES.get(targets) in df.columns:
        return ROLES[targets]
    return next((column_of(t) for t in targets if column_of(t) in df.columns), None)


def apply_mapping(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """Mapped columns under their target name; the others, as text, in map `_notes`; attributes
    also in map `_attributes`."""
    targets = mapping.targets(raw.columns)
    notes = mapping.notes(raw.columns)
    # A column left unmapped but already named like a target still serves as that target.
    targets |= {c: c for c in notes if c in KNOWN_TARGETS and c not in targets.values()}
    attributes = {c: k for c, k in mapping.attributes.items()
                  if c in raw.columns and c not in targets}
    mapped = [F.col(f"`{c}`").alias(column_of(t)) for c, t in targets.items()]
    return raw.select(
        *KEYS, *mapped,
        _text_map({c: c for c in notes}).alias("_notes"),
        _text_map(attributes).alias("_attributes"),
    )


def _text_map(columns: dict[str, str]) -> Column:
    if not columns:
        return F.create_map().cast("map<string,string>")
    pairs = [x for c, k in columns.items() for x in (F.lit(k), F.col(f"`{c}`").cast("string"))]
    return F.create_map(*pairs)


def row_flags(lines: DataFrame, mapping: Mapping) -> DataFrame:
    """`_cancelled` (raw order id has the prefix) and `_negative` (quantity below zero).

    The two filters run in this order, so a cancelled row is not counted as negative again.
    """
    cancelled = F.lit(False)
    if "order_id" in lines.columns:
        cancelled = F.coalesce(F.col("order_id").startswith(mapping.cancelled_prefix), F.lit(False))
    negative = F.lit(False)
    qty = first_present(lines, *QUANTITY)
    if qty:
        negative = F.coalesce(tx.amount(F.col(qty)) < 0, F.lit(False))
    return lines.withColumn("_cancelled", cancelled).withColumn("_negative", ~cancelled & negative)


def keep_valid(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col("_cancelled") & ~F.col("_negative")).drop("_cancelled", "_negative")


def row_counters(flagged: DataFrame) -> DataFrame:
    """Rows read, cancelled, negative and kept, per dataset."""
    bad = F.col("_cancelled") | F.col("_negative")
    return flagged.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(F.col("_cancelled").cast("long")).alias("cancelled_rows"),
        F.sum(F.col("_negative").cast("long")).alias("negative_rows"),
        F.sum((~bad).cast("long")).alias("clean_rows"),
    )


def normalise(lines: DataFrame) -> DataFrame:
    """Typed, cleaned columns; dates are only trimmed here and read by `read_dates`.

    Two steps, so that the costly first one is computed once per value: read, then drop the marks
    for missing values.
    """
    def present(targets: tuple[str, ...]) -> list[str]:
        return [column_of(t) for t in targets if column_of(t) in lines.columns]

    numbers, ids, texts = present((*NUMBER_TARGETS, "_quantity")), present(ID_TARGETS), present(TEXT_TARGETS)
    dates = present(DATE_TARGETS)
    read = {c: tx.amount(F.col(c)) for c in numbers}
    read |= {c: tx.id_text(F.col(c)) for c in ids}
    read |= {c: tx.strip(F.col(c)) for c in texts + dates}
    read |= {c: tx.clean_status(F.col(c)) for c in present(("order.status",))}
    known = {c: tx.finite(F.col(c)) for c in numbers}
    known |= {c: tx.not_token(F.col(c), *tx.ID_TOKENS) for c in ids}
    known |= {c: tx.not_token(F.col(c), "nan", "None") for c in texts + dates}
    return lines.withColumns(read).withColumns(known)


def date_notation(lines: DataFrame, column: str) -> DataFrame:
    """Per dataset the notation that reads most values of `column`; the earlier one on ties. Each
    distinct text is tried once."""
    texts = lines.filter(F.col(column).isNotNull()).groupBy("dataset_id", column).agg(F.count(F.lit(1)).alias("_n"))
    reads = [F.sum(F.when(tx.read_date(F.col(column), i).isNotNull(), F.col("_n")).otherwise(0)).alias(f"n{i}")
             for i in range(len(tx.DATE_FORMATS))]
    counts = texts.groupBy("dataset_id").agg(*reads)
    ranked = F.array(*[
        F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("order"))
        for i in range(len(tx.DATE_FORMATS))
    ])
    return counts.select("dataset_id", (-F.array_max(ranked)["order"]).alias("_notation"))


def read_dates(lines: DataFrame, mapping: Mapping) -> DataFrame:
    """Date columns as wall-clock timestamps; texts that do not fit stay in `<column>_rejected`.

    The vote is written first, one row a dataset: its size is then known to the planner, which needn't
    shuffle the lines to join it where it is small.
    """
    for target in DATE_TARGETS:
        c = column_of(target)
        if c not in lines.columns:
            continue
        if mapping.date_format is not None:
            value = tx.read_date(F.col(c), mapping.date_format)
            lines = lines.withColumn("_date", value)
        else:
            lines = lookup_join(lines, cut(date_notation(lines, c)), ["dataset_id"])
            value = F.lit(None).cast("timestamp_ntz")
            for i in reversed(range(len(tx.DATE_FORMATS))):
                value = F.when(F.col("_notation") == i, tx.read_date(F.col(c), i)).otherwise(value)
            lines = lines.withColumn("_date", value).drop("_notation")
        lines = lines.withColumn(
            f"{c}_rejected", F.when(F.col("_date").isNull(), F.col(c))
        ).withColumn(c, F.col("_date")).drop("_date")
    return lines


def with_line_money(lines: DataFrame) -> DataFrame:
    """`_line_revenue` = quantity x price, else the revenue column; `_item_profit` where cost is
    known."""
    qty = first_present(lines, *QUANTITY)
    price = first_present(lines, *PRICE)
    cost = first_present(lines, *COST)
    null = F.lit(None).cast("double")
    if "_priced" in lines.columns:
        revenue = F.when(F.col("_priced"), F.col(qty) * F.col(price)).otherwise(F.col("revenue"))
    elif qty and price:
        revenue = F.col(qty) * F.col(price)
    elif "revenue" in lines.columns:
        revenue = F.col("revenue")
    else:
        revenue = null
    profit = revenue - F.col(cost) * F.col(qty) if cost and qty else null
    return lines.withColumn("_line_revenue", revenue).withColumn("_item_profit", profit)


def clean_lines(raw: DataFrame, mapping: Mapping, dates: bool = True) -> DataFrame:
    """Raw lines to valid, typed lines with their money columns.

    Four entity builders read the result: persist it, or write it to a table, before using it
    more than once.
    """
    lines = normalise(keep_valid(row_flags(apply_mapping(raw, mapping), mapping)))
    if dates:
        lines = read_dates(lines, mapping)
    return with_line_money(lines)


def written_lines(raw: DataFrame, mapping: Mapping, columns: list[str] | None = None) -> DataFrame:
    """Clean lines, written once (only `columns`, where given). The vote on the notations reads the written date
    texts, as do the readings, so the raw lines are made and cleaned once, not once more for the vote."""
    lines = clean_lines(raw, mapping, dates=False)
    return read_dates(cut(lines.select(*columns) if columns else lines), mapping)
