"""Queries over the messy sales export: cleaning, entities, load and training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import cleaning as cl
from tallybook.operators import entities as en
from tallybook.operators import loading as ld
from tallybook.operators.training import training_table
from tallybook.plans.extract import MAPPING, extract, oracle_extract, order_number
from tallybook.registry import TRAINING_COLUMNS
from tallybook.session import cut, fresh_path
from tallybook.sources import stores

NOTES = ["Size", "Colour", "Region", "Channel"]
RUN_TS = "2002-01-01 00:00:00"
# What an order's money, customer, status and date are made of.
ORDER_FACTS = ["dataset_id", "_ord", "order_id", "customer_id", "order_date", "order_status", "_line_revenue",
               "_item_profit"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.clean_lines(extract(spark, sf_dir), MAPPING, dates=False)


def _written(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return cl.written_lines(extract(spark, sf_dir), MAPPING, columns)


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.apply_mapping(extract(spark, sf_dir), MAPPING)


def money(c: str):
    return F.round(F.col(c), 4).alias(c)


def orders_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.orders(_lines(spark, sf_dir)).select(
        "dataset_id", "externalOrderId", "customerExternalId", "status", money("revenue"))


def clean_counters(spark, sf_dir):
    return cl.row_counters(cl.row_flags(_mapped(spark, sf_dir), MAPPING))


def numeric_clean(spark, sf_dir):
    lines = cl.normalise(_mapped(spark, sf_dir))
    return lines.groupBy("order_item_quantity", "product_cost", "product_stock").agg(
        F.count(F.lit(1)).alias("rows"), F.count("product_price").alias("prices"),
        F.max("product_price").alias("top_price"))


def id_clean(spark, sf_dir):
    lines = cl.normalise(_mapped(spark, sf_dir))
    return lines.groupBy("order_id", "customer_id", "product_id").agg(
        F.count(F.lit(1)).alias("rows"))


def string_clean(spark, sf_dir):
    lines = cl.normalise(_mapped(spark, sf_dir))
    return lines.groupBy("product_name", "customer_fullName", "customer_email").agg(
        F.count(F.lit(1)).alias("rows"))


def status_map(spark, sf_dir):
    lines = cl.normalise(_mapped(spark, sf_dir))
    return lines.groupBy("dataset_id", F.col("order_status").alias("status")).agg(
        F.count(F.lit(1)).alias("rows"))


def date_clean(spark, sf_dir):
    lines = cl.read_dates(cut(cl.normalise(_mapped(spark, sf_dir)).select("dataset_id", "order_date")), MAPPING)
    return lines.groupBy("dataset_id", cl.tx.iso_seconds(F.col("order_date")).alias("order_date"),
                         F.col("order_date_rejected").alias("rejected")) \
        .agg(F.count(F.lit(1)).alias("rows"))


def products_dim(spark, sf_dir):
    return en.products(_lines(spark, sf_dir)).drop("_ord")


def customers_dim(spark, sf_dir):
    return en.customers(_lines(spark, sf_dir)).select(
        "dataset_id", "clerkId", "fullName", "email", "phoneNumber", "segment")


def customer_metadata(spark, sf_dir):
    found = en.customers(_lines(spark, sf_dir), NOTES)
    return found.select("dataset_id", "clerkId",
                        *[F.col("metadata")[n].alias(n.lower()) for n in NOTES],
                        F.size("metadata").cast("long").alias("known"))


def order_items(spark, sf_dir):
    return en.order_items(_lines(spark, sf_dir)).select(
        "dataset_id", "orderExternalId", "productAccId", "productName", "quantity", "unitPrice",
        "itemDiscount", money("revenue"), money("profit"))


def item_attributes(spark, sf_dir):
    items = en.order_items(_lines(spark, sf_dir))
    text = F.array_join(F.transform(
        F.array_sort(F.map_entries("attributes")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return items.groupBy("dataset_id", text.alias("attributes"),
                         ld.stored_attributes(F.col("attributes")).isNull().alias("is_empty")) \
        .agg(F.count(F.lit(1)).alias("items"))


def order_margins(spark, sf_dir):
    return en.orders(_written(spark, sf_dir, ORDER_FACTS), MAPPING.cost_pct).select(
        "dataset_id", "externalOrderId", money("revenue"), F.round("profit", 2).alias("profit"),
        "profit_margin", cl.tx.iso_seconds(F.col("createdAt")).alias("created_at"))


def orders_item_profit(spark, sf_dir):
    found = en.orders(_lines(spark, sf_dir), profit_from="items")
    return found.select("dataset_id", "externalOrderId", money("profit"))


def rejected_lines(spark, sf_dir):
    place = F.col("_ord")  # the place of a line and, with it, its part's number
    raw = extract(spark, sf_dir, keys=("l_partkey",)).withColumn("_ord", F.struct(
        place.alias("place"), F.when(place.isNotNull(), F.col("l_partkey")).alias("part"))).drop("l_partkey")
    lines = cl.written_lines(raw, MAPPING, ["dataset_id", "_ord", "order_date", "order_item_quantity"])
    return en.rejected_lines(lines).select(
        "dataset_id", order_number(F.col("_ord.place")).alias("orderkey"), F.col("_ord.part").alias("partkey"), "reason")


def clean_summary(spark, sf_dir):
    raw = extract(spark, sf_dir)
    flagged = cl.row_flags(cl.apply_mapping(raw, MAPPING), MAPPING)
    lines = cl.written_lines(raw, MAPPING)
    entities = {"customers": en.customers(lines), "products": en.products(lines),
                "orders": en.orders(lines), "order_items": en.order_items(lines)}
    return en.clean_summary(cl.row_counters(flagged), lines, entities, MAPPING)


# Load: rows of even customer / part keys are already stored.

def _business(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("dataset_id", "business_id")


ENTITIES_OF = {
    "customers": en.customers, "products": en.products,
    "orders": lambda lines: en.orders(lines, MAPPING.cost_pct), "order_items": en.order_items,
}


def _entities(lines: DataFrame, names=tuple(ENTITIES_OF)) -> dict[str, DataFrame]:
    """A batch. A load reads its entities several times, so each that is grouped out of the lines is written once."""
    found = {n: _business(ENTITIES_OF[n](lines)) for n in names}
    return {n: df if n == "order_items" else cut(df) for n, df in found.items()}


def _batch(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return _entities(_written(spark, sf_dir), names or tuple(ENTITIES_OF))


def _empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], ld.STORED[name]).limit(0)  # so the planner knows that it is empty


def _stored_customers(spark: SparkSession, batch: dict[str, DataFrame]) -> DataFrame:
    """What an earlier load would have stored: customers (below, products) with an even number."""
    rows = batch["customers"].filter(F.col("clerkId").cast("long") % 2 == 0)
    return cut(ld.new_customers(rows, _empty(spark, "customer")).drop("_ord"))


def _stored_products(spark: SparkSession, batch: dict[str, DataFrame]) -> DataFrame:
    rows = batch["products"].filter(F.regexp_extract("externalAccId", r"\d+", 0).try_cast("long") % 2 == 0)
    return cut(ld.new_products(rows, _empty(spark, "product")).drop("_ord"))


def new_customers(spark, sf_dir):
    batch = _batch(spark, sf_dir, "customers")
    found = ld.new_customers(batch["customers"], _stored_customers(spark, batch))
    return found.select("business_id", "clerk_id", "full_name", "email", "id")


def new_products(spark, sf_dir):
    batch = _batch(spark, sf_dir, "products")
    found = ld.new_products(batch["products"], _stored_products(spark, batch))
    return found.select("business_id", "external_acc_id", "name", "price", "cost", "stock", "id")


def _load(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    batch = _batch(spark, sf_dir)
    store = {"customer": _stored_customers(spark, batch), "product": _stored_products(spark, batch),
             "order": _empty(spark, "order"), "order_item": _empty(spark, "order_item")}
    return store, ld.plan_load(batch, store, F.lit(RUN_TS).cast("timestamp_ntz"))


def resolve_orders(spark, sf_dir):
    _, load = _load(spark, sf_dir)
    return load["order"].select("id", "business_id", "customer_id", money("total"), "status",
                                "order_discount", "created_at")


def resolve_items(spark, sf_dir):
    _, load = _load(spark, sf_dir)
    return load["order_item"].groupBy("business_id", "order_id", "product_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("quantity"),
        F.round(F.sum("unit_price"), 2).alias("unit_prices"),
        F.count("attributes").alias("with_attributes"))


def load_quarantine(spark, sf_dir):
    _, load = _load(spark, sf_dir)
    return load["quarantine"].groupBy("business_id", "kind", "reference", "reason") \
        .agg(F.count(F.lit(1)).alias("rows"))


def load_stats(spark, sf_dir):
    return _load(spark, sf_dir)[1]["stats"]


def load_roundtrip(spark, sf_dir):
    """Load the batch into an empty store twice, then read the store back."""
    root = fresh_path(spark, "store")
    batch = _batch(spark, sf_dir)
    for _ in range(2):
        store = stores.read_store(spark, root)
        load = ld.plan_load(batch, store, F.lit(RUN_TS).cast("timestamp_ntz"))
        stores.append_load(load, root)
    back = stores.read_store(spark, root)
    parts = [df.groupBy("business_id").agg(
        F.lit(name).alias("entity"), F.count(F.lit(1)).alias("rows"),
        F.count_distinct("id").alias("ids")) for name, df in back.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def load_unnumbered(spark, sf_dir):
    """Two uploads of each business, every fifth order marked `none` in both, loaded one after the other, and
    the first once more."""
    number = order_number(F.col("_ord"))
    raw = extract(spark, sf_dir).withColumns({
        "InvoiceNo": F.when(number % 5 == 0, F.lit("none")).otherwise(F.col("InvoiceNo")),
        "Email": F.lit(None).cast("string"), "_upload": (number % 2).cast("string")})
    lines = [cl.written_lines(raw.filter(F.col("_upload") == u).drop("_upload"), MAPPING) for u in ("0", "1")]
    batches = [_entities(part) for part in lines]
    root = fresh_path(spark, "store")
    for u in (0, 1, 0):
        batch = batches[u] | {"orders": batches[u]["orders"].withColumn("upload_id", F.lit(str(u)))}
        stores.append_load(ld.plan_load(batch, stores.read_store(spark, root), F.lit(RUN_TS).cast("timestamp_ntz")), root)
    return stores.read_store(spark, root)["order"].groupBy("business_id").agg(
        F.count(F.lit(1)).alias("orders"), F.count_distinct("id").alias("ids"),
        F.round(F.sum(F.col("total").cast("decimal(22,6)")), 2).cast("double").alias("total"))


def _training(spark, sf_dir) -> DataFrame:
    lines = _written(spark, sf_dir)
    return training_table(cut(en.products(lines)), en.orders(lines, MAPPING.cost_pct), en.order_items(lines))


def _plain(flat: DataFrame) -> DataFrame:
    return flat.select("dataset_id", "order_id", "price", "cost", "quantity", "stock",
                       "profit_margin", money("revenue"), "customer_id",
                       cl.tx.iso_seconds(F.col("order_date")).alias("order_date"))


def training(spark, sf_dir):
    return _plain(_training(spark, sf_dir))


def export_roundtrip(spark, sf_dir):
    """The training table exported as CSV, one folder per business, and read back."""
    root = fresh_path(spark, "export")
    flat = _business(_training(spark, sf_dir))
    stores.export_training(flat, root)
    schema = flat.select(*TRAINING_COLUMNS, "business_id").schema
    back = spark.read.schema(schema).option("header", True).csv(f"{root}/ml_dataset")
    return _plain(back.withColumnRenamed("business_id", "dataset_id"))


QUERIES = {
    "orders_revenue": orders_revenue, "clean_counters": clean_counters,
    "numeric_clean": numeric_clean, "id_clean": id_clean, "string_clean": string_clean,
    "status_map": status_map, "date_clean": date_clean, "products_dim": products_dim,
    "customers_dim": customers_dim, "customer_metadata": customer_metadata,
    "order_items": order_items, "item_attributes": item_attributes,
    "order_margins": order_margins, "orders_item_profit": orders_item_profit,
    "rejected_lines": rejected_lines, "clean_summary": clean_summary,
    "new_customers": new_customers, "new_products": new_products,
    "resolve_orders": resolve_orders, "resolve_items": resolve_items,
    "load_quarantine": load_quarantine, "load_stats": load_stats,
    "load_roundtrip": load_roundtrip, "load_unnumbered": load_unnumbered,
    "training_table": training, "export_roundtrip": export_roundtrip,
}


# The same in DuckDB SQL. `mapped` is the whole cleaned export with its two filter flags, `kept` the
# rows that stay.

def _amount(c: str) -> str:
    t = f"regexp_replace(translate({c}, '٠١٢٣٤٥٦٧٨٩£, ', '0123456789'), 'egp', '', 'gi')"
    return f"TRY_CAST({t} AS DOUBLE)"


def _text(c: str) -> str:
    return f"nullif(nullif(nullif(trim({c}), ''), 'nan'), 'None')"


def _id(c: str) -> str:
    return f"nullif(nullif(nullif(nullif(trim(regexp_replace({c}, '\\.0$', '')), ''), 'nan'), 'None'), 'NaT')"


_DATE = """CASE WHEN dataset_id IN (SELECT concat('n', cast(i AS VARCHAR)) FROM range(25) t(i) WHERE i % 3 = 0)
    THEN try_strptime(InvoiceDate, '%Y-%m-%d %H:%M:%S')
  WHEN dataset_id IN (SELECT concat('n', cast(i AS VARCHAR)) FROM range(25) t(i) WHERE i % 3 = 1)
    THEN try_strptime(InvoiceDate, '%m/%d/%Y %H:%M')
  ELSE try_strptime(InvoiceDate, '%d/%m/%Y') END"""

BASE = f"""WITH export AS MATERIALIZED ({oracle_extract()}),
mapped AS MATERIALIZED (
  SELECT dataset_id, ord, l_orderkey, l_partkey,
    coalesce(starts_with(InvoiceNo, 'C'), false) AS cancelled,
    NOT coalesce(starts_with(InvoiceNo, 'C'), false)
      AND coalesce({_amount('Quantity')} < 0, false) AS negative,
    {_id('InvoiceNo')} AS order_id, {_id('StockCode')} AS product_id,
    {_id('CustomerID')} AS customer_id, {_text('Description')} AS product_name,
    {_text('CustomerName')} AS full_name, {_text('Email')} AS email,
    {_amount('Quantity')} AS qty, {_amount('UnitPrice')} AS price, {_amount('UnitCost')} AS cost,
    {_amount('Stock')} AS stock,
    CASE lower(trim(Status)) WHEN 'delivered' THEN 'shipped' WHEN 'processing' THEN 'pending'
      ELSE 'completed' END AS status,
    {_DATE} AS order_date,
    CASE WHEN {_DATE} IS NULL THEN {_text('InvoiceDate')} END AS date_rejected,
    Size, Colour, Region, Channel
  FROM export),
kept AS MATERIALIZED (
  SELECT *, qty * price AS revenue, qty * price - cost * qty AS profit
  FROM mapped WHERE NOT cancelled AND NOT negative)"""


def _first(c: str, name: str | None = None) -> str:
    return f"arg_min({c}, ord) FILTER (WHERE {c} IS NOT NULL) AS {name or c}"


ENTITIES = BASE + f""",
p AS MATERIALIZED (
  SELECT dataset_id, coalesce(n, product_id) AS name, product_id AS acc, price, cost,
    cast(stock AS BIGINT) AS stock, o AS ord
  FROM (SELECT dataset_id, product_id, {_first('product_name', 'n')}, {_first('price')},
          {_first('cost')}, {_first('stock')}, min(ord) AS o
        FROM kept WHERE product_id IS NOT NULL GROUP BY ALL)),
c AS MATERIALIZED (
  SELECT dataset_id, customer_id AS clerk, coalesce(n, 'Customer ' || customer_id) AS full_name,
    email, o AS ord
  FROM (SELECT dataset_id, customer_id, {_first('full_name', 'n')}, {_first('email')}, min(ord) AS o
        FROM kept WHERE customer_id IS NOT NULL GROUP BY ALL)),
o AS MATERIALIZED (
  SELECT dataset_id, order_id, coalesce(sum(revenue::DECIMAL(22,6))::DOUBLE, 0.0) AS revenue, sum(profit::DECIMAL(22,6))::DOUBLE AS items_profit,
    {_first('customer_id')}, {_first('order_date')}, {_first('status')}, min(ord) AS ord
  FROM kept WHERE order_id IS NOT NULL GROUP BY dataset_id, order_id),
i AS MATERIALIZED (
  SELECT dataset_id, ord, order_id, product_id, product_name,
    cast(coalesce(qty, 1) AS BIGINT) AS quantity, price, revenue, profit,
    CASE WHEN Size IS NOT NULL THEN 'size=' || Size END AS a_size,
    CASE WHEN Colour <> 'nan' THEN 'color=' || Colour END AS a_color
  FROM kept)"""

LOAD = ENTITIES + """,
cm AS (SELECT dataset_id AS business_id, clerk AS clerk_id, full_name,
    CASE WHEN lower(email) <> 'none' THEN email END AS email, ord FROM c),
stored_c AS MATERIALIZED (
  SELECT * FROM cm WHERE cast(clerk_id AS BIGINT) % 2 = 0
  QUALIFY email IS NULL OR row_number() OVER (PARTITION BY business_id, email ORDER BY ord) = 1),
fresh_c AS MATERIALIZED (
  SELECT * FROM cm WHERE (business_id, clerk_id) NOT IN (SELECT business_id, clerk_id FROM stored_c)
    AND NOT EXISTS (SELECT 1 FROM stored_c s WHERE s.business_id = cm.business_id AND s.email = cm.email)
  QUALIFY email IS NULL OR row_number() OVER (PARTITION BY business_id, email ORDER BY ord) = 1),
all_c AS MATERIALIZED (
  SELECT *, sha256('customer|' || business_id || '|id:' || clerk_id) AS id, 0 AS fresh FROM stored_c
  UNION ALL
  SELECT *, sha256('customer|' || business_id || '|id:' || clerk_id), 1 FROM fresh_c),
pm AS (SELECT dataset_id AS business_id, acc, name, coalesce(price, 0.0) AS price, cost,
    coalesce(stock, 0) AS stock, ord FROM p),
stored_p AS MATERIALIZED (
  SELECT * FROM pm WHERE cast(substr(acc, 2) AS BIGINT) % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY business_id, name ORDER BY ord) = 1),
fresh_p AS MATERIALIZED (
  SELECT * FROM pm WHERE (business_id, acc) NOT IN (SELECT business_id, acc FROM stored_p)
    AND (business_id, name) NOT IN (SELECT business_id, name FROM stored_p)
  QUALIFY row_number() OVER (PARTITION BY business_id, name ORDER BY ord) = 1),
all_p AS MATERIALIZED (
  SELECT *, sha256('product|' || business_id || '|id:' || acc) AS id FROM stored_p
  UNION ALL SELECT *, sha256('product|' || business_id || '|id:' || acc) FROM fresh_p),
ro AS MATERIALIZED (
  SELECT o.dataset_id AS business_id, o.order_id AS ext,
    sha256('order|' || o.dataset_id || '|' || o.order_id) AS id, m.id AS customer_id,
    o.revenue AS total, o.status, coalesce(o.order_date, TIMESTAMP '2002-01-01') AS created_at
  FROM o LEFT JOIN all_c m ON m.business_id = o.dataset_id AND m.clerk_id = o.customer_id),
ri AS MATERIALIZED (
  SELECT ro.business_id, ro.id AS order_id, ro.ext, coalesce(a.id, n.id) AS product_id,
    CASE WHEN i.quantity = 0 THEN 1 ELSE i.quantity END AS quantity,
    coalesce(i.price, 0.0) AS unit_price,
    coalesce(i.a_size, i.a_color) IS NOT NULL AS with_attributes
  FROM i JOIN ro ON ro.business_id = i.dataset_id AND ro.ext = i.order_id
    AND ro.customer_id IS NOT NULL
  LEFT JOIN all_p a ON a.business_id = i.dataset_id AND a.acc = i.product_id
  LEFT JOIN all_p n ON n.business_id = i.dataset_id AND n.name = i.product_name)"""

_FRESH_LOAD = LOAD.replace(
    "SELECT * FROM cm WHERE cast(clerk_id AS BIGINT) % 2 = 0", "SELECT * FROM cm WHERE false"
).replace("SELECT * FROM pm WHERE cast(substr(acc, 2) AS BIGINT) % 2 = 0",
          "SELECT * FROM pm WHERE false")

ORACLES = {
    "orders_revenue": ENTITIES + """
SELECT dataset_id, order_id AS externalOrderId, customer_id AS customerExternalId, status,
  round(revenue, 4) AS revenue FROM o""",
    "clean_counters": BASE + """
SELECT dataset_id, count(*) AS total_rows, count(*) FILTER (cancelled) AS cancelled_rows,
  count(*) FILTER (negative) AS negative_rows,
  count(*) FILTER (NOT cancelled AND NOT negative) AS clean_rows FROM mapped GROUP BY 1""",
    "numeric_clean": BASE + """
SELECT qty AS order_item_quantity, cost AS product_cost, stock AS product_stock,
  count(*) AS rows, count(price) AS prices, max(price) AS top_price FROM mapped GROUP BY ALL""",
    "id_clean": BASE + """
SELECT order_id, customer_id, product_id, count(*) AS rows FROM mapped GROUP BY ALL""",
    "string_clean": BASE + """
SELECT product_name, full_name AS customer_fullName, email AS customer_email, count(*) AS rows
FROM mapped GROUP BY ALL""",
    "status_map": BASE + """
SELECT dataset_id, status, count(*) AS rows FROM mapped GROUP BY ALL""",
    "date_clean": BASE + """
SELECT dataset_id, strftime(order_date, '%Y-%m-%dT%H:%M:%S') AS order_date,
  date_rejected AS rejected, count(*) AS rows FROM mapped GROUP BY ALL""",
    "products_dim": ENTITIES + """
SELECT dataset_id, name, acc AS externalAccId, price, cost, stock,
  cast(NULL AS VARCHAR) AS description FROM p""",
    "customers_dim": ENTITIES + """
SELECT dataset_id, clerk AS clerkId, full_name AS fullName, email,
  cast(NULL AS VARCHAR) AS phoneNumber, cast(NULL AS VARCHAR) AS segment FROM c""",
    "customer_metadata": BASE + f"""
SELECT *, cast((size IS NOT NULL)::INT + (colour IS NOT NULL)::INT + (region IS NOT NULL)::INT
  + (channel IS NOT NULL)::INT AS BIGINT) AS known
FROM (SELECT dataset_id, customer_id AS clerkId, {_first('Size', 'size')},
  {_first('Colour', 'colour')}, {_first('Region', 'region')}, {_first('Channel', 'channel')}
  FROM kept WHERE customer_id IS NOT NULL GROUP BY ALL)""",
    "order_items": ENTITIES + """
SELECT dataset_id, order_id AS orderExternalId, product_id AS productAccId,
  product_name AS productName, quantity, price AS unitPrice, 0.0::DOUBLE AS itemDiscount,
  round(revenue, 4) AS revenue, round(profit, 4) AS profit FROM i""",
    "item_attributes": ENTITIES + """
SELECT dataset_id, concat_ws(',', a_color, a_size) AS attributes,
  coalesce(a_color, a_size) IS NULL AS is_empty, count(*) AS items FROM i GROUP BY ALL""",
    "order_margins": ENTITIES + """
SELECT dataset_id, order_id AS externalOrderId, round(revenue, 4) AS revenue,
  round(round_even(revenue * (1 - 0.4), 4), 2) AS profit,
  CASE WHEN revenue <> 0 THEN round_even(round_even(revenue * (1 - 0.4), 4) / revenue * 100, 2) END
    AS profit_margin,
  strftime(order_date, '%Y-%m-%dT%H:%M:%S') AS created_at FROM o""",
    "orders_item_profit": ENTITIES + """
SELECT dataset_id, order_id AS externalOrderId, round(items_profit, 4) AS profit FROM o""",
    "rejected_lines": BASE + """
SELECT dataset_id, l_orderkey AS orderkey, l_partkey AS partkey,
  'order_date: not a date: ' || date_rejected AS reason FROM kept WHERE date_rejected IS NOT NULL""",
    "clean_summary": ENTITIES + """
SELECT m.dataset_id, count(*) AS total_rows, count(*) FILTER (cancelled) AS cancelled_rows,
  count(*) FILTER (negative) AS negative_rows,
  count(*) FILTER (NOT cancelled AND NOT negative) AS clean_rows,
  (SELECT count(*) FROM c WHERE c.dataset_id = m.dataset_id) AS customers_found,
  (SELECT count(*) FROM p WHERE p.dataset_id = m.dataset_id) AS products_found,
  (SELECT count(*) FROM o WHERE o.dataset_id = m.dataset_id) AS orders_found,
  (SELECT count(*) FROM i WHERE i.dataset_id = m.dataset_id) AS order_items_found,
  count(*) FILTER (NOT cancelled AND NOT negative AND date_rejected IS NOT NULL) AS failed_rows,
  100.0::DOUBLE AS ml_coverage_pct, 'revenue,profit,profit_margin' AS derived_fields,
  '' AS missing_fields
FROM mapped m GROUP BY 1""",
    "new_customers": LOAD + """
SELECT business_id, clerk_id, full_name, email, id FROM all_c WHERE fresh = 1""",
    "new_products": LOAD + """
SELECT business_id, acc AS external_acc_id, name, price, cost, stock,
  sha256('product|' || business_id || '|id:' || acc) AS id FROM fresh_p""",
    "resolve_orders": LOAD + """
SELECT id, business_id, customer_id, round(total, 4) AS total, status,
  0.0::DOUBLE AS order_discount, created_at FROM ro WHERE customer_id IS NOT NULL""",
    "resolve_items": LOAD + """
SELECT business_id, order_id, product_id, count(*) AS items,
  cast(sum(quantity) AS BIGINT) AS quantity, round(sum(unit_price), 2) AS unit_prices,
  count(*) FILTER (with_attributes) AS with_attributes
FROM ri WHERE product_id IS NOT NULL GROUP BY 1, 2, 3""",
    "load_quarantine": LOAD + """
SELECT business_id, 'order' AS kind, ext AS reference, 'unknown customer' AS reason,
  count(*) AS rows FROM ro WHERE customer_id IS NULL GROUP BY ALL
UNION ALL
SELECT business_id, 'order_item', ext, 'unknown product', count(*) FROM ri
WHERE product_id IS NULL GROUP BY ALL
UNION ALL
SELECT i.dataset_id, 'order_item', i.order_id, CASE WHEN i.order_id IS NULL THEN 'no order number'
  WHEN ro.id IS NULL THEN 'unknown order' ELSE 'order of an unknown customer' END, count(*)
FROM i LEFT JOIN ro ON ro.business_id = i.dataset_id AND ro.ext = i.order_id
WHERE ro.customer_id IS NULL GROUP BY ALL""",
    "load_stats": LOAD + """,
parts AS (
  SELECT business_id, 'customer' AS entity, 1 AS e, 0 AS f, 0 AS n FROM stored_c
  UNION ALL SELECT business_id, 'customer', 0, 1, 0 FROM cm
  UNION ALL SELECT business_id, 'customer', 0, 0, 1 FROM fresh_c
  UNION ALL SELECT business_id, 'product', 1, 0, 0 FROM stored_p
  UNION ALL SELECT business_id, 'product', 0, 1, 0 FROM pm
  UNION ALL SELECT business_id, 'product', 0, 0, 1 FROM fresh_p
  UNION ALL SELECT dataset_id, 'order', 0, 1, 0 FROM o
  UNION ALL SELECT business_id, 'order', 0, 0, 1 FROM ro WHERE customer_id IS NOT NULL
  UNION ALL SELECT dataset_id, 'order_item', 0, 1, 0 FROM i
  UNION ALL SELECT business_id, 'order_item', 0, 0, 1 FROM ri WHERE product_id IS NOT NULL)
SELECT business_id, entity, cast(sum(e) AS BIGINT) AS existing, cast(sum(f) AS BIGINT) AS offered,
  cast(sum(n) AS BIGINT) AS inserted, cast(sum(f) - sum(n) AS BIGINT) AS skipped
FROM parts GROUP BY 1, 2""",
    "load_roundtrip": _FRESH_LOAD + """
SELECT business_id, 'customer' AS entity, count(*) AS rows, count(*) AS ids FROM fresh_c GROUP BY 1
UNION ALL SELECT business_id, 'product', count(*), count(*) FROM fresh_p GROUP BY 1
UNION ALL SELECT business_id, 'order', count(*), count(*) FROM ro WHERE customer_id IS NOT NULL
  GROUP BY 1
UNION ALL SELECT business_id, 'order_item', count(*), count(*) FROM ri WHERE product_id IS NOT NULL
  GROUP BY 1""",
    "load_unnumbered": f"""WITH export AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN l_orderkey % 5 = 0 THEN 'none' ELSE InvoiceNo END AS InvoiceNo) FROM ({oracle_extract()})),
o AS (
  SELECT dataset_id, l_orderkey % 2 AS upload, {_id('InvoiceNo')} AS order_id, count({_id('CustomerID')}) AS customers,
    coalesce(sum(({_amount('Quantity')} * {_amount('UnitPrice')})::DECIMAL(22,6)), 0) AS total
  FROM export WHERE NOT starts_with(InvoiceNo, 'C') AND NOT coalesce({_amount('Quantity')} < 0, false)
  GROUP BY ALL)
SELECT dataset_id AS business_id, count(*) AS orders, count(*) AS ids, round(sum(total), 2)::DOUBLE AS total
FROM o WHERE order_id IS NOT NULL AND customers > 0 GROUP BY 1""",
    "training_table": ENTITIES + """,
by_name AS (SELECT dataset_id, name, max_by(struct_pack(c := cost, s := stock), ord) AS r
  FROM p GROUP BY ALL)
SELECT i.dataset_id, i.order_id, i.price, CASE WHEN p.acc IS NOT NULL THEN p.cost ELSE by_name.r.c END AS cost,
  i.quantity, CASE WHEN p.acc IS NOT NULL THEN p.stock ELSE by_name.r.s END AS stock,
  CASE WHEN o.revenue <> 0 THEN round_even(round_even(o.revenue * (1 - 0.4), 4) / o.revenue * 100, 2) END
    AS profit_margin,
  round(i.revenue, 4) AS revenue, o.customer_id,
  strftime(o.order_date, '%Y-%m-%dT%H:%M:%S') AS order_date
FROM i LEFT JOIN o ON o.dataset_id = i.dataset_id AND o.order_id = i.order_id
LEFT JOIN p ON p.dataset_id = i.dataset_id AND p.acc = i.product_id
LEFT JOIN by_name ON by_name.dataset_id = i.dataset_id AND by_name.name = i.product_name""",
}
ORACLES["export_roundtrip"] = ORACLES["training_table"]
