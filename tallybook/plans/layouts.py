"""Queries over files of four layouts in one plan: the mapping of each is data.

Nations stand for files as in the other queries; the remainder of a nation's number by 4 chooses its layout: the whole
export; one without customer number, columns turned round, under a title row; quantities and prices alone; and
one keyed by product name, with a unit price and no cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import entities as en
from tallybook.operators import layouts as lay
from tallybook.plans.extract import MAPPING, RAW_COLUMNS, extract, oracle_extract
from tallybook.plans.sales import _amount, _id, _text, money
from tallybook.session import cut

TURNED = [c for c in reversed(RAW_COLUMNS) if c != "CustomerID"]
BARE = ["Quantity", "UnitPrice"]
NAMED = ["Channel", "Description", "InvoiceNo", "InvoiceDate", "Quantity", "UnitPrice", "CustomerName", "Region"]
LAYOUTS = [RAW_COLUMNS, TURNED, BARE, NAMED]
NAMED_TARGETS = {"Description": "product.name", "InvoiceNo": "order_id", "InvoiceDate": "order_item.createdAt",
                 "Quantity": "quantity", "UnitPrice": "order_item.unitPrice", "CustomerName": "customer.fullName"}


def _number(dataset_id):
    return F.substring(dataset_id, 2, 9).cast("int") % 4


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells of all files, and their layouts."""
    raw = extract(spark, sf_dir)
    which = _number(F.col("dataset_id"))
    cells, names = F.array(*RAW_COLUMNS), F.lit(None)
    for i, columns in enumerate(LAYOUTS):
        cells = F.when(which == i, F.array(*columns)).otherwise(cells)
        names = F.when(which == i, F.array(*map(F.lit, columns))).otherwise(names)
    body = raw.select("dataset_id", "_ord", cells.alias("cells"))
    datasets = cut(raw.select("dataset_id").distinct())  # read five times below
    above = lambda n: F.lit(n).cast("long").alias("_ord")
    heads = datasets.select("dataset_id", above(-1), names.alias("cells"))
    titles = datasets.where(which == 1).select("dataset_id", above(-2), F.array(F.lit("Sales")).alias("cells"))
    cells = cut(body.unionByName(heads).unionByName(titles))
    rows = []
    for i, columns in enumerate(LAYOUTS):
        targets = NAMED_TARGETS if i == 3 else MAPPING.confirmed
        attributes = MAPPING.attributes if i < 2 else {}
        rows += [(i, c, targets.get(c), attributes.get(c), i == 3 and c == "Channel") for c in columns]
    mapping = datasets.withColumn("layout", which).join(F.broadcast(spark.createDataFrame(  # 41 rows
        rows, "layout int, column string, target string, attribute string, ignored boolean")), "layout").drop("layout")
    settings = datasets.select(
        "dataset_id", F.when(which == 1, F.lit(1).cast("long")).alias("header_row"),
        F.when(which == 0, 0.4).when(which == 1, 0.25).alias("cost_pct"),
        F.create_map(F.lit("stock"), F.lit("placeholder"), F.lit("cost"), F.lit("skip_feature")).alias("decisions"))
    return cells, cut(lay.layouts(lay.headers(cells, settings), mapping, settings))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(lay.clean_layouts(*_tables(spark, sf_dir)))


def clean_mixed_layouts(spark, sf_dir):
    """Orders of all files."""
    return en.orders(_lines(spark, sf_dir)).select(
        "dataset_id", "externalOrderId", "customerExternalId", "status", money("revenue"),
        money("profit"), "profit_margin", en.tx.iso_seconds(F.col("createdAt")).alias("created_at"))


def mixed_entities(spark, sf_dir):
    """Products, customers and lines of all files in one shape."""
    lines = _lines(spark, sf_dir)
    products = en.products(lines).select(
        "dataset_id", F.lit("product").alias("entity"), F.col("externalAccId").alias("key"), "name",
        F.col("price").alias("figure"), F.col("stock").alias("count"))
    customers = en.customers(lines).select(
        "dataset_id", F.lit("customer").alias("entity"), F.col("clerkId").alias("key"),
        F.concat_ws("|", "fullName", "email").alias("name"), F.lit(None).cast("double").alias("figure"),
        F.lit(None).cast("long").alias("count"))
    items = en.order_items(lines).groupBy("dataset_id", F.lit("item").alias("entity"), F.col("productAccId").alias("key"),
                                          F.col("productName").alias("name")).agg(
        F.round(F.sum("revenue"), 2).alias("figure"), F.sum("quantity").alias("count"))
    return products.unionByName(customers).unionByName(items)


def mixed_metadata(spark, sf_dir):
    found = lay.customer_metadata(_lines(spark, sf_dir))
    return found.select("dataset_id", F.col("_key").alias("customer"), F.explode("metadata").alias("name", "value"))


def mixed_warnings(spark, sf_dir):
    """Warnings of each file, and what was decided for its missing fields."""
    cells, known = _tables(spark, sf_dir)
    texts = lay.warnings(known, lay.row_counters(cells, known)).select("dataset_id", "warning")
    decided = lay.missing_decisions(known).select("dataset_id", F.concat(
        "field", F.lit(": "), F.coalesce("decision", F.lit("open"))).alias("warning"))
    return texts.unionByName(decided)


QUERIES = {"clean_mixed_layouts": clean_mixed_layouts, "mixed_entities": mixed_entities,
           "mixed_metadata": mixed_metadata, "mixed_warnings": mixed_warnings}

_FORMATS = ["'%Y-%m-%d %H:%M:%S'", "'%m/%d/%Y %H:%M'", "'%d/%m/%Y'"]
_WHEN = "CASE n % 3 " + " ".join(f"WHEN {i} THEN try_strptime(InvoiceDate, {f})" for i, f in enumerate(_FORMATS)) + " END"

_BASE = f"""WITH export AS MATERIALIZED (
  SELECT *, substr(dataset_id, 2)::INT AS n, substr(dataset_id, 2)::INT % 4 AS l FROM ({oracle_extract()})),
read AS MATERIALIZED (
  SELECT dataset_id, l, ord, l <> 2 AND coalesce(starts_with(InvoiceNo, 'C'), false) AS cancelled,
    NOT (l <> 2 AND coalesce(starts_with(InvoiceNo, 'C'), false)) AND coalesce({_amount('Quantity')} < 0, false) AS negative,
    CASE WHEN l <> 2 THEN {_id('InvoiceNo')} END AS order_id, CASE WHEN l < 2 THEN {_id('StockCode')} END AS product_id,
    CASE WHEN l = 0 THEN {_id('CustomerID')} END AS customer_id, CASE WHEN l < 2 THEN {_text('Email')} END AS email,
    CASE WHEN l <> 2 THEN {_text('Description')} END AS product_name,
    CASE WHEN l <> 2 THEN {_text('CustomerName')} END AS full_name,
    {_amount('Quantity')} AS qty, {_amount('UnitPrice')} AS price, CASE WHEN l < 2 THEN {_amount('Stock')} END AS stock,
    CASE WHEN l < 2 THEN CASE lower(trim(Status)) WHEN 'delivered' THEN 'shipped' WHEN 'processing' THEN 'pending'
      ELSE 'completed' END ELSE 'completed' END AS status,
    CASE WHEN l <> 2 THEN {_WHEN} END AS date, Size, Colour, Region, Channel FROM export),
kept AS MATERIALIZED (
  SELECT *, qty * price AS revenue, CASE l WHEN 0 THEN customer_id WHEN 1 THEN email WHEN 3 THEN full_name END AS customer,
    CASE WHEN l < 2 THEN product_id WHEN l = 3 THEN product_name END AS product
  FROM read WHERE NOT cancelled AND NOT negative)"""

_FIRST = "arg_min({0}, ord) FILTER (WHERE {0} IS NOT NULL)"
_PROFIT = "round_even(revenue * (1 - CASE l WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 0.25::DOUBLE END), 4)"

ORACLES = {
    "clean_mixed_layouts": _BASE + f""",
o AS (SELECT dataset_id, l, order_id, coalesce(sum(revenue::DECIMAL(22,6))::DOUBLE, 0.0) AS revenue, {_FIRST.format('customer')} AS customer,
  {_FIRST.format('date')} AS date, {_FIRST.format('status')} AS status FROM kept WHERE order_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT dataset_id, order_id AS externalOrderId, customer AS customerExternalId, status, round(revenue, 4) AS revenue,
  round({_PROFIT}, 4) AS profit, CASE WHEN revenue <> 0 THEN round_even({_PROFIT} / revenue * 100, 2) END AS profit_margin,
  strftime(date, '%Y-%m-%dT%H:%M:%S') AS created_at FROM o""",
    "mixed_entities": _BASE + f"""
SELECT dataset_id, 'product' AS entity, CASE WHEN l < 2 THEN product END AS key,
  coalesce({_FIRST.format('product_name')}, product) AS name,
  CASE WHEN l < 2 THEN {_FIRST.format('price')} END AS figure, cast({_FIRST.format('stock')} AS BIGINT) AS count
FROM kept WHERE product IS NOT NULL GROUP BY dataset_id, l, product
UNION ALL
SELECT dataset_id, 'customer', CASE WHEN l = 0 THEN customer END,
  concat_ws('|', coalesce({_FIRST.format('full_name')}, CASE l WHEN 0 THEN 'Customer ' || customer END),
    CASE WHEN l = 1 THEN customer ELSE {_FIRST.format('email')} END), NULL, NULL
FROM kept WHERE customer IS NOT NULL GROUP BY dataset_id, l, customer
UNION ALL
SELECT dataset_id, 'item', product_id, product_name, round(sum(revenue), 2), sum(cast(coalesce(qty, 1) AS BIGINT))::BIGINT
FROM kept GROUP BY dataset_id, product_id, product_name""",
    "mixed_metadata": _BASE + """,
notes AS (
  SELECT dataset_id, l, customer, ord, unnest(['Size', 'Colour', 'Region', 'Channel']) AS name,
    unnest([Size, Colour, Region, Channel]) AS value FROM kept WHERE customer IS NOT NULL)
SELECT dataset_id, customer, name, arg_min(value, ord) AS value FROM notes
WHERE value IS NOT NULL AND (l < 2 OR name = 'Region') GROUP BY ALL""",
    "mixed_warnings": _BASE + """,
counts AS (SELECT dataset_id, l, count(*) FILTER (negative) AS neg, count(*) FILTER (cancelled) AS can FROM read GROUP BY ALL),
missing AS (
  SELECT dataset_id, unnest(CASE l WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['customer_id']
    WHEN 2 THEN ['cost', 'stock', 'profit', 'profit_margin', 'order_date', 'product_id', 'customer_id']
    ELSE ['quantity', 'price', 'cost', 'stock', 'profit', 'profit_margin', 'order_date', 'product_id', 'customer_id'] END) AS field
  FROM counts)
SELECT dataset_id, 'Removed ' || format('{:,}', neg) || ' rows with negative quantities (usually returns or corrections).' AS warning
FROM counts WHERE neg > 0
UNION ALL SELECT dataset_id, 'Skipped ' || format('{:,}', can) || ' cancelled orders (order number started with ''C'').'
FROM counts WHERE can > 0
UNION ALL SELECT dataset_id, unnest(['No product identifier found — products skipped.',
  'No customer identifier found — customers skipped.', 'No order ID column — orders skipped.']) FROM counts WHERE l = 2
UNION ALL SELECT dataset_id, '''' || field || ''' was not found in your data and will be left empty. '
  || 'You can add it later from the dashboard.' FROM missing
UNION ALL SELECT dataset_id, field || ': ' || CASE field WHEN 'stock' THEN 'placeholder' WHEN 'cost' THEN 'skip_feature'
  ELSE 'open' END FROM missing""",
}
