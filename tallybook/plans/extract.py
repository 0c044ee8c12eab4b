"""A messy sales export made from the supplied order tables, one dataset per nation.

The SQL text is shared by Spark and the oracle because it only prepares input; what the package
does with it is expressed twice, independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators.cleaning import Mapping

EXTRACT_SQL = """
SELECT
  {dataset} AS dataset_id,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
  l_returnflag,
  CASE WHEN l_orderkey % 97 = 5 AND l_linenumber = 2 THEN NULL
       WHEN l_orderkey % 10 = 0 THEN concat('C', cast(l_orderkey AS string))
       WHEN l_orderkey % 7 = 0 THEN concat(cast(l_orderkey AS string), '.0')
       ELSE cast(l_orderkey AS string) END AS InvoiceNo,
  CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_partkey % 50 = 1 THEN 'nan'
       ELSE concat(' P', cast(l_partkey AS string)) END AS StockCode,
  CASE WHEN l_linenumber = 3 THEN 'nan' WHEN l_linenumber = 5 THEN '  '
       ELSE concat('  ', p_name, ' ') END AS Description,
  CASE WHEN l_linenumber = 6 AND l_partkey % 5 = 0 THEN NULL
       WHEN l_returnflag = 'R' AND l_linenumber = 1
         THEN concat('-', cast(cast(l_quantity AS bigint) AS string))
       WHEN l_suppkey % 17 = 0
         THEN translate(cast(cast(l_quantity AS bigint) AS string), '0123456789', '٠١٢٣٤٥٦٧٨٩')
       ELSE cast(cast(l_quantity AS bigint) AS string) END AS Quantity,
  CASE WHEN l_partkey % 60 = 7 THEN 'soon'
       WHEN c_nationkey % 3 = 0 THEN {iso_date}
       WHEN c_nationkey % 3 = 1 THEN {us_date}
       ELSE {eu_date} END AS InvoiceDate,
  CASE WHEN l_partkey % 40 = 3 THEN 'N/A'
       WHEN l_linenumber = 4 THEN concat('£ ', unit_text)
       ELSE concat('EGP ', unit_text) END AS UnitPrice,
  CASE WHEN l_partkey % 13 = 0 AND l_linenumber % 2 = 0 THEN ''
       ELSE concat(cost_text, ' egp') END AS UnitCost,
  CASE WHEN p_size = 7 THEN 'n/a' ELSE cast(p_size * 3 AS string) END AS Stock,
  CASE WHEN l_orderkey % 31 = 4 THEN NULL ELSE concat(cast(c_custkey AS string), '.0') END
    AS CustomerID,
  CASE WHEN l_linenumber < 3 THEN 'None' ELSE concat(' ', c_name) END AS CustomerName,
  CASE WHEN c_custkey % 9 = 0 THEN 'none'
       ELSE concat('user', cast(c_custkey % 700 AS string), '@shop.example') END AS Email,
  CASE o_orderstatus WHEN 'F' THEN ' Delivered ' WHEN 'O' THEN 'processing' ELSE '' END AS Status,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE p_brand END AS Size,
  CASE WHEN p_size % 6 = 0 THEN 'nan' ELSE p_type END AS Colour,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE c_mktsegment END AS Region,
  o_orderpriority AS Channel
FROM (
  SELECT *,
    concat(cast({unit} AS string), '.', lpad(cast(unit_cents % 100 AS string), 2, '0'))
      AS unit_text,
    concat(cast({cost} AS string), '.', lpad(cast(cost_cents % 100 AS string), 2, '0'))
      AS cost_text
  FROM (
    SELECT *,
      cast(floor(round(l_extendedprice * 100) / l_quantity) AS bigint) AS unit_cents,
      cast(floor(round(p_retailprice * 100) / 2) AS bigint) AS cost_cents
    FROM {lineitem}
    JOIN {orders} ON o_orderkey = l_orderkey
    JOIN {customer} ON c_custkey = o_custkey
    JOIN {part} ON p_partkey = l_partkey
  ) AS joined
) AS priced
"""

# Spark joins in the order of the text. The rows are the same.
SOLD = ("""JOIN {orders} ON o_orderkey = l_orderkey
    JOIN {customer} ON c_custkey = o_custkey""",
        """JOIN (SELECT * FROM {orders} JOIN {customer} ON c_custkey = o_custkey) AS sold
      ON o_orderkey = l_orderkey""")

# A line's place in its export: its order's number, then its place among the order's lines, whatever their part and
# supplier numbers. Only lines that agree in all four numbers share a place; a line without one of them has none.
LINE_BITS = 20
ORDER_LINES = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey"
POSITION = (f"CASE WHEN l_linenumber IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL THEN"
            f" l_orderkey * {1 << LINE_BITS} + rank() OVER ({ORDER_LINES}) END")
PLACED = ("l_orderkey, l_linenumber,", "_ord, l_orderkey, l_linenumber,")
# The same order, column by column.
ORDER_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

RAW_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice",
               "UnitCost", "Stock", "CustomerID", "CustomerName", "Email", "Status", "Size",
               "Colour", "Region", "Channel"]

MAPPING = Mapping(
    confirmed={
        "InvoiceNo": "order_id", "StockCode": "product_id", "Description": "product.name",
        "Quantity": "order_item.quantity", "InvoiceDate": "order_date",
        "UnitPrice": "product.price", "UnitCost": "product.cost", "Stock": "product.stock",
        "CustomerID": "customer_id", "CustomerName": "customer.fullName",
        "Email": "customer.email", "Status": "order.status",
    },
    attributes={"Size": "size", "Colour": "color"},
    cost_pct=0.4,
)


# What counts as one upload: a nation's sales, one customer's year, or the sales of one part.
DATASETS = {
    "nation": "concat('n', cast(c_nationkey AS string))",
    "customer_year": "concat('c', cast(c_custkey AS string), '-', "
                     "cast(extract(year FROM o_orderdate) AS string))",
    "part": "concat('p', cast(p_partkey AS string))",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_number(position):
    return F.shiftright(position, LINE_BITS)


def extract(spark: SparkSession, sf_dir: str, dataset: str = "nation", keys: tuple[str, ...] = ()) -> DataFrame:
    """Raw sales lines: text columns, `dataset_id`, `_ord` and those of a line's `keys` that are asked for."""
    dialect = {
        "iso_date": "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')",
        "us_date": "date_format(o_orderdate, 'M/d/yyyy H:mm')",
        "eu_date": "date_format(o_orderdate, 'dd/MM/yyyy')",
        "unit": "unit_cents div 100", "cost": "cost_cents div 100",
        "dataset": DATASETS[dataset],
    }
    tables = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part")}
    # Dealt by order: a line becomes several texts, so the work doesn't follow the files' sizes, and the join with
    # orders needs no further shuffle. Orders meet their customers first, so lines are shuffled twice, not four times.
    # A line's place is found among its order's lines, in the order that the join sorts them by anyway.
    tables["lineitem"] = tables["lineitem"].repartition("l_orderkey").withColumn("_ord", F.expr(POSITION))
    sql = EXTRACT_SQL.replace(*SOLD).replace(*PLACED)
    for k, v in dialect.items():
        sql = sql.replace("{" + k + "}", v)
    raw = spark.sql(sql, **tables)
    return raw.select("dataset_id", "_ord", *keys, *RAW_COLUMNS)


def oracle_extract(dataset: str = "nation") -> str:
    sql = EXTRACT_SQL
    for k, v in {
        "iso_date": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')",
        "us_date": "strftime(o_orderdate, '%-m/%-d/%Y %-H:%M')",
        "eu_date": "strftime(o_orderdate, '%d/%m/%Y')",
        "unit": "unit_cents // 100", "cost": "cost_cents // 100", "dataset": DATASETS[dataset],
        "lineitem": "lineitem", "orders": "orders", "customer": "customer", "part": "part",
    }.items():
        sql = sql.replace("{" + k + "}", v)
    order = ", ".join(ORDER_COLUMNS)
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS ord FROM ({sql}) AS export"
