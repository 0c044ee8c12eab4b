"""The sales export out of order tables whose numbers are as high as in tables hundreds of times as large."""

import duckdb
import pytest

from oracle import difference
from tallybook.plans.catalogue import ORACLES, QUERIES
from tallybook.plans.extract import ORDER_COLUMNS, extract, order_number

ORDERS, PARTS, SUPPLIERS = 54_000_000, 7_200_000, 360_000
TABLES = {
    "customer": "SELECT 2000000 + i AS c_custkey, 'Customer ' || i AS c_name, (i % 4)::INT AS c_nationkey, "
                "100.0::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(12) t(i)",
    "part": f"SELECT {PARTS} + i * 1000003 AS p_partkey, 'part ' || i AS p_name, 'Brand#' || (i % 3) AS p_brand, "
            "'TIN' AS p_type, (i % 9 + 1)::INT AS p_size, 10.0 + i AS p_retailprice FROM range(20) t(i)",
    "orders": f"SELECT {ORDERS} + i AS o_orderkey, 2000000 + i % 12 AS o_custkey, 'F' AS o_orderstatus, "
              "1.0::DOUBLE AS o_totalprice, TIMESTAMP '1995-01-01' + to_days(i::INT) AS o_orderdate, '1-URGENT' AS o_orderpriority "
              "FROM range(60) t(i)",
    # Lines of one order that agree in their line number: told apart by part, then supplier.
    "lineitem": f"SELECT {ORDERS} + i % 60 AS l_orderkey, {PARTS} + (i * 7 % 20) * 1000003 AS l_partkey, "
                f"{SUPPLIERS} - i * 977 % 300000 AS l_suppkey, (i % 3 + 1)::INT AS l_linenumber, (i % 5 + 1)::DOUBLE AS l_quantity, "
                "(i % 5 + 1) * 12.5::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'N' AS l_returnflag, "
                "'O' AS l_linestatus, TIMESTAMP '1995-02-01' AS l_shipdate FROM range(480) t(i)",
}


@pytest.fixture(scope="module")
def high(tmp_path_factory):
    """Tables with high numbers, and a connection to them."""
    folder = str(tmp_path_factory.mktemp("high"))
    con = duckdb.connect()
    for name, sql in TABLES.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


def test_places_follow_the_four_numbers(spark, high):
    keys = tuple(ORDER_COLUMNS)
    raw = extract(spark, high[0], keys=keys)
    rows = raw.select("_ord", order_number(raw["_ord"]).alias("number"), *keys).collect()
    by_place = sorted(rows, key=lambda r: r._ord)
    by_keys = sorted(rows, key=lambda r: tuple(r[k] for k in keys))
    assert len({r._ord for r in rows}) == len({tuple(r[k] for k in keys) for r in rows}) == 480
    assert by_place == by_keys and all(r.number == r.l_orderkey for r in rows)


@pytest.mark.parametrize("name", ["order_margins", "rejected_lines", "upload_head", "upload_quoted", "load_unnumbered"])
def test_high_numbers_agree(spark, high, name):
    assert difference(QUERIES[name](spark, high[0]), high[1], ORACLES[name]) is None
