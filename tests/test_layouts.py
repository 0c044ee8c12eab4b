"""Files of several layouts cleaned together, each as by itself."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallybook.operators import cleaning as cl
from tallybook.operators import entities as en
from tallybook.operators import layouts as lay
from tallybook.sources import uploads as up

# dataset -> rows of cells, header row included
FILES = {
    "R1": [["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"],
           ["536365", "A1", "mug", "6", "2010-12-01 08:26:00", "2.5", "17850.0", "UK"],
           ["C5363", "A1", "mug", "1", "2010-12-01 08:26:00", "2.5", "17850.0", "UK"],
           ["536366", "B2", None, "-2", "2010-12-01 08:28:00", "1", "17850.0", "FR"],
           ["536366", "B2", "jar", "2", "2010-12-02 08:28:00", "£1.25", "17851", "FR"]],
    "R2": [["Spring stock"], ["order_id", "sku", "product_name", "size", "colour", "qty", "selling_price", "cost", "secret"],
           ["7.0", "S1", "shirt", "M", "red", "3", "10", "4", "x"], ["7.0", "S2", "skirt", "nan", None, None, "20", "5", "y"]],
    "R9": [["order_id", "email", "name", "total", "when"], ["1", "a@b.c", "Ann", "12.5", "13/02/2024"],
           ["1", "a@b.c", None, "7.5", "14/02/2024"], ["2", None, "Bo", "1", "soon"]],
    "R10": [["Quantity", "UnitPrice"], ["2", "3"], ["-1", "3"]],
    "own": [["order_id", "revenue", "revenue2"], ["9", "5", "6"]],
}
MAPPING = [
    *[("R1", c, t, None, False) for c, t in {
        "InvoiceNo": "order_id", "StockCode": "product_id", "Description": "product.name", "Quantity": "order_item.quantity",
        "InvoiceDate": "order_date", "UnitPrice": "order_item.unitPrice", "CustomerID": "customer_id", "Country": "__unmapped__"}.items()],
    *[("R2", c, t, None, False) for c, t in {
        "order_id": "order_id", "sku": "product_id", "product_name": "product.name", "qty": "order_item.quantity",
        "selling_price": "product.price", "cost": "product.cost"}.items()],
    ("R2", "size", None, "size", False), ("R2", "colour", "__attributes__.color", "color", False), ("R2", "secret", None, None, True),
    ("R9", "email", "customer.email", None, False), ("R9", "name", "customer.fullName", None, False), ("R9", "total", "revenue", None, False),
    ("R9", "when", "order_item.createdAt", None, False),
    ("R10", "Quantity", "order_item.quantity", None, False), ("R10", "UnitPrice", "product.price", None, False),
    ("own", "revenue2", "revenue", None, False),
]
SETTINGS = [("R1", None, 0.4, {}), ("R2", 1, None, {"customer_id": "skip_feature"}), ("R9", 0, 0.25, None), ("R10", None, None, None)]


@pytest.fixture(scope="module")
def loaded(spark):
    rows = [(d, i, r) for d, table in FILES.items() for i, r in enumerate(table)]
    cells = spark.createDataFrame(rows, "dataset_id string, _ord long, cells array<string>")
    mapping = spark.createDataFrame(MAPPING, lay.MAPPING_SCHEMA)
    settings = spark.createDataFrame(SETTINGS, lay.SETTINGS_SCHEMA)
    known = lay.layouts(lay.headers(cells, settings), mapping, settings)
    return cells, known, lay.clean_layouts(cells, known).cache()


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict(recursive=True) for r in df.collect()}


def test_confirmed_header_and_positions(loaded):
    known = by_key(loaded[1], "dataset_id")
    assert known["R2",]["where"]["product_id"] == 1 and known["R2",]["notes"] == {"size": 3, "colour": 4}
    assert known["R2",]["attributes"] == {"size": 3, "color": 4}
    assert known["R1",]["notes"] == {"Country": 7}
    # order_id stands under its own name; `revenue` is taken from the mapped column, not from its namesake
    assert known["own",]["where"] == {"order_id": 0, "revenue": 2} and known["R9",]["where"]["order_id"] == 0


def test_orders_of_all_layouts(loaded):
    got = by_key(en.orders(loaded[2]), "dataset_id", "externalOrderId")
    first = got["R1", "536365"]
    assert (first["revenue"], first["profit"], first["profit_margin"], first["customerExternalId"]) == (15.0, 9.0, 60.0, "17850")
    assert first["createdAt"] == datetime.datetime(2010, 12, 1, 8, 26)
    assert (got["R1", "536366"]["revenue"], got["R1", "536366"]["customerExternalId"]) == (2.5, "17851")
    assert (got["R2", "7"]["revenue"], got["R2", "7"]["profit"], got["R2", "7"]["customerExternalId"]) == (30.0, None, None)
    ann = got["R9", "1"]
    assert (ann["revenue"], ann["profit"], ann["customerExternalId"]) == (20.0, 15.0, "a@b.c")
    assert ann["createdAt"] == datetime.datetime(2024, 2, 13) and got["R9", "2"]["createdAt"] is None
    assert ("own", "9") in got and got["own", "9"]["revenue"] == 6.0 and len(got) == 6


def test_products_customers_items(loaded):
    products = by_key(en.products(loaded[2]), "dataset_id", "name")
    assert products["R1", "jar"]["price"] is None and products["R1", "jar"]["externalAccId"] == "B2"
    assert (products["R2", "skirt"]["price"], products["R2", "skirt"]["cost"]) == (20.0, 5.0) and len(products) == 4
    customers = by_key(en.customers(loaded[2]), "dataset_id", "email")
    assert customers["R9", "a@b.c"]["fullName"] == "Ann" and customers["R9", "a@b.c"]["clerkId"] is None
    assert {k[0] for k in customers} == {"R1", "R9"} and len(en.customers(loaded[2]).collect()) == 3
    items = en.order_items(loaded[2])
    shirt = items.where("productName = 'shirt'").first()
    assert (shirt.revenue, shirt.profit, shirt.attributes) == (30.0, 18.0, {"size": "M", "color": "red"})
    assert items.where("productName = 'skirt'").first().attributes == {}
    assert items.where("dataset_id = 'R10'").first().revenue == 6.0
    notes = by_key(lay.customer_metadata(loaded[2]), "dataset_id", "_key")
    assert notes["R1", "17850"]["metadata"] == {"Country": "UK"} and notes["R1", "17851"]["metadata"] == {"Country": "FR"}


def test_warnings_coverage_and_decisions(loaded):
    cells, known, _ = loaded
    counters = lay.row_counters(cells, known)
    texts = {}
    for r in lay.warnings(known, counters).orderBy("dataset_id", "place").collect():
        texts.setdefault(r.dataset_id, []).append(r.warning)
    assert texts["R10"][:4] == [lay.NEGATIVE % "1", lay.NO_PRODUCT, lay.NO_CUSTOMER, lay.NO_ORDER]
    assert texts["R10"][-1] == "'customer_id' was not found in your data and will be left empty. You can add it later from the dashboard."
    assert texts["R1"][:2] == [lay.NEGATIVE % "1", lay.CANCELLED % "1"] and lay.NO_CUSTOMER in texts["R2"]
    found = by_key(lay.coverage(known), "dataset_id")
    assert {"revenue", "profit", "profit_margin"} == set(found["R1",]["derived_fields"]) and "profit" in found["R2",]["missing_fields"]
    decided = by_key(lay.missing_decisions(known), "dataset_id", "field")
    assert decided["R2", "customer_id"]["decision"] == "skip_feature" and decided["R10", "cost"]["decision"] is None


def test_one_layout_alone_gives_the_same_lines(spark, loaded):
    """The single mapping and the table of mappings agree."""
    cells, _, lines = loaded
    header = FILES["R1"][0]
    raw = up.raw_lines(cells.where("dataset_id = 'R1' AND _ord > 0"), header)
    confirmed = {c: t for d, c, t, _, _ in MAPPING if d == "R1"}
    alone = cl.clean_lines(raw, cl.Mapping(confirmed, cost_pct=0.4))
    for build in (en.orders, en.products, en.order_items):
        one = build(alone, 0.4) if build is en.orders else build(alone)
        mine = build(lines).where("dataset_id = 'R1'").select(*one.columns)
        assert sorted(map(str, one.collect())) == sorted(map(str, mine.collect()))


def test_repeated_target_is_named(spark):
    cells = spark.createDataFrame([("d", 0, ["a", "b"]), ("d", 1, ["1", "2"])], "dataset_id string, _ord long, cells array<string>")
    mapping = spark.createDataFrame([("d", "a", "order_id", None, False), ("d", "b", "order_id", None, False)], lay.MAPPING_SCHEMA)
    settings = spark.createDataFrame([("d", 0, None, None)], lay.SETTINGS_SCHEMA)
    known = lay.layouts(lay.headers(cells, settings), mapping, settings)
    assert en.orders(lay.clean_layouts(cells, known)).first().externalOrderId == "1"
    texts = [r.warning for r in lay.warnings(known, lay.row_counters(cells, known)).collect()]
    assert lay.TWICE % "order_id" in texts
    assert lay.clean_layouts(cells.where("false"), known).count() == 0
