"""Cleaning, entities, load and training table on small worked examples."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.functions import text as tx
from tallybook.operators import cleaning as cl
from tallybook.operators import entities as en
from tallybook.operators import loading as ld
from tallybook.operators.lookup import lookup_join
from tallybook.operators.training import training_table
from tallybook.session import cut, fresh_path, shared_dir
from tallybook.sources import stores


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.x for r in df.select("i", fn(F.col("s")).alias("x")).orderBy("i").collect()]


def test_amounts(spark):
    values = ["EGP 1,250.50", "£12", "1 234", "٢٥", "-5", "(5)", "N/A", "5d", "", "1.234,56", "1e3",
              " 7\t", "inf", None]
    assert column(spark, values, tx.amount) == [
        1250.5, 12, 1234, 25, -5, None, None, None, None, 1.23456, 1000, 7, None, None]


def test_ids_status_text(spark):
    assert column(spark, ["17850.0", "85123A", "nan", " x ", "5.00"], tx.id_text) == [
        "17850", "85123A", "nan", "x", "5.00"]
    assert column(spark, [" Delivered ", "Refunded", "open", "", "xyz", None], tx.clean_status) == [
        "shipped", "cancelled", "pending", "completed", "completed", "completed"]
    assert column(spark, [" a ", "nan", "None", "", " "], tx.clean_text) == ["a", None, None, None, None]


def lines_of(spark, rows, schema, mapping, **kw):
    raw = spark.createDataFrame(rows, "dataset_id string, _ord long, " + schema)
    return cl.clean_lines(raw, mapping, **kw)


def test_row_filters_and_counters(spark):
    raw = spark.createDataFrame(
        [("d", 0, "536365", "2"), ("d", 1, "C536366", "1"), ("d", 2, "c536367", "-1"), ("d", 3, None, None)],
        "dataset_id string, _ord long, no string, q string")
    mapping = cl.Mapping({"no": "order_id", "q": "order_item.quantity"})
    flagged = cl.row_flags(cl.apply_mapping(raw, mapping), mapping)
    got = cl.row_counters(flagged).first()
    assert (got.total_rows, got.cancelled_rows, got.negative_rows, got.clean_rows) == (4, 1, 1, 2)
    assert [r._ord for r in cl.keep_valid(flagged).orderBy("_ord").collect()] == [0, 3]


ENTITY_MAPPING = cl.Mapping({"o": "order_id", "p": "product_id", "n": "product.name",
                             "price": "product.price", "q": "order_item.quantity"}, cost_pct=0.4)


def worked_lines(spark):
    return lines_of(spark, [
        ("d", 0, "o1", "p1", None, "2.0", "3"), ("d", 1, "o1", "p1", "Mug", "2.5", None),
        ("d", 2, "o2", "p2", None, None, "4"), ("d", 3, None, "p1", "Cup", "1.0", "1")],
        "o string, p string, n string, price string, q string", ENTITY_MAPPING)


def test_entities(spark):
    lines = worked_lines(spark)
    products = {r.externalAccId: (r.name, r.price) for r in en.products(lines).collect()}
    assert products == {"p1": ("Mug", 2.0), "p2": ("p2", None)}
    orders = {r.externalOrderId: (r.revenue, r.profit, r.profit_margin)
              for r in en.orders(lines, 0.4).collect()}
    assert orders == {"o1": (6.0, 3.6, 60.0), "o2": (0.0, 0.0, None)}
    items = en.order_items(lines).orderBy("_ord").collect()
    assert [(r.quantity, r.revenue) for r in items] == [(3, 6.0), (1, None), (4, None), (1, 1.0)]


def test_missing_columns_give_empty_entities(spark):
    lines = lines_of(spark, [("d", 0, "2", "3.5")], "q string, u string",
                     cl.Mapping({"q": "order_item.quantity", "u": "product.price"}))
    assert en.products(lines).count() == en.customers(lines).count() == en.orders(lines).count() == 0
    assert en.order_items(lines).first().revenue == 7.0


def test_same_target_twice_is_refused(spark):
    raw = spark.createDataFrame([("d", 0, "1", "2")], "dataset_id string, _ord long, a string, b string")
    with pytest.raises(ValueError):
        cl.apply_mapping(raw, cl.Mapping({"a": "order_id", "b": "order_id"}))


def test_unmapped_column_with_target_name_is_used(spark):
    lines = lines_of(spark, [("d", 0, "2", "3")], "quantity string, price string", cl.Mapping({}))
    assert en.order_items(lines).first().revenue == 6.0


def test_customers_known_by_name_keep_it(spark):
    lines = lines_of(spark, [("d", 0, " Ann "), ("d", 1, "Ann"), ("d", 2, "nan")], "who string",
                     cl.Mapping({"who": "customer.fullName"}))
    assert [(r.clerkId, r.fullName) for r in en.customers(lines).collect()] == [(None, "Ann")]


def test_metadata_keeps_first_known_value(spark):
    mapping = cl.Mapping({"id": "customer_id"}, attributes={"sz": "size"}, ignored=("junk",))
    lines = lines_of(spark, [("d", 0, "7.0", None, "x", "S"), ("d", 1, "7", "web", "y", "M")],
                     "id string, channel string, junk string, sz string", mapping)
    notes = mapping.notes(["dataset_id", "_ord", "id", "channel", "junk", "sz"])
    got = en.customers(lines, notes).first()
    assert got.clerkId == "7" and got.fullName == "Customer 7"
    assert got.metadata == {"channel": "web", "sz": "S"}
    assert en.order_items(lines).orderBy("_ord").first().attributes == {"size": "S"}


def test_each_dataset_chooses_its_date_notation(spark):
    rows = [("us", 0, "12/25/2010 8:26"), ("us", 1, "1/2/2011 0:00"), ("us", 2, "soon"),
            ("eu", 3, "25/12/2010"), ("eu", 4, "1/2/2011"), ("iso", 5, "2011-03-04T05:06:07"),
            ("tie", 6, "3/4/2011"), ("none", 7, None)]
    lines = lines_of(spark, rows, "d string", cl.Mapping({"d": "order_date"}))
    got = {r._ord: (r.order_date, r.order_date_rejected) for r in lines.collect()}
    at = datetime.datetime
    assert got == {0: (at(2010, 12, 25, 8, 26), None), 1: (at(2011, 1, 2), None), 2: (None, "soon"),
                   3: (at(2010, 12, 25), None), 4: (at(2011, 2, 1), None),
                   5: (at(2011, 3, 4, 5, 6, 7), None), 6: (at(2011, 3, 4), None), 7: (None, None)}
    assert [r.reason for r in en.rejected_lines(lines).collect()] == ["order_date: not a date: soon"]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_equals_plain_join_with_hot_and_null_keys(spark, how):
    rows = [("hot", i) for i in range(60)] + [("lost", i) for i in range(40)] + \
        [(None, i) for i in range(30)] + [(f"k{i}", i) for i in range(10)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k3", None), ("k4", 4), ("other", 5)], "k string, v int")
    want = sorted(left.join(right, "k", how).select("k", "i", "v").collect(), key=repr)
    got = lookup_join(left, right, ["k"], how)
    assert sorted(got.select("k", "i", "v").collect(), key=repr) == want


def empty(spark, name):
    return spark.createDataFrame([], ld.STORED[name])


def test_new_customers_and_products(spark):
    stored = spark.createDataFrame([("1", "b", "a", "A", "x", None, None)], ld.STORED["customer"])
    batch = spark.createDataFrame(
        [("b", i, c, None, e, None, None) for i, (c, e) in enumerate(
            [("a", "y"), ("b", "x"), ("c", "z"), ("d", "z"), ("e", None)])],
        "business_id string, _ord long, clerkId string, fullName string, email string, "
        "phoneNumber string, segment string")
    new = ld.new_customers(batch, stored)
    assert sorted((r.clerk_id, r.full_name) for r in new.collect()) == [
        ("c", "Customer c"), ("e", "Customer e")]
    known = spark.createDataFrame([("1", "b", "Mug", 1.0, None, 0, None, "p1", None)],
                                  ld.STORED["product"])
    products = spark.createDataFrame(
        [("b", i, n, a, None, 2.0, None, None) for i, (a, n) in enumerate(
            [("p9", "Mug"), ("p8", "Cup"), ("p7", "Cup"), ("p1", "Jar")])],
        "business_id string, _ord long, name string, externalAccId string, price double, cost double, "
        "stock long, description string")
    got = ld.new_products(products, known).collect()
    assert [(r.external_acc_id, r.name, r.price, r.cost, r.stock) for r in got] == [("p8", "Cup", 0.0, 2.0, 0)]


def batch_of(spark):
    mapping = cl.Mapping({"o": "order_id", "c": "customer_id", "p": "product_id", "n": "product.name",
                          "u": "product.price", "q": "order_item.quantity"})
    lines = lines_of(spark, [
        ("b", 0, "o1", "1", "p1", "Mug", "2", "0"), ("b", 1, "o1", "1", "p2", "Cup", "3", None),
        ("b", 2, "o2", None, "p1", "Mug", "2", "1"), ("b", 3, "o3", "2", None, "Cup", "3", "2")],
        "o string, c string, p string, n string, u string, q string", mapping)
    lines = cut(lines)
    named = {"customers": en.customers(lines), "products": en.products(lines),
             "orders": en.orders(lines), "order_items": en.order_items(lines)}
    return {k: df.withColumnRenamed("dataset_id", "business_id") for k, df in named.items()}


def test_load_twice_equals_load_once(spark):
    root, batch = fresh_path(spark, "store"), batch_of(spark)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    seen = []
    for _ in range(2):
        load = ld.plan_load(batch, stores.read_store(spark, root), now)
        stores.append_load(load, root)
        seen.append({n: df.count() for n, df in stores.read_store(spark, root).items()})
    assert seen[0] == seen[1] == {"customer": 2, "product": 2, "order": 2, "order_item": 3}
    items = stores.read_store(spark, root)["order_item"].collect()
    assert sorted(r.quantity for r in items) == [1, 1, 2]
    assert sorted(tuple(r) for r in load["quarantine"].collect()) == [
        ("b", "order", "o2", "unknown customer"), ("b", "order_item", "o2", "order of an unknown customer")]
    stats = {r.entity: (r.existing, r.inserted, r.skipped) for r in load["stats"].collect()}
    assert stats["customer"] == (2, 0, 2) and stats["order_item"] == (3, 0, 4)


def items_of(spark, rows):
    return spark.createDataFrame(
        [("b", i, o, p, None, q, 1.0, None, None) for i, (o, p, q) in enumerate(rows)],
        "business_id string, _ord long, orderExternalId string, productAccId string, productName string, "
        "quantity long, unitPrice double, itemDiscount double, attributes map<string,string>")


def orders_of(spark, names, customer="1"):
    return spark.createDataFrame(
        [("b", n, customer, 1.0, 1.0, None, None, None, None) for n in names],
        "business_id string, externalOrderId string, customerExternalId string, total double, "
        "revenue double, status string, orderVoucher string, address string, createdAt timestamp_ntz")


def test_every_item_that_is_left_out_is_reported(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    keys = spark.createDataFrame([("b", "1", "c1")], "business_id string, _key string, _id string")
    orders = ld.resolve_orders(orders_of(spark, ["o1"]).unionByName(orders_of(spark, ["o2"], "9")), keys, now)
    none = spark.createDataFrame([], ld.STORED["product"])
    products = spark.createDataFrame([("b", "P1", "p1", None, 0)],
                                     "business_id string, id string, external_acc_id string, name string, _ord long")
    items = ld.resolve_items(items_of(spark, [("o1", "p1", 1), ("o1", "p1", 1), ("o1", "zz", 1), (None, "p1", 1),
                                              ("none", "p1", 1), ("o2", "p1", 1), ("o7", "p1", 1)]),
                             orders, none, products)
    kept = items.filter("_reason is null")
    assert kept.count() == 2 and kept.select("id").distinct().count() == 2
    reasons = sorted((r.kind, str(r.reference), r.reason) for r in ld.quarantined(orders, items).collect())
    assert reasons == [("order", "o2", "unknown customer"), ("order_item", "None", "no order number"),
                       ("order_item", "none", "no order number"), ("order_item", "o1", "unknown product"),
                       ("order_item", "o2", "order of an unknown customer"), ("order_item", "o7", "unknown order")]


def test_ids_of_items_do_not_depend_on_the_place_of_a_line(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    keys = spark.createDataFrame([("b", "1", "c1")], "business_id string, _key string, _id string")
    orders = ld.resolve_orders(orders_of(spark, ["o1"]), keys, now)
    none = spark.createDataFrame([], ld.STORED["product"])
    products = spark.createDataFrame([("b", "P1", "p1", None, 0)],
                                     "business_id string, id string, external_acc_id string, name string, _ord long")
    rows = [("o1", "p1", 1), ("o1", "p1", 2), ("o1", "p1", 1)]
    first, again = ([sorted(r.id for r in ld.resolve_items(items_of(spark, x), orders, none, products).collect())
                     for x in (rows, [("o1", "zz", 5), *reversed(rows)])])
    assert set(first) < set(again) and len(set(first)) == 3


def test_orders_marked_as_unnumbered_keep_their_own_ids(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    keys = spark.createDataFrame([("b", "1", "c1")], "business_id string, _key string, _id string")
    got = ld.resolve_orders(orders_of(spark, ["none", "NONE", "o1"]), keys, now)
    assert got.select("id").distinct().count() == 3


def test_uploads_tell_unnumbered_orders_apart(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    keys = spark.createDataFrame([("b", "1", "c1")], "business_id string, _key string, _id string")
    batch = orders_of(spark, ["none", "o1"])
    ids = [{r.id for r in ld.resolve_orders(batch.withColumn("upload_id", F.lit(u)), keys, now).collect()} for u in "aba"]
    assert ids[0] == ids[2] and len(ids[0] & ids[1]) == 1 and len(ids[0] | ids[1]) == 3


def test_a_load_reads_only_the_businesses_of_its_batch(spark, tmp_path):
    rows = [(f"id{i}", f"b{i}", None, None, f"n{i}", None, None) for i in range(20)]
    stores.append_rows(spark.createDataFrame(rows, ld.STORED["customer"]), str(tmp_path), "customer")
    batch = {"customers": spark.createDataFrame([("b3",), ("b7",), ("new",)], "business_id string")}
    found = ld.touched(batch, {"customer": stores.read_table(spark, str(tmp_path), "customer")})["customer"]
    assert {r.business_id for r in found.collect()} == {"b3", "b7"}
    assert "dynamicpruningexpression" in found._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_without_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_training_table(spark):
    products = spark.createDataFrame(
        [("d", "p1", "Mug", None, 5, 0), ("d", "p2", "Cup", 1.0, 6, 1), ("d", "p3", "Cup", 2.0, 7, 2)],
        "dataset_id string, externalAccId string, name string, cost double, stock long, _ord long")
    orders = spark.createDataFrame([("d", "o1", 60.0, "c1", None, 0)],
        "dataset_id string, externalOrderId string, profit_margin double, customerExternalId string, "
        "createdAt timestamp_ntz, _ord long")
    items = spark.createDataFrame(
        [("d", "o1", "p1", "Cup", 1, 2.0, 2.0, 0), ("d", "o9", "zz", "Cup", 1, 2.0, 2.0, 1),
         ("d", None, None, None, 1, 2.0, 2.0, 2)],
        "dataset_id string, orderExternalId string, productAccId string, productName string, "
        "quantity long, unitPrice double, revenue double, _ord long")
    got = {r.order_id: (r.cost, r.stock, r.profit_margin, r.customer_id)
           for r in training_table(products, orders, items).collect()}
    assert got == {"o1": (None, 5, 60.0, "c1"), "o9": (2.0, 7, None, None), None: (None, None, None, None)}


def test_no_python_in_cleaning_plans(spark):
    lines = worked_lines(spark)
    for df in (lines, en.products(lines), en.orders(lines, 0.4), en.order_items(lines)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=20, max_size=20))
def test_cleaners_accept_any_text(spark, values):
    values = [v.replace("\x00", "").encode("utf-8", "ignore").decode() for v in values]
    once = column(spark, values, tx.normalise_header)
    assert column(spark, once, tx.normalise_header) == once
    column(spark, values, tx.amount)


def test_the_entities_of_a_batch_are_written_once(spark):
    """A load reads a batch's entities several times: they are scans, not aggregates of all lines."""
    from tallybook.plans import sales
    mapping = cl.Mapping({"no": "order_id", "code": "product_id", "who": "customer_id", "q": "order_item.quantity"})
    lines = cut(lines_of(spark, [("d", 0, "o1", "p1", "c1", "2"), ("d", 1, "o1", "p2", "c1", "1")],
                         "no string, code string, who string, q string", mapping))
    batch = sales._entities(lines)
    assert {n: df.count() for n, df in batch.items()} == {"customers": 1, "products": 2, "orders": 1, "order_items": 2}
    assert not any("Aggregate" in df._jdf.queryExecution().optimizedPlan().toString() for df in batch.values())


def test_dates_are_read_from_written_lines(spark, tmp_path):
    """The raw lines are made once: neither the vote on the notations nor the readings go back to them."""
    spark.createDataFrame([("d", 0, "1", "31/12/2020", "2"), ("d", 1, "2", "1/2/2021", "1"), ("d", 2, "C3", "2020-01-01", "1")],
                          "dataset_id string, _ord long, no string, day string, q string").write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    mapping = cl.Mapping({"no": "order_id", "day": "order_date", "q": "order_item.quantity"})
    got = cl.written_lines(raw, mapping)
    assert not set(raw.inputFiles()) & set(got.inputFiles())
    want = cl.clean_lines(raw, mapping)
    assert sorted(got.collect(), key=lambda r: r._ord) == sorted(want.select(got.columns).collect(), key=lambda r: r._ord)
    few = cl.written_lines(raw, mapping, ["dataset_id", "_ord", "order_date"])
    assert [r.order_date for r in few.orderBy("_ord").collect()] == [datetime.datetime(2020, 12, 31), datetime.datetime(2021, 2, 1)]


def test_what_an_order_adds_to_the_training_table_is_looked_up_last(spark):
    """Its margin, customer and date are not carried through the lookups of products."""
    orders = spark.createDataFrame([("d", "o1", 60.0, "c1", None, 0)],
        "dataset_id string, externalOrderId string, profit_margin double, customerExternalId string, "
        "createdAt timestamp_ntz, _ord long")
    products = spark.createDataFrame([("d", "p1", "Mug", 1.0, 5, 0)],
        "dataset_id string, externalAccId string, name string, cost double, stock long, _ord long")
    items = spark.createDataFrame([("d", "o1", "p1", "Cup", 1, 2.0, 2.0, 9.0, 0)],
        "dataset_id string, orderExternalId string, productAccId string, productName string, "
        "quantity long, unitPrice double, revenue double, profit double, _ord long")
    got = training_table(products, orders, items)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 3 and "orderExternalId" in joins[0]
    assert [(r.cost, r.profit_margin, r.customer_id) for r in got.collect()] == [(1.0, 60.0, "c1")]


def test_partitions_stay_small_whatever_the_table(spark):
    """Cleaned lines unfold about tenfold in memory, so their shuffles are cut into small partitions."""
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
    lines = spark.range(4_000_000).selectExpr("sha2(cast(id as string), 256) as text", "id % 100000 as k") \
        .repartition("k")
    assert lines.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_a_load_into_an_empty_store_compares_with_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("b", "1"), ("b", "2"), (None, "3")], "business_id string, id string")
    fresh = ld._marked(rows, stores.read_table(spark, str(tmp_path), "order"))
    assert "Join" not in fresh._jdf.queryExecution().optimizedPlan().toString()
    stored = spark.createDataFrame([("b", "1"), ("b", "1"), (None, "3")], "business_id string, id string")
    assert {r.id: r._seen for r in ld._marked(rows, stored).collect()} == {"1": True, "2": False, "3": False}


def test_items_are_numbered_before_they_carry_the_id_of_their_order(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    keys = spark.createDataFrame([("b", "1", "c1")], "business_id string, _key string, _id string")
    orders = ld.resolve_orders(orders_of(spark, ["o1"]), keys, now)
    none = spark.createDataFrame([], ld.STORED["product"])
    products = spark.createDataFrame([("b", "P1", "p1", None, 0)],
                                     "business_id string, id string, external_acc_id string, name string, _ord long")
    found = ld.resolve_items(items_of(spark, [("o1", "p1", 1), ("o1", "p1", 1), (None, "p1", 1)]), orders, none, products)
    window = next(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x)
    assert "_order_key" in window and "order_id" not in window
    assert found.filter("_reason is null").select("id").distinct().count() == 2


def test_items_that_are_left_out_carry_no_long_ids(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    keys = spark.createDataFrame([("b", "1", "c1")], "business_id string, _key string, _id string")
    orders = ld.resolve_orders(orders_of(spark, ["o1"]), keys, now)
    none = spark.createDataFrame([], ld.STORED["product"])
    products = spark.createDataFrame([("b", "P1", "p1", None, 0)],
                                     "business_id string, id string, external_acc_id string, name string, _ord long")
    found = ld.resolve_items(items_of(spark, [("o1", "p1", 1), ("o1", "zz", 1), ("o1", "zz", 1)]), orders, none, products)
    left = found.filter("_reason is not null")
    assert [r.order_id for r in left.collect()] == [None, None] and left.select("id").distinct().count() == 2
    assert "Join" not in left._jdf.queryExecution().optimizedPlan().toString()
