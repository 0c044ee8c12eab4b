"""Queries about stored tables: product facts, segmentation, refresh decisions and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators import history as hi
from tallybook.operators import refresh as rf
from tallybook.operators import runs as rn
from tallybook.operators.clusters import segment_products
from tallybook.operators import segmentation as sg
from tallybook.plans.extract import table
from tallybook.session import cut, fresh_path
from tallybook.sources import journal as jn
from tallybook.sources import stores

NOW = "2002-01-05 12:00:00"


def _products(spark, sf_dir, business: str = "p_brand") -> DataFrame:
    """Parts as stored products. Some have no cost, some no stock, some a cost below zero."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("id"), F.expr(business).cast("string").alias("business_id"),
        F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"),
        F.when(key % 3 == 0, F.lit(0.0)).when(key % 47 == 5, F.lit(-1.0))
        .otherwise(F.col("p_retailprice") * 4 / 8).alias("cost"),
        F.when(key % 11 == 0, F.lit(0)).otherwise(F.col("p_size")).cast("long").alias("stock"),
        F.to_timestamp_ntz(F.lit("2001-12-01 00:00:00")).alias("updated_at"))


def _items(spark, sf_dir) -> DataFrame:
    """All line items; those of every tenth part go to the part before, so that some products have no
    sales."""
    line = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey") - (F.col("l_partkey") % 10 == 9).cast("int")
    return line.select(
        F.col("l_orderkey").cast("string").alias("order_id"), part.cast("string").alias("product_id"),
        F.col("l_quantity").cast("long").alias("quantity"),
        (F.floor(F.round(F.col("l_extendedprice") * 100) / 32) / 100).alias("unit_price"))


def _facts(spark, sf_dir, business: str = "p_brand") -> DataFrame:
    return sg.product_facts(_products(spark, sf_dir, business), _items(spark, sf_dir))


def product_facts(spark, sf_dir):
    return _facts(spark, sf_dir).withColumn("profit_margin", F.round("profit_margin", 6))


def facts_without_cancelled(spark, sf_dir):
    """The same without the items of orders in one state."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"))
    facts = sg.product_facts(_products(spark, sf_dir), _items(spark, sf_dir), orders, ["F"])
    return facts.select("product_id", "quantity", "revenue", "profit")


def segment_gate(spark, sf_dir):
    """Businesses of 1, 3, 5, ... products."""
    return sg.gate(_facts(spark, sf_dir, "cast(floor(sqrt(p_partkey)) as int)"))


def _sparse_features(spark, sf_dir) -> DataFrame:
    """Features with gaps: every eighth product has no stock known, every ninth no price."""
    facts = _facts(spark, sf_dir)
    key = F.col("product_id").cast("long")
    facts = facts.withColumns({
        "stock": F.when(key % 8 != 0, F.col("stock")).otherwise(F.lit(0.0)),
        "price": F.when(key % 9 != 0, F.col("price")),
    })
    return sg.features(facts, sg.gate(facts))


def product_features(spark, sf_dir):
    got = sg.impute(cut(_sparse_features(spark, sf_dir)))
    return got.select("business_id", "product_id", *[F.round(c, 6).alias(c) for c in sg.FEATURES])


def impute_scale(spark, sf_dir):
    """Log features robust-scaled, without the fitted power transform."""
    rows = sg.log_features(sg.impute(cut(_sparse_features(spark, sf_dir))))
    got = sg.robust_scale(cut(rows), sg.TRANSFORMED, "quantity_log")
    return got.select("business_id", "product_id",
                      *[F.round(c, 6).alias(c) for c in sg.TRANSFORMED])


def yeo_johnson(spark, sf_dir):
    rows = cut(sg.log_features(sg.impute(cut(_sparse_features(spark, sf_dir)))))
    got = sg.power_parameters(rows, sg.TRANSFORMED)
    # Scales differ by tens of powers of ten, so their logarithms are compared.
    return got.select("business_id", "name", F.round("lam", 7).alias("lam"),
                      F.round(F.log1p(F.abs("mean")), 6).alias("log_mean"), F.round(F.ln("std"), 6).alias("log_std"))


def product_segments(spark, sf_dir):
    """Named segments of all brands, with the model that won."""
    out = segment_products(_facts(spark, sf_dir))
    return out["labels"].join(out["models"], "business_id")


def segment_summary(spark, sf_dir):
    out = segment_products(_facts(spark, sf_dir))
    return out["summary"].withColumns({
        c: F.to_json(c) for c in ("top_products", "bottom_products")})


def _by_size(spark, sf_dir) -> DataFrame:
    """Facts with a fixed cluster: part size modulo 4."""
    size = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        (F.col("p_size") % 4).alias("cluster"))
    rows = _facts(spark, sf_dir).join(size, "product_id")
    return rows.withColumn("cluster_name", F.concat(F.lit("size "), F.col("cluster").cast("string")))


def cluster_summary(spark, sf_dir):
    return sg.cluster_summary(_by_size(spark, sf_dir))


def cluster_top_bottom(spark, sf_dir):
    lists = sg.top_and_bottom(_by_size(spark, sf_dir))
    ids = lambda c: F.array_join(F.transform(c, lambda s: s["product_id"]), ",")
    return lists.select("business_id", "cluster", ids("top_products").alias("top"),
                        ids("bottom_products").alias("bottom"))


def name_clusters(spark, sf_dir):
    centres = _by_size(spark, sf_dir).groupBy("business_id", "cluster").agg(
        F.round(F.avg("profit_margin"), 4).alias("profit_margin"),
        F.round(F.avg(F.col("price") - F.col("cost")), 4).alias("absolute_margin_log"),
        F.round(F.avg(F.col("quantity") / F.col("stock")), 4).alias("stock_turnover"))
    return sg.name_clusters(centres).select("business_id", "cluster", "cluster_name")


def segment_replace(spark, sf_dir):
    """Write every business's segments, then replace those of one group; read all back."""
    root = fresh_path(spark, "segments")
    rows = cut(_by_size(spark, sf_dir).select("business_id", "product_id", "cluster"))
    stores.replace_businesses(rows, root, "product_segment")
    again = rows.filter(F.col("business_id").endswith("1")) \
        .withColumn("cluster", F.col("cluster") + 10)
    stores.replace_businesses(again, root, "product_segment")
    stores.mark_runs(rows.select("business_id").distinct(), root, F.lit(NOW).cast("timestamp_ntz"))
    stores.mark_runs(again.select("business_id").distinct(), root,
                     F.lit(NOW).cast("timestamp_ntz") + F.expr("interval 1 day"))
    back = stores.read_table(spark, root, "product_segment",
                             "business_id string, product_id string, cluster int")
    runs = rf.last_runs(stores.read_table(spark, root, "segment_run", stores.RUN_MARKS))
    return back.groupBy("business_id", "cluster").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("product_id").alias("products")) \
        .join(runs, "business_id")


# A run as a whole: brands, products without a usable cost and a few others are the businesses.
RUN_BUSINESS = ("CASE WHEN p_partkey % 47 = 5 THEN 'unpriced' WHEN p_partkey % 400 = 0 THEN 'few' "
                "ELSE cast(p_brand AS {0}) END")


def _fixed_fit(facts: DataFrame) -> dict[str, DataFrame]:
    """Clusters by the last digit of the product id, for a first run that later ones replace."""
    rows = facts.withColumn("cluster", (F.col("product_id").cast("long") % 4).cast("int")) \
        .withColumn("cluster_name", F.concat(F.lit("digit "), F.col("cluster").cast("string")))
    models = facts.groupBy("business_id").agg(
        F.lit("fixed").alias("model"), F.lit(4).alias("k"), F.lit(1.0).alias("silhouette"))
    summary = sg.cluster_summary(rows).join(sg.top_and_bottom(rows), ["business_id", "cluster"])
    return {"gate": sg.gate(facts), "models": models, "labels": rows, "summary": summary}


def segment_run(spark, sf_dir):
    """Brands 1 to 3 of each ten were segmented two days ago. Since then those with a 2 had sales and those with a 3
    changed products, so a run replaces theirs and segments all other brands; those with a 1 keep what they have."""
    root, now = fresh_path(spark, "runs"), F.lit(NOW).cast("timestamp_ntz")
    earlier = now - F.expr("interval 2 days")
    brand = F.col("business_id")
    products = cut(_products(spark, sf_dir, RUN_BUSINESS.format("string")).withColumn("updated_at", F.when(
        brand.endswith("3"), now).otherwise(F.col("updated_at"))))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("business_id"),
        F.col("o_orderdate").alias("created_at"))
    orders = orders.withColumn("created_at", F.when(brand.endswith("2"), now).otherwise(F.col("created_at")))
    items = _items(spark, sf_dir)
    facts = cut(sg.product_facts(products, items))
    businesses = products.select("business_id").distinct()
    first = businesses.filter(F.substring("business_id", -1, 1).isin("1", "2", "3")).withColumn("should_run", F.lit(True))
    rn.run_segmentation(spark, root, "first", first, facts, earlier, "upload", _fixed_fit)
    activity = rf.business_activity(businesses, products, orders, items, jn.committed_marks(spark, root))
    rn.run_segmentation(spark, root, "second", rf.decide(activity, now), facts, now)

    rows = jn.read_committed(spark, root, "product_segment", rn.SEGMENTS).groupBy("business_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("product_id").alias("products"),
        F.count_distinct("cluster").cast("int").alias("_k"))
    summaries = jn.read_committed(spark, root, "product_cluster_summary", "business_id string, cluster int") \
        .groupBy("business_id").agg(F.count(F.lit(1)).cast("int").alias("_summaries"))
    records = hi.run_states(jn.events(spark, root, hi.EVENT_SCHEMA), order="step")
    latest = records.groupBy("business_id").agg(F.max_by(F.struct(
        "status", "triggered_by", "detail", "result_meta", "progress"), "finished_at").alias("r"))
    field = lambda name: F.get_json_object("r.result_meta", f"$.{name}")
    says = F.concat(F.lit("Found "), field("best_k"), F.lit(" segments using "), field("model_used"),
                    F.lit(" (silhouette "), field("silhouette_score"), F.lit(")"))
    whole = (F.col("_k") == field("best_k").cast("int")) & (F.col("_k") == F.col("_summaries")) & (F.col("r.detail") == says)
    out = jn.read_step(spark, root, "run_decision", "second").join(jn.committed_marks(spark, root), "business_id", "left")
    for part in (rows, summaries, latest):
        out = out.join(part, "business_id", "left")
    return out.select(
        "business_id", "should_run", "reason", "run_id", F.col("finished_at").alias("last_run"), "rows", "products",
        F.col("r.status").alias("status"), F.col("r.triggered_by").alias("triggered_by"),
        F.when(F.col("r.status") == "skipped", F.col("r.detail")).alias("skip_detail"),
        field("total_rows").cast("long").alias("total_rows"), whole.alias("consistent"))


# Refresh: customers' nations are the businesses, customers their products.

def _activity(spark, sf_dir) -> DataFrame:
    business = F.col("c_nationkey").cast("string").alias("business_id")
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    now = F.lit(NOW).cast("timestamp_ntz")
    # Nation n last ran n/2 days before now; nations 0 to 3 never did; large ones first.
    runs = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("business_id"),
        F.when(F.col("n_nationkey") > 3, now - F.expr("make_interval(0, 0, 0, 0, 12 * n_nationkey, 0, 0)"))
        .alias("finished_at"))
    # Most products of every eighth nation belong to the one before, so a few nations have hardly any.
    seller = F.col("c_nationkey") - ((F.col("c_nationkey") % 8 == 1) & (F.col("c_custkey") % 100 != 0)).cast("int")
    products = customers.select(
        seller.cast("string").alias("business_id"), F.to_timestamp_ntz(F.when(F.col("c_custkey") % (F.col("c_nationkey") * 20 + 1) == 0,
                                            F.lit(NOW)).otherwise(F.lit("1995-01-01 00:00:00")))
        .alias("updated_at"))
    sales = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("id"), business,
        F.when(F.col("c_nationkey") % 5 == 2, F.col("o_orderdate") + F.expr("interval 4 years"))
        .otherwise(F.col("o_orderdate")).alias("created_at"))
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"))
    businesses = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("business_id"))
    return rf.business_activity(businesses, products, sales, items, runs)


def refresh_decisions(spark, sf_dir):
    return rf.decide(_activity(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


def refresh_forced(spark, sf_dir):
    return rf.decide(_activity(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), force=True)


# Run history: events are patches of runs, one run per 8 events.

def _events(spark, sf_dir) -> DataFrame:
    step = F.col("event_id") % 8
    states = F.array(*[F.lit(s) for s in ("queued", "running", None, None)]
                     + [F.when(F.col("event_id") % 5 == 0, F.lit(s)) for s in
                        ("done", "failed", "skipped")] + [F.lit(None)])
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.floor(F.col("event_id") / 8).cast("string")).alias("id"),
        F.when(step == 0, (F.floor(F.col("event_id") / 8) % 40).cast("string")).alias("business_id"),
        F.when(step == 0, F.lit("product_segmentation")).alias("type"),
        F.when(step == 0, F.lit("upload")).alias("triggered_by"),
        F.get(states, step.cast("int")).alias("status"),
        F.when(F.col("event_type") != "error", (F.col("user_id") % 100).cast("int"))
        .alias("progress"),
        F.when(F.col("event_type") == "click", F.col("props")).alias("detail"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.lit(None).cast("string").alias("result_meta"), "ts", "event_id")


def run_history(spark, sf_dir):
    return hi.run_states(_events(spark, sf_dir), order="event_id").drop("result_meta")


def run_history_active(spark, sf_dir):
    return hi.active_runs(hi.run_states(_events(spark, sf_dir), order="event_id"))


def run_history_one(spark, sf_dir):
    return hi.run_by_id(_events(spark, sf_dir), "run7", order="event_id") \
        .select("id", "business_id", "status", "progress", "detail", "error", "finished_at")


QUERIES = {
    "product_facts": product_facts, "facts_without_cancelled": facts_without_cancelled,
    "segment_gate": segment_gate, "product_features": product_features,
    "impute_scale": impute_scale, "yeo_johnson": yeo_johnson,
    "cluster_summary": cluster_summary, "cluster_top_bottom": cluster_top_bottom,
    "name_clusters": name_clusters, "product_segments": product_segments,
    "segment_summary": segment_summary, "segment_replace": segment_replace,
    "segment_run": segment_run, "refresh_decisions": refresh_decisions, "refresh_forced": refresh_forced,
    "run_history": run_history, "run_history_active": run_history_active,
    "run_history_one": run_history_one,
}


def _facts_sql(business: str = "p_brand", keep: str = "true") -> str:
    return f"""WITH products AS (
  SELECT p_partkey AS k, cast(p_partkey AS VARCHAR) AS id, cast({business} AS VARCHAR) AS business_id,
    p_retailprice AS price, p_size,
    CASE WHEN p_partkey % 3 = 0 THEN 0.0 WHEN p_partkey % 47 = 5 THEN -1.0
      ELSE p_retailprice * 4 / 8 END AS raw_cost,
    CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size END AS raw_stock FROM part),
sold AS (
  SELECT l_partkey - (l_partkey % 10 = 9)::INT AS k, sum(cast(l_quantity AS BIGINT)) AS q,
    sum(cast(l_quantity AS BIGINT) * cast(floor(round(l_extendedprice * 100) / 32) / 100 AS DECIMAL(18, 4))) AS m
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE {keep} GROUP BY 1),
base AS (
  SELECT business_id, id AS product_id, k, p_size, price,
    coalesce(nullif(cast(raw_cost AS DECIMAL(18, 4)), 0), cast(price AS DECIMAL(18, 4)) * 0.5) AS dcost,
    greatest(raw_stock, 1)::DOUBLE AS stock, q, m FROM products LEFT JOIN sold USING (k)),
facts AS MATERIALIZED (
  SELECT business_id, product_id, k, p_size, price, dcost::DOUBLE AS cost, stock,
    coalesce(q, 0)::DOUBLE AS quantity, coalesce(m, 0)::DOUBLE AS revenue,
    coalesce((m - dcost * q)::DOUBLE, 0) AS profit,
    CASE WHEN coalesce(m, 0) > 0 THEN coalesce((m - dcost * q)::DOUBLE, 0) / m::DOUBLE * 100 ELSE 0.0 END
      AS profit_margin FROM base)"""


_CLUSTERED = _facts_sql() + """,
c AS (SELECT *, p_size % 4 AS cluster, 'size ' || (p_size % 4) AS cluster_name FROM facts)"""

_IMPUTED = _facts_sql() + """,
sparse AS (
  SELECT * REPLACE (CASE WHEN k % 8 <> 0 THEN stock ELSE 0.0 END AS stock,
    CASE WHEN k % 9 <> 0 THEN price END AS price) FROM facts),
gated AS (
  SELECT *, count(*) OVER (PARTITION BY business_id) AS n,
    count(*) FILTER (cost >= 0) OVER (PARTITION BY business_id) AS usable FROM sparse),
f AS (
  SELECT *, price - cost AS absolute_margin, quantity / nullif(stock, 0) AS stock_turnover
  FROM gated WHERE n >= 15 AND usable >= 15 AND cost >= 0),
imputed AS MATERIALIZED (
  SELECT business_id, product_id,
    coalesce(profit_margin, quantile_cont(profit_margin, 0.5) OVER b, 0) AS profit_margin,
    coalesce(absolute_margin, quantile_cont(absolute_margin, 0.5) OVER b, 0) AS absolute_margin,
    coalesce(stock_turnover, quantile_cont(stock_turnover, 0.5) OVER b, 0) AS stock_turnover,
    coalesce(quantity, quantile_cont(quantity, 0.5) OVER b, 0) AS quantity
  FROM f WINDOW b AS (PARTITION BY business_id))"""


def _robust(c: str, clip: bool = False) -> str:
    x = f"least({c}, quantile_cont({c}, 0.99) OVER b)" if clip else c
    iqr = f"(quantile_cont({c}, 0.75) OVER b - quantile_cont({c}, 0.25) OVER b)"
    return (f"round(({x} - quantile_cont({c}, 0.5) OVER b) / "
            f"CASE WHEN {iqr} = 0 THEN 1.0 ELSE {iqr} END, 6) AS {c}")


def _likelihood_sql(round_: int, grid: str) -> str:
    """One round of the search: the best lambda of each business and column among those of `grid`."""
    return f""",
t{round_} AS (SELECT business_id, name, lam, any_value(step) AS step, avg(y) AS m, var_pop(z) AS v,
    count(*) AS n, any_value(j) AS j
  FROM (SELECT *, CASE WHEN signs OR p = 0 THEN y ELSE pow(1 + x, p) / p END AS z FROM (
    SELECT *, sign(x) * CASE WHEN p = 0 THEN ln(1 + abs(x)) ELSE (pow(1 + abs(x), p) - 1) / p END AS y
    FROM (SELECT business_id, name, x, j, signs, lam, step, CASE WHEN x >= 0 THEN lam ELSE 2 - lam END AS p
      FROM u JOIN {grid}))) GROUP BY business_id, name, lam),
b{round_} AS MATERIALIZED (SELECT business_id, name, unnest(arg_max({{lam: lam, step: step, m: m, v: v}},
    (CASE WHEN v > 1e-20 * m * m AND v > 0 THEN -n / 2 * ln(v) + (lam - 1) * j ELSE -1e308 END, -abs(lam - 1), lam)))
  FROM t{round_} GROUP BY business_id, name)"""


def _power_sql() -> str:
    steps = [max(abs(v - w) for w in sg.LAMBDAS[max(i - 1, 0):i + 2]) for i, v in enumerate(sg.LAMBDAS)]
    first = "(VALUES " + ", ".join(f"({v}::DOUBLE, {s}::DOUBLE)" for v, s in zip(sg.LAMBDAS, steps)) + ") g(lam, step) ON true"
    nearer = ("(SELECT business_id AS bb, name AS bn, lam + step * (i / 20) AS lam, step / 20 AS step FROM b{0}, "
              "range(-20, 21) r(i)) g ON bb = business_id AND bn = name")
    sql = _IMPUTED + """,
u AS MATERIALIZED (SELECT *, sum(sign(x) * ln(1 + abs(x))) OVER w AS j, bool_or(x < 0) OVER w AS signs FROM (
  SELECT business_id, 'absolute_margin_log' AS name, sign(absolute_margin) * ln(1 + abs(absolute_margin)) AS x FROM imputed
  UNION ALL SELECT business_id, 'quantity_log', ln(1 + quantity) FROM imputed
  UNION ALL SELECT business_id, 'profit_margin', profit_margin FROM imputed
  UNION ALL SELECT business_id, 'stock_turnover', stock_turnover FROM imputed)
  WINDOW w AS (PARTITION BY business_id, name))"""
    for i in range(sg.ROUNDS + 1):
        sql += _likelihood_sql(i, first if i == 0 else nearer.format(i - 1))
    return sql + f"""
SELECT business_id, name, round(lam, 7) AS lam, round(ln(1 + abs(m)), 6) AS log_mean,
  round(ln(CASE WHEN v > 1e-20 * m * m THEN sqrt(v) ELSE 1.0 END), 6) AS log_std FROM b{sg.ROUNDS}"""


_ACTIVITY = f"""WITH runs AS (
  SELECT n_nationkey AS b,
    CASE WHEN n_nationkey > 3 THEN TIMESTAMP '{NOW}' - to_hours(12 * n_nationkey) END AS last_run
  FROM nation),
prods AS (
  SELECT s AS b, count(*) AS products,
    count(*) FILTER (c_custkey % (c_nationkey * 20 + 1) = 0 AND TIMESTAMP '{NOW}' > last_run) AS changes
  FROM (SELECT *, c_nationkey - (c_nationkey % 8 = 1 AND c_custkey % 100 <> 0)::INT AS s FROM customer)
  LEFT JOIN runs ON b = s GROUP BY 1),
sales AS (
  SELECT c_nationkey AS b, count(*) FILTER (CASE WHEN c_nationkey % 5 = 2
    THEN o_orderdate + INTERVAL 4 YEAR ELSE o_orderdate END > last_run) AS items
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  LEFT JOIN runs ON b = c_nationkey GROUP BY 1),
a AS (
  SELECT n_nationkey AS b, coalesce(products, 0) AS products, coalesce(changes, 0) AS changes,
    coalesce(items, 0) AS items, last_run,
    cast(floor(epoch(TIMESTAMP '{NOW}' - last_run) / 86400) AS BIGINT) AS days
  FROM nation LEFT JOIN prods p ON p.b = n_nationkey LEFT JOIN sales s ON s.b = n_nationkey
  LEFT JOIN runs r ON r.b = n_nationkey)"""

_FEW = "'Only ' || products || ' products — need at least 15.'"

_EVENTS = """WITH ev AS (
  SELECT 'run' || (event_id // 8) AS id, event_id, ts,
    CASE WHEN event_id % 8 = 0 THEN cast((event_id // 8) % 40 AS VARCHAR) END AS business_id,
    CASE WHEN event_id % 8 = 0 THEN 'product_segmentation' END AS type,
    CASE WHEN event_id % 8 = 0 THEN 'upload' END AS triggered_by,
    CASE event_id % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'running'
      WHEN 4 THEN CASE WHEN event_id % 5 = 0 THEN 'done' END
      WHEN 5 THEN CASE WHEN event_id % 5 = 0 THEN 'failed' END
      WHEN 6 THEN CASE WHEN event_id % 5 = 0 THEN 'skipped' END END AS status,
    CASE WHEN event_type <> 'error' THEN cast(user_id % 100 AS INT) END AS progress,
    CASE WHEN event_type = 'click' THEN props END AS detail,
    CASE WHEN event_type = 'error' THEN props END AS error FROM events),
states AS (
  SELECT id, """ + ", ".join(
    f"arg_max({c}, (ts, event_id)) FILTER ({c} IS NOT NULL) AS {c}"
    for c in ("business_id", "type", "triggered_by", "status", "progress", "detail", "error")) + """,
    min(ts) FILTER (status = 'queued') AS created_at,
    max(ts) FILTER (status = 'running') AS started_at,
    max(ts) FILTER (status IN ('done', 'failed', 'skipped')) AS finished_at FROM ev GROUP BY id)"""

ORACLES = {
    "product_facts": _facts_sql() + """
SELECT business_id, product_id, price, cost, stock, quantity, revenue, profit,
  round(profit_margin, 6) AS profit_margin FROM facts""",
    "facts_without_cancelled": _facts_sql(keep="o_orderstatus <> 'F'") + """
SELECT product_id, quantity, revenue, profit FROM facts""",
    "segment_gate": _facts_sql("cast(floor(sqrt(p_partkey)) AS INT)") + """,
g AS (SELECT business_id, count(*) AS products, count(*) FILTER (cost >= 0) AS usable
  FROM facts GROUP BY 1)
SELECT *, CASE WHEN products < 15 THEN 'Need at least 15 products for segmentation, got ' || products
  WHEN usable < 15 THEN 'After cleaning, only ' || usable || ' products remain (need 15).' END
  AS skip_reason FROM g""",
    "product_features": _IMPUTED + """
SELECT business_id, product_id, round(profit_margin, 6) AS profit_margin,
  round(absolute_margin, 6) AS absolute_margin, round(stock_turnover, 6) AS stock_turnover,
  round(quantity, 6) AS quantity FROM imputed""",
    "impute_scale": _IMPUTED + f""",
logged AS (SELECT business_id, product_id, profit_margin, stock_turnover,
  sign(absolute_margin) * ln(1 + abs(absolute_margin)) AS absolute_margin_log,
  ln(1 + quantity) AS quantity_log FROM imputed)
SELECT business_id, product_id, {_robust("absolute_margin_log")}, {_robust("quantity_log", True)},
  {_robust("profit_margin")}, {_robust("stock_turnover")}
FROM logged WINDOW b AS (PARTITION BY business_id)""",
    "yeo_johnson": _power_sql(),
    "cluster_summary": _CLUSTERED + """,
s AS (SELECT business_id, cluster, cluster_name, count(*) AS num_products,
  round_even(round(avg(profit), 8), 2) AS avg_profit, round_even(round(sum(profit), 8), 2) AS total_profit,
  round_even(round(avg(revenue), 8), 2) AS avg_revenue, round_even(round(sum(revenue), 8), 2) AS total_revenue,
  round_even(round(avg(price), 8), 2) AS avg_price, round_even(round(avg(cost), 8), 2) AS avg_cost,
  round_even(round(avg(profit_margin), 8), 2) AS avg_margin, round_even(round(avg(stock), 8), 2) AS avg_stock,
  round_even(round(avg(quantity), 8), 2) AS avg_quantity FROM c GROUP BY ALL)
SELECT *, round_even(round(total_revenue / coalesce(nullif(round(sum(total_revenue) OVER b, 2), 0), 1) * 100, 8), 2)
    AS revenue_share_pct,
  round_even(round(total_profit / coalesce(nullif(round(sum(total_profit) OVER b, 2), 0), 1) * 100, 8), 2)
    AS profit_share_pct
FROM s WINDOW b AS (PARTITION BY business_id)""",
    "cluster_top_bottom": _CLUSTERED + """,
r AS (SELECT *, row_number() OVER (PARTITION BY business_id, cluster ORDER BY profit DESC, product_id) AS t,
  row_number() OVER (PARTITION BY business_id, cluster ORDER BY profit_margin, product_id) AS b FROM c)
SELECT business_id, cluster, string_agg(product_id, ',' ORDER BY t) FILTER (t <= 5) AS top,
  string_agg(product_id, ',' ORDER BY b) FILTER (b <= 5) AS bottom FROM r GROUP BY ALL""",
    "name_clusters": _CLUSTERED + """,
m AS (SELECT business_id, cluster, round(avg(profit_margin), 4) AS m, round(avg(price - cost), 4) AS a,
  round(avg(quantity / stock), 4) AS t FROM c GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY business_id) AS k,
  floor(rank() OVER (PARTITION BY business_id ORDER BY m)
    + (count(*) OVER (PARTITION BY business_id, m) - 1) / 2) AS rm,
  floor(rank() OVER (PARTITION BY business_id ORDER BY a)
    + (count(*) OVER (PARTITION BY business_id, a) - 1) / 2) AS ra,
  floor(rank() OVER (PARTITION BY business_id ORDER BY t)
    + (count(*) OVER (PARTITION BY business_id, t) - 1) / 2) AS rt FROM m),
n AS (SELECT business_id, cluster, CASE
  WHEN rm >= k * 0.6 AND ra >= k * 0.6 AND rt >= k * 0.6 THEN 'Premium Stars'
  WHEN rm >= k * 0.6 AND ra >= k * 0.6 THEN 'High Margin, Slow Movers'
  WHEN rt >= k * 0.6 AND rm <= k * 0.4 THEN 'Low Margin, High Velocity'
  WHEN rm <= k * 0.4 AND rt <= k * 0.4 THEN 'Underperformers'
  WHEN rt >= k * 0.6 THEN 'Fast Movers' ELSE 'Balanced Performance' END AS name FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY business_id, name ORDER BY cluster) AS i FROM n)
SELECT business_id, cluster, name || CASE WHEN i > 1 THEN ' (' || i || ')' ELSE '' END
  AS cluster_name FROM o""",
    "segment_replace": f"""
SELECT p_brand AS business_id,
  p_size % 4 + CASE WHEN p_brand LIKE '%1' THEN 10 ELSE 0 END AS cluster,
  count(*) AS rows, count(*) AS products,
  TIMESTAMP '{NOW}' + CASE WHEN p_brand LIKE '%1' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
    AS last_run FROM part GROUP BY ALL""",
    "segment_run": f"""
WITH p AS (SELECT *, {RUN_BUSINESS.format("VARCHAR")} AS b FROM part),
n AS (SELECT b, count(*) AS n, count(*) FILTER (p_partkey % 47 <> 5 OR p_partkey % 3 = 0) AS usable,
  CASE WHEN right(b, 1) IN ('1', '2', '3') THEN TIMESTAMP '{NOW}' - INTERVAL 2 DAY END AS earlier FROM p GROUP BY b),
s AS (SELECT 'Brand#' || (o_custkey % 25 + 1) AS b, count(*) FILTER (right('Brand#' || (o_custkey % 25 + 1), 1) = '2'
    OR o_orderdate > TIMESTAMP '{NOW}' - INTERVAL 2 DAY) AS items
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
r AS (SELECT n.*, CASE WHEN n < 15 THEN 'insufficient_products' WHEN earlier IS NULL THEN 'first_run'
    WHEN coalesce(items, 0) >= 50 THEN 'new_sales' WHEN right(b, 1) = '3' AND n >= 5 THEN 'product_changes'
    ELSE 'no_threshold_met' END AS reason FROM n LEFT JOIN s USING (b)),
d AS (SELECT *, reason NOT IN ('insufficient_products', 'no_threshold_met') AS should_run,
  should_run AND usable >= 15 AS fits, fits OR earlier IS NOT NULL AS has,
  CASE WHEN fits THEN usable WHEN has THEN n END AS kept FROM r)
SELECT b AS business_id, should_run, reason,
  CASE WHEN fits THEN 'second' WHEN has THEN 'first' END AS run_id,
  CASE WHEN fits THEN TIMESTAMP '{NOW}' ELSE earlier END AS last_run,
  kept AS rows, kept AS products,
  CASE WHEN has THEN 'done' WHEN should_run THEN 'skipped' END AS status,
  CASE WHEN should_run THEN 'schedule' WHEN has THEN 'upload' END AS triggered_by,
  CASE WHEN should_run AND NOT has THEN 'After cleaning, only ' || usable || ' products remain (need 15).' END AS skip_detail,
  kept AS total_rows, CASE WHEN has THEN true END AS consistent FROM d""",
    "refresh_decisions": _ACTIVITY + f"""
SELECT cast(b AS VARCHAR) AS business_id,
  products >= 15 AND (last_run IS NULL OR days > 7 OR items >= 50 OR changes >= 5) AS should_run,
  CASE WHEN products < 15 THEN 'insufficient_products' WHEN last_run IS NULL THEN 'first_run'
    WHEN days > 7 THEN 'scheduled_refresh' WHEN items >= 50 THEN 'new_sales'
    WHEN changes >= 5 THEN 'product_changes' ELSE 'no_threshold_met' END AS reason,
  CASE WHEN products < 15 THEN {_FEW}
    WHEN last_run IS NULL THEN 'No prior segmentation — running for the first time.'
    WHEN days > 7 THEN days || ' days since last run — running scheduled refresh.'
    WHEN items >= 50 THEN items || ' new sales since last run.'
    WHEN changes >= 5 THEN changes || ' products added or edited since last run.'
    ELSE items || ' new sales, ' || changes || ' product changes — below thresholds.' END AS detail
FROM a""",
    "refresh_forced": _ACTIVITY + f"""
SELECT cast(b AS VARCHAR) AS business_id, products >= 15 AS should_run,
  CASE WHEN products < 15 THEN 'insufficient_products' ELSE 'forced' END AS reason,
  CASE WHEN products < 15 THEN {_FEW} ELSE 'Manual refresh requested.' END AS detail FROM a""",
    "run_history": _EVENTS + " SELECT * FROM states",
    "run_history_active": _EVENTS + """
SELECT business_id, id, type, status, progress, detail, started_at, created_at FROM states
WHERE status IN ('queued', 'running')""",
    "run_history_one": _EVENTS + """
SELECT id, business_id, status, progress, detail, error, finished_at FROM states WHERE id = 'run7'""",
}
