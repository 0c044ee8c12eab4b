"""Queries about unknown files: uploads, headers, column profiles and the mapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import text as tx
from tallybook.operators import matching as mt
from tallybook.operators import profiling as pf
from tallybook.operators.fills import forward_fill, upload_block
from tallybook.plans import mapping_sql as sql
from tallybook.plans.extract import LINE_BITS, RAW_COLUMNS, extract, oracle_extract, table
from tallybook.registry import REQUIRED_FIELDS
from tallybook.session import cut, fresh_path
from tallybook.sources import uploads as up

PROFILED = RAW_COLUMNS
STAMP = 1_700_000_000_000


# Uploaded files: the export as CSV under {business}/{timestamp}-{name}, with two title rows.

def write_uploads(spark: SparkSession, sf_dir: str, description: str | None = None) -> str:
    """CSV files, several parts per upload in file order, in the shared folder. `description` is SQL
    for what stands between the quotes of a description."""
    root = fresh_path(spark, "uploads")
    raw = extract(spark, sf_dir)
    if description is not None:
        raw = raw.withColumn("Description", F.expr(description))
    quoted = [F.concat(F.lit('"'), F.col(c), F.lit('"')) if c == "Description" else F.col(c)
              for c in RAW_COLUMNS]
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in quoted])
    key = raw.schema["_ord"].dataType
    body = raw.select("dataset_id", F.lit(3).alias("part"), "_ord", line.alias("value"))
    titles = raw.select("dataset_id").distinct().select("dataset_id", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("Sales report").alias("value")),
        F.struct(F.lit(1).alias("part"), F.lit("exported,2024").alias("value")),
        F.struct(F.lit(2).alias("part"), F.lit(",".join(RAW_COLUMNS)).alias("value")),
    )).alias("t")).select("dataset_id", "t.part", F.lit(None).cast(key).alias("_ord"), "t.value")
    lines = body.unionByName(titles).withColumn(
        "upload", F.concat(F.lit(f"{STAMP}-"), "dataset_id", F.lit("-sales.csv")))
    order = ["dataset_id", "upload", "part", "_ord"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order) \
        .select(F.col("dataset_id").alias("business"), "upload", "value") \
        .write.partitionBy("business", "upload").text(root)
    return root


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.read_cells(spark, write_uploads(spark, sf_dir))


def upload_head(spark, sf_dir):
    rows = up.head(_cells(spark, sf_dir))
    return rows.select("business_id", "filename", F.col("_row").cast("long").alias("row"),
                       F.array_join(F.array_compact("cells"), "|").alias("cells"))


def upload_counts(spark, sf_dir):
    return up.row_counts(_cells(spark, sf_dir)).drop("dataset_id")


def upload_lines(spark, sf_dir):
    """Files read back, header found, typed by column name."""
    cells = cut(_cells(spark, sf_dir))
    rows = up.data_rows(cells, up.detect_header(up.head(cells)))
    lines = up.raw_lines(rows, RAW_COLUMNS)
    return lines.groupBy("dataset_id", "InvoiceNo").agg(
        F.count(F.lit(1)).alias("rows"), F.count("StockCode").alias("codes"),
        F.count("Description").alias("descriptions"), F.max("UnitPrice").alias("top_price"),
        F.min("InvoiceDate").alias("date"))


# Every third line's description runs over several lines, with commas and quotes in it.
_LONG_TEXT = f"""CASE WHEN shiftright(_ord, {LINE_BITS}) % 3 = 0
  THEN concat(trim(Description), ', ""new""\\n\\n', Channel, '\\n,end') ELSE Description END"""


def upload_quoted(spark, sf_dir):
    """Files whose cells hold line breaks, commas and quotes, read back in byte ranges."""
    cells = cut(up.read_cells(spark, write_uploads(spark, sf_dir, _LONG_TEXT)))
    rows = up.data_rows(cells, up.detect_header(up.head(cells)))
    lines = up.raw_lines(rows, RAW_COLUMNS)
    return lines.groupBy("dataset_id", "InvoiceNo").agg(
        F.count(F.lit(1)).alias("rows"), F.max("Description").alias("description"),
        F.sum(F.length("Description")).alias("letters"), F.min("Channel").alias("channel"))


def upload_fill(spark, sf_dir):
    """Uploads filled downwards as sheets with merged cells, range by range of each file."""
    cells = cut(_cells(spark, sf_dir))
    rows = up.data_rows(cells, up.detect_header(up.head(cells)))
    lines = forward_fill(up.raw_lines(rows, RAW_COLUMNS), ["InvoiceNo", "StockCode", "Stock", "Region"], "_ord",
                         ["dataset_id"], upload_block())
    return lines.groupBy("dataset_id", "InvoiceNo", "StockCode", "Stock", "Region").agg(F.count(F.lit(1)).alias("rows"))


def parse_uploads(spark, sf_dir):
    """Unknown files to mapping, coverage and warnings."""
    cells = cut(_cells(spark, sf_dir))
    headers = cut(up.detect_header(up.head(cells)))
    rows = up.data_rows(cells, headers)
    values = cut(up.long_cells(rows))
    columns = headers.select("dataset_id", F.posexplode("names").alias("pos", "column"))
    mapping = cut(mt.map_columns(columns, pf.signal_table(pf.profile(values)),
                                 pf.cooccurrence(values)))
    covered = mt.coverage(mapping)
    warnings = mt.parse_warnings(mapping, covered, headers)
    return mapping.join(pf.sample_values(values), pf.COLUMN, "left").join(covered, "dataset_id") \
        .join(warnings, "dataset_id") \
        .select("dataset_id", "column", "mapped_to", "confidence", "match_method", "human_label",
                "group", F.array_join("sample_values", "|").alias("sample_values"),
                "ml_coverage_pct", F.size("warnings").alias("warnings"))


# Header rows: every document is taken for a file, its lines for rows, commas for cell borders.

def header_detect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("dataset_id"),
        F.posexplode(F.split("text", "\n")).alias("_ord", "line"))
    cells = docs.withColumn("cells", F.transform(
        F.split("line", ","), lambda c: F.nullif(tx.strip(c), F.lit(""))))
    cells = cells.filter(tx.strip(F.col("line")) != "").select("dataset_id", "_ord", "cells")
    found = up.detect_header(up.head(cells))
    return found.select("dataset_id", "header_row", F.size("names").cast("long").alias("columns"))


def header_normalise(spark, sf_dir):
    """Whole texts and names as if they were column headers."""
    sources = [("documents", "text"), ("pages", "url"), ("part", "p_name"), ("nation", "n_name"),
               ("customer", "c_mktsegment"), ("orders", "o_orderpriority"),
               ("events", "event_type")]
    parts = [table(spark, sf_dir, t).select(
        F.lit(t).alias("dataset_id"), F.lit(0).alias("pos"), F.col(c).alias("column"))
        for t, c in sources]
    texts = parts[0]
    for p in parts[1:]:
        texts = texts.unionByName(p)
    known = mt.normalised_columns(texts)
    return known.groupBy("dataset_id", F.md5("norm").alias("norm"), "denied").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.length("norm")).cast("long").alias("length"))


def fuzzy_match(spark, sf_dir):
    """Every word of every document against the aliases."""
    words = table(spark, sf_dir, "documents").select(
        F.explode(F.split("text", r"\s+")).alias("word"))
    probes = words.select(tx.normalise_header(F.col("word")).alias("probe")) \
        .filter("probe <> ''").distinct()
    return mt.fuzzy_matches(probes)


# Profiles: a nation's sales are one file.

def _file_cells(spark, sf_dir, dataset: str = "nation") -> DataFrame:
    return pf.to_long(extract(spark, sf_dir, dataset), PROFILED)


def column_profile(spark, sf_dir):
    got = pf.profile(_file_cells(spark, sf_dir))
    return got.select(
        "dataset_id", "column", "n", "n_num", "mn", "mx", F.round("med", 6).alias("med"), "all_int",
        F.round("u", 6).alias("u"), F.round("uq", 6).alias("uq"),
        F.round("avg_len", 6).alias("avg_len"),
        *[F.round(c, 6).alias(c) for c in ("email", "phone", "date", "id", "sku")])


def pattern_profile(spark, sf_dir):
    got = pf.profile(_file_cells(spark, sf_dir))
    return got.select("dataset_id", "column", *[F.round(c, 6).alias(c) for c in (
        "status", "currency", "invoice", "person", "title", "address")])


def signal_scores(spark, sf_dir):
    got = pf.signal_table(pf.profile(_file_cells(spark, sf_dir)))
    return got.select("dataset_id", "column", "target", "signal", F.round("score", 4).alias("score"))


def column_mapping(spark, sf_dir):
    """The mapping of every customer-year file with its true headers."""
    cells = cut(_file_cells(spark, sf_dir, "customer_year"))
    columns = cells.select(*pf.COLUMN).distinct()
    return mt.map_columns(columns, pf.signal_table(pf.profile(cells)), pf.cooccurrence(cells)) \
        .select("dataset_id", "column", "mapped_to", "confidence", "match_method", "human_label",
                "group")


def mapping_warnings(spark, sf_dir):
    """What a person should know about the sales files of the parts, some with Arabic or conflicting headers."""
    cells = _file_cells(spark, sf_dir, "part").withColumn("column", F.expr(_RENAMED.replace('"column"', "`column`")))
    cells = cut(cells)
    columns = cells.filter("value IS NOT NULL").select(*pf.COLUMN).distinct()
    mapping = cut(mt.map_columns(columns, pf.signal_table(pf.profile(cells)), pf.cooccurrence(cells)))
    headers = columns.select("dataset_id").distinct().withColumn("header_row", F.expr(_SKIPPED))
    shown = F.struct("pos", F.concat("column", F.lit(">"), "mapped_to", F.lit(" "), "match_method").alias("text"))
    report = mapping.groupBy("dataset_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(shown)), lambda c: c["text"]), ",").alias("mapping"))  # one entry a column
    return mt.parse_warnings(mapping, mt.coverage(mapping), headers).join(report, "dataset_id") \
        .select("dataset_id", F.array_join("warnings", "\n").alias("warnings"), "mapping")


# Order dates in words and with points, which the usual shape misses; some can't be read, some are no dates at all.
_WORDED = """CASE WHEN o_orderkey % 10 = 0 THEN '31 Feb 2001' WHEN o_custkey % 4 = 3 AND o_orderkey % 3 = 0 THEN 'later'
  WHEN o_custkey % 4 = 0 THEN {short} WHEN o_custkey % 4 = 1 THEN {long} ELSE {points} END"""


def worded_dates(spark, sf_dir):
    """Date columns that only a full reading finds: each customer's order dates are a file's column."""
    worded = _WORDED.format(short="date_format(o_orderdate, 'd MMM yyyy')", long="date_format(o_orderdate, 'MMMM d, yyyy')",
                            points="date_format(o_orderdate, 'd.M.yyyy')")
    cells = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("dataset_id"), F.lit(0).alias("pos"), F.lit("When").alias("column"),
        F.col("o_orderkey").alias("_ord"), F.expr(worded).alias("value"))
    found = cut(pf.profile(cells))
    scores = pf.signal_table(found).filter(F.col("target") == "order_date")
    return found.join(scores, pf.COLUMN, "left").select(
        "dataset_id", "n", F.round("date", 6).alias("date"), F.round("date_read", 6).alias("date_read"), "score")


def transliterate(spark, sf_dir):
    """Names written in Arabic letters, as if they were column headers, and the texts that they are compared by."""
    sources = [("part", "p_name"), ("customer", "c_name"), ("nation", "n_name"), ("events", "event_type")]
    parts = [table(spark, sf_dir, t).select(
        F.lit(t).alias("dataset_id"), F.translate(F.lower(c), *_ARABIC).alias("column")) for t, c in sources]
    known = mt.normalised_columns(reduce(DataFrame.unionByName, parts))
    return known.groupBy("dataset_id", "column", "arabic", "norm", "probe").agg(F.count(F.lit(1)).alias("rows"))


def cooccurrence(spark, sf_dir):
    """Price x quantity = amount, looked for in the sales of each part."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("dataset_id"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
                 "l_discount").alias("_ord"),
        F.col("l_quantity").alias("a"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("b"),
        F.col("l_extendedprice").alias("c"), F.col("l_discount").alias("d"))
    got = pf.cooccurrence(pf.to_long(lines, ["a", "b", "c", "d"]))
    return got.select("dataset_id", F.col("pos").cast("long").alias("pos"), "target", "bonus")


def sample_sizes(spark, sf_dir):
    return pf.sample_sizes(extract(spark, sf_dir, "part").unionByName(extract(spark, sf_dir)))


def sample_values(spark, sf_dir):
    got = pf.sample_values(pf.to_long(extract(spark, sf_dir), ["Description", "Status", "Channel"]))
    return got.select("dataset_id", "column", F.array_join("sample_values", "|").alias("values"))


# Matching on given scores: orders stand in for columns, customers for files.

TARGETS = list(REQUIRED_FIELDS.values())


def _claims(spark, sf_dir) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(t) for t in TARGETS]),
                        (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("dataset_id"), F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("col"), F.col("o_orderkey").cast("string")).alias("column"),
        mt.combined_score(
            F.when(F.col("o_orderstatus") == "F", 100.0), F.col("o_orderkey") % 80,
            F.when(F.col("o_orderkey") % 3 == 0, 75.0), F.when(F.col("o_orderkey") % 7 == 0, 40.0),
        ).alias("combined"),
        F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.0).alias("name_score"),
        F.when(F.col("o_orderstatus") == "P", F.lit(mt.UNMAPPED)).otherwise(pick).alias("target"),
        F.lit("data_signal").alias("method"), pick.alias("label"), F.lit("Order").alias("grp"),
        F.lit(None).cast("string").alias("meta_label"), F.lit(False).alias("arabic"))


def conflicts(spark, sf_dir):
    got = mt.resolve_conflicts(_claims(spark, sf_dir))
    return got.select("dataset_id", "column", "mapped_to", "confidence", "human_label", "lost")


def coverage(spark, sf_dir):
    got = mt.coverage(mt.resolve_conflicts(_claims(spark, sf_dir)))
    return got.select(
        "dataset_id", F.array_join("ml_missing", ",").alias("missing"),
        F.array_join(F.transform("derivable_fields", lambda d: F.concat(
            d["field"], F.lit("<"), F.array_join(d["source_columns"], "+"))), ",").alias("derived"),
        F.array_join("truly_missing", ",").alias("absent"), "ml_coverage_pct")


def forward_fills(spark, sf_dir):
    """Event values kept only now and then, as in a sheet with merged cells."""
    events = table(spark, sf_dir, "events")
    sheet = events.select(
        "event_type", "event_id",
        F.when(F.col("event_id") % 7 == 0, F.col("value")).alias("value"),
        F.when(F.col("user_id") % 5 == 0, F.col("props")).alias("props"))
    return forward_fill(sheet, ["value", "props"], "event_id", ["event_type"],
                        block=F.floor(F.col("event_id") / 1000))


QUERIES = {
    "upload_head": upload_head, "upload_counts": upload_counts, "upload_lines": upload_lines,
    "upload_quoted": upload_quoted, "upload_fill": upload_fill,
    "parse_uploads": parse_uploads, "header_detect": header_detect,
    "header_normalise": header_normalise, "fuzzy_match": fuzzy_match,
    "column_profile": column_profile, "pattern_profile": pattern_profile,
    "signal_scores": signal_scores, "column_mapping": column_mapping,
    "mapping_warnings": mapping_warnings, "transliterate": transliterate,
    "worded_dates": worded_dates,
    "cooccurrence": cooccurrence, "sample_sizes": sample_sizes, "sample_values": sample_values,
    "conflicts": conflicts, "coverage": coverage, "forward_fill": forward_fills,
}

_CSV = f"""WITH export AS MATERIALIZED ({oracle_extract()}),
files AS MATERIALIZED (
  SELECT dataset_id, l.* FROM (SELECT DISTINCT dataset_id FROM export),
    (VALUES (0, 'Sales report'), (1, 'exported|2024'), (2, '{"|".join(RAW_COLUMNS)}')) l(row, cells)
  UNION ALL
  SELECT dataset_id, rn + 2, concat_ws('|', {", ".join(
        f"CASE WHEN trim({c}) = '' AND {c} = '' OR {c} IN ('nan', 'None', 'N/A', 'n/a') THEN NULL ELSE {c} END"
        for c in RAW_COLUMNS)})
  FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS rn
    FROM export))"""

_WORDS = ", ".join(f"'{w}'" for w in pf.STATUS_VOCABULARY)

def _file_oracle(dataset: str = "nation") -> str:
    """`export`, and its cells with their places."""
    return f"""export AS MATERIALIZED ({oracle_extract(dataset)}),
file_cells AS (SELECT dataset_id, ord, list_position({PROFILED}, "column") - 1 AS pos, "column", raw FROM (
  UNPIVOT (SELECT dataset_id, ord, {", ".join(PROFILED)} FROM export)
  ON {", ".join(PROFILED)} INTO NAME "column" VALUE raw))"""


# Figures of every column of `file_cells`.
_PROF = f"""known AS MATERIALIZED (
  SELECT dataset_id, ord, pos, "column", trim(raw) AS v,
    CASE WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
      THEN cast(trim(raw) AS DOUBLE) END AS num FROM file_cells),
prof AS MATERIALIZED (
  SELECT dataset_id, "column", count(*) AS n, count(num) AS n_num, min(num) AS mn, max(num) AS mx,
    quantile_cont(num, 0.5) AS med, coalesce(bool_and(num = round(num)), false) AS all_int,
    count(DISTINCT num) / count(*) AS u, count(DISTINCT v) / count(*) AS uq,
    avg(length(v)) AS avg_len,
    avg(regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')::INT) AS email,
    avg((regexp_matches(v, '^[+\\p{{Nd}}][\\p{{Nd}}\\s\\-().]{{6,18}}$') AND regexp_matches(v, '[+\\-\\s()]'))::INT) AS phone,
    avg(regexp_matches(v, '^([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}|[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{2,4}})')::INT) AS date,
    avg(regexp_matches(v, '(?i)^[A-Z]{{0,4}}[\\-_]?\\p{{Nd}}{{3,12}}$|^[A-Z]{{1,4}}\\p{{Nd}}{{2,8}}$')::INT) AS id,
    avg(regexp_matches(v, '(?i)^[A-Z0-9]{{3,6}}[\\-_]?[A-Z0-9]{{0,6}}$')::INT) AS sku,
    avg((lower(v) IN ({_WORDS}))::INT) AS status,
    avg(regexp_matches(v, '(?i)[£$€¥₹﷼]|\\bEGP\\s*[0-9]|[0-9]\\s*EGP\\b')::INT) AS currency,
    avg(regexp_matches(v, '(?i)^(C?\\p{{Nd}}{{4,8}}|INV|ORD|REC|TXN)[\\-_]?\\p{{Nd}}*$')::INT) AS invoice,
    avg(regexp_matches(v, '^[A-Z][a-z]+(\\s[A-Z][a-z]+)+$')::INT) AS person,
    avg(regexp_matches(v, '^[A-Z][A-Za-z\\s\\-]{{3,60}}$')::INT) AS title,
    avg(regexp_matches(v, '(?i)[0-9]+.{{3,}}(st|street|rd|ave|blvd|road|شارع)')::INT) AS address
  FROM known GROUP BY ALL)"""

_SMALL = f"WITH {_file_oracle()},\n{_PROF}"

_GIVEN = ", ".join(f"'{t}'" for t in TARGETS)

_CLAIMS = f"""WITH claims AS (
  SELECT cast(o_custkey AS VARCHAR) AS dataset_id, o_orderkey AS pos,
    'col' || o_orderkey AS "column", o_orderstatus = 'F' AS exact,
    round_even((o_orderstatus = 'F')::INT * 100 * 0.40::DOUBLE + (o_orderkey % 80) * 0.30::DOUBLE
      + (o_orderkey % 3 = 0)::INT * 75 * 0.20::DOUBLE
      + (o_orderkey % 7 = 0)::INT * 100 * 0.10::DOUBLE, 1) AS combined,
    [{_GIVEN}][o_orderkey % 10 + 1] AS label,
    CASE WHEN o_orderstatus = 'P' THEN '__unmapped__' ELSE [{_GIVEN}][o_orderkey % 10 + 1] END AS target
  FROM orders),
ranked AS MATERIALIZED (
  SELECT *, target <> '__unmapped__' AS claimed,
    row_number() OVER (PARTITION BY dataset_id, target ORDER BY combined DESC, pos) AS rk FROM claims),
resolved AS MATERIALIZED (
  SELECT dataset_id, "column",
    CASE WHEN claimed AND rk = 1 THEN target ELSE '__unmapped__' END AS mapped_to,
    CASE WHEN claimed AND rk = 1 AND exact THEN 100.0 WHEN claimed THEN combined ELSE 0.0 END::DOUBLE AS confidence,
    CASE WHEN claimed AND rk > 1 THEN "column" ELSE label END AS human_label,
    claimed AND rk > 1 AS lost FROM ranked)"""

def _signals() -> str:
    """Scores of the columns in `prof`, not rounded."""
    usual = "med BETWEEN 0.01 AND 10000"
    price = f"""CASE WHEN NOT all_int AND {usual}
      THEN greatest((CASE WHEN {usual} THEN 65 ELSE 0 END) + (CASE WHEN u > 0.3 THEN 10 ELSE 0 END), 80)
      ELSE (CASE WHEN {usual} THEN 65 ELSE 0 END) + (CASE WHEN u > 0.3 THEN 10 ELSE 0 END) END"""
    num = "n_num / n >= 0.85"
    nodate = "date <= 0.7"
    rules = [
        ("order_item.quantity", "type", f"{nodate} AND {num} AND all_int AND mn >= 0 AND mx <= 50000 AND med <= 200 AND u < 0.5", "80"),
        ("product.price", "type", f"{nodate} AND {num} AND mx > 0 AND mn >= 0 AND mx <= 1000000 AND ({price}) > 0", price),
        ("revenue", "type", f"{nodate} AND {num} AND med > 1 AND (mx > 100 OR (mx > 10 AND mx / greatest(med, 0.01) > 2))",
         "CASE WHEN mx > 10 AND mx / greatest(med, 0.01) > 2 THEN 75 ELSE 65 END"),
        ("profit_margin", "type", f"{nodate} AND {num} AND mn >= 0 AND mx <= 100 AND med BETWEEN 5 AND 80", "60"),
        ("profit", "type", f"{nodate} AND {num} AND mn >= 0 AND mx < 100000", "55"),
        ("product.stock", "type", f"{nodate} AND {num} AND all_int AND mn >= 0", "60"),
        ("customer.email", "type", f"{nodate} AND email > 0.7", "least(100, 70 + 30 * email)"),
        ("customer.phoneNumber", "type", f"{nodate} AND phone > 0.6", "least(100, 60 + 40 * phone)"),
        ("order_date", "type", "date > 0.7", "least(100, 70 + 30 * date)"),
        ("order_id", "type", f"(id > 0.5 AND uq > 0.3) OR ({nodate} AND {num} AND all_int AND u > 0.7 AND mn > 0)",
         "CASE WHEN id > 0.5 AND uq > 0.3 THEN 72 ELSE 68 END"),
        ("customer_id", "type",
         f"(id > 0.5 AND uq > 0.3) OR (uq > 0.8 AND avg_len < 40) OR ({nodate} AND {num} AND all_int AND u > 0.7 AND mn > 0)",
         f"CASE WHEN (id > 0.5 AND uq > 0.3) OR ({nodate} AND {num} AND all_int AND u > 0.7 AND mn > 0) THEN 70 ELSE 58 END"),
        ("product_id", "type", "sku > 0.5 AND uq > 0.2", "75"),
        ("customer.fullName", "type", "uq > 0.8 AND avg_len < 40", "60"),
        ("product.name", "type", "uq > 0.3 AND avg_len > 5 AND avg_len < 80", "65"),
        ("product.description", "type", "uq > 0.3 AND avg_len > 5 AND avg_len < 80", "55"),
        ("order.status", "pattern", "status > 0.5", "least(100, 70 + 30 * status)"),
        ("product.price", "pattern", "currency > 0.3", "72"),
        ("revenue", "pattern", "currency > 0.3", "68"),
        ("order_id", "pattern", "invoice > 0.4", "80"),
        ("customer.fullName", "pattern", "person > 0.5", "78"),
        ("product.name", "pattern", "title > 0.4", "72"),
        ("order.address", "pattern", "address > 0.3", "80"),
    ]
    return "\nUNION ALL\n".join(
        f"""SELECT dataset_id, "column", '{t}' AS target, '{s}' AS signal,
  cast({score} AS DOUBLE) AS score FROM prof WHERE {test}""" for t, s, test, score in rules)


_NORM = sql.norm("t")

# Headers that depend on the file, shared by query and oracle: Arabic ones, and names that claim a taken target.
_RENAMED = """CASE WHEN cast(substr(dataset_id, 2) AS int) % 2 = 0 AND "column" = 'Channel' THEN 'Order State'
  WHEN cast(substr(dataset_id, 2) AS int) % 3 = 0 AND "column" = 'Status' THEN 'ستاتوس'
  WHEN cast(substr(dataset_id, 2) AS int) % 5 = 0 AND "column" = 'Quantity' THEN 'الكمية'
  WHEN cast(substr(dataset_id, 2) AS int) % 7 = 0 AND "column" = 'UnitCost' THEN 'Unit Prce'
  WHEN cast(substr(dataset_id, 2) AS int) % 11 = 0 AND "column" = 'Stock' THEN 'Qty' ELSE "column" END"""
_SKIPPED = "cast(substr(dataset_id, 2) AS int) % 3"
_ARABIC = ("abcdefghijklmnopqrstuvwxyz", "ابثدعفغحيجكلمنوشقرستؤآخءئذ")

# Columns of every file, also those without a value.
_ALL_COLUMNS = f"""SELECT DISTINCT dataset_id, pos, "column" FROM export,
  (SELECT unnest({PROFILED}) AS "column", unnest(range({len(PROFILED)})) AS pos)"""

# The files as uploads give them: missing-value words are no cells.
_UPLOADED = f"""{_file_oracle()},
uploaded AS (SELECT dataset_id || '/{STAMP}-' || dataset_id || '-sales.csv' AS dataset_id, ord, pos, "column", raw
  FROM file_cells WHERE raw NOT IN ('', 'nan', 'None', 'N/A', 'n/a'))"""

ORACLES = {
    "upload_head": _CSV + """
SELECT dataset_id AS business_id, dataset_id || '-sales.csv' AS filename, cast(row AS BIGINT) AS row,
  cells FROM files WHERE row < 15""",
    "upload_counts": _CSV + f"""
SELECT dataset_id AS business_id, dataset_id || '-sales.csv' AS filename,
  make_timestamp({STAMP} * 1000) AS uploaded_at, count(*) - 1 AS rows FROM files GROUP BY dataset_id""",
    "upload_lines": _CSV + f"""
SELECT dataset_id || '/{STAMP}-' || dataset_id || '-sales.csv' AS dataset_id, InvoiceNo,
  count(*) AS rows, count(nullif(StockCode, 'nan')) AS codes,
  count(nullif(Description, 'nan')) AS descriptions,
  max(nullif(UnitPrice, 'N/A')) AS top_price, min(InvoiceDate) AS date FROM export GROUP BY 1, 2""",
    "upload_quoted": _CSV + f"""
SELECT dataset_id || '/{STAMP}-' || dataset_id || '-sales.csv' AS dataset_id, InvoiceNo, count(*) AS rows,
  max(t) AS description, sum(length(t))::BIGINT AS letters, min(Channel) AS channel
FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0
    THEN trim(Description) || ', "new"' || chr(10) || chr(10) || Channel || chr(10) || ',end'
    ELSE nullif(Description, 'nan') END AS t FROM export) GROUP BY 1, 2""",
    "upload_fill": _CSV + f"""
SELECT *, count(*) AS rows FROM (SELECT dataset_id || '/{STAMP}-' || dataset_id || '-sales.csv' AS dataset_id, {", ".join(
        f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("InvoiceNo", "StockCode", "Stock", "Region"))}
FROM (SELECT dataset_id, ord, InvoiceNo, nullif(StockCode, 'nan') AS StockCode, nullif(Stock, 'n/a') AS Stock, Region
  FROM export) WINDOW w AS (PARTITION BY dataset_id ORDER BY ord)) GROUP BY ALL""",
    "header_detect": r"""WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
rows AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS row,
    list_transform(string_split(line, ','), lambda x: nullif(regexp_replace(x, '^\s+|\s+$', '', 'g'), '')) AS cells
  FROM lines WHERE regexp_replace(line, '\s+', '', 'g') <> ''),
scored AS (
  SELECT *, len(list_filter(cells, lambda x: x IS NOT NULL)) AS filled,
    len(list_filter(cells, lambda x: x IS NOT NULL AND regexp_full_match(x,
      '[a-zA-Z\x{0600}-\x{06FF}][a-zA-Z0-9 _\-\x{0600}-\x{06FF}]{1,39}'))) AS named
  FROM rows WHERE row < 10),
ranked AS (
  SELECT *, filled * 0.5 + named * 2 - CASE WHEN filled < 0.5 * max(filled) OVER (PARTITION BY doc_id)
    THEN 5 ELSE 0 END AS score FROM scored)
SELECT cast(doc_id AS VARCHAR) AS dataset_id, row AS header_row,
  (SELECT max(k) FROM (SELECT unnest(list_transform(cells, lambda x, k: CASE WHEN x IS NOT NULL THEN k ELSE 0 END)) AS k)) AS columns
FROM ranked QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row) = 1""",
    "header_normalise": f"""WITH texts AS (
  SELECT 'documents' AS d, text AS t FROM documents UNION ALL SELECT 'pages', url FROM pages
  UNION ALL SELECT 'part', p_name FROM part UNION ALL SELECT 'nation', n_name FROM nation
  UNION ALL SELECT 'customer', c_mktsegment FROM customer
  UNION ALL SELECT 'orders', o_orderpriority FROM orders
  UNION ALL SELECT 'events', event_type FROM events)
SELECT d AS dataset_id, md5({_NORM}) AS norm, {_NORM} IN ({sql.DENIED}) AS denied,
  count(*) AS rows, max(length({_NORM})) AS length FROM texts GROUP BY 1, 2, 3""",
    "column_profile": _SMALL + """
SELECT dataset_id, "column", n, n_num, mn, mx, round(med, 6) AS med, all_int, round(u, 6) AS u, round(uq, 6) AS uq,
  round(avg_len, 6) AS avg_len, round(email, 6) AS email, round(phone, 6) AS phone,
  round(date, 6) AS date, round(id, 6) AS id, round(sku, 6) AS sku FROM prof""",
    "pattern_profile": _SMALL + """
SELECT dataset_id, "column", round(status, 6) AS status, round(currency, 6) AS currency,
  round(invoice, 6) AS invoice, round(person, 6) AS person, round(title, 6) AS title,
  round(address, 6) AS address FROM prof""",
    "signal_scores": f"""{_SMALL},
signals AS ({_signals()})
SELECT dataset_id, "column", target, signal, round(score, 4) AS score FROM signals""",
    "fuzzy_match": f"""WITH RECURSIVE {sql.ALIASES},
words AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS t FROM documents),
probes AS MATERIALIZED (SELECT DISTINCT {_NORM} AS probe FROM words),
{sql.FUZZY}
SELECT * FROM fuzzy""",
    "worded_dates": "WITH w AS (SELECT o_custkey, " + _WORDED.format(
        short="strftime(o_orderdate, '%-d %b %Y')", long="strftime(o_orderdate, '%B %-d, %Y')",
        points="strftime(o_orderdate, '%-d.%-m.%Y')") + """ AS v FROM orders),
s AS (SELECT cast(o_custkey AS VARCHAR) AS dataset_id, count(*) AS n,
  avg((v NOT IN ('later', '31 Feb 2001'))::INT) AS date_read FROM w GROUP BY 1)
SELECT dataset_id, n, 0.0::DOUBLE AS date, round(date_read, 6) AS date_read,
  CASE WHEN date_read > 0.7 THEN 75.0 END::DOUBLE AS score FROM s""",
    "transliterate": f"""WITH texts AS (
  SELECT 'part' AS d, p_name AS t FROM part UNION ALL SELECT 'customer', c_name FROM customer
  UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'events', event_type FROM events),
w AS (SELECT d, translate(lower(t), '{_ARABIC[0]}', '{_ARABIC[1]}') AS t FROM texts)
SELECT d AS dataset_id, t AS "column", {sql.arabic("t")} AS arabic, {_NORM} AS norm, {sql.probe("t")} AS probe,
  count(*) AS rows FROM w GROUP BY ALL""",
    "column_mapping": f"""WITH RECURSIVE {_file_oracle("customer_year")},
{_PROF},
{sql.mapping_ctes(_signals(), _ALL_COLUMNS)}
SELECT dataset_id, "column", mapped_to, confidence, match_method, human_label, "group" FROM resolved""",
    "mapping_warnings": f"""WITH RECURSIVE {_file_oracle("part")},
{_PROF.replace("FROM file_cells", f'FROM (SELECT * REPLACE ({_RENAMED} AS "column") FROM file_cells)')},
{sql.mapping_ctes(_signals())},
{sql.coverage_ctes()},
{sql.warning_ctes(_SKIPPED)}
SELECT dataset_id, array_to_string(warnings, chr(10)) AS warnings,
  (SELECT string_agg("column" || '>' || mapped_to || ' ' || match_method, ',' ORDER BY pos) FROM resolved r
   WHERE r.dataset_id = w.dataset_id) AS mapping FROM warned w""",
    "parse_uploads": f"""WITH RECURSIVE {_UPLOADED},
{_PROF.replace("FROM file_cells", "FROM uploaded")},
{sql.mapping_ctes(_signals())},
{sql.coverage_ctes()},
{sql.warning_ctes("2")},
firsts AS (SELECT dataset_id, "column", v, min(ord) AS ord FROM known WHERE v <> '' GROUP BY ALL),
samples AS (SELECT dataset_id, "column", string_agg(v, '|' ORDER BY ord) AS sample_values FROM (
  SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY dataset_id, "column" ORDER BY ord) <= 3) GROUP BY ALL)
SELECT dataset_id, "column", mapped_to, confidence, match_method, human_label, "group", sample_values,
  ml_coverage_pct, len(warnings)::INT AS warnings
FROM resolved JOIN covered USING (dataset_id) JOIN warned USING (dataset_id)
LEFT JOIN samples USING (dataset_id, "column")""",
    "cooccurrence": """WITH lines AS MATERIALIZED (
  SELECT * FROM (
    SELECT l_partkey AS ds, l_quantity AS a, round(l_extendedprice / l_quantity, 2) AS b,
      l_extendedprice AS c, l_discount AS d,
      row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey,
        l_quantity, l_extendedprice, l_discount) AS rn FROM lineitem)),
cells AS MATERIALIZED (
  SELECT ds, rn, unnest([0, 1, 2, 3]) AS pos, unnest([a, b, c, d]) AS x FROM lines),
""" + sql.COOCCURRENCE + """
SELECT cast(ds AS VARCHAR) AS dataset_id, cast(pos AS BIGINT) AS pos, target,
  max(bonus)::DOUBLE AS bonus FROM gains GROUP BY ALL""",
    "sample_sizes": f"""WITH n AS (
  SELECT dataset_id, count(*) AS rows FROM ({oracle_extract("part")}) GROUP BY 1
  UNION ALL SELECT dataset_id, count(*) FROM ({oracle_extract()}) GROUP BY 1)
SELECT dataset_id, rows, CASE WHEN rows <= 50 THEN rows
  ELSE least(1000, greatest(50, cast(floor(rows * 0.1) AS BIGINT)), rows) END AS sample FROM n""",
    "sample_values": f"""WITH export AS MATERIALIZED ({oracle_extract()}),
cells AS (UNPIVOT (SELECT dataset_id, ord, Description, Status, Channel FROM export)
  ON Description, Status, Channel INTO NAME "column" VALUE raw),
firsts AS (SELECT dataset_id, "column", trim(raw) AS v, min(ord) AS ord FROM cells
  WHERE trim(raw) <> '' GROUP BY ALL),
three AS (SELECT * FROM firsts
  QUALIFY row_number() OVER (PARTITION BY dataset_id, "column" ORDER BY ord) <= 3)
SELECT dataset_id, "column", string_agg(v, '|' ORDER BY ord) AS values FROM three GROUP BY ALL""",
    "conflicts": _CLAIMS + """
SELECT dataset_id, "column", mapped_to, confidence, human_label, lost FROM resolved""",
    "coverage": f"""{_CLAIMS},
{sql.coverage_ctes()}
SELECT dataset_id, missing, derived, absent, ml_coverage_pct FROM covered""",
    "forward_fill": """
SELECT event_type, event_id,
  last_value(CASE WHEN event_id % 7 = 0 THEN value END IGNORE NULLS) OVER w AS value,
  last_value(CASE WHEN user_id % 5 = 0 THEN props END IGNORE NULLS) OVER w AS props
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}
