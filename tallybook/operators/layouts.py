"""Confirmed mappings as data: files of any number of layouts cleaned in one plan.

Two small tables say how each dataset is to be read. `mapping` has a row per column: `dataset_id`, `column`, `target`
(null or unmapped: none), `attribute` (null: none), `ignored`. `settings` has a row per dataset: `dataset_id`,
`header_row` (0-based, null: as detected), `cost_pct` (null: none), `decisions` (missing field to what was decided).

A dataset's layout is one row: where each target stands, and where its metadata and attribute columns stand. Joined to the
cell arrays it drives one projection to a fixed set of columns, in which targets that a file lacks are null. What the
single mapping decides by the presence of a column (`cleaning.first_present`) is decided per dataset here and handed
on in role columns (`_quantity`, `_customer_key`, ...), which the entity builders take where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import text as tx
from tallybook.operators import cleaning as cl
from tallybook.operators.entities import first_value
from tallybook.operators.lookup import lookup_join
from tallybook.registry import ATTRIBUTE_PREFIX, REQUIRED_FIELDS, UNMAPPED
from tallybook.sources import uploads as up

MAPPING_SCHEMA = "dataset_id string, column string, target string, attribute string, ignored boolean"
SETTINGS_SCHEMA = "dataset_id string, header_row long, cost_pct double, decisions map<string,string>"
# The texts of the warnings.
NEGATIVE = "Removed %s rows with negative quantities (usually returns or corrections)."
CANCELLED = "Skipped %s cancelled orders (order number started with 'C')."
NO_PRODUCT = "No product identifier found — products skipped."
NO_CUSTOMER = "No customer identifier found — customers skipped."
NO_ORDER = "No order ID column — orders skipped."
MISSING = "'%s' was not found in your data and will be left empty. You can add it later from the dashboard."
TWICE = "'%s' is mapped from more than one column; the first is used."


def headers(cells: DataFrame, settings: DataFrame) -> DataFrame:
    """`header_row`, `_header_ord`, `names` per dataset: the confirmed row, or else the detected one."""
    deepest = settings.agg(F.max("header_row").alias("n")).first()["n"]  # one number
    rows = up.first_rows(cells, max(up.HEAD_ROWS, (deepest or 0) + 1))
    detected = up.detect_header(rows.filter(F.col("_row") < up.HEAD_ROWS))
    confirmed = rows.join(settings.select("dataset_id", "header_row").distinct(), "dataset_id").filter(
        F.col("_row") == F.col("header_row")).select(
        "dataset_id", "header_row", F.col("_ord").alias("_header_ord"), up.column_names(F.col("cells")).alias("names"))
    return confirmed.unionByName(detected.join(confirmed, "dataset_id", "left_anti"))


def layouts(heads: DataFrame, mapping: DataFrame, settings: DataFrame) -> DataFrame:
    """One row per dataset: `where` (target to position), `notes` and `attributes` (name to position),
    `twice` (targets mapped more than once), `_header_ord`, `cost_pct`, `decisions`."""
    columns = heads.select("dataset_id", F.posexplode("names").alias("pos", "column"))
    asked = mapping.groupBy("dataset_id", "column").agg(
        F.first("target", True).alias("target"), F.first("attribute", True).alias("attribute"),
        F.max(F.coalesce("ignored", F.lit(False))).alias("ignored"))
    known = columns.join(asked, ["dataset_id", "column"], "left")
    ignored = F.coalesce("ignored", F.lit(False))
    real = F.when(~ignored & (F.col("target") != UNMAPPED) & ~F.col("target").startswith(ATTRIBUTE_PREFIX), F.col("target"))
    known = known.withColumns({"target": real, "ignored": ignored})
    # A column left unmapped but already named like a target still serves as that target.
    named = F.when(F.col("target").isNull() & ~F.col("ignored") & F.col("column").isin(*cl.KNOWN_TARGETS), F.col("column"))
    known = known.withColumn("named", named)
    spot = lambda name, when: F.sort_array(F.collect_list(
        F.when(when, F.struct("pos", F.col(name).alias("name")))))
    found = known.groupBy("dataset_id").agg(
        spot("target", F.col("target").isNotNull()).alias("targets"),
        spot("named", F.col("named").isNotNull()).alias("named"),
        spot("column", F.col("target").isNull() & ~F.col("ignored")).alias("notes"),
        spot("attribute", F.col("attribute").isNotNull() & F.col("target").isNull() & F.col("named").isNull())
        .alias("attributes"))
    taken = F.concat("targets", F.filter("named", lambda c: ~F.exists("targets", lambda t: t["name"] == c["name"])))
    firsts = lambda spots: F.map_from_entries(F.transform(
        F.filter(spots, lambda c, i: F.array_position(F.transform(spots, lambda t: t["name"]), c["name"]) == i + 1),
        lambda c: F.struct(c["name"], c["pos"])))
    found = found.withColumn("taken", taken)
    names = F.transform("targets", lambda c: c["name"])
    repeated = F.array_distinct(F.filter(names, lambda n, i: F.array_position(names, n) < i + 1))
    return heads.select("dataset_id", "_header_ord").join(found, "dataset_id").join(settings.drop("header_row"), "dataset_id", "left") \
        .select("dataset_id", "_header_ord", firsts(F.col("taken")).alias("where"), firsts(F.col("notes")).alias("notes"),
                firsts(F.col("attributes")).alias("attributes"), repeated.alias("twice"), "cost_pct", "decisions")


def has(target: str) -> Column:
    return F.try_element_at("where", F.lit(target)).isNotNull()


def _role(targets: tuple[str, ...], value) -> Column:
    """The value of the first of the targets that the dataset has, null or not."""
    out = F.lit(None)
    for t in reversed(targets):
        out = F.when(has(t), value(t)).otherwise(out)
    return out


def apply_layouts(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Rows below the header, every target as a text column; metadata in map `_notes`, attributes in
    map `_attributes`. The small layout columns stay for the roles."""
    rows = lookup_join(cells.select("dataset_id", "_ord", "cells"), known, ["dataset_id"], how="inner")
    rows = rows.filter(F.col("_ord") > F.col("_header_ord"))
    cell = lambda t: F.get("cells", F.try_element_at("where", F.lit(t)))
    texts = lambda spots: F.transform_values(spots, lambda _, pos: F.get("cells", pos))
    return rows.select(
        *cl.KEYS, *[cell(t).alias(cl.column_of(t)) for t in cl.KNOWN_TARGETS],
        _role(cl.QUANTITY, cell).alias("_quantity"),
        texts(F.col("notes")).alias("_notes"), texts(F.col("attributes")).alias("_attributes"),
        "where", F.col("cost_pct").alias("_cost_pct"))


def with_roles(lines: DataFrame) -> DataFrame:
    """Role columns out of cleaned ones."""
    column = lambda t: F.col(cl.column_of(t))
    plain = lambda t: F.lit(t)
    return lines.withColumns({
        **{role: _role(targets, column) for targets, role in cl.ROLES.items()},
        "_product_kind": _role(cl.PRODUCT_KEY, plain), "_customer_kind": _role(cl.CUSTOMER_KEY, plain),
        "_priced": _role(cl.QUANTITY, plain).isNotNull() & _role(cl.PRICE, plain).isNotNull(),
    }).drop("where")


def clean_layouts(cells: DataFrame, known: DataFrame, cancelled_prefix: str = "C") -> DataFrame:
    """Rows of all layouts to valid, typed lines, as `cleaning.clean_lines` gives them for one."""
    any_mapping = cl.Mapping({}, cancelled_prefix=cancelled_prefix)
    lines = cl.normalise(cl.keep_valid(cl.row_flags(apply_layouts(cells, known), any_mapping)))
    return cl.with_line_money(with_roles(cl.read_dates(lines, any_mapping)))


def row_counters(cells: DataFrame, known: DataFrame, cancelled_prefix: str = "C") -> DataFrame:
    return cl.row_counters(cl.row_flags(apply_layouts(cells, known), cl.Mapping({}, cancelled_prefix=cancelled_prefix)))


def customer_metadata(lines: DataFrame) -> DataFrame:
    """First non-null value of each metadata column: `dataset_id`, `_key`, `metadata`."""
    notes = lines.filter(F.col("_customer_key").isNotNull()).select(
        "dataset_id", F.col("_customer_key").alias("_key"), "_ord", F.explode("_notes").alias("name", "value"))
    firsts = notes.filter(F.col("value").isNotNull()).groupBy("dataset_id", "_key", "name").agg(
        first_value(F.col("value")).alias("value"))
    # as many entries as the file has columns
    return firsts.groupBy("dataset_id", "_key").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("metadata"))


def coverage(known: DataFrame) -> DataFrame:
    """Per dataset: `ml_coverage_pct`, `derived_fields`, `missing_fields` after cleaning."""
    computed = {
        "revenue": _role(cl.QUANTITY, F.lit).isNotNull() & _role(cl.PRICE, F.lit).isNotNull(),
        "profit": F.col("cost_pct").isNotNull() & has("order_id"),
        "profit_margin": F.col("cost_pct").isNotNull() & has("order_id"),
    }
    some = lambda tests: F.filter(F.array(*[F.when(t, F.lit(f)) for f, t in tests.items()]), F.isnotnull)
    derived = {f: t & ~has(REQUIRED_FIELDS[f]) for f, t in computed.items()}
    missing = {f: ~has(t) & ~computed.get(f, F.lit(False)) for f, t in REQUIRED_FIELDS.items()}
    return known.select(
        "dataset_id", some(derived).alias("derived_fields"), some(missing).alias("missing_fields")).withColumn(
        "ml_coverage_pct", F.round((len(REQUIRED_FIELDS) - F.size("missing_fields")) * 100.0 / len(REQUIRED_FIELDS), 1))


def missing_decisions(known: DataFrame) -> DataFrame:
    """`dataset_id`, `field`, `decision`: what was decided for each field that stays empty."""
    found = coverage(known).join(known.select("dataset_id", "decisions"), "dataset_id")
    return found.select("dataset_id", "decisions", F.explode("missing_fields").alias("field")).select(
        "dataset_id", "field", F.try_element_at("decisions", F.col("field")).alias("decision"))


def warnings(known: DataFrame, counters: DataFrame) -> DataFrame:
    """`dataset_id`, `place`, `warning`: what a person should know about each cleaned file, in order."""
    found = known.join(coverage(known).select("dataset_id", "missing_fields"), "dataset_id").join(counters, "dataset_id", "left")

    def counted(text: str, column: str) -> Column:
        before, after = text.split("%s")
        return F.when(F.col(column) > 0, F.concat(F.lit(before), F.format_number(column, 0), F.lit(after)))

    each = lambda text, names: F.transform(names, lambda f: F.concat(
        F.lit(text.split("%s")[0]), f, F.lit(text.split("%s")[1])))
    lacks = lambda targets, text: F.when(_role(targets, F.lit).isNull(), F.lit(text))
    texts = F.concat(
        F.array(counted(NEGATIVE, "negative_rows"), counted(CANCELLED, "cancelled_rows"), lacks(cl.PRODUCT_KEY, NO_PRODUCT),
                lacks(cl.CUSTOMER_KEY, NO_CUSTOMER), lacks(("order_id",), NO_ORDER)),
        each(TWICE, F.col("twice")), each(MISSING, F.col("missing_fields")))
    return found.select("dataset_id", F.posexplode(F.filter(texts, F.isnotnull)).alias("place", "warning"))
