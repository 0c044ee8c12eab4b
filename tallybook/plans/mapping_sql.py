"""Oracle SQL of the column mapping: aliases, fuzzy match, candidates, conflicts, coverage and warnings."""

from __future__ import annotations

from tallybook.registry import (
    ATTRIBUTE_PREFIX, ATTRIBUTES, DENYLIST, FIELDS, METADATA_LABELS, REQUIRED_FIELDS, TRANSLITERATION)

NORM = r"regexp_replace(regexp_replace(lower({t}), '[^a-z0-9\x{{0600}}-\x{{06FF}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
DENIED = ", ".join(f"'{d}'" for d in DENYLIST)


def norm(t: str) -> str:
    return NORM.format(t=t)


def _values(rows: list[tuple]) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def _given_aliases() -> list[tuple[str, str, int]]:
    owners = [(t, 0, names) for t, _, _, names in FIELDS] \
        + [(ATTRIBUTE_PREFIX + k, 1, names) for k, _, names in ATTRIBUTES]
    return [(a, t, kind) for t, kind, names in owners for a in names]


# Every alias once a kind: at its first place, with its last target.
ALIASES = f"""given(place, alias, target, kind) AS ({_values([(i, *r) for i, r in enumerate(_given_aliases())])}),
aliases AS MATERIALIZED (
  SELECT alias, kind, min(place) AS place, arg_max(target, place) AS target, length(alias) AS m FROM given GROUP BY ALL)"""

# Longest common subsequence row by row, for pairs whose lengths and letters allow the cutoff.
_LETTERS = "list_reduce(list_transform(string_split({t}, ''), lambda c: 1::BIGINT << (ascii(c) % 63)), lambda a, b: a | b)"
FUZZY = f"""masked AS MATERIALIZED (SELECT probe, length(probe) AS n, {_LETTERS.format(t="probe")} AS pm FROM probes
  WHERE probe <> ''),
named AS MATERIALIZED (SELECT alias, m, min(place) AS place, {_LETTERS.format(t="alias")} AS am FROM aliases GROUP BY alias, m),
near AS MATERIALIZED (
  SELECT probe, alias, n, m FROM masked, named
  WHERE least(n, m) * 200.0 >= 82 * (n + m)
    AND least(n - bit_count(pm & ~am), m - bit_count(am & ~pm)) * 200.0 >= 82 * (n + m)),
lcs AS (
  SELECT probe, alias, n, m, 0::BIGINT AS i, list_transform(range(m + 1), lambda x: 0::BIGINT) AS so_far FROM near
  UNION ALL
  SELECT probe, alias, n, m, i + 1,
    list_transform(range(1, m + 2), lambda j: list_max(with_letter[1:j]))
  FROM (SELECT *, list_transform(range(1, m + 2), lambda k: CASE
      WHEN k > 1 AND alias[k - 1] = probe[i + 1] THEN greatest(so_far[k], so_far[k - 1] + 1) ELSE so_far[k] END) AS with_letter
    FROM lcs WHERE i < n)),
fuzzy AS MATERIALIZED (
  SELECT probe, alias AS fuzzy_alias, target AS fuzzy_target, score AS fuzzy_score FROM (
    SELECT probe, alias, so_far[m + 1]::DOUBLE * 200.0::DOUBLE / (n + m) AS score FROM lcs WHERE i = n)
  JOIN aliases USING (alias) WHERE score >= 82
  QUALIFY row_number() OVER (PARTITION BY probe ORDER BY kind, score DESC, place) = 1)"""

ARABIC = r"regexp_matches({t}, '[\x{{0600}}-\x{{06FF}}]')"
_LATIN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in TRANSLITERATION.items()) + "}"


def arabic(t: str) -> str:
    return ARABIC.format(t=t)


def probe(t: str) -> str:
    latin = f"array_to_string(list_transform(string_split({t}, ''), lambda c: coalesce({_LATIN}[c], c)), '')"
    return norm(f"CASE WHEN {arabic(t)} THEN {latin} ELSE {t} END")


_LABELS = [(t, label, group, i) for i, (t, label, group, _) in enumerate(FIELDS)]
_LABELS += [(ATTRIBUTE_PREFIX + k, label, "Product", len(FIELDS) + i) for i, (k, label, _) in enumerate(ATTRIBUTES)]

COOCCURRENCE = """usable AS (SELECT ds, pos, quantile_cont(x, 0.5) AS med FROM cells GROUP BY ALL
  HAVING count(*) > 10 AND min(x) >= 0),
t AS (
  SELECT a.ds, a.pos AS pa, b.pos AS pb, c.pos AS pc,
    round_even(a.x * b.x, 2) / nullif(round_even(c.x, 2), 0) AS r
  FROM cells a JOIN cells b ON b.ds = a.ds AND b.rn = a.rn AND b.pos > a.pos
  JOIN cells c ON c.ds = a.ds AND c.rn = a.rn AND c.pos <> a.pos AND c.pos <> b.pos),
held AS (SELECT ds, pa, pb, pc FROM t GROUP BY ALL
  HAVING count(r) >= 5 AND quantile_cont(r, 0.5) BETWEEN 0.9 AND 1.1 AND stddev_samp(r) < 0.3),
sided AS (
  SELECT h.*, ua.med < ub.med AS lower_a FROM held h
  JOIN usable ua ON ua.ds = h.ds AND ua.pos = pa JOIN usable ub ON ub.ds = h.ds AND ub.pos = pb
  JOIN usable uc ON uc.ds = h.ds AND uc.pos = pc),
gains AS (
  SELECT ds, pc AS pos, 'revenue' AS target, 50.0 AS bonus FROM sided
  UNION ALL SELECT ds, CASE WHEN lower_a THEN pa ELSE pb END, 'order_item.quantity', 40.0 FROM sided
  UNION ALL SELECT ds, CASE WHEN lower_a THEN pb ELSE pa END, 'product.price', 40.0 FROM sided)"""


KNOWN_COLUMNS = 'SELECT DISTINCT dataset_id, pos, "column" FROM known'


def mapping_ctes(signals: str, columns: str = KNOWN_COLUMNS) -> str:
    """CTEs from `known` (dataset_id, pos, "column", ord, num) and the signals of its columns to `resolved`.

    Only columns that can be usable enter the ratios, as the others can't hold a triple.
    """
    return f"""signals AS MATERIALIZED ({signals}),
cells AS MATERIALIZED (
  SELECT dataset_id AS ds, pos, ord AS rn, num AS x FROM known WHERE num IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY dataset_id, pos) > 10 AND min(num) OVER (PARTITION BY dataset_id, pos) >= 0),
{COOCCURRENCE},
bonuses AS (SELECT ds AS dataset_id, pos, target, max(bonus)::DOUBLE AS bonus FROM gains GROUP BY ALL),
{ALIASES},
columns AS MATERIALIZED ({columns}),
headers AS MATERIALIZED (SELECT DISTINCT "column", {norm('"column"')} AS norm, {arabic('"column"')} AS arabic,
  {probe('"column"')} AS probe FROM columns),
exacts AS MATERIALIZED (
  SELECT h.*, norm IN ({DENIED}) AS denied, CASE WHEN norm NOT IN ({DENIED}) THEN a.target END AS exact
  FROM headers h LEFT JOIN (SELECT alias, arg_min(target, kind) AS target FROM aliases GROUP BY 1) a ON a.alias = norm),
probes AS (SELECT DISTINCT probe FROM exacts WHERE exact IS NULL AND NOT denied),
{FUZZY},
names AS MATERIALIZED (
  SELECT e.*, coalesce(exact, fuzzy_target) AS name_target,
    CASE WHEN exact IS NOT NULL THEN 100.0 ELSE coalesce(fuzzy_score, 0) END::DOUBLE AS name_score,
    CASE WHEN exact IS NOT NULL THEN 'exact' WHEN fuzzy_target IS NULL THEN 'unmatched'
      WHEN arabic THEN 'arabic_transliterated' ELSE 'fuzzy' END AS name_method
  FROM exacts e LEFT JOIN fuzzy f ON f.probe = e.probe AND exact IS NULL AND NOT denied),
scores AS (
  SELECT dataset_id, pos, target, max(type) AS type, max(pattern) AS pattern, max(name) AS name FROM (
    SELECT dataset_id, pos, target, CASE WHEN signal = 'type' THEN score END AS type,
      CASE WHEN signal = 'pattern' THEN score END AS pattern, NULL::DOUBLE AS name
    FROM signals JOIN columns USING (dataset_id, "column")
    UNION ALL SELECT dataset_id, pos, name_target, NULL, NULL, name_score
    FROM columns JOIN names USING ("column") WHERE name_target IS NOT NULL) GROUP BY ALL),
labels AS (SELECT * FROM ({_values(_LABELS)}) l(target, label, grp, target_ord)),
weighed AS (
  SELECT s.*, label, grp, target_ord,
    CASE WHEN starts_with(target, '{ATTRIBUTE_PREFIX}') AND name = 100 THEN 100.0::DOUBLE
      ELSE round_even(coalesce(name, 0::DOUBLE) * 0.40::DOUBLE + coalesce(type, 0::DOUBLE) * 0.30::DOUBLE
        + coalesce(pattern, 0::DOUBLE) * 0.20::DOUBLE
        + least(100::DOUBLE, coalesce(bonus, 0::DOUBLE) * 3) * 0.10::DOUBLE, 1) END AS combined
  FROM scores s LEFT JOIN bonuses USING (dataset_id, pos, target) LEFT JOIN labels USING (target)),
best AS (
  SELECT *, bool_or(type IS NOT NULL) OVER c AS has_type, bool_or(pattern IS NOT NULL) OVER c AS has_pattern
  FROM weighed WINDOW c AS (PARTITION BY dataset_id, pos)
  QUALIFY row_number() OVER (PARTITION BY dataset_id, pos
    ORDER BY combined DESC, (name IS NOT NULL) DESC, target_ord) = 1),
meta AS (SELECT * FROM ({_values(list(METADATA_LABELS.items()))}) m(norm, meta_label)),
judged AS (
  SELECT dataset_id, pos, "column", arabic, denied, name_score, name_method, meta_label, b.target, b.label, b.grp,
    b.name IS NULL AS by_data, b.combined, coalesce(NOT denied AND b.combined >= CASE
      WHEN name_score = 100 THEN 0 WHEN has_pattern AND NOT has_type THEN 12 WHEN has_pattern THEN 16 ELSE 18 END, false) AS ok
  FROM columns JOIN names USING ("column") LEFT JOIN best b USING (dataset_id, pos) LEFT JOIN meta USING (norm)),
found AS (
  SELECT dataset_id, pos, "column", arabic, name_score, meta_label, ok,
    CASE WHEN ok THEN target ELSE '__unmapped__' END AS target, CASE WHEN ok THEN combined ELSE 0 END AS combined,
    CASE WHEN NOT ok THEN 'unmatched' WHEN by_data THEN 'data_signal' ELSE name_method END AS method,
    CASE WHEN ok THEN label WHEN denied THEN coalesce(meta_label, "column") ELSE coalesce(meta_label, label, "column") END AS label,
    CASE WHEN ok THEN grp WHEN denied OR meta_label IS NOT NULL THEN 'Notes' ELSE coalesce(grp, 'Notes') END AS grp
  FROM judged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, target ORDER BY combined DESC, pos) AS rk FROM found),
resolved AS MATERIALIZED (
  SELECT dataset_id, pos, "column", arabic, ok AND rk > 1 AS lost, label AS claimed_label,
    CASE WHEN ok AND rk = 1 THEN target ELSE '__unmapped__' END AS mapped_to,
    CASE WHEN ok AND rk = 1 AND name_score = 100 THEN 100 WHEN ok THEN combined ELSE 0 END::DOUBLE AS confidence,
    method AS match_method, CASE WHEN ok AND rk > 1 THEN coalesce(meta_label, "column") ELSE label END AS human_label,
    CASE WHEN ok AND rk > 1 THEN 'Notes' ELSE grp END AS "group" FROM ranked)"""


_FIELDS = list(REQUIRED_FIELDS)


def coverage_ctes() -> str:
    """From `resolved` to `covered`: per dataset the missing and derived fields and the share covered."""
    has = ", ".join(
        f"""max("column") FILTER (mapped_to = '{t}') AS {f}""" for f, t in REQUIRED_FIELDS.items())
    rule = {
        "revenue": "revenue IS NULL AND price IS NOT NULL AND quantity IS NOT NULL",
        "profit": "profit IS NULL AND k_revenue AND cost IS NOT NULL",
        "profit_margin": "profit_margin IS NULL AND k_profit AND k_revenue",
        "cost": "cost IS NULL AND k_revenue AND k_profit",
    }
    needs = {"revenue": ("price", "quantity"), "profit": ("revenue", "cost"),
             "profit_margin": ("profit", "revenue"), "cost": ("revenue", "profit")}
    src = {f: " || '+' || ".join(f"coalesce({n}, '[derived:{n}]')" for n in ns)
           for f, ns in needs.items()}
    derived = ", ".join(f"CASE WHEN d_{f} THEN '{f}<' || {src[f]} END" for f in rule)
    fields = ", ".join(f"CASE WHEN d_{f} THEN '{f}' END" for f in rule)
    missing = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in _FIELDS)
    absent = ", ".join(f"CASE WHEN {f} IS NULL AND NOT {'d_' + f if f in rule else 'false'} THEN '{f}' END"
                       for f in _FIELDS)
    return f"""m AS (SELECT dataset_id, {has} FROM resolved GROUP BY 1),
r AS (SELECT *, {rule['revenue']} AS d_revenue FROM m),
k AS (SELECT *, revenue IS NOT NULL OR d_revenue AS k_revenue FROM r),
p AS (SELECT *, {rule['profit']} AS d_profit FROM k),
q AS (SELECT *, profit IS NOT NULL OR d_profit AS k_profit FROM p),
d AS (SELECT *, {rule['profit_margin']} AS d_profit_margin, {rule['cost']} AS d_cost FROM q),
covered AS MATERIALIZED (SELECT dataset_id, concat_ws(',', {missing}) AS missing, concat_ws(',', {derived}) AS derived,
  concat_ws(', ', {fields}) AS derivable, concat_ws(',', {absent}) AS absent,
  10.0 * (10 - len(list_filter([{absent}], lambda x: x IS NOT NULL)))::DOUBLE AS ml_coverage_pct
FROM d)"""


def warning_ctes(header_row: str) -> str:
    """From `resolved` and `covered` to `warned`: the texts of each dataset as a list."""
    return f"""claims AS (
  SELECT dataset_id, bool_or(arabic) AS arabic, coalesce(list('''' || "column" || ''' matched ''' || claimed_label
    || ''' but that field was already claimed — moved to Notes.' ORDER BY pos) FILTER (lost), []) AS lost
  FROM resolved GROUP BY 1),
warned AS MATERIALIZED (
  SELECT dataset_id, list_filter(list_concat([
      CASE WHEN h > 0 THEN 'Data starts at row ' || (h + 1) || ' — ' || h || ' header row(s) skipped.' END,
      CASE WHEN arabic THEN 'Arabic column headers detected — transliteration applied.' END],
    lost, [CASE WHEN derivable <> '' THEN
      'These analytics fields will be calculated automatically: ' || derivable || '.' END]),
    lambda w: w IS NOT NULL) AS warnings
  FROM (SELECT *, {header_row} AS h FROM claims) JOIN covered USING (dataset_id))"""
