"""The registered queries as SQL for DuckDB, written apart from the Spark code."""

from __future__ import annotations

from .fixtures import with_sql
from .sources.fixed_width import APPLICANT_LAYOUT

COSINE_THRESHOLD = 0.35
WEIGHTS = {"o_totalprice": 3.0, "o_orderstatus": 2.0}
BADGES = (
    (95.0, "Excellent Match"), (80.0, "Review Recommended"), (50.0, "Significant Mismatches"),
    (None, "Likely Column Mismatch — Check Mapping"),
)
NARRATIVES = (
    (100.0, "All clear! Every record and value matched perfectly between sources."),
    (95.0, "Mostly matched with limited issues. Data integrity is high with few discrepancies."),
    (80.0, "Review recommended. Significant portions match, but some systematic issues may be present."),
    (None, "Significant mismatch volume detected. Verify column mappings and source data consistency."),
)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def text(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def number(x: str) -> str:
    return rf"CASE WHEN regexp_matches({strip(x)}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST({strip(x)} AS DOUBLE) END"


def shown(x: str) -> str:
    """A double as text."""
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def numbers_differ(a: str, b: str) -> str:
    return (f"CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN (({a}) IS NULL) <> (({b}) IS NULL) "
            f"ELSE NOT (({a}) = ({b}) OR abs(({a}) - ({b})) <= 1e-8 + 1e-5 * abs({b})) END")


def texts_differ(a: str, b: str) -> str:
    return f"upper({text(a)}) IS DISTINCT FROM upper({text(b)})"


def joined(a: str, b: str, key_a: str, key_b: str) -> str:
    return f"""
ka AS (SELECT {key_a} AS ka, * FROM {a}),
kb AS (SELECT {key_b} AS kb, * FROM {b}),
j AS (SELECT * FROM ka FULL JOIN kb ON ka = kb)"""


def mismatches(pairs, label: str = "match_type") -> str:
    """``mm``: missing rows and one SELECT per pair ``(col_a, col_b, shown a, shown b, failing condition)``."""
    lost = "'missing_key', 'missing_key'" if label != "match_type" else "'Missing in Source B', 'Missing in Source A'"
    lost_b, lost_a = lost.split(", ")
    row = "'<ROW MISSING>' AS col_df1, '<ROW MISSING>' AS col_df2, '<ROW MISSING>' AS val_df1, '<ROW MISSING>' AS val_df2"
    parts = [
        f"SELECT ka AS key_df1, '<MISSING>' AS key_df2, {row}, {lost_b} AS {label} FROM j WHERE kb IS NULL",
        f"SELECT '<MISSING>' AS key_df1, kb AS key_df2, {row}, {lost_a} AS {label} FROM j WHERE ka IS NULL",
    ]
    for col_a, col_b, show_a, show_b, bad in pairs:
        kind = (f"CASE WHEN ({show_a}) IS NULL OR ({show_b}) IS NULL THEN 'Missing Value' ELSE 'Value Mismatch' END"
                if label == "match_type" else f"'{col_a} vs {col_b}'")
        parts.append(
            f"SELECT ka AS key_df1, kb AS key_df2, '{col_a}' AS col_df1, '{col_b}' AS col_df2, {show_a} AS val_df1, "
            f"{show_b} AS val_df2, {kind} AS {label} FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND ({bad})"
        )
    return "mm AS (" + "\nUNION ALL ".join(parts) + ")"


KEY_COUNTS = """
na AS (SELECT ka AS k, count(*) AS n FROM ka GROUP BY ka),
nb AS (SELECT kb AS k, count(*) AS n FROM kb GROUP BY kb),
kk AS (SELECT coalesce(na.n, 0) AS n_a, coalesce(nb.n, 0) AS n_b FROM na FULL JOIN nb ON na.k = nb.k),
ov AS (SELECT count(*) AS total_keys, count(*) FILTER (n_a > 0 AND n_b > 0) AS joined_count,
  count(*) FILTER (n_a = 0) AS missing_in_a, count(*) FILTER (n_b = 0) AS missing_in_b,
  CAST(sum(n_a) AS BIGINT) AS rows_a, CAST(sum(n_b) AS BIGINT) AS rows_b,
  sum(CAST(n_a AS DOUBLE) * n_b) AS joined_rows, max(n_a) AS largest_a, max(n_b) AS largest_b FROM kk)"""

ORDERS = f"""{with_sql("orders_a", "orders_b")},
{joined("orders_a", "orders_b", "CAST(o_orderkey AS VARCHAR)", f"upper({strip('order_id')})")},
{mismatches([
    ("o_custkey", "customer", "CAST(o_custkey AS VARCHAR)", "customer", numbers_differ("CAST(o_custkey AS DOUBLE)", number("customer"))),
    ("o_orderstatus", "status", "o_orderstatus", "status", texts_differ("o_orderstatus", "status")),
    ("o_totalprice", "total", shown("o_totalprice"), "total", numbers_differ("o_totalprice", number("total"))),
    ("o_orderpriority", "priority", "o_orderpriority", "priority", texts_differ("o_orderpriority", "priority")),
])},
{KEY_COUNTS}"""

LINEITEM = f"""{with_sql("lineitem_a", "lineitem_b")},
{joined("lineitem_a", "lineitem_b", "concat(l_orderkey, '|', l_linenumber)", "concat(order_id, '|', line_no)")},
{mismatches([
    ("l_quantity", "qty", shown("l_quantity"), shown("qty"), numbers_differ("l_quantity", "qty")),
    ("l_extendedprice", "price", shown("l_extendedprice"), shown("price"), numbers_differ("l_extendedprice", "price")),
    ("l_returnflag", "flag", "l_returnflag", "flag", texts_differ("l_returnflag", "flag")),
])},
{KEY_COUNTS}"""

COUNTED = "SELECT key_df1, key_df2, col_df1, col_df2, val_df1, val_df2, match_type, count(*) AS n_rows FROM mm GROUP BY ALL"

_CUSTOMER_PAIRS = [
    ("zip", "zip", "ka_zip", "kb_zip", texts_differ("ka_zip", "kb_zip")),
    ("balance", "balance", shown("ka_balance"), "kb_balance", texts_differ(f"({shown('ka_balance')})", "kb_balance")),
    ("segment", "segment", "ka_segment", "kb_segment", texts_differ("ka_segment", "kb_segment")),
    ("nation", "nation", "CAST(ka_nation AS VARCHAR)", "kb_nation", numbers_differ("CAST(ka_nation AS DOUBLE)", number("kb_nation"))),
]


def customer(key) -> str:
    columns = ("zip", "balance", "segment", "nation")
    sides = ", ".join(f"{s}.{c} AS {s}_{c}" for s in ("ka", "kb") for c in columns)
    return f"""{with_sql("customer_a", "customer_b")},
ka AS (SELECT {key("cust_id")} AS ka, * FROM customer_a),
kb AS (SELECT {key("cust_id")} AS kb, * FROM customer_b),
j AS (SELECT ka.ka, kb.kb, {sides} FROM ka FULL JOIN kb ON ka.ka = kb.kb),
{mismatches(_CUSTOMER_PAIRS)}"""


_NO_CODE = " AND ".join(f"({texts_differ('code', c)})" for c in ("code1", "code2", "code3"))
PART = f"""{with_sql("part_a", "part_b")},
{joined("part_a", "part_b", "CAST(p_partkey AS VARCHAR)", "CAST(part_id AS VARCHAR)")},
{mismatches([*[("code", c, "code", c, _NO_CODE) for c in ("code1", "code2", "code3")],
             ("size", "size_b", "CAST(size AS VARCHAR)", "CAST(size_b AS VARCHAR)", numbers_differ("size", "size_b"))],
            "comparison_type")}"""


def pair_types(rows: str, pairs) -> str:
    """Shares and decision of each pair ``(col_a, col_b, a, a is number, b, b is number)`` over ``rows``."""
    selects = []
    for col_a, col_b, a, a_number, b, b_number in pairs:
        facts = []
        for side, x, is_number in (("a", a, a_number), ("b", b, b_number)):
            value = x if is_number else text(x)
            ids = "0" if is_number else rf"count(*) FILTER (regexp_matches({value}, '^([A-Za-z]|0)\d+$'))"
            numbers = f"count({value})" if is_number else f"count({number(x)})"
            blanks = "0" if is_number else f"count(*) FILTER ({strip(x)} = '')"
            facts.append(f"count({value}) AS n_{side}, {ids} AS ids_{side}, {numbers} AS nums_{side}, {blanks} AS blanks_{side}")
        selects.append(f"SELECT '{col_a}' AS col_a, '{col_b}' AS col_b, {', '.join(facts)} FROM {rows}")
    share = lambda k, s: f"coalesce({k}_{s} / nullif(CAST(n_{s} AS DOUBLE), 0), 0.0)"
    return f"""facts AS ({" UNION ALL ".join(selects)}),
shares AS (SELECT col_a, col_b, n_a, n_b, {share("ids", "a")} AS id_rate_a, {share("ids", "b")} AS id_rate_b,
  {share("nums", "a")} AS num_rate_a, {share("nums", "b")} AS num_rate_b, blanks_a + blanks_b > 0 AS blanks_found,
  n_a - nums_a + n_b - nums_b AS n_unparseable FROM facts),
types AS (SELECT *, CASE WHEN id_rate_a > 0.05 OR id_rate_b > 0.05 THEN 'text'
    WHEN num_rate_a > 0.9 AND num_rate_b > 0.9 THEN 'numeric' ELSE 'text' END AS mode,
  CASE WHEN id_rate_a > 0.05 OR id_rate_b > 0.05 THEN
      'ID pattern detected — string comparison' || CASE WHEN blanks_found THEN ' (blanks normalized to missing)' ELSE '' END
    ELSE CASE WHEN num_rate_a > 0.9 AND num_rate_b > 0.9 THEN 'Numeric handling applied' ELSE 'String fallback — mixed types' END
      || CASE WHEN blanks_found THEN ' (blanks standardized to missing)' ELSE '' END END AS note FROM shares)"""


_CUSTOMER_TYPES = pair_types("matched", [
    ("zip", "zip", "ka_zip", False, "kb_zip", False), ("balance", "balance", "ka_balance", True, "kb_balance", False),
    ("segment", "segment", "ka_segment", False, "kb_segment", False), ("nation", "nation", "ka_nation", True, "kb_nation", False),
])
_ORDERS_TYPES = pair_types("matched", [
    ("o_custkey", "customer", "o_custkey", True, "customer", False),
    ("o_orderstatus", "status", "o_orderstatus", False, "status", False),
    ("o_totalprice", "total", "o_totalprice", True, "total", False),
    ("o_orderpriority", "priority", "o_orderpriority", False, "priority", False),
])


def whole_mode(column: str, a_is_number: bool) -> str:
    """Mode and note of a customer pair over whole columns."""
    def facts(table: str, is_number: bool) -> str:
        if is_number:
            return f"SELECT 0.0 AS ids, CASE WHEN count({column}) > 0 THEN 1.0 ELSE 0.0 END AS nums, 0 AS blanks FROM {table}"
        return (rf"SELECT count(*) FILTER (regexp_matches({text(column)}, '^([A-Za-z]|0)\d+$')) / CAST(count({text(column)}) AS DOUBLE) AS ids, "
                f"count({number(column)}) / CAST(count({text(column)}) AS DOUBLE) AS nums, "
                f"count(*) FILTER ({strip(column)} = '') AS blanks FROM {table}")
    return f"""SELECT '{column}' AS col_a, '{column}' AS col_b,
  x.ids <= 0.05 AND y.ids <= 0.05 AND x.nums > 0.9 AND y.nums > 0.9 AS kept,
  CASE WHEN x.ids > 0.05 OR y.ids > 0.05 THEN 'ID pattern detected — string comparison'
    WHEN x.nums > 0.9 AND y.nums > 0.9 THEN 'Numeric handling applied' ELSE 'String fallback — mixed types' END AS note
FROM ({facts("customer_a", a_is_number)}) x, ({facts("customer_b", False)}) y"""


def statistics(pairs) -> str:
    """Long-form statistics of ``(column, a, b)``; pairs without expressions give NULLs."""
    metrics = (
        ("count", "CAST(count({x}) AS DOUBLE)"), ("mean", "avg({x})"), ("std", "stddev_samp({x})"), ("min", "min({x})"),
        ("25%", "quantile_cont({x}, 0.25)"), ("50%", "quantile_cont({x}, 0.5)"), ("75%", "quantile_cont({x}, 0.75)"),
        ("max", "max({x})"),
    )
    out = []
    for column, a, b in pairs:
        for name, form in metrics:
            value_a = f"(SELECT {form.format(x=a)} FROM orders_a)" if a else "CAST(NULL AS DOUBLE)"
            value_b = f"(SELECT {form.format(x=b)} FROM orders_b)" if b else "CAST(NULL AS DOUBLE)"
            out.append(f"SELECT '{column}' AS \"column\", '{name}' AS metric, {value_a} AS a, {value_b} AS b")
    return (f"{with_sql('orders_a', 'orders_b')}, s AS ({' UNION ALL '.join(out)}) SELECT \"column\", metric, round(a, 4) AS a, "
            "round(b, 4) AS b, round(a - b, 4) AS abs_diff, round((a - b) / nullif(b, 0), 4) AS rel_diff FROM s")


def ladder(x: str, steps) -> str:
    cases = " ".join(f"WHEN {x} >= {limit} THEN '{words}'" for limit, words in steps[:-1])
    return f"CASE {cases} ELSE '{steps[-1][1]}' END"


_ANY_KEY = "CASE WHEN key_df1 = '<MISSING>' THEN key_df2 ELSE key_df1 END"
_WEIGHT = "CASE col_df1 " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in WEIGHTS.items()) + " ELSE 1.0 END"

COVERAGE = f"""{ORDERS},
found AS (SELECT count(DISTINCT {_ANY_KEY}) AS bad_keys,
  count(DISTINCT key_df1) FILTER (col_df1 <> '<ROW MISSING>') AS mismatch_count,
  count(DISTINCT key_df2) FILTER (match_type = 'Missing in Source A') AS missing_in_a,
  count(DISTINCT key_df1) FILTER (match_type = 'Missing in Source B') AS missing_in_b FROM mm),
s AS (SELECT round(greatest(0.0, (1.0 - CAST(bad_keys AS DOUBLE) / total_keys) * 100.0), 1) AS score, total_keys, joined_count,
  found.missing_in_a, found.missing_in_b, mismatch_count, joined_count - mismatch_count AS fully_matched FROM found, ov)
SELECT *, {ladder("score", BADGES)} AS band, {ladder("score", NARRATIVES)} AS narrative FROM s"""

def words(x: str) -> str:
    return rf"array_to_string(list_sort(string_split(trim(regexp_replace(lower({x}), '\W+', ' ', 'g')), ' ')), ' ')"


def similar(a: str, b: str) -> str:
    """Percent similarity of two texts by the table of common subsequences, one row per character of ``a``."""
    cell = (f"list_append(line, greatest(line[-1], CASE WHEN string_split({b}, '')[j] = c THEN above[j] + 1 ELSE above[j + 1] END))")
    line = f"list_reduce(range(1, length({b}) + 1), lambda line, j: {cell}, [0])"
    last = f"list_reduce(string_split({a}, ''), lambda above, c: {line}, list_resize([0], length({b}) + 1, 0))[-1]"
    return f"round_even(200.0 * {last} / (length({a}) + length({b})), 0)"


SUPPLIER = f"""{with_sql("supplier_a", "supplier_b")},
j AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name, name, {words("s_name")} AS wa, {words("name")} AS wb
  FROM supplier_a JOIN supplier_b ON s_suppkey = supp_id),
s AS (SELECT *, {similar("wa", "wb")} AS score FROM j)
SELECT k AS key_df1, k AS key_df2, 's_name' AS col_df1, 'name' AS col_df2, s_name AS val_df1, name AS val_df2,
  'Value Mismatch' AS match_type FROM s WHERE score < 80"""

BEST_NAMES = f"""{with_sql("supplier_a", "supplier_b")},
l AS (SELECT s_name AS name, min(s_suppkey) AS place, {words("s_name")} AS wl FROM supplier_a GROUP BY s_name),
r AS (SELECT name, min(supp_id) AS place, {words("name")} AS wr FROM supplier_b GROUP BY name),
p AS (SELECT l.name AS left_name, l.place AS left_place, r.name AS right_name, r.place AS right_place,
  CASE WHEN l.name = r.name THEN 2 WHEN lower(l.name) = lower(r.name) THEN 1 ELSE 0 END AS step,
  CASE WHEN l.name = r.name THEN 100 WHEN lower(l.name) = lower(r.name) THEN 99 ELSE CAST({similar("wl", "wr")} AS INTEGER) END AS score
  FROM l, r),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY left_name ORDER BY step DESC, score DESC, right_place) = 1)
SELECT left_name, right_name, score FROM b WHERE score >= 60
QUALIFY row_number() OVER (PARTITION BY right_name ORDER BY score DESC, left_place) = 1"""

ORACLE: dict[str, str] = {
    "fuzzy_record_mismatches": SUPPLIER,
    "fuzzy_best_match": BEST_NAMES,
    "orders_record_mismatches": f"{ORDERS} SELECT * FROM mm",
    "lineitem_composite_key_mismatches": f"{LINEITEM} SELECT * FROM mm",
    "lineitem_mismatches_counted": f"{LINEITEM} {COUNTED}",
    "lineitem_mismatches_hot_keys": f"{LINEITEM} {COUNTED}",
    "customer_record_mismatches": f"{customer(lambda c: f'upper({strip(c)})')} SELECT * FROM mm",
    "customer_case_sensitive_keys": f"{customer(strip)} SELECT * FROM mm",
    "any_of_mismatches": f"{PART} SELECT * FROM mm",
    "missing_in_b": f"{ORDERS} SELECT ka AS row_key FROM j WHERE kb IS NULL",
    "missing_in_a": f"{ORDERS} SELECT kb AS row_key FROM j WHERE ka IS NULL",
    "documents_without_labels":
        "SELECT CAST(doc_id AS VARCHAR) AS row_key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "matched_rows": f"{ORDERS} SELECT ka AS row_key, o_custkey, o_orderstatus, customer, status FROM j WHERE ka = kb",
    "outer_rows": f"""{LINEITEM} SELECT coalesce(ka, kb) AS row_key, l_quantity, qty,
  CASE WHEN kb IS NULL THEN 'a' WHEN ka IS NULL THEN 'b' ELSE 'both' END AS found_in FROM j""",
    "rows_of_mismatched_keys":
        f"{ORDERS} SELECT ka AS row_key, o_orderkey, o_orderstatus FROM ka WHERE ka IN (SELECT key_df1 FROM mm)",
    "pair_type_decision":
        f"{customer(lambda c: f'upper({strip(c)})')}, matched AS (SELECT * FROM j WHERE ka = kb), {_CUSTOMER_TYPES} SELECT * FROM types",
    "orders_pair_types": f"{ORDERS}, matched AS (SELECT * FROM j WHERE ka = kb), {_ORDERS_TYPES} SELECT * FROM types",
    "numeric_pair_filter": f"{with_sql('customer_a', 'customer_b')} " + " UNION ALL ".join(
        whole_mode(c, n) for c, n in (("zip", False), ("balance", True), ("segment", False), ("nation", True))),
    # More than 80% of all rows that parse make a column numbers. A decision the other way would give another type, hence an error.
    "convert_numeric_columns": f"""{with_sql('customer_b')},
share AS (SELECT {", ".join(f"CAST(count({number(c)}) AS DOUBLE) / count(*) AS {c}" for c in ("zip", "balance", "nation"))} FROM customer_b)
SELECT cust_id, {", ".join(
    f"CASE WHEN (SELECT {c} {test} 0.8 FROM share) THEN {value} ELSE error('{c} is decided otherwise') END AS {c}"
    for c, test, value in (("zip", ">", number("zip")), ("balance", "<=", "balance"), ("nation", ">", number("nation"))))} FROM customer_b""",
    # Integer leaves a column alone that holds fractions.
    "type_overrides": f"""{with_sql('orders_a')},
whole AS (SELECT NOT bool_or(o_custkey <> floor(o_custkey)) AS o_custkey, bool_or(o_totalprice <> floor(o_totalprice)) AS o_totalprice FROM orders_a)
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN (SELECT o_custkey FROM whole) THEN o_custkey ELSE error('fractions') END AS o_custkey,
  CASE WHEN (SELECT o_totalprice FROM whole) THEN o_totalprice ELSE error('no fractions') END AS o_totalprice,
  CAST(o_orderdate AS TIMESTAMP) AS o_orderdate,
  CASE WHEN o_orderkey % 59 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS price FROM orders_a""",
    "normalise_text": f"{with_sql('customer_b')} SELECT cust_id, coalesce(upper({text('segment')}), '') AS segment_text, "
                      f"{text('segment')} AS segment_shown FROM customer_b",
    "blank_values": f"{with_sql('orders_b')} SELECT " + ", ".join(
        f"count(*) FILTER ({strip(c)} = '') AS {c}_blanks" for c in ("order_id", "customer", "status", "total", "priority"))
        + " FROM orders_b",
    "null_tokens": f"{with_sql('customer_b')} SELECT cust_id, CASE WHEN segment <> 'NULL' THEN segment END AS segment, balance FROM customer_b",
    "locale_numbers": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM lineitem",
    "fixed_width_field_table": """SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cust,
  CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment,
  CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer""",
    # Columns with a value stay; one that had none would have to go, hence an error.
    "drop_empty_columns": f"""{with_sql('customer_b')},
filled AS (SELECT {", ".join(f"count({c}) AS {c}" for c in ("cust_id", "zip", "balance", "segment", "nation", "empty_col"))} FROM customer_b)
SELECT CASE WHEN (SELECT empty_col = 0 FROM filled) THEN cust_id ELSE error('empty_col has values') END AS cust_id, {", ".join(
    f"CASE WHEN (SELECT {c} > 0 FROM filled) THEN {c} ELSE error('{c} is empty') END AS {c}" for c in ("zip", "balance", "segment", "nation"))}
FROM customer_b""",
    "descriptive_stats_orders": statistics([
        ("o_custkey", "CAST(o_custkey AS DOUBLE)", number("customer")), ("o_orderstatus", None, None),
        ("o_totalprice", "o_totalprice", number("total")), ("o_orderpriority", None, None),
    ]),
    "union_key_count": f"{ORDERS} SELECT total_keys FROM ov",
    "joined_key_count": f"{LINEITEM} SELECT joined_count FROM ov",
    "key_counts": f"{LINEITEM} SELECT * FROM ov",
    "coverage_summary": COVERAGE,
    "csv_lines": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderkey % 50 = 0 THEN 'x' WHEN o_orderkey % 60 <> 7 THEN concat(o_orderpriority, ', "', o_orderstatus, '"') END AS note,
  CASE WHEN o_orderkey % 50 = 0 THEN '1' WHEN o_orderkey % 60 <> 7 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS total,
  CASE WHEN o_orderkey % 50 = 0 THEN concat(o_orderkey, ',x,1,EXTRA') END AS surplus_line FROM orders""",
    "applicant_layout_fields": f"""{with_sql("applicant_lines")} SELECT c_custkey, {", ".join(
        f'nullif(trim(substring(line, {s + 1}, {e - s})), {chr(39) * 2}) AS "{n}"' for n, s, e in APPLICANT_LAYOUT)} FROM applicant_lines""",
    "multi_line_records": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN concat(o_orderpriority, chr(10), 'said "', o_orderstatus, ',"', chr(10), chr(10), 'end') ELSE concat('5" ', o_orderstatus) END AS note,
  CAST(o_custkey AS VARCHAR) AS total, CAST(NULL AS VARCHAR) AS surplus_line FROM orders""",
    "sketched_key_counts": """SELECT count(*) AS total_keys, count(*) FILTER (a AND b) AS in_both, count(*) FILTER (a AND NOT b) AS only_a,
  count(*) FILTER (b AND NOT a) AS only_b, true AS total_keys_within, true AS in_both_within, true AS only_a_within, true AS only_b_within
FROM (SELECT DISTINCT o_orderkey, o_orderkey % 31 <> 0 AS a, o_orderkey % 29 <> 0 AS b FROM orders) WHERE a OR b""",
    "preflight_findings": f"""{with_sql("lineitem_a", "lineitem_b")},
ka AS (SELECT l_linenumber AS n, upper(trim(l_returnflag)) AS f, count(*) AS m FROM lineitem_a GROUP BY ALL),
kb AS (SELECT line_no AS n, upper(trim(flag)) AS f, count(*) AS m FROM lineitem_b GROUP BY ALL),
t AS (SELECT (SELECT count(*) FROM lineitem_a) AS na, (SELECT count(*) FROM lineitem_b) AS nb, (SELECT count(*) FROM ka) AS da, (SELECT count(*) FROM kb) AS db,
  (SELECT sum(CAST(ka.m AS DOUBLE) * kb.m) FROM ka JOIN kb ON ka.n = kb.n AND ka.f IS NOT DISTINCT FROM kb.f) AS joined)
SELECT 'key_uniqueness' AS "check", 'error' AS severity, 'A l_linenumber|l_returnflag' AS subject, round(da / na, 9) AS observed FROM t WHERE da / na < 0.1
UNION ALL SELECT 'key_uniqueness', 'error', 'B line_no|flag', round(db / nb, 9) FROM t WHERE db / nb < 0.1
UNION ALL SELECT 'row_counts', 'warning', 'rows', CAST(na - nb AS DOUBLE) FROM t WHERE na <> nb
UNION ALL SELECT 'join_size', 'error', 'l_linenumber|l_returnflag', joined FROM t WHERE (da / na < 0.9 OR db / nb < 0.9) AND CAST(na AS DOUBLE) * nb > 10000000""",
    "tsv_lines": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name AS name, c_mktsegment AS segment,
  CASE WHEN c_custkey % 9 = 0 THEN concat(c_custkey, chr(9), c_name, chr(9), c_mktsegment, chr(9), 'more') END AS surplus_line FROM customer""",
    "header_line": """WITH f AS (SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 2 WHEN n_nationkey = 3 THEN 3 ELSE 2 END AS fields FROM nation WHERE n_nationkey < 10)
SELECT CAST(arg_min(n_nationkey, -fields * 100 + n_nationkey) AS BIGINT) AS header_row, max(fields) AS fields FROM f""",
    "run_history_row": f"""SELECT 'records' AS approach, 'orders' AS source_a_name, 'copy' AS source_b_name, 'o_orderkey' AS key_cols_a,
  'order_id' AS key_cols_b, score, total_keys, joined_count, missing_in_a, missing_in_b, mismatch_count,
  'o_custkey=customer,o_orderstatus=status,o_totalprice=total,o_orderpriority=priority' AS column_pairs, 0 AS n_composite_pairs
FROM ({COVERAGE}) AS c""",
    "coverage_of_like_keys": f"""{with_sql("like_keys_a", "like_keys_b")},
j AS (SELECT a.part AS pa, b.part AS pb, a.size <> b.size AS differ FROM like_keys_a a FULL JOIN like_keys_b b
  ON a.k1 IS NOT DISTINCT FROM b.k1 AND a.k2 = b.k2),
c AS (SELECT count(*) AS total_keys, count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) AS joined_count, count(*) FILTER (pa IS NULL) AS missing_in_a,
  count(*) FILTER (pb IS NULL) AS missing_in_b, count(*) FILTER (differ) AS mismatch_count FROM j),
s AS (SELECT *, round((1.0 - CAST(missing_in_a + missing_in_b + mismatch_count AS DOUBLE) / total_keys) * 100, 1) AS score FROM c)
SELECT score, total_keys, joined_count, missing_in_a, missing_in_b, mismatch_count, joined_count - mismatch_count AS fully_matched,
  {ladder("score", BADGES)} AS band, {ladder("score", NARRATIVES)} AS narrative FROM s""",
    "match_score": f"""{LINEITEM}, s AS (SELECT total_keys, (SELECT count(DISTINCT {_ANY_KEY}) FROM mm) AS bad_keys FROM ov)
SELECT total_keys, bad_keys, greatest(0.0, (1.0 - CAST(bad_keys AS DOUBLE) / total_keys) * 100.0) AS score,
  round(greatest(0.0, (1.0 - CAST(bad_keys AS DOUBLE) / total_keys) * 100.0), 1) AS score_rounded FROM s""",
    "weighted_score": f"""{ORDERS}, c AS (SELECT col_df1, CAST(count(DISTINCT key_df1) AS DOUBLE) AS m, CAST({_WEIGHT} AS DOUBLE) AS w
  FROM mm WHERE col_df1 <> '<ROW MISSING>' GROUP BY col_df1),
e AS (SELECT sum(m * w) / greatest(1.0, sum(w) / count(*)) AS eff FROM c)
SELECT total_keys, greatest(0.0, (1.0 - eff / total_keys) * 100.0) AS weighted_score,
  round(greatest(0.0, (1.0 - eff / total_keys) * 100.0), 1) AS weighted_score_rounded FROM e, ov""",
    "column_scores": f"""{ORDERS} SELECT col_df1 AS "column", count(DISTINCT key_df1) AS mismatches,
  (1.0 - CAST(count(DISTINCT key_df1) AS DOUBLE) / (SELECT joined_count FROM ov)) * 100.0 AS score
FROM mm WHERE col_df1 <> '<ROW MISSING>' GROUP BY col_df1""",
    "score_bands": f"""{ORDERS}, r AS (SELECT o_custkey, round((1.0 - CAST(count(*) FILTER (ka IN (SELECT key_df1 FROM mm)) AS DOUBLE)
  / count(*)) * 100, 1) AS score FROM ka GROUP BY o_custkey)
SELECT o_custkey, score, {ladder("score", BADGES)} AS band, {ladder("score", NARRATIVES)} AS narrative FROM r""",
    "clean_columns": f"""{ORDERS}, cols AS (SELECT unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS "column")
SELECT "column" FROM cols WHERE "column" NOT IN (SELECT col_df1 FROM mm)""",
    "mismatch_frequency": f"""{ORDERS} SELECT col_df1 AS "column", count(*) AS mismatch_rows FROM mm
WHERE col_df1 <> '<ROW MISSING>' GROUP BY col_df1""",
    "crosstab_candidates": with_sql("orders_a") + ", c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_filled, count(DISTINCT {c}) AS n_distinct FROM orders_a"
        for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"))
        + ") SELECT * FROM c WHERE n_distinct <= 50 AND n_distinct < n_filled * 0.5",
    "crosstab_by_priority": f"""{ORDERS}, g AS (SELECT o_orderpriority AS group_value, count(*) AS mismatches FROM
  (SELECT DISTINCT ka, o_orderpriority FROM ka WHERE ka IN (SELECT key_df1 FROM mm)) GROUP BY o_orderpriority)
SELECT group_value, mismatches, round(CAST(mismatches AS DOUBLE) / sum(mismatches) OVER () * 100, 1) AS pct_of_total FROM g""",
    "column_profile": with_sql("customer_b") + " " + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", 'string' AS type, CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 AS null_pct,
  count(DISTINCT {c}) AS n_distinct, count({number(c)}) > 0 AND count({number(c)}) < count({c}) AS is_mixed,
  CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 > 50 AS high_null FROM customer_b"""
        for c in ("cust_id", "zip", "balance", "segment", "nation", "empty_col")),
    "mixed_type_columns": with_sql("customer_b") + ", c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({number(c)}) AS p, count({c}) AS n FROM customer_b"
        for c in ("cust_id", "zip", "balance", "segment", "nation", "empty_col")) + ') SELECT "column" FROM c WHERE p > 0 AND p < n',
    "preflight_uniqueness": with_sql("lineitem_a", "lineitem_b", "orders_a") + ", u AS (" + " UNION ALL ".join(
        f"SELECT '{side}' AS side, '{'|'.join(ks)}' AS key_columns, count(*) AS n_rows, count(DISTINCT ({', '.join(ks)})) AS distinct_keys FROM {t}"
        for side, t, ks in (("A", "lineitem_a", ("l_orderkey", "l_linenumber")), ("B", "lineitem_b", ("order_id", "line_no")),
                            ("A", "orders_a", ("o_orderkey",)), ("A", "orders_a", ("o_orderpriority",))))
        + """) SELECT *, CAST(distinct_keys AS DOUBLE) / n_rows AS ratio, CAST(distinct_keys AS DOUBLE) / n_rows < 0.10 AS fires FROM u""",
    "preflight_sequence": with_sql("orders_a") + " " + " UNION ALL ".join(f"""
SELECT count(*) FILTER (d = 1) AS steps_of_one, count(d) AS neighbours, CAST(count(*) FILTER (d = 1) AS DOUBLE) / count(d) AS share, '{k}' AS key
FROM (SELECT {k} - lag({k}) OVER (ORDER BY {k}) AS d FROM {t})"""
        for k, t in (("o_orderkey", "orders_a"), ("l_extendedprice", "lineitem"))),
    "preflight_row_counts": with_sql("orders_a", "orders_b") + """, r AS (SELECT (SELECT count(*) FROM orders_a) AS rows_a,
  (SELECT count(*) FROM orders_b) AS rows_b) SELECT *, rows_a <> rows_b AS differ FROM r""",
    "preflight_join_size": f"""{LINEITEM}, r AS (SELECT rows_a, rows_b, (SELECT CAST(count(*) AS DOUBLE) FROM na) / rows_a AS ratio_a,
  (SELECT CAST(count(*) AS DOUBLE) FROM nb) / rows_b AS ratio_b, CAST(rows_a AS DOUBLE) * rows_b AS estimated_rows, joined_rows FROM ov)
SELECT *, (ratio_a < 0.9 OR ratio_b < 0.9) AND estimated_rows > 10000000 AS refused FROM r""",
    "latest_per_key": "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "first_n_rows": "SELECT event_id, ts, user_id FROM events ORDER BY ts, event_id LIMIT 1000",
    "cosine_best_match": f"""{with_sql("embeddings_a", "embeddings_b")},
s AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id,
  list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cosine FROM embeddings_a a, embeddings_b b)
SELECT left_id, right_id, round(cosine, 4) AS cosine FROM s WHERE cosine >= {COSINE_THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY cosine DESC, right_id) = 1""",
    "cosine_of_neighbours": f"""{with_sql("embeddings_a", "embeddings_b")}
SELECT a.vec_id AS left_id, b.vec_id AS right_id,
  round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS cosine
FROM embeddings_a a JOIN embeddings_b b ON b.vec_id = a.vec_id + 1""",
    "review_sample": f"""{ORDERS} SELECT * FROM mm WHERE col_df1 <> '<ROW MISSING>'
ORDER BY md5(concat_ws('|', key_df1, key_df2, col_df1, col_df2, val_df1, val_df2, match_type, '42')) LIMIT 20""",
    "json_array_records": """SELECT o_orderkey AS key, CASE o_orderkey % 7 WHEN 0 THEN 'a"}, {"b' WHEN 1 THEN '][' WHEN 2 THEN concat('{', chr(92))
  ELSE 'plain' END AS note, o_orderstatus AS status, o_orderkey % 5 AS tag FROM orders""",
    "recent_runs": f"{with_sql('run_rows')} SELECT * FROM run_rows ORDER BY ts DESC, run_id DESC LIMIT 20",
    "runs_retention": f"{with_sql('run_rows')} SELECT * FROM run_rows ORDER BY ts DESC, run_id DESC LIMIT 100",
    "run_by_id": f"{with_sql('run_rows')} SELECT * FROM run_rows WHERE run_id = '1997-01-15'",
}
# The same results by another plan.
ORACLE["fuzzy_best_match_table"] = ORACLE["fuzzy_best_match"]
ORACLE["cosine_best_match_blocks"] = ORACLE["cosine_best_match"]
ORACLE["orders_mismatches_by_digest"] = ORACLE["orders_record_mismatches"]
ORACLE["lineitem_mismatches_by_digest"] = ORACLE["lineitem_composite_key_mismatches"]

_BATCH = f"""{ORDERS},
both_wrong AS (SELECT * FROM j WHERE ka = kb AND ({texts_differ("o_orderstatus", "status")}) AND ({texts_differ("o_orderstatus", "priority")})),
batch AS (
  SELECT 'amounts' AS preset, 'records' AS approach, * RENAME (match_type AS kind) FROM mm WHERE col_df1 IN ('<ROW MISSING>', 'o_custkey', 'o_totalprice')
  UNION ALL SELECT 'states', 'records', * FROM mm WHERE col_df1 IN ('<ROW MISSING>', 'o_orderstatus', 'o_totalprice')
  UNION ALL SELECT 'amounts', 'any_of', * REPLACE ('missing_key' AS match_type) FROM mm WHERE col_df1 = '<ROW MISSING>'
  UNION ALL SELECT 'amounts', 'any_of', ka, kb, 'o_orderstatus', 'status', o_orderstatus, status, 'o_orderstatus vs status' FROM both_wrong
  UNION ALL SELECT 'amounts', 'any_of', ka, kb, 'o_orderstatus', 'priority', o_orderstatus, priority, 'o_orderstatus vs priority' FROM both_wrong)"""
ORACLE["preset_batch_mismatches"] = f"{_BATCH} SELECT * FROM batch"
ORACLE["preset_batch_summaries"] = f"""{_BATCH},
per_key AS (SELECT preset, approach, CASE WHEN key_df1 = '<MISSING>' THEN key_df2 ELSE key_df1 END AS k,
  bool_or(col_df1 <> '<ROW MISSING>') AS cell, bool_or(key_df1 = '<MISSING>') AS lone_b, bool_or(key_df2 = '<MISSING>') AS lone_a
  FROM batch GROUP BY ALL),
counted AS (SELECT preset, approach, count(*) AS bad, count(*) FILTER (cell) AS mismatch_count, count(*) FILTER (lone_b) AS missing_in_a,
  count(*) FILTER (lone_a) AS missing_in_b FROM per_key GROUP BY ALL),
-- columns without a mismatch have no weight in the mean
per_column AS (SELECT preset, approach, col_df1, count(DISTINCT key_df1) AS n, CASE WHEN col_df1 = 'o_totalprice' THEN 2.0 ELSE 1.0 END AS w
  FROM batch WHERE col_df1 <> '<ROW MISSING>' AND preset = 'amounts' AND approach = 'records' GROUP BY ALL),
weighed AS (SELECT preset, approach, sum(n * w) / greatest(1.0, sum(w) / count(*)) AS effective FROM per_column GROUP BY ALL)
SELECT preset, approach, round((1 - CAST(bad AS DOUBLE) / total_keys) * 100, 1) AS score,
  round((1 - CAST(effective AS DOUBLE) / total_keys) * 100, 1) AS weighted_score,
  total_keys, joined_count, c.missing_in_a, c.missing_in_b, mismatch_count
FROM counted c LEFT JOIN weighed USING (preset, approach) CROSS JOIN ov"""
ORACLE["titled_files"] = """SELECT CAST(c_custkey AS VARCHAR) AS key, concat(c_mktsegment, ', ', c_nationkey) AS segment, c_name AS name, NULL::VARCHAR AS nation
FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, c_name, CASE WHEN c_custkey % 9 <> 1 THEN CAST(c_nationkey AS VARCHAR) END
FROM customer WHERE c_custkey % 2 = 1"""

_NAMED = BEST_NAMES[:BEST_NAMES.index("SELECT left_name, right_name, score FROM b WHERE")]
ORACLE["hybrid_match"] = f"""{_NAMED},
named AS (SELECT left_name, right_name, score FROM b WHERE score >= 85
  QUALIFY row_number() OVER (PARTITION BY right_name ORDER BY score DESC, left_place) = 1),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT s_name AS left_name, s_suppkey AS place, supp_id, name AS right_name, list_cosine_similarity(x.v, y.v) AS cosine
  FROM supplier_a JOIN e x ON x.vec_id = s_suppkey, supplier_b JOIN e y ON y.vec_id = supp_id + 1),
nearest AS (SELECT * FROM near WHERE cosine >= 0.2 QUALIFY row_number() OVER (PARTITION BY left_name ORDER BY cosine DESC, supp_id) = 1),
free AS (SELECT * FROM nearest WHERE left_name NOT IN (SELECT left_name FROM named) AND right_name NOT IN (SELECT right_name FROM named)
  QUALIFY row_number() OVER (PARTITION BY right_name ORDER BY round(cosine, 4) DESC, place, left_name) = 1)
SELECT left_name, right_name, CAST(score AS DOUBLE) AS score FROM named UNION ALL SELECT left_name, right_name, round(cosine, 4) FROM free"""
ORACLE["written_mismatches"] = f"""{ORDERS} SELECT key_df1, key_df2, col_df1, col_df2, nullif(val_df1, '') AS val_df1, nullif(val_df2, '') AS val_df2, match_type FROM mm"""
ORACLE["written_report"] = f"""{ORDERS}, matched AS (SELECT * FROM j WHERE ka = kb), {_ORDERS_TYPES},
bad AS (SELECT col_df1, count(DISTINCT key_df1) AS n FROM mm WHERE col_df1 <> '<ROW MISSING>' GROUP BY col_df1),
wrong AS (SELECT count(DISTINCT CASE WHEN key_df1 = '<MISSING>' THEN key_df2 ELSE key_df1 END) AS n FROM mm)
SELECT col_a, col_b, mode, n AS mismatches, round((1.0 - CAST(n AS DOUBLE) / (SELECT joined_count FROM ov)) * 100.0, 6) AS score,
  (SELECT round((1.0 - CAST(n AS DOUBLE) / total_keys) * 100.0, 1) FROM wrong, ov) AS run_score
FROM types LEFT JOIN bad ON col_a = col_df1"""
ORACLE["sql_with_clause"] = """SELECT o_orderpriority, count(*) AS n_orders, CAST(sum(n_lines) AS BIGINT) AS n_lines
FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines, max(l_quantity) AS most FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
WHERE o_totalprice > 100000 AND most >= 40 GROUP BY o_orderpriority"""
