"""A/B table pairs derived from the test tables by SQL that Spark and DuckDB read alike.

Doubles become text only through DECIMAL(18,2), and white space stays ASCII.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

DERIVED = {
    "orders_a": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate
FROM orders WHERE o_orderkey % 31 <> 0""",
    "orders_b": """
SELECT concat(' ', CAST(o_orderkey AS STRING), ' ') AS order_id,
  CAST(o_custkey AS STRING) AS customer,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN '   '
       WHEN o_orderkey % 47 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 53 = 0 THEN 'X'
       ELSE concat(o_orderstatus, ' ') END AS status,
  CASE WHEN o_orderkey % 37 = 0 THEN CAST(CAST(o_totalprice + 10 AS DECIMAL(18,2)) AS STRING)
       WHEN o_orderkey % 59 = 0 THEN 'N/A'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS total,
  CASE WHEN o_orderkey % 61 = 0 THEN '9-OTHER' ELSE o_orderpriority END AS priority
FROM orders WHERE o_orderkey % 29 <> 0""",
    "lineitem_a": """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem""",
    "lineitem_b": """
SELECT l_orderkey AS order_id, l_linenumber AS line_no,
  CASE WHEN l_partkey % 37 = 0 THEN l_quantity + 1 ELSE l_quantity END AS qty,
  CASE WHEN l_partkey % 41 = 0 THEN l_extendedprice * 1.000005 ELSE l_extendedprice END AS price,
  CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE lower(l_returnflag) END AS flag
FROM lineitem WHERE l_orderkey % 23 <> 0""",
    "customer_a": """
SELECT concat('C', lpad(CAST(c_custkey AS STRING), 6, '0')) AS cust_id,
  lpad(CAST(c_custkey % 1000 AS STRING), 5, '0') AS zip, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS nation
FROM customer""",
    "customer_b": """
SELECT concat(CASE WHEN c_custkey % 5 = 0 THEN 'c' ELSE 'C' END, lpad(CAST(c_custkey AS STRING), 6, '0')) AS cust_id,
  CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey % 1000 AS STRING) ELSE lpad(CAST(c_custkey % 1000 AS STRING), 5, '0') END AS zip,
  CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END AS balance,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'NULL' ELSE concat(' ', lower(c_mktsegment)) END AS segment,
  CAST(c_nationkey AS STRING) AS nation, CAST(NULL AS STRING) AS empty_col
FROM customer WHERE c_custkey % 13 <> 0""",
    "part_a": """
SELECT p_partkey, p_type AS code, p_size AS size FROM part""",
    "part_b": """
SELECT p_partkey AS part_id,
  CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'NONE' END AS code1,
  CASE WHEN p_partkey % 3 = 1 THEN lower(p_type) ELSE NULL END AS code2,
  CASE WHEN p_partkey % 3 = 2 AND p_partkey % 17 <> 0 THEN concat(p_type, ' ') ELSE '' END AS code3,
  CASE WHEN p_partkey % 19 = 0 THEN p_size + 1 ELSE p_size END AS size_b
FROM part WHERE p_partkey % 29 <> 0""",
    "order_csv_lines": """
SELECT CASE WHEN o_orderkey % 50 = 0 THEN concat(CAST(o_orderkey AS STRING), ',x,1,EXTRA') WHEN o_orderkey % 60 = 7 THEN CAST(o_orderkey AS STRING)
  ELSE concat(CAST(o_orderkey AS STRING), ',', chr(34), o_orderpriority, ', ', chr(34), chr(34), o_orderstatus, chr(34), chr(34), chr(34), ',', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) END AS value
FROM orders""",
    "applicant_lines": """
SELECT c_custkey, substring(repeat(concat(CAST(c_custkey AS STRING), '  ', lower(c_mktsegment), ' ', c_name, ' '), 8), 1, 203) AS line FROM customer""",
    "order_record_lines": """
SELECT 'orders' AS file, o_orderkey * 4 + pos AS at, CAST(floor((o_orderkey * 4 + pos) / 1999) AS BIGINT) AS block, value
FROM (SELECT o_orderkey, posexplode(split(CASE
  WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_orderkey AS STRING), ',', chr(34), o_orderpriority, chr(10), 'said ', chr(34), chr(34), o_orderstatus, ',', chr(34), chr(34),
    chr(10), chr(10), 'end', chr(34), ',', CAST(o_custkey AS STRING))
  ELSE concat(CAST(o_orderkey AS STRING), ',5', chr(34), ' ', o_orderstatus, ',', CAST(o_custkey AS STRING)) END, chr(10))) AS (pos, value) FROM orders)""",
    "customer_tsv_lines": """
SELECT concat(CAST(c_custkey AS STRING), chr(9), c_name, chr(9), CASE WHEN c_custkey % 9 = 0 THEN concat(c_mktsegment, chr(9), 'more') ELSE c_mktsegment END) AS value
FROM customer""",
    "titled_lines": """
SELECT CAST(n_nationkey AS BIGINT) AS line_no, CASE WHEN n_nationkey < 3 THEN 'A title, with a comma'
  WHEN n_nationkey = 3 THEN 'key|name|region|' ELSE concat(CAST(n_nationkey AS STRING), '|', n_name, '|') END AS value
FROM nation""",
    # two files of customers: other titles, delimiters and columns, both with a total line; keys count up from 0
    "customer_files": """
SELECT file, CAST(floor((at + 3) / 97) AS BIGINT) AS block, at, value FROM (
  SELECT 'east' AS file, CAST(floor(c_custkey / 2) AS BIGINT) + 1 AS at,
    concat(CAST(c_custkey AS STRING), ',', chr(34), c_mktsegment, ', ', CAST(c_nationkey AS STRING), chr(34), ',', c_name) AS value
  FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'west', CAST(floor(c_custkey / 2) AS BIGINT) AS at,
    concat(c_name, '|', CASE WHEN c_custkey % 9 = 1 THEN '' ELSE CAST(c_nationkey AS STRING) END, '|', CAST(c_custkey AS STRING))
  FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT 'west', CAST(count(*) AS BIGINT), concat('total|', CAST(count(*) AS STRING)) FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT 'east', CAST(count(*) AS BIGINT) + 1, concat('total,', CAST(count(*) AS STRING)) FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'east', CAST(-2 AS BIGINT), 'Customers' UNION ALL SELECT 'east', CAST(-1 AS BIGINT), 'East, all'
  UNION ALL SELECT 'east', CAST(0 AS BIGINT), 'key,"segment, nation",name'
  UNION ALL SELECT 'west', CAST(-1 AS BIGINT), 'name| nation |key')""",
    "like_keys_a": """
SELECT CASE WHEN p_partkey % 10 = 8 THEN NULL WHEN p_partkey % 10 = 9 THEN '<NULL>' WHEN p_partkey % 2 = 0 THEN concat(q, '|y') ELSE q END AS k1,
  CASE WHEN p_partkey % 10 >= 8 THEN q WHEN p_partkey % 2 = 0 THEN 'z' ELSE 'y|z' END AS k2, p_size AS size, p_partkey AS part
FROM (SELECT p_partkey, p_size, CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS q FROM part) AS p""",
    "like_keys_b": """
SELECT CASE WHEN p_partkey % 10 = 8 THEN NULL WHEN p_partkey % 10 = 9 THEN '<NULL>' WHEN p_partkey % 2 = 0 THEN concat(q, '|y') ELSE q END AS k1,
  CASE WHEN p_partkey % 10 >= 8 THEN q WHEN p_partkey % 2 = 0 THEN 'z' ELSE 'y|z' END AS k2,
  CASE WHEN p_partkey % 7 < 2 THEN p_size + 1 ELSE p_size END AS size, p_partkey AS part
FROM (SELECT p_partkey, p_size, CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS q FROM part WHERE p_partkey % 11 <> 0) AS p""",
    "supplier_a": """
SELECT s_suppkey, s_name FROM supplier""",
    "supplier_b": """
SELECT s_suppkey AS supp_id,
  CASE WHEN s_suppkey % 3 = 0 THEN concat(substr(s_name, 10), ' SUPPLIER') WHEN s_suppkey % 7 = 0 THEN 'Unrelated Company'
       ELSE concat(s_name, ' Ltd') END AS name
FROM supplier""",
    "embeddings_a": """
SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = 0""",
    "embeddings_b": """
SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = 1""",
    # one history row per order day, a fixed-width line per customer, and prices written the European way
    "run_rows": """
SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS run_id, o_orderdate AS ts, 'record' AS approach,
  count(*) AS total_keys, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS mismatch_count
FROM orders GROUP BY o_orderdate""",
    # one JSON array over all orders, whose strings hold quotes, brackets and braces, in pieces that end at each brace; braces are doubled for the
    # formatter of spark.sql
    "order_json_pieces": """
SELECT 'orders.json' AS file, (o_orderkey * 3 + pos) div 1000 AS block, o_orderkey * 3 + pos AS at, value FROM (
  SELECT o_orderkey, posexplode(slice(split(concat(CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN '[' ELSE ',' END,
    chr(10), ' {{"key": ', o_orderkey, ', "note": "', CASE WHEN o_orderkey % 7 = 0 THEN concat('a', chr(92), '"}}, {{', chr(92), '"b') WHEN o_orderkey % 7 = 1 THEN ']['
      WHEN o_orderkey % 7 = 2 THEN concat('{{', chr(92), chr(92)) ELSE 'plain' END,
    '", "of": {{"status": "', o_orderstatus, '", "tags": [', o_orderkey % 5, ', 1]', chr(10), '}}}}'), '[}}]'), 1, 3
    + CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE -1 END)) AS (pos, value) FROM orders)
UNION ALL SELECT 'orders.json', (max(o_orderkey) * 3 + 3) div 1000, max(o_orderkey) * 3 + 3, ']' FROM orders""",
    "customer_lines": """
SELECT concat(lpad(CAST(c_custkey AS STRING), 8, '0'), rpad(CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment END, 12, ' '),
  lpad(CASE WHEN c_custkey % 10 = 0 THEN 'NA' ELSE CAST(c_nationkey AS STRING) END, 4, ' ')) AS value
FROM customer""",
    "european_prices": """
SELECT l_orderkey, l_linenumber, l_extendedprice, concat(
  CASE WHEN l_extendedprice >= 1000 THEN concat(CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING), '.',
    lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS STRING), 3, '0'))
  ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END,
  ',', right(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), 2)) AS price_text
FROM lineitem""",
}

KEYS = {
    "orders": [("o_orderkey", "order_id")],
    "lineitem": [("l_orderkey", "order_id"), ("l_linenumber", "line_no")],
    "customer": [("cust_id", "cust_id")],
    "part": [("p_partkey", "part_id")],
    "supplier": [("s_suppkey", "supp_id")],
}

COLUMNS = {
    "orders": {"o_custkey": "customer", "o_orderstatus": "status", "o_totalprice": "total", "o_orderpriority": "priority"},
    "lineitem": {"l_quantity": "qty", "l_extendedprice": "price", "l_returnflag": "flag"},
    "customer": {"zip": "zip", "balance": "balance", "segment": "segment", "nation": "nation"},
    "part": {"code": ["code1", "code2", "code3"], "size": ["size_b"]},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table by name; only the test table it reads is opened."""
    sql = DERIVED[name]
    base = next(t for t in TABLES if f"FROM {t}" in sql)
    return spark.sql(sql.replace(f"FROM {base}", "FROM {base_table}"), base_table=table(spark, sf_dir, base))


def side_pair(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Source A and source B of a pair: orders, lineitem, customer, part, supplier, embeddings."""
    return derived(spark, sf_dir, f"{name}_a"), derived(spark, sf_dir, f"{name}_b")


def with_sql(*names: str) -> str:
    """The derived tables as a WITH clause for the oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n]}\n)" for n in names)
