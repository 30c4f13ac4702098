"""Dirty inputs made from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS = r"""
SELECT o_orderkey AS order_id, o_custkey AS cust_id, o_totalprice AS total, o_orderdate AS placed, o_orderstatus AS status, o_orderpriority AS priority,
  CASE o_orderkey % 7 WHEN 0 THEN '$' || n WHEN 1 THEN n || ' USD' WHEN 2 THEN k || 'k' WHEN 3 THEN 'N/A' WHEN 4 THEN 'abc' WHEN 5 THEN '-' || n ELSE n END AS price_txt,
  CASE o_orderkey % 4 WHEN 0 THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') WHEN 1 THEN m || '/' || d || '/' || y WHEN 2 THEN y || '/' || lpad(m, 2, '0') || '/' || lpad(d, 2, '0') ELSE '00/00/0000' END AS date_txt,
  CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'N' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' ELSE NULL END AS flag_txt,
  CASE o_orderkey % 5 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN '  ' || o_orderpriority || ' ' WHEN 3 THEN replace(o_orderpriority, '-', ' ') ELSE o_orderpriority END AS prio_txt,
  CASE o_orderkey % 5 WHEN 0 THEN '+91 ' || lpad(c, 10, '9') WHEN 1 THEN '(934) 854-' || lpad(c, 4, '0') WHEN 2 THEN lpad(c, 10, '8') WHEN 3 THEN '12-34' ELSE 'none' END AS phone_txt,
  CASE o_orderkey % 4 WHEN 0 THEN 'User' || c || '@Mail.COM' WHEN 1 THEN 'x@' WHEN 2 THEN 'a.b@c.d' ELSE NULL END AS email_txt,
  CASE o_orderkey % 5 WHEN 0 THEN '15%' WHEN 1 THEN '15 %' WHEN 2 THEN '0.15' WHEN 3 THEN '15' ELSE 'x%' END AS pct_txt,
  CASE o_orderkey % 5 WHEN 0 THEN '4.5/5' WHEN 1 THEN '8/10' WHEN 2 THEN '3' WHEN 3 THEN 'rated 2.5 of 5' ELSE 'great' END AS rating_txt,
  CASE o_orderkey % 4 WHEN 0 THEN '5''7"' WHEN 1 THEN '5 ft 11 in' WHEN 2 THEN '6''' ELSE 'tall' END AS height_txt,
  CASE o_orderkey % 4 WHEN 0 THEN '159lbs' WHEN 1 THEN '72kg' WHEN 2 THEN '72.5 KG' ELSE 'heavy' END AS weight_txt,
  CASE o_orderkey % 4 WHEN 0 THEN '  two   words ' WHEN 1 THEN 'caf' || chr(233) || ' #' || c WHEN 2 THEN 'line' || chr(10) || 'break' || chr(13) || chr(10) || 'x' ELSE '' END AS text_txt,
  CASE o_orderkey % 6 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN ' n/a ' WHEN 2 THEN '' WHEN 3 THEN '-' WHEN 4 THEN 'error' ELSE o_orderstatus END AS mark_txt,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(floor(o_totalprice) AS bigint) END AS amount,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status_gap,
  CASE o_orderkey % 4 WHEN 0 THEN '-0.5' WHEN 1 THEN '1.5' WHEN 2 THEN '2.5' ELSE 'q' END AS half_txt,
  CASE o_orderkey % 3 WHEN 0 THEN '550e8400-e29b-41d4-a716-44665544' || lpad(cast(o_orderkey % 10000 AS string), 4, '0') WHEN 1 THEN 'US' ELSE 'AB-1234' END AS code_txt
FROM (SELECT *, cast(cast(floor(o_totalprice) AS bigint) AS string) AS n, cast(cast(floor(o_totalprice / 1000) AS bigint) AS string) AS k, cast(o_custkey AS string) AS c,
  cast(year(o_orderdate) AS string) AS y, cast(month(o_orderdate) AS string) AS m, cast(day(o_orderdate) AS string) AS d FROM {t}) AS source
"""

#: Orders with copies of every tenth, and every fiftieth repeated with another status; ``row_no`` keeps the order.
REPEATED = r"""
SELECT o_orderkey AS order_id, o_orderstatus AS status, o_custkey AS cust_id, o_orderkey * 3 AS row_no FROM {t}
UNION ALL SELECT o_orderkey, o_orderstatus, o_custkey, o_orderkey * 3 + 1 FROM {t} WHERE o_orderkey % 10 = 0
UNION ALL SELECT o_orderkey, 'X', o_custkey, o_orderkey * 3 + 2 FROM {t} WHERE o_orderkey % 50 = 0
UNION ALL SELECT NULL, o_orderstatus, o_custkey, o_orderkey * 3 + 2 FROM {t} WHERE o_orderkey % 100 = 1
"""


def dirty(spark: SparkSession, sf_dir: str, sql: str, table: str = "orders") -> DataFrame:
    return spark.sql(sql.format(t=f"parquet.`{sf_dir}/{table}.parquet`"))


def duck(sql: str, table: str = "orders") -> str:
    return sql.format(t=table)
