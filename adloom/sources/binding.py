"""Items, users and the search log as the library's schemas, from star-schema tables.

The statements run as they are in Spark and in DuckDB, so that a check reads the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = """
SELECT p_partkey AS item_id, p_name AS item_title,
  CASE WHEN p_partkey % 5 = 0 THEN '无品牌' ELSE p_brand END AS brand_name,
  s_name AS seller_name, p_type AS category_level1_name,
  CASE WHEN p_size % 7 = 0 THEN 'UNKNOWN' ELSE concat('size-', CAST(p_size AS STRING)) END AS category_level2_name,
  ascii(p_type) AS category_level1_id, p_size AS category_level2_id, CAST(p_partkey % 97 AS INT) AS category_level3_id
FROM {part} LEFT JOIN {supplier} ON s_suppkey = p_partkey % 100"""

USERS = """
SELECT c_custkey AS user_id,
  CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS gender,
  CASE c_custkey % 8 WHEN 0 THEN '0-11' WHEN 1 THEN '12-17' WHEN 2 THEN '18-23' WHEN 3 THEN '24-30'
    WHEN 4 THEN '31-40' WHEN 5 THEN '41-49' WHEN 6 THEN '50+' END AS age_bucket,
  n_name AS fre_city, r_name AS fre_province
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey"""

LOG = """
SELECT md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))) AS seq,
  CASE WHEN l_linenumber = 7 THEN concat(p_name, ' ', p_brand, ' ', p_type)
    WHEN l_linenumber = 6 THEN split_part(p_name, ' ', 1)
    WHEN l_linenumber % 4 = 0 THEN concat('#', p_name)
    WHEN l_linenumber % 4 = 1 THEN concat('"', p_name)
    WHEN l_linenumber % 4 = 2 THEN concat('  ', p_name, ' ”') ELSE p_name END AS query,
  o_custkey AS user_id, l_orderkey AS session_id, l_partkey AS item_id,
  CASE WHEN l_returnflag IN ('A','R') THEN 1 ELSE 0 END AS is_clicked,
  CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_purchased,
  CAST(l_quantity AS BIGINT) AS show_cnt, CAST(l_linenumber AS BIGINT) AS click_cnt,
  CAST(round(l_tax * 100) AS BIGINT) AS order_cnt, l_shipdate AS shown_at,
  CASE WHEN l_shipdate >= TIMESTAMP '2001-01-01 00:00:00' THEN 'test' ELSE 'train' END AS split
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey"""

TABLES = ("part", "supplier", "customer", "nation", "region", "lineitem", "orders")
#: The key on which the log's two large tables meet, by table.
SESSION = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def _bound(spark: SparkSession, sf_dir: str, statement: str, narrowed: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> DataFrame:
    used = {t: narrowed(t, spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES if "{" + t + "}" in statement}
    return spark.sql(statement, **used)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, ITEMS)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, USERS)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, LOG)


def log_parts(spark: SparkSession, sf_dir: str, n: int) -> Iterator[DataFrame]:
    """The log in n parts, by a hash of the session; together they are log()."""
    for i in range(n):
        here = lambda t, df: df.where(F.pmod(F.xxhash64(F.col(SESSION[t]).cast("bigint")), F.lit(n)) == i) if t in SESSION else df  # noqa: E731, B023
        yield _bound(spark, sf_dir, LOG, here)


def as_sql(statement: str) -> str:
    """The statement over tables by name."""
    return statement.format(**{t: t for t in TABLES})
