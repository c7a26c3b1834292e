"""Registry of checked queries: a Spark plan and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.text import LEADING, TRAILING
from adloom.operators import evidence as E
from adloom.sources import binding
from adloom.sources.stored import dropped, stored_parts, stored_slices

#: Log rows that are shuffled at a time, as long as that takes no more rounds than MOST_ROUNDS.
ROUND_ROWS, MOST_ROUNDS = 4_000_000, 12

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def checked(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, sf_dir) -> DataFrame:
    return E.canonical_items(binding.items(spark, sf_dir))


def users(spark, sf_dir) -> DataFrame:
    return E.canonical_users(binding.users(spark, sf_dir))


def log(spark, sf_dir) -> DataFrame:
    return binding.log(spark, sf_dir)


def history(spark, sf_dir, last: int = 40) -> DataFrame:
    """user_id, recently_clicked_item_ids: a user's last items by time, at most `last` (the log's own window)."""
    return last_items(log(spark, sf_dir), last)


def last_items(rows: DataFrame, last: int = 40) -> DataFrame:
    """history() of log rows that hold all rows of their users."""
    from pyspark.sql.window import Window

    rows = rows.select("user_id", "item_id", "shown_at", "seq")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("shown_at"), F.desc("seq")))
    recent = rows.withColumn("back", place).where(F.col("back") <= last)
    return recent.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("b"), "item_id"))), lambda x: x["item_id"]).alias("recently_clicked_item_ids")
    ).withColumn("recently_purchased_item_ids", F.array().cast("array<bigint>"))


def user_slices(spark, sf_dir, *columns: str) -> list[DataFrame]:
    """Columns of the log, stored in slices of its users. The joins behind it run session by session group, the plans on a
    slice run one after the other, so what is shuffled at a time is a share of the log."""
    n = max(1, min(MOST_ROUNDS, -(-table(spark, sf_dir, "lineitem").count() // ROUND_ROWS)))
    return stored_slices((part.select(*columns) for part in binding.log_parts(spark, sf_dir, n)), "log", "user_id", n)


def emptied(slices: list[DataFrame]) -> Iterator[DataFrame]:
    """Each slice in turn; it is removed when the next one is asked for."""
    for rows in slices:
        yield rows
        dropped(rows)


def stored_history(spark, sf_dir, last: int = 40) -> DataFrame:
    """history(), made slice by slice of the users and stored."""
    slices = user_slices(spark, sf_dir, "user_id", "item_id", "shown_at", "seq")
    return stored_parts((last_items(rows, last) for rows in emptied(slices)), "history")


def behavior(spark, sf_dir, last: int = 40) -> DataFrame:
    """user_id, recently_clicked_item_ids, recently_purchased_item_ids: a user's last clicked and last purchased items by time."""
    from pyspark.sql.window import Window

    def recent(flag: str, name: str) -> DataFrame:
        rows = log(spark, sf_dir).where(F.col(flag) == 1).select("user_id", "item_id", "shown_at", "seq")
        place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("shown_at"), F.desc("seq")))
        kept = rows.withColumn("back", place).where(F.col("back") <= last)
        return kept.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("b"), "item_id"))), lambda x: x["item_id"]).alias(name))

    return recent("is_clicked", "recently_clicked_item_ids").join(recent("is_purchased", "recently_purchased_item_ids"), "user_id", "full")


# SQL pieces


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[](){}\\" else c for c in chars) + "]"


def norm(c: str) -> str:
    one = f"regexp_replace(trim({c}), '\\s+', ' ', 'g')"
    body = f"regexp_replace({one}, {quoted('^(?:' + _class(LEADING) + ' *)+')}, '')"
    body = f"regexp_replace({body}, {quoted('(?: *' + _class(TRAILING) + ')+$')}, '')"
    return f"coalesce(nullif(trim({body}), ''), trim({c}))"


def compare(c: str) -> str:
    return f"lower(regexp_replace(trim(coalesce({c}, '')), '[^0-9a-zA-Z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g'))"


def chunk4(c: str) -> str:
    return f"regexp_extract_all({c}, '[A-Za-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]{{1,4}}')"


def unigram(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]')"


WITH_ITEMS = f"""raw_items AS ({binding.as_sql(binding.ITEMS)}),
items AS (SELECT item_id, trim(coalesce(item_title, '')) AS item_title, trim(coalesce(brand_name, '')) AS brand_name,
  trim(coalesce(seller_name, '')) AS seller_name,
  concat_ws(' > ', nullif(trim(category_level1_name), ''), CASE WHEN upper(trim(category_level2_name)) <> 'UNKNOWN' THEN nullif(trim(category_level2_name), '') END) AS category_path,
  category_level1_id, category_level2_id, category_level3_id
  FROM raw_items WHERE item_id > 0)"""
WITH_USERS = f"""raw_users AS ({binding.as_sql(binding.USERS)}),
users AS (SELECT user_id, coalesce(gender, '') AS gender, coalesce(age_bucket, '') AS age_bucket, fre_city AS city, fre_province AS province
  FROM raw_users WHERE user_id > 0)"""
WITH_LOG = f"""log AS ({binding.as_sql(binding.LOG)}),
pos AS (SELECT *, 5000 * is_purchased + 2000 * is_clicked + show_cnt + 10 * click_cnt + 50 * order_cnt AS signal FROM
  (SELECT * REPLACE (trim(query) AS query) FROM log) WHERE query <> '' AND (is_clicked = 1 OR is_purchased = 1) AND item_id > 0)"""
WITH_STATS = """stats AS (SELECT query, item_id, sum(is_purchased)::BIGINT AS purchase_cnt, sum(is_clicked)::BIGINT AS item_click_cnt, sum(signal)::BIGINT AS signal
  FROM pos GROUP BY ALL),
best AS (SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY query ORDER BY signal DESC, is_purchased DESC, is_clicked DESC, item_id, seq) = 1)"""
WITH_EVIDENCE = """ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY signal DESC, purchase_cnt DESC, item_click_cnt DESC, item_id) AS pos FROM stats),
evidence AS (SELECT query, pos, r.item_id, coalesce(item_title, '') AS item_title, coalesce(brand_name, '') AS brand_name, coalesce(seller_name, '') AS seller_name,
  coalesce(category_path, '') AS category_path, purchase_cnt, item_click_cnt AS click_cnt, round(signal / 1000.0, 6) AS ranking_signal,
  CASE WHEN purchase_cnt > 0 THEN 2 ELSE 1 END AS relevance_signal
  FROM ranked r LEFT JOIN items i ON i.item_id = r.item_id WHERE pos <= 3)"""
WITH_HISTORY = """recent AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY shown_at DESC, seq DESC) AS back FROM log QUALIFY back <= 40)"""
#: behaved: the titles of the last clicked, then the last purchased items of a query's best row.
WITH_BEHAVIOR = """clicked AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY shown_at DESC, seq DESC) AS back FROM log WHERE is_clicked = 1 QUALIFY back <= 40),
bought AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY shown_at DESC, seq DESC) AS back FROM log WHERE is_purchased = 1 QUALIFY back <= 40),
acted AS (SELECT b.query, c.item_id, -back AS at_place FROM best b JOIN clicked c ON c.user_id = b.user_id UNION ALL SELECT b.query, o.item_id, 1000 - back FROM best b JOIN bought o ON o.user_id = b.user_id),
titled AS (SELECT query, item_title, min(at_place) AS at_place FROM acted JOIN items USING (item_id) WHERE item_title <> '' GROUP BY ALL),
behaved AS (SELECT query, list(item_title ORDER BY at_place) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY at_place) AS n FROM titled) WHERE n <= 5 GROUP BY query)"""
#: Everything the evidence queries need.
WITH_ALL = ",\n".join((WITH_ITEMS, WITH_USERS, WITH_LOG, WITH_STATS, WITH_EVIDENCE, WITH_HISTORY))
