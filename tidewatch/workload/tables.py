"""Roles the given tables play, in Spark and in SQL.

``events`` are ticks: key = ``event_type`` (view, click and signup are reference assets, purchase the
target), received up to six seconds after the event, quantity and side derived from the other
columns.  The SQL text of every role states the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import to_ms

REFERENCES = ("view", "click", "signup")
TARGET = "purchase"
ASSETS = (*REFERENCES, TARGET)
HOUR = 3_600_000
DAY = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    event_ms = to_ms(F.col("ts"))
    return e.select(
        F.col("event_type").alias("asset"),
        F.col("event_id").alias("id"),
        event_ms.alias("event_ms"),
        (event_ms + F.pmod("event_id", F.lit(7)) * 1000).alias("received_ms"),
        F.col("value").cast("decimal(20,8)").alias("price"),
        F.when(F.pmod(k, F.lit(13)) != 0, (F.pmod("user_id", F.lit(9)) + 1).cast("decimal(20,8)")).alias("quantity"),
        F.when(F.pmod(k, F.lit(10)) == 0, "UNKNOWN").when(F.pmod(k, F.lit(2)) == 0, "BUY").otherwise("SELL").alias("side"),
    )


TICKS_SQL = """ticks AS (
  SELECT event_type AS asset, event_id AS id, (epoch_us(ts) // 1000) AS event_ms,
         (epoch_us(ts) // 1000) + (event_id % 7) * 1000 AS received_ms,
         CAST(value AS DECIMAL(20,8)) AS price,
         CASE WHEN k % 13 <> 0 THEN CAST(user_id % 9 + 1 AS DECIMAL(20,8)) END AS quantity,
         CASE WHEN k % 10 = 0 THEN 'UNKNOWN' WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""


def grid_sql(step_ms: int, assets: tuple[str, ...] | None = None, time: str = "received_ms") -> str:
    """Grid rows over the ticks, for the keys they have or those listed: from the first time rounded down to the last."""
    keys = "(SELECT DISTINCT asset FROM ticks)" if assets is None else "(VALUES " + ", ".join(f"('{a}')" for a in assets) + ")"
    return f"""bounds AS (SELECT (min({time}) // {step_ms}) * {step_ms} AS s, max({time}) AS e FROM ticks),
grid AS (SELECT asset, unnest(generate_series(s, e, {step_ms})) AS as_of_ms
         FROM bounds, {keys} v(asset))"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as trades per return flag: price per unit, quantity, ship time."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("asset"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        to_ms(F.col("l_shipdate")).alias("event_ms"),
        to_ms(F.col("l_shipdate")).alias("received_ms"),
        (F.col("l_extendedprice").cast("decimal(20,2)") / F.col("l_quantity").cast("decimal(10,0)")).cast("decimal(20,8)").alias("price"),
        F.col("l_quantity").cast("decimal(20,8)").alias("quantity"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
    )
