"""Market files and landed stream messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.decimals import AMOUNT, mid_price, notional, taker_side

TRADE_SCHEMA = "a long, p string, q string, T long, m boolean"
DERIVATIVE_SCHEMA = (
    "symbol string, sumOpenInterest string, sumOpenInterestValue string, buySellRatio string, sellVol string, "
    "buyVol string, longAccount string, longShortRatio string, shortAccount string, timestamp long"
)


def read_klines(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """One file per array of 12-element klines: close price at close time, side UNKNOWN.

    A file is one JSON array, so it is parsed from text and exploded; many files spread over tasks.
    """
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "array<array<string>>")).alias("k"))
    return klines(rows, F.lit(asset))


def klines(rows: DataFrame, asset: Column) -> DataFrame:
    """Arrays ``k`` of kline fields to price observations."""
    k = F.col("k")
    close = k[6].cast("long")
    return rows.select(
        F.concat(asset, F.lit(":kline:"), k[0]).alias("id"),
        asset.alias("asset"),
        F.lit("PRICE_REFERENCE").alias("market_role"),
        F.lit("KLINE_CLOSE").alias("observation_kind"),
        close.alias("event_ms"),
        close.alias("received_ms"),
        k[4].cast(AMOUNT).alias("price"),
        k[5].cast(AMOUNT).alias("quantity"),
        F.lit("UNKNOWN").alias("side"),
        k[0].cast("long").alias("sequence"),
    )


def read_agg_trades(spark: SparkSession, path: str, asset: str) -> DataFrame:
    """JSON array files or JSON lines of aggregate trades."""
    return agg_trades(spark.read.schema(TRADE_SCHEMA).option("multiLine", True).json(path), F.lit(asset))


def agg_trades(rows: DataFrame, asset: Column) -> DataFrame:
    """``m`` (buyer is maker) means the taker sold."""
    return rows.select(
        F.concat(asset, F.lit(":aggTrade:"), F.col("a")).alias("id"),
        asset.alias("asset"),
        F.lit("ORDER_FLOW_REFERENCE").alias("market_role"),
        F.lit("AGGREGATE_TRADE").alias("observation_kind"),
        F.col("T").alias("event_ms"),
        F.col("T").alias("received_ms"),
        F.col("p").cast(AMOUNT).alias("price"),
        F.col("q").cast(AMOUNT).alias("quantity"),
        taker_side(F.col("m")).alias("side"),
        F.col("a").alias("sequence"),
    )


def read_derivatives(spark: SparkSession, path: str) -> DataFrame:
    """Five-minute open interest and ratio series."""
    raw = spark.read.schema(DERIVATIVE_SCHEMA).option("multiLine", True).json(path)
    wide = "decimal(28,8)"
    return raw.select(
        "symbol",
        F.col("timestamp").alias("observed_ms"),
        F.col("timestamp").alias("received_ms"),
        F.col("sumOpenInterest").cast(wide).alias("open_interest"),
        F.col("sumOpenInterestValue").cast(wide).alias("open_interest_value"),
        F.col("buySellRatio").cast(wide).alias("taker_ratio"),
        F.col("longShortRatio").cast(wide).alias("position_ratio"),
    )


def parse_stream_messages(messages: DataFrame, assets: dict[str, str], text: str = "message") -> DataFrame:
    """Landed JSON messages (bare or in a ``{stream, data}`` envelope) to ticks.

    ``messages``: the text and ``received_ms``.  ``assets`` maps symbols to assets; messages with
    other symbols or broken fields get ``tick_error`` and null fields.
    """
    body = F.coalesce(F.get_json_object(text, "$.data"), F.col(text))
    parsed = (
        messages.withColumn("__body", body)
        # keys differ only by case (a/A, m/M), so they are read as a map, not as struct fields
        .withColumn("__m", F.from_json("__body", "map<string,string>"))
        .withColumn("__kind", F.col("__m")["e"])
    )
    field = F.col("__m")
    trade = F.coalesce(F.col("__kind") == "aggTrade", F.lit(False))
    symbol = field["s"]
    sequence = F.when(trade, field["a"].try_cast("long")).otherwise(field["u"].try_cast("long"))
    asset = F.lit(None).cast("string")
    for name, value in assets.items():
        asset = F.when(symbol == name, value).otherwise(asset)
    kind = F.when(trade, "aggTrade").otherwise("bookTicker")
    price, quantity = field["p"].try_cast(AMOUNT), field["q"].try_cast(AMOUNT)
    bid, ask = field["b"].try_cast(AMOUNT), field["a"].try_cast(AMOUNT)
    traded_ms, quoted_ms = field["T"].try_cast("long"), field["E"].try_cast("long")
    maker = field["m"].try_cast("boolean")
    short = F.when(trade, "agg").otherwise("book")
    needed = F.when(
        trade, price.isNotNull() & quantity.isNotNull() & traded_ms.isNotNull() & maker.isNotNull()
    ).otherwise(bid.isNotNull() & ask.isNotNull())
    usable = F.coalesce(asset.isNotNull() & (sequence >= 0) & needed, F.lit(False))

    def only(condition: Column, value: Column) -> Column:
        return F.when(usable & condition, value)

    known_kind = F.col("__kind").isNull() | F.col("__kind").isin("aggTrade", "bookTicker")
    return parsed.select(
        *messages.columns,
        F.when(usable & known_kind, F.when(trade, "AGG_TRADE").otherwise("BOOK_TICKER")).alias("kind"),
        F.when(usable, F.concat_ws("-", F.lower(symbol), short, sequence)).alias("id"),
        asset.alias("asset"),
        symbol.alias("symbol"),
        kind.alias("stream_kind"),
        F.when(usable, F.concat_ws(":", symbol, kind, sequence)).alias("dedup_key"),
        sequence.alias("sequence"),
        only(trade, price).alias("price"),
        only(trade, quantity).alias("quantity"),
        only(trade, notional(price, quantity)).alias("quote_notional"),
        only(trade, taker_side(maker)).alias("side"),
        only(~trade, bid).alias("bid_price"),
        only(~trade, ask).alias("ask_price"),
        only(~trade, mid_price(bid, ask)).alias("mid_price"),
        F.when(trade, traded_ms).otherwise(F.coalesce(quoted_ms, F.col("received_ms"))).alias("event_ms"),
        (trade | quoted_ms.isNotNull()).alias("latency_measurable"),
        F.when(~(usable & known_kind), "INVALID_MESSAGE").alias("tick_error"),
    )


def merge_pages_by_id(pages: DataFrame, row_id: str, page: str, at: str, start_ms: int, end_ms: int) -> DataFrame:
    """Overlapping page reads to one row per id: the last page wins, inside [start, end]."""
    rest = [c for c in pages.columns if c != row_id]
    return (
        pages.filter(F.col(at).between(start_ms, end_ms))
        .groupBy(row_id)
        .agg(F.max_by(F.struct(*rest), page).alias("__r"))
        .select(row_id, "__r.*")
    )


def received_through(df: DataFrame, until_ms: int, received: str, row_id: str) -> DataFrame:
    """Rows received by the instant in (received, id) order."""
    return df.filter(F.col(received) <= until_ms).orderBy(received, row_id)
