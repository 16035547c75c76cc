"""Column expressions, contracts and landed messages over the given tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import decimals, hashing, knowledge, progress, times
from tidewatch.functions import text as rules_text
from tidewatch.operators import features, validation
from tidewatch.sources import evidence, market
from tidewatch.streaming.streams import shared_folder
from tidewatch.workload.registry import number, numbers, query
from tidewatch.workload.tables import DAY, HOUR, TICKS_SQL, table, ticks, trades

D20 = "decimal(20,8)"


@query(
    "canonical_decimal",
    """SELECT event_id, CASE WHEN v = 0 THEN '0' ELSE regexp_replace(CAST(v AS VARCHAR), '(\\.[0-9]*[1-9])0+$|\\.0+$', '\\1') END AS text, true AS is_canonical FROM (SELECT event_id, CAST(value - 50 AS DECIMAL(20,8)) AS v FROM events)""",
)
def canonical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") - 50).cast(D20).alias("v"))
    text = decimals.canonical(F.col("v"))
    return e.select("event_id", text.alias("text"), decimals.is_canonical(text).alias("is_canonical"))


@query(
    "decimal_arithmetic",
    """WITH a AS (SELECT event_id, CAST(value AS DECIMAL(20,8)) AS x, CAST(user_id - 75 AS DECIMAL(20,8)) AS y FROM events)
SELECT event_id, CAST(x + y AS DOUBLE) AS added, CAST(x - y AS DOUBLE) AS subtracted, round(CAST(x AS DOUBLE) * CAST(y AS DOUBLE), 6) AS multiplied,
  round(CASE WHEN y <> 0 THEN CAST(x AS DOUBLE) / CAST(y AS DOUBLE) END, 8) AS divided, CAST(abs(y) AS DOUBLE) AS absolute, CAST(sign(x - y) AS INTEGER) AS compared, y > 0 AS positive,
  round(CAST(x AS DOUBLE) * 2, 6) AS notional, round(CAST(x AS DOUBLE) + 0.5, 6) AS mid FROM a""",
)
def decimal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    a = table(spark, sf_dir, "events").select(
        "event_id", F.col("value").cast(D20).alias("x"), (F.col("user_id") - 75).cast(D20).alias("y")
    )
    return a.select(
        "event_id", (x + y).cast("double").alias("added"), (x - y).cast("double").alias("subtracted"),
        number(x * y, 6).alias("multiplied"), number(decimals.ratio(x, y)).alias("divided"),
        F.abs(y).cast("double").alias("absolute"), decimals.compare(x, y).alias("compared"), decimals.is_positive(y).alias("positive"),
        number(decimals.notional(x, F.lit(Decimal(2)).cast(D20)), 6).alias("notional"),
        number(decimals.mid_price(x, x + F.lit(1)), 6).alias("mid"),
    )


@query(
    "knowledge_states",
    f"""WITH {TICKS_SQL} SELECT id, CASE WHEN quantity IS NULL THEN 'UNKNOWN' ELSE 'KNOWN' END AS state, CAST(quantity AS DOUBLE) AS value, CASE WHEN quantity IS NULL THEN 'quantity is missing' END AS reason,
  CASE WHEN quantity IS NOT NULL THEN received_ms END AS observed_ms, quantity IS NOT NULL AND event_ms + 3000 >= received_ms AS fresh FROM ticks""",
)
def knowledge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn(
        "k", knowledge.from_nullable(F.col("quantity"), F.lit("quantity is missing"), F.col("received_ms"))
    )
    fresh = knowledge.is_fresh(F.col("k.state"), F.col("event_ms") + 3000, F.col("received_ms"))
    return t.select(
        "id", "k.state", F.col("k.value").cast("double").alias("value"), "k.reason", "k.observed_ms", fresh.alias("fresh")
    )


@query(
    "validate_contract",
    """SELECT doc_id, concat_ws(',', CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'lang:enum' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source:pattern' END,
  CASE WHEN n_chars < 100 THEN 'n_chars:minimum' END, CASE WHEN n_chars > 50000 THEN 'n_chars:maximum' END, CASE WHEN quality IS NULL THEN 'quality:missing' END) AS violations FROM documents LEFT JOIN labels USING (doc_id)""",
)
def validate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = validation.Rule
    contract = validation.Contract(
        "document",
        (
            rule("lang", one_of=("en", "fr", "de")), rule("source", pattern="^src[0-9]$"),
            rule("n_chars", minimum=100, maximum=50_000), rule("quality"),
        ),
    )
    d = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    checked = validation.with_violations(d, contract)
    return checked.select("doc_id", F.array_join("violations", ",").alias("violations"))


@query(
    "visible_feed",
    f"""WITH {TICKS_SQL} SELECT asset, count(*) AS visible, bool_or(received_ms > 1705276800000) AS future_seen, count(*) FILTER (quantity IS NOT NULL AND side <> 'UNKNOWN') AS known_flow
FROM ticks WHERE asset = 'purchase' AND received_ms <= 1705276803000 GROUP BY ALL""",
)
def visible_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = validation.select_feed(ticks(spark, sf_dir), "asset", "purchase")
    seen = validation.visible_at(feed, F.lit(1705276803000))
    known = validation.known_flow_rows(seen).groupBy("asset").agg(F.count(F.lit(1)).alias("known_flow"))
    counted = seen.groupBy("asset").agg(
        F.count(F.lit(1)).alias("visible"), validation.future_rows(seen, F.lit(1705276800000)).alias("future_seen")
    )
    return counted.join(known, "asset")


@query(
    "latency_breakdown",
    f"""WITH {TICKS_SQL}, a AS (SELECT id, event_ms AS o, received_ms AS r, received_ms + id % 5 - 1 AS n, received_ms + id % 11 AS d FROM ticks)
SELECT id, CASE WHEN ok THEN r - o END AS source_to_receive_ms, CASE WHEN ok THEN n - r END AS receive_to_normalise_ms, CASE WHEN ok THEN d - n END AS normalise_to_decision_ms, CASE WHEN ok THEN 'KNOWN' ELSE 'ERROR' END AS latency_state
FROM (SELECT *, o <= r AND r <= n AND n <= d AS ok FROM a)""",
)
def latency_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).select(
        "id", F.col("event_ms").alias("o"), F.col("received_ms").alias("r"),
        (F.col("received_ms") + F.pmod("id", F.lit(5)) - 1).alias("n"), (F.col("received_ms") + F.pmod("id", F.lit(11))).alias("d"),
    )
    return validation.latency_breakdown(t, "o", "r", "n", "d").drop("o", "r", "n", "d")


@query(
    "stable_hash",
    """SELECT event_id, 'sha256:' || sha256(j) AS content_hash, 'event-' || substr(sha256(j), 1, 24) AS content_id FROM (
  SELECT event_id, '{"event_type":"' || event_type || '","id":' || event_id || ',"user":' || user_id || '}' AS j FROM events)""",
)
def hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"user": F.col("user_id"), "id": F.col("event_id"), "event_type": F.col("event_type")}
    return table(spark, sf_dir, "events").select(
        "event_id", hashing.stable_hash(columns).alias("content_hash"), hashing.stable_id("event", columns).alias("content_id")
    )


@query(
    "json_extract",
    """SELECT user_id, count(*) FILTER (k = 0) AS zero_values, count(*) FILTER (k IS NULL) AS missing_values, CAST(sum(k) AS BIGINT) AS total FROM (
  SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) GROUP BY ALL""",
)
def json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(k == 0).alias("zero_values"), F.count_if(k.isNull()).alias("missing_values"), F.sum(k).alias("total")
    )


@query(
    "time_and_text_scalars",
    """SELECT event_id, m AS at_ms, strftime(make_timestamp(m * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at_text, m + 90000 AS later_ms, greatest(0, 1705276800000 - m) AS age_ms, greatest(0, 1705276800000 - m) // 1000 AS age_seconds,
  printf('%.3f%%', value) AS percent_text, event_type AS error_code FROM (SELECT *, epoch_us(ts) // 1000 AS m FROM events)""",
)
def scalars_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = times.to_ms(F.col("ts"))
    age = times.age_ms(F.lit(1705276800000), at)
    return table(spark, sf_dir, "events").select(
        "event_id", at.alias("at_ms"), times.to_text(at).alias("at_text"), times.seconds_after(at, 90).alias("later_ms"),
        age.alias("age_ms"), times.whole_seconds(age).alias("age_seconds"),
        progress.percent_text((F.col("value").cast("decimal(12,2)") / F.lit(100))).alias("percent_text"),
        rules_text.error_code(F.concat("event_type", F.lit(":"), "props")).alias("error_code"),
    )


@query(
    "array_and_map_functions",
    """WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds, count(*) AS kind_count, min(event_type) AS first_kind, max(n) FILTER (event_type = 'error') AS errors FROM a GROUP BY ALL""",
)
def collections_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    grouped = counted.groupBy("user_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("event_type"))))).alias("kinds"),
        F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("by_kind"),
    )
    return grouped.select(
        "user_id", F.array_join("kinds", ",").alias("kinds"), F.size("kinds").cast("long").alias("kind_count"),
        F.try_element_at("kinds", F.lit(1)).alias("first_kind"), F.col("by_kind")["error"].alias("errors"),
    )


_LTE = "CASE WHEN x <= -20 THEN 1.0 WHEN x >= 0 THEN 0.0 ELSE x / -20.0 END"
_GTE = "CASE WHEN x >= 30 THEN 1.0 ELSE greatest(0.0, x / 30.0) END"


@query(
    "condition_progress",
    f"""WITH a AS (SELECT event_id, CAST(CAST(value - 40 AS DECIMAL(20,8)) AS DOUBLE) AS x, event_id % 90 AS secs FROM events)
SELECT event_id, round({_LTE}, 8)::DOUBLE AS lte_progress, round({_GTE}, 8)::DOUBLE AS gte_progress, round(greatest(0, x + 20), 8) AS lte_gap, round(greatest(0, 30 - x), 8) AS gte_gap,
  round(CASE WHEN x >= -10 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - (-10 - x) / 10)) END, 8)::DOUBLE AS gte_negative_progress,
  round(CASE WHEN x <= -20 THEN 1.0 WHEN x >= 0 THEN 0.0 ELSE abs(x) / 20 END, 8)::DOUBLE AS panel_lte, round(CASE WHEN x >= 30 THEN 1.0 WHEN x <= 0 THEN 0.0 ELSE x / 30 END, 8)::DOUBLE AS panel_gte,
  round(least(1.0, secs / 30.0), 8)::DOUBLE AS duration, round(least({_GTE}, least(1.0, secs / 30.0)), 8)::DOUBLE AS value_and_duration,
  CASE WHEN x <= -20 THEN 'PASS' ELSE 'FAIL' END AS state,
  CASE WHEN x <= -20 AND secs >= 30 THEN 'PASS' WHEN secs < 5 THEN 'UNKNOWN' ELSE 'FAIL' END AS composite, (x <= -20)::INT + (secs >= 30)::INT AS passed FROM a""",
)
def progress_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").select(
        "event_id", (F.col("value") - 40).cast(D20).alias("x"), F.pmod("event_id", F.lit(90)).cast("decimal(10,0)").alias("secs")
    )
    x, secs = F.col("x"), F.col("secs")
    p = progress
    lte, gte = p.progress_for("LTE", x, -20), p.progress_for("GTE", x, 30)
    state = p.directional_state("LTE", x, F.lit("KNOWN"), F.lit(True), -20)
    timed = F.when(secs >= 30, "PASS").when(secs < 5, "UNKNOWN").otherwise("FAIL")
    return a.select(
        "event_id", number(lte).alias("lte_progress"), number(gte).alias("gte_progress"),
        number(p.gap_for("LTE", x, -20)).alias("lte_gap"), number(p.gap_for("GTE", x, 30)).alias("gte_gap"),
        number(p.progress_for("GTE", x, -10)).alias("gte_negative_progress"),
        number(p.panel_progress("LTE", x, -20)).alias("panel_lte"), number(p.panel_progress("GTE", x, 30)).alias("panel_gte"),
        number(p.duration_progress(secs, 30)).alias("duration"),
        number(p.value_and_duration_progress(gte, secs, 30)).alias("value_and_duration"),
        state.alias("state"), p.composite_state([state, timed]).alias("composite"), p.passed_count([state, timed]).alias("passed"),
    )


@query(
    "composite_rows",
    """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) AS required, CASE WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'PASS' WHEN bool_or(o_orderstatus = 'P') THEN 'UNKNOWN' ELSE 'FAIL' END AS state,
  CASE WHEN NOT bool_or(o_orderstatus = 'P') THEN min(o_totalprice) END AS progress FROM orders GROUP BY ALL""",
)
def composite_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children as rows: one parent condition per customer."""
    s = F.col("o_orderstatus")
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(s == "F").alias("passed"), F.count(F.lit(1)).alias("required"),
        F.bool_or(s == "P").alias("any_unknown"), F.min("o_totalprice").alias("least"),
    )
    return grouped.select(
        "o_custkey", "passed", "required",
        F.when(F.col("passed") == F.col("required"), "PASS").when(F.col("any_unknown"), "UNKNOWN").otherwise("FAIL").alias("state"),
        F.when(~F.col("any_unknown"), F.col("least")).alias("progress"),
    )


# --- landed data ---------------------------------------------------------------------------


@query(
    "parse_stream_messages",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'BOOK_TICKER' ELSE 'AGG_TRADE' END AS kind,
  CASE event_type WHEN 'view' THEN 'ref-a' WHEN 'click' THEN 'ref-b' WHEN 'signup' THEN 'ref-c' WHEN 'purchase' THEN 'target' END AS asset, event_id AS sequence,
  CASE WHEN event_type <> 'error' THEN event_type || CASE WHEN event_id % 3 = 0 THEN ':bookTicker:' ELSE ':aggTrade:' END || event_id END AS dedup_key,
  CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN value END AS price, CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'SELL' ELSE 'BUY' END END AS side,
  CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN round(value + 0.5, 6) END AS mid_price, CASE WHEN event_type = 'error' THEN 'INVALID_MESSAGE' END AS tick_error FROM events""",
)
def messages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as stream messages, half of them in an envelope, and parsed back."""
    e = table(spark, sf_dir, "events").withColumn("at", times.to_ms(F.col("ts")))
    is_quote = F.pmod("event_id", F.lit(3)) == 0
    price = F.col("value").cast("string")
    trade = F.to_json(F.struct(
        F.lit("aggTrade").alias("e"), F.col("at").alias("E"), F.col("event_type").alias("s"), F.col("event_id").alias("a"), price.alias("p"),
        F.lit("2").alias("q"), F.col("at").alias("T"), (F.pmod("event_id", F.lit(2)) == 0).alias("m"),
    ))
    quote = F.to_json(F.struct(
        F.col("event_id").alias("u"), F.col("event_type").alias("s"), price.alias("b"), F.lit("1").alias("B"),
        (F.col("value") + 1).cast("decimal(12,2)").cast("string").alias("a"), F.lit("1").alias("A"),
    ))
    body = F.when(is_quote, quote).otherwise(trade)
    message = F.when(F.pmod("event_id", F.lit(2)) == 0, F.concat(F.lit('{"stream":"x","data":'), body, F.lit("}"))).otherwise(body)
    landed = e.select("event_id", F.col("at").alias("received_ms"), message.alias("message"))
    parsed = market.parse_stream_messages(landed, {"view": "ref-a", "click": "ref-b", "signup": "ref-c", "purchase": "target"})
    return parsed.select(
        "event_id", "kind", "asset", "sequence", "dedup_key", F.col("price").cast("double").alias("price"), "side",
        number("mid_price", 6).alias("mid_price"), "tick_error",
    )


@query(
    "derivative_series",
    f"""WITH s AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 // {HOUR} * {HOUR} AS observed_ms, sum(CAST(value AS DECIMAL(20,8))) AS oi, count(*) AS n FROM events GROUP BY ALL)
SELECT a.symbol, a.observed_ms, round(CAST(a.oi AS DOUBLE), 6) AS open_interest, CAST(a.n AS DOUBLE) AS taker_ratio,
  CASE WHEN b.oi > 0 THEN round(CAST(a.oi - b.oi AS DOUBLE) / CAST(b.oi AS DOUBLE), 8) END AS change
FROM s a LEFT JOIN s b ON a.symbol = b.symbol AND a.observed_ms = b.observed_ms + {HOUR}""",
)
def derivatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open interest by hour, landed as one JSON array a symbol and day, read back, with its change over an hour."""
    at = F.floor(times.to_ms(F.col("ts")) / HOUR) * HOUR
    hourly = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), at.alias("at")).agg(F.sum(F.col("value").cast(D20)).alias("oi"), F.count(F.lit(1)).alias("n"))
    item = F.struct("symbol", F.col("at").alias("timestamp"), F.col("oi").cast("string").alias("sumOpenInterest"), F.col("n").cast("string").alias("buySellRatio"))
    files = hourly.groupBy(F.col("symbol").alias("of"), F.floor(F.col("at") / DAY).alias("day")).agg(F.to_json(F.collect_list(item)).alias("value"))
    folder = shared_folder(spark)
    files.write.partitionBy("of", "day").text(folder)
    series = market.read_derivatives(spark, f"{folder}/*/*")
    earlier = series.select(F.col("symbol").alias("of"), (F.col("observed_ms") + HOUR).alias("later_ms"), F.col("open_interest").alias("baseline"))
    found = series.join(earlier, (F.col("symbol") == F.col("of")) & (F.col("observed_ms") == F.col("later_ms")), "left")
    change = features.oi_change(F.col("baseline"), F.col("open_interest"))
    return found.select(
        "symbol", "observed_ms", number("open_interest", 6).alias("open_interest"), F.col("taker_ratio").cast("double").alias("taker_ratio"), number(change).alias("change")
    )


@query(
    "klines_and_trades",
    """SELECT event_id, event_type AS asset, epoch_us(ts) // 1000 AS event_ms, value AS price, 'UNKNOWN' AS side FROM events WHERE event_type <> 'purchase'
UNION ALL SELECT event_id, 'target', epoch_us(ts) // 1000, value, CASE WHEN event_id % 2 = 0 THEN 'SELL' ELSE 'BUY' END FROM events WHERE event_type = 'purchase'""",
)
def klines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as kline arrays and as aggregate trades, read into one feed."""
    e = table(spark, sf_dir, "events").withColumn("at", times.to_ms(F.col("ts")).cast("string"))
    price, key = F.col("value").cast("string"), F.col("event_id").cast("string")
    bars = e.filter("event_type <> 'purchase'").select(
        "event_type", F.array(key, price, price, price, price, F.lit("1"), F.col("at"), F.lit("1"), F.lit("1"), F.lit("1"), F.lit("1"), F.lit("0")).alias("k")
    )
    fills = e.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("a"), price.alias("p"), F.lit("1").alias("q"), F.col("at").cast("long").alias("T"), (F.pmod("event_id", F.lit(2)) == 0).alias("m")
    )
    feed = market.klines(bars, F.col("event_type")).unionByName(market.agg_trades(fills, F.lit("target")), allowMissingColumns=True)
    return feed.select(F.col("sequence").alias("event_id"), "asset", "event_ms", F.col("price").cast("double").alias("price"), "side")


@query(
    "merge_pages_by_id",
    """SELECT user_id AS trade_id, arg_max(value, event_id) AS value, max(event_id) AS page_no FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1704153600000 AND 1705276800000 GROUP BY ALL""",
)
def merge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as trade ids that several pages repeat; the last page wins."""
    pages = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trade_id"), F.col("event_id").alias("page_no"), times.to_ms(F.col("ts")).alias("at_ms"), "value"
    )
    return market.merge_pages_by_id(pages, "trade_id", "page_no", "at_ms", 1704153600000, 1705276800000).drop("at_ms")


@query(
    "evidence_rows",
    """SELECT event_id, event_type AS source, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, j AS payload_json, 'sha256:' || sha256(j) AS payload_hash FROM (
  SELECT *, '{"a":' || event_id || ',"k":' || regexp_extract(props, '([0-9]+)', 1) || ',"z":"' || event_type || '"}' AS j FROM events)""",
)
def evidence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    payload = F.concat(F.lit('{ "z": "'), "event_type", F.lit('", "k": '), k, F.lit(', "a": '), "event_id", F.lit("}"))
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("source_id"), F.col("ts").alias("event_time"), F.col("ts").alias("received_at"), payload.alias("payload")
    )
    rows = evidence.evidence_rows(e, "1.0.0", "run-1")
    return rows.select(
        F.get_json_object("payload_json", "$.a").cast("long").alias("event_id"), "source", "date", "hour", "payload_json", "payload_hash"
    )


@query(
    "trade_flow_by_day",
    f"""WITH t AS (SELECT l_returnflag AS asset, epoch_us(l_shipdate) // 1000 // {30 * DAY} AS month, l_linestatus AS s, CAST(l_extendedprice AS DECIMAL(20,2)) AS v FROM lineitem)
SELECT asset, month, round(CAST(sum(v) FILTER (s = 'O') AS DOUBLE), 2) AS buy, round(CAST(sum(v) FILTER (s <> 'O') AS DOUBLE), 2) AS sell, count(*) AS n FROM t GROUP BY ALL""",
)
def trade_flow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notional of the trade rows: unit price times quantity gives the line total again."""
    t = trades(spark, sf_dir)
    value = decimals.notional(F.col("price"), F.col("quantity"))
    summed = t.groupBy("asset", times.int_div(F.col("event_ms"), 30 * DAY).alias("month")).agg(
        F.sum(F.when(F.col("side") == "BUY", value)).alias("buy"), F.sum(F.when(F.col("side") == "SELL", value)).alias("sell"),
        F.count(F.lit(1)).alias("n"),
    )
    return numbers(summed, "buy", "sell", places=2)
