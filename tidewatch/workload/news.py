"""Documents as news items; conversations as revisions; pages as landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.hashing import sha256
from tidewatch.operators import news as ops
from tidewatch.operators.grid import Grid
from tidewatch.operators.lookups import latest_qualifying, policy_lookup, without_relays
from tidewatch.operators.running import fixed_segments
from tidewatch.workload.registry import query
from tidewatch.workload.tables import table

START = 1704067200000
MINUTE = 60_000
WINDOW = 120 * MINUTE

# The default rules are Chinese; the given documents need rules in their own words.
RULES = T.TextRules(
    event_types=(
        ("MONETARY_MACRO", "thnder|copyright"),
        ("TRADE_SANCTIONS", "ichge|schen"),
        ("GEOPOLITICS", "ereand|eauou"),
        ("FINANCIAL_STABILITY", "mentoi|password"),
        ("ENERGY_SUPPLY", "ingst"),
    ),
    risk_off="nded|leeau|ungen",
    risk_on="oned|ciones",
    high="edtion|ouell|erhe",
    systemic="thereis|license",
    scheduled="whan|ement",
    entities=(
        T.EntityRule("alpha", "thnder|andthe", "AA"),
        T.EntityRule("beta", "eaux", "BB"),
        T.EntityRule("gamma", "ichge|cion", "CC"),
        T.EntityRule("delta", "estion"),
    ),
)


def _case(pairs) -> str:
    return " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in pairs)


ITEMS_SQL = f"""typed AS (SELECT *, CASE {_case(RULES.event_types)} WHEN length(regexp_replace(text, '^[\\s\\x{{00a0}}\\x{{3000}}]+|[\\s\\x{{00a0}}\\x{{3000}}]+$', '', 'g')) > 0 THEN 'OTHER' ELSE 'UNKNOWN' END AS event_type FROM documents),
items AS (SELECT doc_id AS item_id, text, source, lang, event_type, {START} + doc_id * {MINUTE} AS occurred_ms, {START} + doc_id * {MINUTE} + (doc_id % 5) * {MINUTE} AS received_ms,
  CASE WHEN regexp_matches(text, '(?i){RULES.risk_off}') THEN 'RISK_OFF' WHEN regexp_matches(text, '(?i){RULES.risk_on}') THEN 'RISK_ON' ELSE 'UNKNOWN' END AS direction,
  CASE WHEN regexp_matches(text, '(?i){RULES.systemic}') THEN 'SYSTEMIC' WHEN regexp_matches(text, '(?i){RULES.high}') THEN 'HIGH' WHEN event_type IN ('OTHER', 'UNKNOWN') THEN 'UNKNOWN' ELSE 'MEDIUM' END AS severity,
  CASE WHEN regexp_matches(text, '(?i){RULES.scheduled}') THEN 'SCHEDULED' ELSE 'UNKNOWN' END AS scheduled_state, event_type NOT IN ('OTHER', 'UNKNOWN') AS macro_relevant FROM typed)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per document, a minute apart, received up to four minutes later."""
    d = table(spark, sf_dir, "documents")
    occurred = F.lit(START) + F.col("doc_id") * MINUTE
    rows = d.select(
        F.col("doc_id").alias("item_id"), "text", "source", "lang", occurred.alias("occurred_ms"),
        (occurred + F.pmod("doc_id", F.lit(5)) * MINUTE).alias("received_ms"),
    )
    return ops.classify(rows, F.col("text"), RULES)


@query(
    "classify_text",
    f"""WITH {ITEMS_SQL} SELECT item_id, event_type, direction, severity, scheduled_state, macro_relevant FROM items""",
)
def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", "event_type", "direction", "severity", "scheduled_state", "macro_relevant")


@query(
    "match_entities",
    f"""SELECT doc_id AS item_id, nullif(concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(text, '(?i){e.pattern}') THEN '{e.label}' END" for e in RULES.entities)}), '') AS entities,
  nullif(concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(text, '(?i){e.pattern}') THEN '{e.country}' END" for e in RULES.entities if e.country)}), '') AS countries FROM documents""",
)
def entities_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir)
    joined = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return found.select("item_id", joined("entities").alias("entities"), joined("countries").alias("countries"))


RAW_SQL = f"""raw AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS source, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://example.org/' || doc_id END AS url, lang AS category FROM documents)"""


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return d.select(
        F.col("doc_id").alias("item_id"), title.alias("title"),
        F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)").alias("abstract"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, "").otherwise(F.col("source")).alias("source"),
        F.when(F.pmod("doc_id", F.lit(4)) == 0, "").otherwise(F.concat(F.lit("https://example.org/"), "doc_id")).alias("url"),
        (F.lit(START) + F.col("doc_id") * MINUTE).alias("created_ms"), F.lit(None).cast("long").alias("updated_ms"),
        F.col("lang").alias("category"), F.array(F.lit("")).alias("content_categories"),
        (F.lit(START) + F.col("doc_id") * MINUTE).alias("received_ms"), F.lit(0).alias("revision"),
    )


@query(
    "normalise_news",
    f"""WITH {RAW_SQL}, h AS (SELECT *, 'sha256:' || sha256(CAST(json_object('abstract', abstract, 'source', source, 'title', title, 'url', url) AS VARCHAR)) AS content_hash FROM raw)
SELECT 'news-' || doc_id || '-r0-' || right(content_hash, 12) AS observation_id, CAST(doc_id AS VARCHAR) AS item_id, 'https://example.org/list/' || doc_id AS source_url, nullif(url, '') AS original_url,
  title AS headline, substr(abstract, 1, 600) AS excerpt, nullif(source, '') AS attribution, category AS categories, content_hash FROM h""",
)
def normalise_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.normalise(raw_items(spark, sf_dir), "news", "https://example.org/list/", 600, RULES)
    return found.select(
        "observation_id", "item_id", "source_url", "original_url", "headline", "excerpt", "attribution",
        F.array_join("categories", ",").alias("categories"), "content_hash",
    )


@query(
    "public_projection",
    f"""WITH {RAW_SQL} SELECT CAST(doc_id AS VARCHAR) AS item_id, title AS headline, nullif(url, '') AS original_url, 0 AS revision FROM raw""",
)
def public_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ops.public_projection(ops.normalise(raw_items(spark, sf_dir), "news", "https://example.org/list/", 600, RULES))
    return shown.select("item_id", "headline", "original_url", "revision")


@query(
    "news_revisions",
    """WITH a AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b, text FROM conversations)
SELECT conv_id, turn, CAST(sum(CASE WHEN b <> text THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS revision, coalesce(b = text, false) AS is_duplicate FROM a""",
)
def revisions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", sha256(F.col("text")).alias("content_hash"))
    found = ops.revisions(c, "conv_id", ["turn"], "content_hash", fixed_segments(F.col("turn"), 1_000_000))
    return found.select("conv_id", "turn", "revision", "is_duplicate")


@query(
    "latest_revision",
    """SELECT conv_id, max(turn // 2) AS revision, arg_max(turn, (turn // 2, turn)) AS judged, arg_max(role, (turn // 2, turn)) AS role, count(*) AS revision_count, min(turn * 1000 + conv_id) AS first_received_ms FROM conversations GROUP BY ALL""",
)
def latest_revision_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", F.floor(F.col("turn") / 2).alias("revision"), F.col("turn").alias("judged"), "role",
        (F.col("turn") * 1000 + F.col("conv_id")).alias("received_ms"),
    )
    return ops.latest_revision(c, "conv_id", "revision", "judged", "received_ms").drop("received_ms")


@query(
    "latest_macro_item",
    f"""WITH {ITEMS_SQL} SELECT max(received_ms) AS received_ms, arg_max(item_id, (received_ms, item_id)) AS item_id, arg_max(event_type, (received_ms, item_id)) AS event_type FROM items WHERE macro_relevant""",
)
def latest_macro_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_macro_item(
        items(spark, sf_dir).select("received_ms", "item_id", "event_type", "macro_relevant"), "received_ms", "item_id"
    ).drop("macro_relevant")


# --- gate and audit ------------------------------------------------------------------------

NOW = START + 500 * MINUTE
MODEL_VERSION, CONFIG_VERSION = "words-of-documents", "window-120-minutes"
GATE_SQL = f"""{ITEMS_SQL},
checked AS (SELECT *, CASE WHEN macro_relevant THEN 'PASS' ELSE 'FAIL' END AS c1,
  CASE WHEN NOT macro_relevant THEN 'NOT_APPLICABLE' WHEN direction = 'RISK_OFF' THEN 'PASS' WHEN direction = 'UNKNOWN' THEN 'REVIEW_REQUIRED' ELSE 'FAIL' END AS c2,
  CASE WHEN NOT macro_relevant THEN 'NOT_APPLICABLE' WHEN severity IN ('HIGH', 'SYSTEMIC') THEN 'PASS' WHEN severity = 'UNKNOWN' THEN 'REVIEW_REQUIRED' ELSE 'FAIL' END AS c3,
  CASE WHEN NOT macro_relevant THEN 'NOT_APPLICABLE' WHEN occurred_ms > {NOW} OR received_ms > {NOW} THEN 'REVIEW_REQUIRED'
    WHEN {NOW} - occurred_ms > {WINDOW} OR {NOW} - received_ms > {WINDOW} THEN 'FAIL' ELSE 'PASS' END AS c4 FROM items),
judged AS (SELECT *, CASE WHEN 'FAIL' IN (c1, c2, c3, c4) THEN 'NOT_TRIGGERED' WHEN 'REVIEW_REQUIRED' IN (c1, c2, c3, c4) THEN 'REVIEW_REQUIRED' ELSE 'ENTERED_RISK_OBSERVATION' END AS outcome,
  CASE WHEN macro_relevant THEN least(occurred_ms, received_ms) + {WINDOW} END AS window_ends_ms,
  CASE WHEN c1 = 'FAIL' THEN '{ops.REASONS["MACRO_RELEVANCE", "FAIL"]}' WHEN c2 = 'FAIL' THEN '{ops.REASONS["RISK_DIRECTION", "FAIL"]}' WHEN c3 = 'FAIL' THEN '{ops.REASONS["IMPACT_SEVERITY", "FAIL"]}'
    WHEN c4 = 'FAIL' THEN '{ops.REASONS["OBSERVATION_WINDOW", "FAIL"]}' WHEN c2 = 'REVIEW_REQUIRED' THEN '{ops.REASONS["RISK_DIRECTION", "REVIEW_REQUIRED"]}' WHEN c3 = 'REVIEW_REQUIRED' THEN '{ops.REASONS["IMPACT_SEVERITY", "REVIEW_REQUIRED"]}'
    WHEN c4 = 'REVIEW_REQUIRED' THEN '{ops.REASONS["OBSERVATION_WINDOW", "FUTURE"]}' ELSE '{ops.ENTERED_SUMMARY}' END AS summary FROM checked),
audit AS (SELECT *, 'rec-' || item_id AS record_id, received_ms AS first_received_ms FROM judged)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.news_gate(items(spark, sf_dir), F.lit(NOW), WINDOW, model_version=MODEL_VERSION, config_version=CONFIG_VERSION)


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(
        "item_id", "text", "source", "outcome", "summary", F.concat(F.lit("rec-"), "item_id").alias("record_id"),
        F.col("received_ms").alias("first_received_ms"),
    )


@query("news_gate", f"WITH {GATE_SQL} SELECT item_id, concat_ws(',', c1, c2, c3, c4) AS checks, outcome, summary, window_ends_ms FROM judged")
def gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(
        "item_id", F.array_join(F.transform("checks", lambda c: c["state"]), ",").alias("checks"), "outcome", "summary", "window_ends_ms"
    )


def _chosen(column: str, texts: dict[str, str], other: str | None = None) -> str:
    cases = " ".join(f"WHEN '{name}' THEN '{text}'" for name, text in texts.items())
    return f"CASE {column} {cases}" + (f" ELSE '{other}'" if other else "") + " END"


def _check_sql(check: str, state: str, current: str) -> str:
    reasons = {"REVIEW_REQUIRED" if at == "FUTURE" else at: text for (name, at), text in ops.REASONS.items() if name == check and at != "NO_TIME"}
    return f"""{{'id': '{check}', 'label': '{ops.CHECK_LABELS[check]}', 'state': {state}, 'reason': {_chosen(state, reasons)},
  'current': CASE WHEN {state} = 'NOT_APPLICABLE' THEN '{ops.NOT_JUDGED}' ELSE {current} END}}"""


@query(
    "news_gate_checks",
    f"""WITH {GATE_SQL}, c AS (SELECT item_id, unnest([
  {_check_sql("MACRO_RELEVANCE", "c1", _chosen("event_type", ops.EVENT_LABELS))},
  {_check_sql("RISK_DIRECTION", "c2", _chosen("direction", ops.DIRECTION_LABELS, ops.OTHER_DIRECTION))},
  {_check_sql("IMPACT_SEVERITY", "c3", _chosen("severity", ops.SEVERITY_LABELS, ops.OTHER_SEVERITY))},
  {_check_sql("OBSERVATION_WINDOW", "c4", _chosen("c4", {"REVIEW_REQUIRED": "时间顺序异常", "FAIL": "首次判断时已超过 120 分钟窗口", "PASS": "处于 120 分钟观察窗口内"}))}]) AS x FROM judged)
SELECT item_id, x.id AS check_id, x.label AS label, x.state AS state, x.current AS found, x.reason AS reason,
  '{ops.GATE_RULE_VERSION}' AS rule_version, '{MODEL_VERSION}' AS model_version, '{CONFIG_VERSION}' AS config_version FROM c""",
)
def gate_checks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every item with its texts, and the versions under which it was judged."""
    checks = judged(spark, sf_dir).select("item_id", F.explode("checks").alias("x"), "rule_version", "model_version", "config_version")
    return checks.select(
        "item_id", F.col("x.id").alias("check_id"), "x.label", "x.state", F.col("x.current").alias("found"), "x.reason",
        "rule_version", "model_version", "config_version",
    )


@query(
    "outcome_counts",
    f"""WITH {GATE_SQL} SELECT o.outcome, count(j.item_id) AS n FROM (VALUES ('ENTERED_RISK_OBSERVATION'), ('NOT_TRIGGERED'), ('REVIEW_REQUIRED')) o(outcome) LEFT JOIN judged j USING (outcome) GROUP BY ALL""",
)
def outcome_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.outcome_counts(judged(spark, sf_dir))


def _page_sql(where: str, after: str = "true") -> str:
    return f"""WITH {GATE_SQL}, f AS (SELECT * FROM audit WHERE {where}), t AS (SELECT (SELECT count(*) FROM audit) AS total, (SELECT count(*) FROM f) AS filtered_total),
p AS (SELECT *, row_number() OVER (ORDER BY first_received_ms DESC, item_id DESC) AS position, count(*) OVER () AS remaining FROM f WHERE {after})
SELECT item_id, record_id, outcome, position, total, filtered_total, CASE WHEN remaining > 20 THEN arg_max(record_id, position) OVER () END AS next_cursor
FROM (SELECT * FROM p WHERE position <= 20), t"""


SHOWN = ("item_id", "record_id", "outcome", "position", "total", "filtered_total", "next_cursor")


@query("search_audit_first_page", _page_sql("outcome = 'NOT_TRIGGERED' AND (contains(lower(text), 'the') OR contains(lower(source), 'the') OR contains(lower(summary), 'the'))"))
def search_first_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = ops.search_audit(audit(spark, sf_dir), ["text", "source", "summary"], 20, "NOT_TRIGGERED", " The ")
    return page.select(*SHOWN)


@query(
    "search_audit_next_page",
    _page_sql("true", "(first_received_ms, item_id) < (SELECT (first_received_ms, item_id) FROM audit WHERE record_id = 'rec-100')"),
)
def search_next_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.search_audit(audit(spark, sf_dir), ["text"], 20, cursor="rec-100").select(*SHOWN)


@query("item_history", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 7")
def history_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ops.item_history(c, "conv_id", 7, "turn", "role")


STEP = 10 * MINUTE


@query(
    "latest_qualifying_news",
    f"""WITH {ITEMS_SQL}, grid AS (SELECT unnest(generate_series({START}, (SELECT max(received_ms) FROM items), {STEP})) AS as_of_ms)
SELECT g.as_of_ms, arg_max(i.item_id, (i.received_ms, i.item_id)) AS item_id, max(i.received_ms) AS received_ms FROM grid g
LEFT JOIN items i ON i.macro_relevant AND i.direction = 'RISK_OFF' AND i.severity IN ('HIGH', 'SYSTEMIC') AND greatest(i.occurred_ms, i.received_ms) <= g.as_of_ms
  AND g.as_of_ms <= least(i.occurred_ms, i.received_ms) + {WINDOW} GROUP BY ALL""",
)
def qualifying_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    last = table(spark, sf_dir, "documents").agg(
        F.max(F.lit(START) + F.col("doc_id") * MINUTE + F.pmod("doc_id", F.lit(5)) * MINUTE)
    ).first()[0]
    grid = Grid(START, last, STEP)
    found = latest_qualifying(
        grid.instants(spark), i, ops.timeless_gate(), "occurred_ms", "received_ms", "item_id", WINDOW, STEP, START
    )
    return found.select("as_of_ms", F.col("item.item_id").alias("item_id"), F.col("item.received_ms").alias("received_ms"))


# --- clusters ------------------------------------------------------------------------------

CLUSTER_SQL = f"""obs AS (SELECT 'o' || d.doc_id AS observation_id, d.doc_id % 3 AS revision, CASE WHEN d.doc_id % 50 <> 0 THEN sha256(d.text) END AS fingerprint, d.source AS source_id,
  'T' || (d.doc_id % 5) AS source_tier, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'VERIFIED' WHEN l.toxic = 1 THEN 'DISPUTED' WHEN l.quality = 0 THEN 'UNVERIFIED' ELSE 'UNKNOWN' END AS credibility,
  {START} + d.doc_id * {MINUTE} AS received_ms FROM documents d LEFT JOIN labels l USING (doc_id)),
clusters AS (SELECT 'news-cluster-' || substr(sha256(fingerprint), 1, 24) AS cluster_id, fingerprint, CAST(max(revision) + count(*) - 1 AS BIGINT) AS revision, count(*) AS observations, min(received_ms) AS first_received_ms,
  max(received_ms) AS last_updated_ms, count(DISTINCT source_id) AS source_count, list_aggregate(list_sort(list(DISTINCT source_id)), 'string_agg', ',') AS source_ids,
  count(DISTINCT source_id) FILTER (source_tier IN ('T0', 'T1', 'T2') AND source_id <> 'src3') AS independent_sources,
  min(received_ms) FILTER (source_tier = 'T0' AND credibility = 'VERIFIED') AS official_ms, bool_or(credibility = 'DISPUTED') AS dis, bool_or(credibility = 'UNVERIFIED') AS unv
  FROM obs WHERE fingerprint IS NOT NULL GROUP BY fingerprint),
stated AS (SELECT * EXCLUDE (dis, unv), observations - independent_sources AS amplification, CASE WHEN official_ms IS NOT NULL THEN 'VERIFIED' WHEN dis THEN 'DISPUTED' WHEN independent_sources >= 2 THEN 'CORROBORATED' WHEN unv THEN 'UNVERIFIED' ELSE 'UNKNOWN' END AS fact_confidence,
  CASE WHEN source_count >= 6 THEN 'SATURATED' WHEN source_count >= 3 THEN 'TRENDING' WHEN source_count >= 2 THEN 'WATCH' ELSE 'QUIET' END AS attention_state FROM clusters)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    credibility = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "VERIFIED")
        .when(F.col("toxic") == 1, "DISPUTED").when(F.col("quality") == 0, "UNVERIFIED").otherwise("UNKNOWN")
    )
    return d.join(l, "doc_id", "left").select(
        F.concat(F.lit("o"), "doc_id").alias("observation_id"), F.pmod("doc_id", F.lit(3)).alias("revision"),
        F.when(F.pmod("doc_id", F.lit(50)) != 0, sha256(F.col("text"))).alias("fingerprint"),
        F.col("source").alias("source_id"), F.concat(F.lit("T"), F.pmod("doc_id", F.lit(5))).alias("source_tier"),
        credibility.alias("credibility"), (F.lit(START) + F.col("doc_id") * MINUTE).alias("received_ms"),
    )


def relays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("src3",)], "source_id string")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cluster_news(observations(spark, sf_dir), relays(spark))


@query("cluster_news", f"WITH {CLUSTER_SQL} SELECT * FROM stated")
def cluster_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).withColumn("source_ids", F.array_join("source_ids", ",")).drop("official_id")


@query("cluster_members", f"WITH {CLUSTER_SQL} SELECT 'news-cluster-' || substr(sha256(fingerprint), 1, 24) AS cluster_id, observation_id, received_ms FROM obs WHERE fingerprint IS NOT NULL")
def members_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cluster_members(observations(spark, sf_dir))


@query(
    "news_arm_state",
    f"""WITH {CLUSTER_SQL}, sev AS (SELECT *, CASE WHEN substr(fingerprint, 1, 1) IN ('0', '1', '2', '3') THEN 'HIGH' WHEN substr(fingerprint, 1, 1) = '4' THEN 'SYSTEMIC' ELSE 'UNKNOWN' END AS severity FROM stated)
SELECT cluster_id, CASE WHEN fact_confidence IN ('VERIFIED', 'CORROBORATED') AND severity IN ('HIGH', 'SYSTEMIC') AND {NOW} - first_received_ms BETWEEN 0 AND {WINDOW} THEN 'NEWS_ARMED' ELSE 'NO_NEWS' END AS arm_state FROM sev""",
)
def arm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("fingerprint", 1, 1)
    severity = F.when(first.isin("0", "1", "2", "3"), "HIGH").when(first == "4", "SYSTEMIC").otherwise("UNKNOWN")
    armed = ops.arm_state(F.col("fact_confidence"), severity, F.col("first_received_ms"), F.lit(NOW), 120)
    return clusters(spark, sf_dir).select("cluster_id", armed.alias("arm_state"))


POLICY_SQL = f"""policy AS (SELECT sha256(d.text) AS fingerprint, {START} + (d.doc_id + d.doc_id % 7 - 3) * {MINUTE} AS since_ms,
  CASE WHEN l.toxic = 1 THEN 'SECURITY' WHEN l.quality = 1 THEN 'MACRO' END AS event_type,
  CASE WHEN l.toxic = 1 THEN 'SYSTEMIC' WHEN l.quality = 1 THEN 'HIGH' END AS severity FROM documents d JOIN labels l USING (doc_id)),
held AS (SELECT s.fingerprint, p.event_type, p.severity FROM stated s JOIN policy p ON p.fingerprint = s.fingerprint AND p.since_ms <= s.last_updated_ms
  QUALIFY row_number() OVER (PARTITION BY s.fingerprint ORDER BY p.since_ms DESC, p.event_type DESC NULLS LAST, p.severity DESC NULLS LAST) = 1),
judged AS (SELECT s.*, coalesce(h.event_type, 'UNKNOWN') AS event_type, coalesce(h.severity, 'UNKNOWN') AS severity FROM stated s LEFT JOIN held h USING (fingerprint))"""


def policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document states the policy of its text from some minutes around its own time on."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return d.join(l, "doc_id").select(
        sha256(F.col("text")).alias("fingerprint"),
        (F.lit(START) + (F.col("doc_id") + F.pmod("doc_id", F.lit(7)) - 3) * MINUTE).alias("since_ms"),
        F.when(toxic, "SECURITY").when(good, "MACRO").alias("event_type"),
        F.when(toxic, "SYSTEMIC").when(good, "HIGH").alias("severity"),
    )


@query(
    "cluster_policy",
    f"""WITH {CLUSTER_SQL}, {POLICY_SQL}
SELECT cluster_id, fact_confidence, event_type, severity, CASE WHEN fact_confidence IN ('VERIFIED', 'CORROBORATED') AND severity IN ('HIGH', 'SYSTEMIC') AND {NOW} - first_received_ms BETWEEN 0 AND {WINDOW} THEN 'NEWS_ARMED' ELSE 'NO_NEWS' END AS arm_state FROM judged""",
)
def cluster_policy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with the policy that held at their last update, armed by its severity."""
    judged = ops.cluster_news(observations(spark, sf_dir), relays(spark), policy_versions(spark, sf_dir))
    armed = ops.arm_state(F.col("fact_confidence"), F.col("severity"), F.col("first_received_ms"), F.lit(NOW), 120)
    return judged.select("cluster_id", "fact_confidence", "event_type", "severity", armed.alias("arm_state"))


@query(
    "policy_lookup",
    """SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'SECURITY' WHEN l.quality = 1 THEN 'MACRO' END, 'UNKNOWN') AS event_type, d.source <> 'src3' AS independent
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.source <> 'src3'""",
)
def policy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"))
    policy = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "SECURITY").when(F.col("quality") == 1, "MACRO").alias("event_type")
    )
    found = policy_lookup(without_relays(d, relays(spark), "source_id"), policy, "doc_id", ["event_type"])
    return found.select("doc_id", "event_type", F.lit(True).alias("independent"))


# --- pages ---------------------------------------------------------------------------------


@query(
    "page_item_detail",
    """WITH a AS (SELECT page_id, nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '/([0-9]+)$', 1), '') AS item_id FROM pages)
SELECT page_id, item_id, CASE WHEN item_id IS NULL THEN 'DETAIL_URL_INVALID' ELSE 'DETAIL_ITEM_MISSING' END AS detail_error FROM a""",
)
def detail_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No given page lists items, so every page that names one misses it."""
    from tidewatch.sources.pages import extract_page_items, page_item_detail

    p = table(spark, sf_dir, "pages")
    return page_item_detail(p, extract_page_items(p)).select("page_id", "item_id", "detail_error")


@query(
    "extract_page_items",
    f"""WITH {RAW_SQL} SELECT doc_id // 20 AS page_id, CAST(doc_id AS VARCHAR) AS item_id, title, abstract, source, CAST(NULL AS VARCHAR) AS page_error FROM raw WHERE title <> ''
UNION ALL SELECT page_id + 1000000000, NULL, NULL, NULL, NULL, 'SCHEMA_DRIFT_OR_EMPTY_LIST' FROM pages""",
)
def extract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages, and list pages of 20 documents each in the payload form."""
    from tidewatch.sources.pages import extract_page_items

    given = table(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000_000).alias("page_id"), "html")
    raw = raw_items(spark, sf_dir)
    body = F.to_json(F.struct("title", "abstract", "source", F.lit("2024-01-01T00:00:00.000Z").alias("created_at")))
    item = F.concat(F.lit('{"id":'), "item_id", F.lit(","), F.expr("substring(body, 2)"))
    lists = (
        raw.withColumn("body", body).select(F.floor(F.col("item_id") / 20).alias("page_id"), "item_id", item.alias("object"))
        .groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "object"))), lambda x: x["object"]), ",").alias("objects"))
    )
    quoted = F.to_json(F.array(F.concat(F.lit('{"items":['), "objects", F.lit("]}"))))
    # a script payload is a JSON array of 1 and one JSON string; "</" would end the script early
    payload = F.concat(F.lit("[1,"), F.replace(F.expr("substring(quoted, 2)"), F.lit("</"), F.lit("<\\/")))
    html = F.concat(F.lit("<html><script>self.__next_f.push("), payload, F.lit(")</script></html>"))
    pages = lists.withColumn("quoted", quoted).select("page_id", html.alias("html"))
    found = extract_page_items(given.unionByName(pages))
    return found.select("page_id", "item_id", "title", "abstract", "source", "page_error")


@query(
    "read_news_raw",
    f"""WITH {RAW_SQL} SELECT CAST(doc_id AS VARCHAR) AS item_id, title, abstract, source, CASE WHEN title = '' THEN 'INVALID_ITEM' END AS item_error FROM raw""",
)
def read_raw_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.sources.pages import read_news_raw

    lines = raw_items(spark, sf_dir).select(
        F.to_json(F.struct(F.col("item_id").alias("id"), "title", "abstract", "source", F.lit("2024-01-01T00:00:00.000Z").alias("created_at"))).alias("value")
    )
    return read_news_raw(lines).select("item_id", "title", "abstract", "source", "item_error")
