"""News items: normalisation, revisions, the news gate, clusters and audit queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as rules_text
from tidewatch.functions.hashing import prefixed, sorted_json
from tidewatch.operators.running import Measure, running

OUTCOMES = ("ENTERED_RISK_OBSERVATION", "NOT_TRIGGERED", "REVIEW_REQUIRED")


# --- normalisation ------------------------------------------------------------------------


def classify(df: DataFrame, text: Column, rules: rules_text.TextRules = rules_text.DEFAULT_RULES) -> DataFrame:
    """Event type, direction, severity, schedule and entities of the whole text."""
    kind = rules_text.event_type(text, rules)
    return (
        df.withColumn("event_type", kind)
        .withColumn("direction", rules_text.direction(text, rules))
        .withColumn("severity", rules_text.severity(text, F.col("event_type"), rules))
        .withColumn("scheduled_state", rules_text.scheduled_state(text, rules))
        .withColumn("macro_relevant", rules_text.macro_relevant(F.col("event_type")))
        .withColumn("entities", rules_text.entities(text, rules))
        .withColumn("countries", rules_text.countries(text, rules))
    )


def normalise(
    items: DataFrame, source_id: str, url_prefix: str, excerpt_characters: int,
    rules: rules_text.TextRules = rules_text.DEFAULT_RULES,
) -> DataFrame:
    """Raw items to classified news items.

    ``items``: ``item_id``, ``title``, ``abstract``, ``source``, ``url``, ``created_ms``, ``updated_ms``,
    ``category``, ``content_categories``, ``received_ms``, ``revision``.
    """
    combined = F.concat(F.col("title"), F.lit("\n"), F.col("abstract"))
    content = sorted_json(
        {c: F.col(c) for c in ("title", "abstract", "source", "url", "updated_ms")}
    )
    named = F.array_compact(F.concat(F.array("category"), F.coalesce("content_categories", F.array().cast("array<string>"))))
    found = classify(items, combined, rules).withColumn("content_hash", prefixed(content))
    return found.select(
        F.concat(
            F.lit(f"{source_id}-"), F.col("item_id"), F.lit("-r"), F.col("revision"), F.lit("-"),
            F.substring(F.col("content_hash"), -12, 12),
        ).alias("observation_id"),
        F.lit(source_id).alias("source_id"),
        F.col("item_id").cast("string").alias("item_id"),
        F.concat(F.lit(url_prefix), F.col("item_id")).alias("source_url"),
        F.nullif(rules_text.trimmed(F.col("url")), F.lit("")).alias("original_url"),
        F.col("title").alias("headline"),
        F.substring("abstract", 1, excerpt_characters).alias("excerpt"),
        rules_text.attribution(F.col("source"), F.col("abstract")).alias("attribution"),
        F.filter(named, lambda c: F.length(c) > 0).alias("categories"),
        F.col("created_ms").alias("occurred_ms"),
        "received_ms", "updated_ms", "revision", "content_hash", "event_type", "entities", "countries",
        "direction", "severity", "scheduled_state", "macro_relevant",
    )


PUBLIC_COLUMNS = (
    "observation_id", "item_id", "source_url", "original_url", "headline", "attribution", "categories",
    "occurred_ms", "received_ms", "revision", "event_type", "entities", "countries", "direction", "severity",
    "scheduled_state", "content_hash",
)


def public_projection(items: DataFrame) -> DataFrame:
    """Metadata only: no body text."""
    return items.select(*PUBLIC_COLUMNS)


# --- revisions and polls ------------------------------------------------------------------


def revisions(polled: DataFrame, item: str, order: Sequence[str], content_hash: str, segment: Column) -> DataFrame:
    """Revision number per item in poll order.

    First sight is 0, the same hash as the last one is a duplicate, a changed hash is one up
    (A, B, A gives 0, 1, 2).
    """
    before = running(
        polled, [item], order, {"__before": Measure("last", F.col(content_hash))}, inclusive=False, segment=segment
    )
    changed = F.col("__before").isNotNull() & (F.col("__before") != F.col(content_hash))
    counted = running(before, [item], order, {"revision": Measure("sum", changed.cast("long"))}, segment=segment)
    return counted.select(
        *polled.columns, "revision",
        F.coalesce(F.col("__before") == F.col(content_hash), F.lit(False)).alias("is_duplicate"),
    )


def poll_head(polled: DataFrame, poll: Sequence[str], created: str, item: str, n: int) -> DataFrame:
    """Newest ``n`` items of each poll."""
    from pyspark.sql import Window

    rank = F.row_number().over(
        Window.partitionBy(*poll).orderBy(F.col(created).desc(), F.col(item).cast("long").desc())
    )
    return polled.withColumn("position", rank).filter(F.col("position") <= n)


def poll_coverage_gaps(polled: DataFrame, source: str, poll: str, item: str, segment: Column) -> DataFrame:
    """Polls whose new maximum id is above the last seen id while that id is no longer listed.

    The last seen id only grows; it is the running maximum of earlier polls.
    """
    per_poll = polled.groupBy(source, poll).agg(F.max(F.col(item).cast("long")).alias("maximum_id"))
    seen = running(
        per_poll, [source], [poll], {"last_seen_id": Measure("max", F.col("maximum_id"))}, inclusive=False,
        segment=segment,
    )
    suspects = seen.filter(F.col("maximum_id") > F.col("last_seen_id"))
    listed = polled.select(source, poll, F.col(item).cast("long").alias("last_seen_id")).distinct()
    return suspects.join(listed, [source, poll, "last_seen_id"], "left_anti").select(
        source, poll, "last_seen_id", "maximum_id",
        F.concat(F.lit("CURSOR_NOT_VISIBLE:"), F.col("last_seen_id"), F.lit("->"), F.col("maximum_id")).alias("coverage_gap"),
    )


def latest_revision(records: DataFrame, item: str, revision: str, judged: str, received: str) -> DataFrame:
    """Newest revision (then newest judgement) per item, revision count, first receipt.

    A plain aggregate: partial maxima before the shuffle keep a hot item cheap.
    """
    rest = [c for c in records.columns if c not in (item, revision, judged)]
    return (
        records.groupBy(item)
        .agg(
            F.max(F.struct(revision, judged, *rest)).alias("__r"),
            F.count(F.lit(1)).alias("revision_count"),
            F.min(received).alias("first_received_ms"),
        )
        .select(item, "__r.*", "revision_count", "first_received_ms")
    )


def latest_macro_item(items: DataFrame, received: str, item: str) -> DataFrame:
    """Newest macro-relevant item."""
    rest = [c for c in items.columns if c not in (received, item)]
    return (
        items.filter("macro_relevant")
        .agg(F.max(F.struct(F.col(received), F.col(item), *rest)).alias("__r"))
        .filter(F.col("__r").isNotNull())
        .select("__r.*")
    )


# --- the news gate ------------------------------------------------------------------------

# Labels and sentences of the gate.
EVENT_LABELS = {
    "MONETARY_MACRO": "货币与宏观",
    "TRADE_SANCTIONS": "贸易与制裁",
    "GEOPOLITICS": "地缘政治",
    "FINANCIAL_STABILITY": "金融稳定",
    "ENERGY_SUPPLY": "能源供给",
    "CRYPTO_POLICY": "加密政策",
    "OTHER": "普通快讯",
    "UNKNOWN": "类型待确认",
}
REASONS = {
    ("MACRO_RELEVANCE", "PASS"): "命中全球宏观、政策、贸易、地缘、金融稳定、能源或加密政策规则",
    ("MACRO_RELEVANCE", "FAIL"): "未匹配当前全球宏观风险类别，作为普通快讯保留供人工核对",
    ("RISK_DIRECTION", "PASS"): "文本包含冲突、制裁、加征、暂停、危机或其他风险升级语义",
    ("RISK_DIRECTION", "REVIEW_REQUIRED"): "事件相关，但现有确定性规则无法证明风险正在上升或缓和",
    ("RISK_DIRECTION", "FAIL"): "事件方向没有显示风险上升，因此不启动减仓观察",
    ("RISK_DIRECTION", "NOT_APPLICABLE"): "非宏观风险快讯无需继续判断方向门槛",
    ("IMPACT_SEVERITY", "PASS"): "影响级别达到新闻风险启动门槛",
    ("IMPACT_SEVERITY", "REVIEW_REQUIRED"): "现有确定性规则无法可靠判断影响程度，需要人工复核",
    ("IMPACT_SEVERITY", "FAIL"): "影响级别尚未达到高或系统性门槛",
    ("IMPACT_SEVERITY", "NOT_APPLICABLE"): "非宏观风险快讯无需继续判断影响门槛",
    ("OBSERVATION_WINDOW", "PASS"): "新闻发生时间和系统接收时间都满足当前时效要求",
    ("OBSERVATION_WINDOW", "FAIL"): "事件内容可能仍值得阅读，但不能再作为当前宏观风险启动条件",
    ("OBSERVATION_WINDOW", "NO_TIME"): "缺少可信的新闻发生时间，不能证明事件仍然新鲜",
    ("OBSERVATION_WINDOW", "FUTURE"): "新闻发生或接收时间晚于判断时间，需要人工复核时钟与来源时间",
    ("OBSERVATION_WINDOW", "NOT_APPLICABLE"): "非宏观风险快讯无需进入风险观察窗口",
}
ENTERED_SUMMARY = "符合宏观相关、风险上升、高影响和时效要求，已进入风险观察；仍需市场条件共同确认"
CHECKS = ("MACRO_RELEVANCE", "RISK_DIRECTION", "IMPACT_SEVERITY", "OBSERVATION_WINDOW")
CHECK_LABELS = {
    "MACRO_RELEVANCE": "属于宏观风险",
    "RISK_DIRECTION": "风险正在上升",
    "IMPACT_SEVERITY": "达到高影响",
    "OBSERVATION_WINDOW": "仍在观察窗口",
}
DIRECTION_LABELS = {"RISK_OFF": "风险偏高", "UNKNOWN": "方向无法确认", "RISK_ON": "风险缓和"}
OTHER_DIRECTION = "影响中性"
SEVERITY_LABELS = {"SYSTEMIC": "系统性影响", "HIGH": "高影响", "UNKNOWN": "影响程度无法确认", "MEDIUM": "中等影响"}
OTHER_SEVERITY = "低影响"
WINDOW_LABELS = {
    "NO_TIME": "新闻发生时间无法确认",
    "FUTURE": "时间顺序异常",
    "FAIL": "首次判断时已超过 {minutes} 分钟窗口",
    "PASS": "处于 {minutes} 分钟观察窗口内",
}
NOT_JUDGED = "无需继续判断"
GATE_RULE_VERSION = "news-gate-v1"


def timeless_gate() -> Column:
    """The part of the gate that does not depend on the instant."""
    return (
        F.col("macro_relevant") & (F.col("direction") == "RISK_OFF") & F.col("severity").isin("HIGH", "SYSTEMIC")
    )


def _label(value: Column, labels: dict[str, str], other: str | None = None) -> Column:
    found = F.lit(other)
    for name, text in labels.items():
        found = F.when(value == name, text).otherwise(found)
    return found


def news_gate(items: DataFrame, at: Column, window_ms: int, occurred: str = "occurred_ms",
              received: str = "received_ms", model_version: str | None = None, config_version: str | None = None) -> DataFrame:
    """Four checks and an outcome per item at an instant; FAIL beats REVIEW_REQUIRED.

    A check has its id, label, state, what it found (``current``) and the reason.  Items without an ``event_type`` column
    have no text for what relevance found.  Every judgment names the versions of rule, model and configuration.
    """
    relevant = F.col("macro_relevant")
    src, rec = F.col(occurred), F.col(received)
    relevance = F.when(relevant, "PASS").otherwise("FAIL")
    direction = (
        F.when(~relevant, "NOT_APPLICABLE")
        .when(F.col("direction") == "RISK_OFF", "PASS")
        .when(F.col("direction") == "UNKNOWN", "REVIEW_REQUIRED")
        .otherwise("FAIL")
    )
    severity = (
        F.when(~relevant, "NOT_APPLICABLE")
        .when(F.col("severity").isin("HIGH", "SYSTEMIC"), "PASS")
        .when(F.col("severity") == "UNKNOWN", "REVIEW_REQUIRED")
        .otherwise("FAIL")
    )
    window = (
        F.when(~relevant, "NOT_APPLICABLE")
        .when(src.isNull(), "NO_TIME")
        .when((src > at) | (rec > at), "FUTURE")
        .when((at - src > window_ms) | (at - rec > window_ms), "FAIL")
        .otherwise("PASS")
    )
    graded = items.withColumns(
        {f"__{c}": state for c, state in zip(CHECKS, (relevance, direction, severity, window), strict=True)}
    )

    def shown(check: str) -> Column:
        state = F.col(f"__{check}")
        return F.when(state.isin("NO_TIME", "FUTURE"), "REVIEW_REQUIRED").otherwise(state)

    def reason(check: str, only: Sequence[str] | None = None) -> Column:
        chain = None
        for (name, state), sentence in REASONS.items():
            if name == check and (only is None or state in only):
                hit = F.col(f"__{check}") == state
                chain = F.when(hit, sentence) if chain is None else chain.when(hit, sentence)
        return chain if chain is not None else F.lit(None).cast("string")

    minutes = f"{window_ms / 60_000:g}"
    event_type = F.col("event_type") if "event_type" in items.columns else F.lit(None).cast("string")
    current = {
        "MACRO_RELEVANCE": _label(event_type, EVENT_LABELS),
        "RISK_DIRECTION": _label(F.col("direction"), DIRECTION_LABELS, OTHER_DIRECTION),
        "IMPACT_SEVERITY": _label(F.col("severity"), SEVERITY_LABELS, OTHER_SEVERITY),
        "OBSERVATION_WINDOW": _label(F.col("__OBSERVATION_WINDOW"), {k: v.format(minutes=minutes) for k, v in WINDOW_LABELS.items()}),
    }

    def judged(check: str) -> Column:
        text = F.when(F.col(f"__{check}") == "NOT_APPLICABLE", NOT_JUDGED).otherwise(current[check])
        return F.struct(
            F.lit(check).alias("id"), F.lit(CHECK_LABELS[check]).alias("label"), shown(check).alias("state"),
            text.alias("current"), reason(check).alias("reason"),
        )

    failed, review = F.lit(False), F.lit(False)
    for check in CHECKS:
        failed = failed | (F.col(f"__{check}") == "FAIL")
        review = review | F.col(f"__{check}").isin("REVIEW_REQUIRED", "NO_TIME", "FUTURE")
    return graded.select(
        *items.columns,
        F.array(*[judged(c) for c in CHECKS]).alias("checks"),
        F.when(failed, "NOT_TRIGGERED").when(review, "REVIEW_REQUIRED").otherwise("ENTERED_RISK_OBSERVATION").alias("outcome"),
        F.coalesce(
            *[reason(c, ("FAIL",)) for c in CHECKS],
            *[reason(c, ("REVIEW_REQUIRED", "NO_TIME", "FUTURE")) for c in CHECKS],
            F.lit(ENTERED_SUMMARY),
        ).alias("summary"),
        at.alias("judged_ms"),
        F.when(relevant & src.isNotNull(), F.least(src, rec) + F.lit(window_ms)).alias("window_ends_ms"),
        F.lit(GATE_RULE_VERSION).alias("rule_version"),
        F.lit(model_version).cast("string").alias("model_version"),
        F.lit(config_version).cast("string").alias("config_version"),
    )


# --- audit queries ------------------------------------------------------------------------


def outcome_counts(latest: DataFrame, outcome: str = "outcome", outcomes: Sequence[str] = OUTCOMES) -> DataFrame:
    """Records per outcome, zero where there are none."""
    spark = latest.sparkSession
    listed = spark.createDataFrame([(o,) for o in outcomes], f"{outcome} string")
    counted = latest.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counted, outcome, "left").select(outcome, F.coalesce("n", F.lit(0)).alias("n"))


def matches(text: str, columns: Sequence[str]) -> Column:
    """Case-folded substring in any column; a blank text matches everything."""
    wanted = text.strip().lower()
    if not wanted:
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(wanted))
    return found


def search_audit(
    latest: DataFrame, columns: Sequence[str], limit: int, outcome: str | None = None, text: str = "",
    cursor: str | None = None, record_id: str = "record_id", item: str = "item_id",
) -> DataFrame:
    """One keyset page of the newest-first list, with totals and the next cursor.

    Order: first receipt descending, then numeric item id descending.  The page starts after
    the cursor record; a cursor that is not in the filtered list means the first page.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    passing = matches(text, columns)
    if outcome is not None:
        passing = passing & (F.col("outcome") == outcome)
    numbered = latest.withColumn("__n", F.col(item).cast("long")).withColumn("__pass", passing)
    sort_key = F.struct("first_received_ms", "__n")
    at_cursor = F.when(F.col("__pass") & (F.col(record_id) == F.lit(cursor)), sort_key)
    totals = numbered.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("__pass").alias("filtered_total"),
        F.max(at_cursor).alias("__cursor"),
    ).first()
    listed = numbered.filter("__pass")
    if totals["__cursor"] is not None:
        received, number = totals["__cursor"]
        listed = listed.filter(
            (F.col("first_received_ms") < received)
            | ((F.col("first_received_ms") == received) & (F.col("__n") < number))
        )
    page = listed.orderBy(F.desc("first_received_ms"), F.desc("__n")).limit(limit + 1)
    ranked = page.withColumn("__rank", F.expr("row_number() over (order by first_received_ms desc, __n desc)"))
    more = ranked.withColumn("has_more", F.expr("max(__rank) over ()") > limit).filter(F.col("__rank") <= limit)
    return more.select(
        *latest.columns,
        F.col("__rank").cast("long").alias("position"),
        F.lit(totals["total"]).cast("long").alias("total"),
        F.lit(totals["filtered_total"]).cast("long").alias("filtered_total"),
        F.when(F.col("has_more"), F.expr(f"max_by({record_id}, __rank) over ()")).alias("next_cursor"),
    )


def item_history(records: DataFrame, item: str, value, revision: str, judged: str) -> DataFrame:
    """All revisions of one item, newest first."""
    return records.filter(F.col(item) == F.lit(value)).orderBy(F.desc(revision), F.desc(judged))


# --- clusters -----------------------------------------------------------------------------


POLICY = ("event_type", "severity")


def cluster_policy(clusters: DataFrame, policy: DataFrame, at: str = "last_updated_ms") -> DataFrame:
    """Event type and severity of every cluster, as the policy said at ``at``.

    ``policy``: ``fingerprint``, ``since_ms``, ``event_type``, ``severity``, a row per version; the newest version that
    holds at the instant counts, of equal times the greatest, and UNKNOWN stands where it says nothing.  A cluster is
    one row a fingerprint, so the join has one row a version at most and versions are reduced before they are dealt.
    """
    said = (
        policy.join(clusters.select("fingerprint", F.col(at).alias("__at")), "fingerprint")
        .filter(F.col("since_ms") <= F.col("__at"))
        .groupBy("fingerprint").agg(F.max(F.struct("since_ms", *POLICY)).alias("__policy"))
    )
    joined = clusters.join(said, "fingerprint", "left")
    return joined.select(
        *clusters.columns, *[F.coalesce(F.col("__policy")[c], F.lit("UNKNOWN")).alias(c) for c in POLICY]
    )


def cluster_news(observations: DataFrame, relays: DataFrame | None = None, policy: DataFrame | None = None) -> DataFrame:
    """Group the newest revision of every observation by claim fingerprint.

    ``observations``: ``observation_id``, ``revision``, ``fingerprint`` (null when not KNOWN),
    ``source_id``, ``source_tier`` (T0..T4), ``credibility``, ``received_ms``.  Sources are reduced
    to one row per (fingerprint, source) before the final grouping; the id list is the
    requested output and as long as the cluster.  ``policy`` adds :func:`cluster_policy`.
    """
    newest = (
        observations.groupBy("observation_id")
        .agg(F.max(F.struct("revision", "received_ms", "fingerprint", "source_id", "source_tier", "credibility")).alias("o"))
        .select("observation_id", "o.*")
        .filter(F.col("fingerprint").isNotNull())
    )
    if relays is not None:
        newest = newest.join(relays.select("source_id", F.lit(True).alias("__relay")), "source_id", "left")
    else:
        newest = newest.withColumn("__relay", F.lit(False))
    independent = F.col("source_tier").isin("T0", "T1", "T2") & ~F.coalesce("__relay", F.lit(False))
    official = (F.col("source_tier") == "T0") & (F.col("credibility") == "VERIFIED")
    per_source = newest.groupBy("fingerprint", "source_id").agg(
        F.max("revision").alias("revision"),
        F.count(F.lit(1)).alias("n"),
        F.min("received_ms").alias("first_ms"),
        F.max("received_ms").alias("last_ms"),
        F.bool_or(independent).alias("independent"),
        F.min(F.when(official, F.struct("received_ms", "observation_id"))).alias("official"),
        F.bool_or(F.col("credibility") == "DISPUTED").alias("disputed"),
        F.bool_or(F.col("credibility") == "UNVERIFIED").alias("unverified"),
    )
    grouped = per_source.groupBy("fingerprint").agg(
        (F.max("revision") + F.sum("n") - 1).alias("revision"),
        F.sum("n").alias("observations"),
        F.min("first_ms").alias("first_received_ms"),
        F.max("last_ms").alias("last_updated_ms"),
        F.count(F.lit(1)).alias("source_count"),
        F.count_if("independent").alias("independent_sources"),
        F.min("official").alias("__official"),
        F.array_sort(F.collect_list("source_id")).alias("source_ids"),
        F.bool_or("disputed").alias("__disputed"),
        F.bool_or("unverified").alias("__unverified"),
    )
    clusters = grouped.select(
        F.concat(F.lit("news-cluster-"), F.substring(F.sha2("fingerprint", 256), 1, 24)).alias("cluster_id"),
        "fingerprint", "revision", "observations", "first_received_ms", "last_updated_ms", "source_count",
        "source_ids", "independent_sources",
        (F.col("observations") - F.col("independent_sources")).alias("amplification"),
        F.col("__official.received_ms").alias("official_ms"),
        F.col("__official.observation_id").alias("official_id"),
        fact_confidence(
            F.col("__official").isNotNull(), F.col("__disputed"), F.col("independent_sources"), F.col("__unverified")
        ).alias("fact_confidence"),
        attention_state(F.col("source_count")).alias("attention_state"),
    )
    return clusters if policy is None else cluster_policy(clusters, policy)


def cluster_members(observations: DataFrame) -> DataFrame:
    """Cluster id per observation, as rows: the exact id list of a cluster of any size."""
    newest = observations.groupBy("observation_id").agg(
        F.max(F.struct("revision", "received_ms", "fingerprint")).alias("o")
    )
    return newest.filter(F.col("o.fingerprint").isNotNull()).select(
        F.concat(F.lit("news-cluster-"), F.substring(F.sha2("o.fingerprint", 256), 1, 24)).alias("cluster_id"),
        "observation_id", F.col("o.received_ms").alias("received_ms"),
    )


def fact_confidence(official: Column, disputed: Column, independent: Column, unverified: Column) -> Column:
    return (
        F.when(official, "VERIFIED")
        .when(disputed, "DISPUTED")
        .when(independent >= 2, "CORROBORATED")
        .when(unverified, "UNVERIFIED")
        .otherwise("UNKNOWN")
    )


def attention_state(sources: Column) -> Column:
    return F.when(sources >= 6, "SATURATED").when(sources >= 3, "TRENDING").when(sources >= 2, "WATCH").otherwise("QUIET")


def arm_state(confidence: Column, severity: Column, first_received_ms: Column, at: Column, minutes: int) -> Column:
    age = at - first_received_ms
    armed = (
        confidence.isin("VERIFIED", "CORROBORATED")
        & severity.isin("HIGH", "SYSTEMIC")
        & age.between(0, minutes * 60_000)
    )
    return F.when(armed, "NEWS_ARMED").otherwise("NO_NEWS")
