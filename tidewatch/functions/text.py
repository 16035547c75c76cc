"""Deterministic text rules over a headline and abstract.

Rules are data: a caller may pass its own, the defaults are the fixed Chinese keyword
patterns below.  Everything stays a JVM-side regular expression over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EntityRule:
    label: str
    pattern: str
    country: str | None = None


@dataclass(frozen=True)
class TextRules:
    event_types: tuple[tuple[str, str], ...]
    risk_off: str
    risk_on: str
    high: str
    systemic: str
    scheduled: str
    entities: tuple[EntityRule, ...]


# Keyword patterns, tried in this order, matched without case.  The QE rule
# spells its word boundary out because Java counts CJK letters as word characters.
DEFAULT_RULES = TextRules(
    event_types=(
        (
            "MONETARY_MACRO",
            r"央行|美联储|联储|利率|加息|降息|量化宽松|(^|[^A-Za-z0-9_])QE([^A-Za-z0-9_]|$)"
            r"|通胀|非农|就业|GDP|经济衰退",
        ),
        ("TRADE_SANCTIONS", r"关税|贸易战|贸易谈判|制裁|出口管制|禁运|反制|进口限制"),
        ("GEOPOLITICS", r"战争|军事|导弹|空袭|入侵|停火|政变|政府危机|边境冲突|地缘"),
        (
            "FINANCIAL_STABILITY",
            r"银行倒闭|银行挤兑|流动性危机|信用危机|债务违约|系统性风险|交易暂停|清算机构",
        ),
        ("ENERGY_SUPPLY", r"原油|石油|天然气|能源供应|OPEC|供应链中断|重大灾害"),
        ("CRYPTO_POLICY", r"加密监管|稳定币|MiCA|SEC|CFTC|FinCEN|禁令|牌照|法案|ETF"),
    ),
    risk_off=r"加征|暂停|制裁|冲突|攻击|危机|违约|倒闭|暴跌|下调|收紧|禁令|战争|恶化|风险|中断",
    risk_on=r"降息|宽松|达成协议|取消关税|停火|批准|利好|复苏|增长超预期",
    high=r"紧急|全面|系统性|战争|倒闭|违约|攻击|加征\s*\d+%|暂停谈判|重大",
    systemic=r"全球金融危机|系统性崩溃|全面战争|银行体系|主权违约",
    scheduled=r"将于|计划|会议|公布|发布|截止|定于|议程|预定",
    entities=(
        EntityRule("美国", r"美国|美联储|白宫|特朗普|FinCEN|SEC|CFTC", "US"),
        EntityRule("加拿大", r"加拿大|卡尼", "CA"),
        EntityRule("欧盟", r"欧盟|欧洲央行|MiCA", "EU"),
        EntityRule("英国", r"英国|英格兰银行", "GB"),
        EntityRule("中国", r"中国|中国人民银行", "CN"),
        EntityRule("日本", r"日本|日本央行", "JP"),
        EntityRule("韩国", r"韩国|韩国央行", "KR"),
        EntityRule("俄罗斯", r"俄罗斯|克里姆林宫", "RU"),
        EntityRule("乌克兰", r"乌克兰|基辅", "UA"),
        EntityRule("以色列", r"以色列", "IL"),
        EntityRule("伊朗", r"伊朗|德黑兰", "IR"),
        EntityRule("OPEC", r"OPEC"),
    ),
)
ATTRIBUTION_PATTERN = r"据\s*([^，。]{1,48}?)(?:报道|消息|数据|监测)"
BLANKS = r"^[\s 　]+|[\s 　]+$"


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def event_type(text: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    """First matching type; OTHER for unmatched text, UNKNOWN for blank text."""
    chain = None
    for name, pattern in rules.event_types:
        hit = _matches(text, pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.when(F.length(trimmed(text)) > 0, "OTHER").otherwise("UNKNOWN")


def macro_relevant(event_type_column: Column) -> Column:
    return ~event_type_column.isin("OTHER", "UNKNOWN")


def direction(text: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    return (
        F.when(_matches(text, rules.risk_off), "RISK_OFF")
        .when(_matches(text, rules.risk_on), "RISK_ON")
        .otherwise("UNKNOWN")
    )


def severity(text: Column, event_type_column: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    return (
        F.when(_matches(text, rules.systemic), "SYSTEMIC")
        .when(_matches(text, rules.high), "HIGH")
        .when(event_type_column.isin("OTHER", "UNKNOWN"), "UNKNOWN")
        .otherwise("MEDIUM")
    )


def scheduled_state(text: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    return F.when(_matches(text, rules.scheduled), "SCHEDULED").otherwise("UNKNOWN")


def attribution(source: Column, abstract: Column) -> Column:
    """The source field, else a short name quoted in the abstract, else null."""
    quoted = trimmed(F.regexp_extract(abstract, ATTRIBUTION_PATTERN, 1))
    return F.coalesce(F.nullif(trimmed(source), F.lit("")), F.nullif(quoted, F.lit("")))


def entities(text: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    return F.array_compact(F.array(*[F.when(_matches(text, r.pattern), r.label) for r in rules.entities]))


def countries(text: Column, rules: TextRules = DEFAULT_RULES) -> Column:
    return F.array_compact(
        F.array(*[F.when(_matches(text, r.pattern), r.country) for r in rules.entities if r.country])
    )


def error_code(reason: Column) -> Column:
    """Text before the first colon."""
    return F.split_part(reason, F.lit(":"), F.lit(1))
