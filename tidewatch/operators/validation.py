"""Contracts: strict row checks that split a DataFrame into valid rows and quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """What one column must satisfy."""

    column: str
    required: bool = True
    one_of: tuple[str, ...] | None = None
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    size: int | None = None

    def violations(self) -> list[Column]:
        c, name = F.col(self.column), self.column
        checks = []
        if self.required:
            checks.append(F.when(c.isNull(), f"{name}:missing"))
        if self.one_of is not None:
            checks.append(F.when(~c.isin(*self.one_of), f"{name}:enum"))
        if self.pattern is not None:
            checks.append(F.when(~c.rlike(self.pattern), f"{name}:pattern"))
        if self.minimum is not None:
            checks.append(F.when(c < self.minimum, f"{name}:minimum"))
        if self.maximum is not None:
            checks.append(F.when(c > self.maximum, f"{name}:maximum"))
        if self.min_length is not None:
            checks.append(F.when(F.length(c) < self.min_length, f"{name}:min_length"))
        if self.max_length is not None:
            checks.append(F.when(F.length(c) > self.max_length, f"{name}:max_length"))
        if self.size is not None:
            checks.append(F.when(F.size(c) != self.size, f"{name}:size"))
        return checks


@dataclass(frozen=True)
class Contract:
    name: str
    rules: tuple[Rule, ...]
    schema: T.StructType | None = None

    def check_schema(self, df: DataFrame) -> None:
        """Unknown or missing columns are an error, as are other types."""
        if self.schema is None:
            return
        wanted = {f.name: f.dataType for f in self.schema}
        found = {f.name: f.dataType for f in df.schema}
        if wanted.keys() != found.keys():
            raise ValueError(f"{self.name}: columns differ: {sorted(wanted.keys() ^ found.keys())}")
        wrong = [n for n in wanted if wanted[n].simpleString() != found[n].simpleString()]
        if wrong:
            raise ValueError(f"{self.name}: types differ: {wrong}")


def with_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Add the list of broken rules; an empty list means valid."""
    contract.check_schema(df)
    checks = [c for rule in contract.rules for c in rule.violations()]
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def validate(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    checked = with_violations(df, contract)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def visible_at(df: DataFrame, as_of: Column, received: str = "received_ms") -> DataFrame:
    """A row is usable only once received."""
    return df.filter(F.col(received) <= as_of)


def future_rows(df: DataFrame, as_of: Column, received: str = "received_ms") -> Column:
    """Aggregate flag: any row received after the instant."""
    return F.coalesce(F.bool_or(F.col(received) > as_of), F.lit(False))


def select_feed(df: DataFrame, key: str, asset: str, role: str | None = None) -> DataFrame:
    picked = df.filter(F.col(key) == asset)
    return picked if role is None else picked.filter(F.col("market_role") == role)


def known_flow_rows(trades: DataFrame) -> DataFrame:
    """Trades with a KNOWN quantity and a known side."""
    return trades.filter(F.col("quantity").isNotNull() & (F.col("side") != "UNKNOWN"))


def latency_breakdown(df: DataFrame, occurred: str, received: str, normalised: str, decided: str) -> DataFrame:
    """Stage latencies; a row whose times run backwards is an error, not a negative latency."""
    o, r, n, d = (F.col(c) for c in (occurred, received, normalised, decided))
    ordered = (o <= r) & (r <= n) & (n <= d)
    ok = F.coalesce(ordered, F.lit(False))
    return df.select(
        "*",
        F.when(ok, r - o).alias("source_to_receive_ms"),
        F.when(ok, n - r).alias("receive_to_normalise_ms"),
        F.when(ok, d - n).alias("normalise_to_decision_ms"),
        F.when(ok, "KNOWN").otherwise("ERROR").alias("latency_state"),
    )


def bounded_retention(ticks: DataFrame, received: str, window_ms: int) -> DataFrame:
    """Rows received within the window of the newest row (one number comes back)."""
    newest = ticks.agg(F.max(received)).first()[0]
    return ticks.filter(F.col(received) >= F.lit((newest or 0) - window_ms))


# Contracts of the market tick and the news observation.
TICK = Contract(
    "market tick",
    (
        Rule("kind", one_of=("AGG_TRADE", "BOOK_TICKER")),
        Rule("id", min_length=1),
        Rule("asset", min_length=1),
        Rule("sequence", minimum=0),
        Rule("side", required=False, one_of=("BUY", "SELL")),
        Rule("event_ms"),
        Rule("received_ms"),
    ),
)
NEWS_OBSERVATION = Contract(
    "news observation",
    (
        Rule("observation_id", min_length=1),
        Rule("source_id", min_length=1),
        Rule("source_tier", one_of=("T0", "T1", "T2", "T3", "T4")),
        Rule("headline", min_length=1),
        Rule("language", min_length=2),
        Rule("revision", minimum=0),
        Rule("content_hash", pattern="^sha256:[0-9a-f]{64}$"),
        Rule("credibility", one_of=("VERIFIED", "CORROBORATED", "UNVERIFIED", "DISPUTED", "UNKNOWN")),
    ),
)
