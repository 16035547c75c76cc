"""Quality rules as a learned decision list, with DataFrame functions only.

Statistics of every whole text are array expressions over its words, without a shuffle.  The list is learned by
sequential covering: a rule grows by the threshold condition with the largest gain in information on two thirds of
the labelled statistics, is pruned back on the last third, and the rows it covers leave before the next rule.  Spark
counts labels by feature and bin for each step, so the driver sees a few hundred counts whatever the corpus.  The
result is an ordered ``CASE`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE, prepared, stored, text_of
from tidewatch.llm.samples import fold

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BINS = 32
MOST_RULES = 8
MOST_CONDITIONS = 4
LEAST_COVERED = 3
LEAST_PRECISION = 0.8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclamations")
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols": "n_symbols / word_chars",
    "dup_lines": "n_dup_lines",
    "repeated": "n_repeat_words / n_words",
    "upper": "n_upper / word_chars",
    "exclamations": "n_exclamations / n_words",
}


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold`` or, where ``above`` is false, ``feature < threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        side = F.col(self.feature) >= F.lit(self.threshold) if self.above else F.col(self.feature) < F.lit(self.threshold)
        return F.coalesce(side, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


def _all(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _removed(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def repeated_words(words: str = "words") -> Column:
    """Words in three-word windows that occur twice or more; windows are compared by a 64-bit hash.

    Windows are sorted by hash; neighbours of equal hash give positions, and sorted positions the words they cover.
    """
    last = F.size(words) - 2
    w = F.col(words)
    hashes = F.transform(F.slice(w, F.lit(1), last), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(last > 1, hashes).otherwise(F.array().cast("array<bigint>"))


def _places(order: str) -> Column:
    """Sorted places of windows that have an equal neighbour in their order by hash; ``order`` is a column of its own,
    so that the sort runs once."""
    pairs = F.zip_with(
        F.slice(order, F.lit(1), F.size(order) - 1), F.slice(order, F.lit(2), F.size(order) - 1),
        lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)),
    )
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the statistics of the whole text; a null text has none."""
    text = text_of()
    words = F.array_remove(F.split(text, SPACE), "")
    first = docs.select(*keep, text.alias("text"), words.alias("words"))
    filled = F.filter(F.split("text", "\n"), lambda x: F.length(F.ltrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    second = first.select(
        *keep, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _removed(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"), filled.alias("filled"), repeated_words().alias("hashes"),
        _removed(F.col("text"), UPPER).cast("long").alias("n_upper"), _removed(F.col("text"), "!").cast("long").alias("n_exclamations"),
    )
    order = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = second.withColumn("order", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), order)).drop("hashes")
    third = ordered.withColumn("places", _places("order")).drop("order")
    gaps = F.zip_with(F.slice("places", F.lit(1), F.size("places") - 1), F.slice("places", F.lit(2), F.size("places") - 1), lambda a, b: F.least(F.lit(3), b - a))
    repeat = F.when(F.size("places") > 1, F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).otherwise(0)
    dup = F.size("filled") - F.size(F.array_distinct("filled"))
    return third.select(
        *keep, "n_words", "word_chars", "n_symbols", dup.cast("long").alias("n_dup_lines"),
        F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"), "n_upper", "n_exclamations",
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def with_features(rows: DataFrame) -> DataFrame:
    """Ratios with a zero divisor are null; a null meets no condition."""
    return rows.withColumns({
        name: F.expr(f"try_divide({part[0]}, {part[1]})" if len(part := how.split(" / ")) == 2 else f"cast({how} AS double)") for name, how in FEATURES.items()
    })


def learn(labelled: DataFrame, label: str = "bad") -> list[tuple[Condition, ...]]:
    """Ordered rules for label 1.  ``labelled``: stored rows with the features, the label (0 or 1) and ``grows``."""
    names = list(FEATURES)
    quantiles = labelled.agg(*(F.percentile_approx(n, [k / BINS for k in range(1, BINS)], 2_000).alias(n) for n in names)).first()
    cuts = {n: sorted(set(quantiles[n] or [])) for n in names}
    left, rules = labelled, []
    for _ in range(MOST_RULES):
        rule = _prune(left, _grow(left.where("grows"), cuts, label), label)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~_all(rule))
    return rules


def _grow(rows: DataFrame, cuts: dict[str, list[float]], label: str) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    while len(rule) < MOST_CONDITIONS:
        best = _best_condition(rows.where(_all(rule)), cuts, label)
        if best is None:
            break
        rule += (best,)
    return rule


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], label: str) -> Condition | None:
    """Largest FOIL gain; ties go to the first feature, then the smaller threshold."""
    def bin_of(name: str) -> Column:
        return F.struct(F.lit(name).alias("feature"), F.size(F.filter(F.lit(cuts[name]), lambda t: t <= F.col(name))).alias("bin"))

    bins = [bin_of(n) for n, c in cuts.items() if c]
    if not bins:
        return None
    counted = rows.select(F.col(label).alias("y"), F.explode(F.array(*bins)).alias("b")).groupBy("b.feature", "b.bin").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    counts: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counted.collect():
        counts.setdefault(r.feature, {})[r.bin] = (r.p, r.n)
    best, most = None, 1e-9
    for name, thresholds in cuts.items():
        by_bin = counts.get(name, {})
        p_all, n_all = (sum(v[k] for v in by_bin.values()) for k in (0, 1))
        if not p_all or not n_all:
            continue
        before = math.log2(p_all / (p_all + n_all))
        for k, threshold in enumerate(thresholds, 1):
            p_high, n_high = (sum(v[j] for b, v in by_bin.items() if b >= k) for j in (0, 1))
            for above, p, n in ((True, p_high, n_high), (False, p_all - p_high, n_all - n_high)):
                gain = p * (math.log2(p / (p + n)) - before) if p else 0.0
                if gain > most:
                    best, most = Condition(name, above, threshold), gain
    return best


def _prune(rows: DataFrame, rule: tuple[Condition, ...], label: str) -> tuple[Condition, ...]:
    """The prefix with the best share on the pruning rows; none if it is right too seldom or covers too little."""
    if not rule:
        return ()
    counts = []
    for k in range(1, len(rule) + 1):
        inside = _all(rule[:k])
        counts += [F.sum(F.when(inside, F.col(label))).alias(f"p{k}"), F.sum(F.when(inside, 1 - F.col(label))).alias(f"n{k}")]
    found = rows.where("not grows").agg(*counts).first()
    best, most = (), LEAST_PRECISION
    for k in range(1, len(rule) + 1):
        p, n = found[f"p{k}"] or 0, found[f"n{k}"] or 0
        if p >= LEAST_COVERED and (share := (p + 1) / (p + n + 2)) > most:
            best, most = rule[:k], share
    return best


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The list as one ordered expression: the first rule that holds rejects, else the text is kept."""
    out = None
    for rule in rules:
        out = F.when(_all(rule), False) if out is None else out.when(_all(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``(doc_id, statistics, base_failed, kept)`` of all rows.

    The list is learned from labelled rows outside the held-out fold that pass the base rules; null labels and ids are
    left out, an id labelled twice counts with its larger label.  Without labels there are no rules.  The text is read
    once: its statistics are stored in the shared folder.  Repeated rows get their own result.
    """
    prepared(docs.sparkSession)
    rows = with_features(stored(statistics(docs, "doc_id")))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("of_id")).agg(
        (1 - F.max(F.col(label).cast("int"))).alias("bad")
    )
    labelled = rows.where(~base_failed() & (fold() != 0)).join(known, F.col("doc_id") == F.col("of_id")).select(
        "bad", *FEATURES, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grows")
    )
    rules = learn(stored(labelled))
    failed = base_failed()
    return rows.select("doc_id", *STATISTICS, failed.alias("base_failed"), F.when(failed, False).otherwise(verdict(rules)).alias("kept"))
