"""Document fingerprints as a homomorphic multiset hash of paragraphs, with DataFrame functions only.

A paragraph (a line) is hashed into a wide vector: four lanes from its whole text, and 124 lanes that count, bit by
bit, the hashes of its word pairs.  A document's vector is the sum of its paragraphs' vectors, so the order of
paragraphs does not matter, a paragraph can be inserted or deleted by adding or subtracting its vector, and equal
texts have equal vectors.  Lanes count modulo ``2**24`` (whole-text lanes modulo ``2**32``).  As every bit is a fair
coin for every word pair, the inner product of two centred vectors estimates how many pairs two texts share.

Sums run as generated code over exploded word pairs.  Texts are dealt by ``doc_id`` once; the sums need no further
exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import keyed_rows, prepared, stored, text_of

HASHES = 2
STEPS = 31  # shifts of a hash; a sum holds the counts of bits ``j`` and ``j + 31`` side by side
PAIR_MASK = 1 | 1 << STEPS
LANE_MASK = (1 << STEPS) - 1
COUNT_MODULUS = 1 << 24
WHOLE_MODULUS = 1 << 32
SEGMENT_ROWS = 100_000
MOST_SEGMENTS = 1_000


def _sums() -> list[Column]:
    """Aggregates over rows ``h0, h1`` (word-pair hashes), ``position`` and ``p0, p1`` (paragraph hashes)."""
    out = [F.sum(F.shiftrightunsigned(F.col(f"h{k}"), j).bitwiseAND(F.lit(PAIR_MASK))).alias(f"s{k}_{j}") for k in range(HASHES) for j in range(STEPS)]
    for k in range(2):
        first = F.col("position") == 0
        out.append(F.sum(F.when(first, F.col(f"p{k}").bitwiseAND(F.lit(WHOLE_MODULUS - 1))).otherwise(0)).alias(f"low{k}"))
        out.append(F.sum(F.when(first, F.shiftrightunsigned(f"p{k}", 32)).otherwise(0)).alias(f"high{k}"))
    return out


def paragraph_sums(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys, pairs, sums array<bigint>`` of rows ``keys, text``; keys should be dealt already."""
    paragraphs = texts.select(*keys, F.explode(F.split("text", "\n")).alias("paragraph"))
    words = paragraphs.select(*keys, F.xxhash64("paragraph").alias("p0"), F.xxhash64("paragraph", F.lit(1)).alias("p1"), F.split("paragraph", " ").alias("words"))
    pairs = words.select(*keys, "p0", "p1", F.posexplode(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b"))).alias("position", "pair"))
    hashed = pairs.select(*keys, "p0", "p1", "position", F.xxhash64("pair.a", "pair.b").alias("h0"), F.xxhash64("pair.a", "pair.b", F.lit(1)).alias("h1"))
    summed = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), *_sums())
    names = [c for c in summed.columns if c not in keys and c != "pairs"]
    return summed.select(*keys, "pairs", F.array(*names).alias("sums"))


def vector(sums: Column) -> Column:
    """128 lanes of packed sums: 124 counts, then four whole-text lanes."""
    n = HASHES * STEPS
    counts = F.flatten(F.transform(F.slice(sums, 1, n), lambda s: F.array(
        F.pmod(s.bitwiseAND(F.lit(LANE_MASK)), F.lit(COUNT_MODULUS)), F.pmod(F.shiftrightunsigned(s, STEPS), F.lit(COUNT_MODULUS))
    )))
    whole = F.transform(F.slice(sums, n + 1, 4), lambda s: F.pmod(s, F.lit(WHOLE_MODULUS)))
    return F.concat(counts, whole)


def _combined(a: Column, b: Column, sign: int) -> Column:
    n = 2 * HASHES * STEPS
    add = lambda m: lambda x, y: F.pmod(x + sign * y, F.lit(m))
    counts = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), add(COUNT_MODULUS))
    return F.concat(counts, F.zip_with(F.slice(a, n + 1, 4), F.slice(b, n + 1, 4), add(WHOLE_MODULUS)))


def insert(a: Column, paragraphs: Column) -> Column:
    """Vector after paragraphs with that vector were added."""
    return _combined(a, paragraphs, 1)


def delete(a: Column, paragraphs: Column) -> Column:
    """Vector after paragraphs with that vector were taken away."""
    return _combined(a, paragraphs, -1)


def as_text(lanes: Column) -> Column:
    """Lowercase hexadecimal, six digits a count and eight a whole-text lane."""
    n = 2 * HASHES * STEPS
    digits = lambda size: lambda x: F.lpad(F.hex(x), size, "0")
    return F.lower(F.concat(F.array_join(F.transform(F.slice(lanes, 1, n), digits(6)), ""), F.array_join(F.transform(F.slice(lanes, n + 1, 4), digits(8)), "")))


def likeness(a: Column, pairs_a: Column, b: Column, pairs_b: Column) -> Column:
    """Estimated share of common word pairs, ``2 ab / (aa + bb)`` of the centred counts, from 0 to 1; equal vectors give 1."""
    n = 2 * HASHES * STEPS
    x = F.transform(F.slice(a, 1, n), lambda v: (2 * v - pairs_a).cast("double"))
    y = F.transform(F.slice(b, 1, n), lambda v: (2 * v - pairs_b).cast("double"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    common = total(F.zip_with(x, y, lambda u, v: 2 * u * v))
    size = total(F.zip_with(x, y, lambda u, v: u * u + v * v))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(common, size), F.lit(0.0))))
    return F.when(a == b, 1.0).otherwise(F.least(raw, F.lit(1 - 1e-9)))


def neighbours(docs: DataFrame) -> DataFrame:
    """``(doc_id, next_id, target_id, target_chars)`` in descending order of ids, the last followed by the first.

    ``target_id`` is the document that this one follows.  Ids are cut into ranges at quantiles, so no task orders more
    than a range of ids; the ends of at most ``MOST_SEGMENTS`` ranges meet in the driver.  Ids must be unique.
    """
    ids = docs.where("doc_id IS NOT NULL").select("doc_id", F.length("text").alias("size"))
    n = ids.count()
    segments = max(1, min(MOST_SEGMENTS, n // SEGMENT_ROWS))
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [k / segments for k in range(1, segments)], 10_000)).first()[0] or [])) if segments > 1 else []
    segment = F.size(F.filter(F.lit(cuts), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    placed = ids.withColumn("segment", segment)
    ends = {r.segment: r for r in placed.groupBy("segment").agg(
        F.max_by(F.struct("doc_id", "size"), "doc_id").alias("high"), F.min_by(F.struct("doc_id", "size"), "doc_id").alias("low")
    ).collect()}
    order = sorted(ends)
    below, above_id, above_size = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for k, s in enumerate(order):
        below[s] = ends[order[k - 1]].high.doc_id
        upper = ends[order[(k + 1) % len(order)]].low
        above_id[s], above_size[s] = upper.doc_id, upper["size"]
    at = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("segment"))
    kind = dict(ids.dtypes)["doc_id"]
    by_id = Window.partitionBy("segment").orderBy("doc_id")
    return placed.select(
        "doc_id", F.coalesce(F.lag("doc_id").over(by_id), at(below, kind)).alias("next_id"),
        F.coalesce(F.lead("doc_id").over(by_id), at(above_id, kind)).alias("target_id"),
        F.coalesce(F.lead("size").over(by_id), at(above_size, "int")).alias("target_chars"),
    )


def _sums_of_edits(linked: DataFrame) -> DataFrame:
    """Sums of the text and the edited text of rows ``doc_id, target_id, text, beginning`` dealt by ``doc_id``."""
    n = F.length("text")
    kept = F.substr(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int"))
    both = linked.select("doc_id", "target_id", F.array(F.col("text"), F.concat(kept, F.coalesce("beginning", F.lit("")))).alias("both"))
    facts = ("doc_id", "target_id", "n_chars", "edited_sha256")
    each = both.select(
        "doc_id", "target_id", F.length(F.get("both", F.lit(0))).cast("long").alias("n_chars"),
        F.sha2(F.get("both", F.lit(1)), 256).alias("edited_sha256"), F.posexplode("both").alias("version", "text"),
    )
    of = lambda version, column: F.max(F.when(F.col("version") == version, F.col(column)))
    return paragraph_sums(each, *facts, "version").groupBy(*facts).agg(
        of(0, "pairs").alias("pairs"), of(0, "sums").alias("sums"), of(1, "pairs").alias("edited_pairs"), of(1, "sums").alias("edited_sums")
    )


def fingerprint_edits(docs: DataFrame, every_row: bool = False) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likenesses that the fingerprints give.

    The edited text has the last third replaced by the beginning of the next document; a row with a null id has no
    next document, which then counts as empty.  With ``every_row`` each row has a result, and rows that share an id
    are ordered by the SHA-256 of their texts.  Otherwise rows that repeat an id are one document, that with the smallest text.
    """
    prepared(docs.sparkSession)
    texts = docs.select("doc_id", text_of().alias("text"))
    ids = texts.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.count_distinct("doc_id").alias("distinct")).first()
    repeated = ids.known != ids.distinct or ids.n > ids.known + 1
    if repeated and every_row:
        keyed = keyed_rows(texts, "row_key")
        known = keyed.where("doc_id IS NOT NULL").select(F.col("row_key").alias("doc_id"), "text")
        unknown = keyed.where("doc_id IS NULL").select(F.col("row_key").alias("doc_id"), "text")
        found = _fingerprints(known, unknown.repartition("doc_id"))
        own = keyed.select("row_key", F.col("doc_id").alias("own_id")).hint("shuffle_hash")
        rest = [c for c in found.columns if c != "doc_id"]
        return found.join(own, F.col("doc_id") == F.col("row_key")).select(F.col("own_id").alias("doc_id"), *rest)
    if repeated:
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    return _fingerprints(texts.where("doc_id IS NOT NULL"), texts.where("doc_id IS NULL") if ids.n > ids.known else None)


def _fingerprints(texts: DataFrame, unknown: DataFrame | None) -> DataFrame:
    """Of texts with unique ids, and of others that have no next document."""
    # The same scan and exchange of texts serves both sides: texts get their links, and give their beginnings away.
    links = neighbours(texts).select(F.col("doc_id").alias("of_id"), "target_id", "target_chars").hint("shuffle_hash")
    base = texts.join(links, F.col("doc_id") == F.col("of_id"))
    beginnings = base.select(
        F.col("target_id").alias("for_id"), F.substr(F.col("text"), F.lit(1), F.floor(F.col("target_chars") / 3).cast("int")).alias("beginning")
    ).hint("shuffle_hash")
    linked = base.join(beginnings, F.col("doc_id") == F.col("for_id"), "left").select("doc_id", "target_id", "text", "beginning")
    rows = _sums_of_edits(linked)
    if unknown is not None:
        alone = unknown.select("doc_id", F.lit(None).cast(dict(texts.dtypes)["doc_id"]).alias("target_id"), "text", F.lit("").alias("beginning"))
        rows = rows.unionByName(_sums_of_edits(alone))
    rows = stored(rows)
    nexts = rows.where("target_id IS NOT NULL").select(F.col("target_id").alias("for_id"), F.col("pairs").alias("next_pairs"), F.col("sums").alias("next_sums"))
    joined = rows.join(nexts.hint("shuffle_hash"), F.col("doc_id") == F.col("for_id"), "left")
    empty = F.array_repeat(F.lit(0).cast("long"), HASHES * STEPS + 4)
    lanes = joined.select(
        "doc_id", "n_chars", "edited_sha256", "pairs", "edited_pairs", F.coalesce("next_pairs", F.lit(0)).alias("next_pairs"), vector(F.col("sums")).alias("a"),
        vector(F.col("edited_sums")).alias("e"), vector(F.coalesce("next_sums", empty)).alias("x"),
    )
    return lanes.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("pairs"), F.col("e"), F.col("edited_pairs")).alias("near_edited"),
        likeness(F.col("a"), F.col("pairs"), F.col("x"), F.col("next_pairs")).alias("near_next"),
    )
