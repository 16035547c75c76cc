"""Spelling variants: words that differ by one code point, found by dense prefix-suffix tiles.

Two words of lengths ``m`` and ``m`` or ``m - 1`` are one edit apart exactly if their common prefix and common suffix
together reach ``m - 1``.  So they agree in the first half of ``m`` or in the last: words that share a length and a half
are a block.  A block of more than ``TILE`` words is cut again: what its words do not share yet is halved once more, to
a longer common prefix or a longer common suffix.  In the end a block shares all but one place, and then there are not
more words in it than letters, so every block gets small whatever the words are.

Blocks meet in tasks as padded matrices of code points.  Prefix and suffix lengths of all of a block's pairs are counted
column by column; only rows of words that have a near word leave the task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import prepared, stored, text_of

LETTERS = "[a-zÀ-ÿ]"
MISSPELT = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
TILE = 256
COUNTED_WORDS = 200_000
KEY = ["m", "cuts", "head", "tail", "head_hash", "tail_hash"]


# --- words and their counts ---------------------------------------------------------------------


def add_words(counts: dict[str, int], doc_id: int | None, text: str, runs: re.Pattern, least_length: int, every: int = MISSPELT) -> None:
    """Count a text's words as they are taken: lower-cased, one code point less where the checksum says so."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            place = h % len(run)
            run = run[:place] + run[place + 1 :]
            if len(run) < least_length:
                continue
        counts[run] = counts.get(run, 0) + n


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = MISSPELT) -> DataFrame:
    """``(word, n)`` of words long and frequent enough; null texts have none, a null id counts as empty in the checksum."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    runs = re.compile(f"{LETTERS}{{{least_length},}}")  # shorter ones cannot become words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                add_words(counts, doc_id, text, runs, least_length, every)
            if len(counts) > COUNTED_WORDS:
                yield rows()
                counts.clear()
        yield rows()

    parts = docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- blocks -------------------------------------------------------------------------------------


def _keyed(placed: DataFrame) -> DataFrame:
    """Blocks by length and what their words share; ``head`` and ``tail`` are lengths, ``cuts`` has a bit for each that led there."""
    tail = F.expr("substring(word, length(word) - tail + 1, tail)")
    return placed.select("word", "n", "m", "cuts", "head", "tail", F.xxhash64(F.expr("substring(word, 1, head)")).alias("head_hash"), F.xxhash64(tail).alias("tail_hash"))


def _halved(placed: DataFrame) -> DataFrame:
    """Every word in both blocks that share half of the rest besides."""
    half = F.floor((F.col("m") - F.col("head") - F.col("tail")) / 2).cast("int")
    both = F.array(
        F.struct((F.col("cuts") * 2 + 1).alias("cuts"), (F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct((F.col("cuts") * 2).alias("cuts"), F.col("head").alias("head"), (F.col("tail") + half).alias("tail")),
    )
    return _keyed(placed.select("word", "n", "m", F.explode(both).alias("shared")).select("word", "n", "m", "shared.*"))


def blocks(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``words`` (``word, n``) placed in blocks of at most ``tile`` words, or of words that share all but one place.

    Levels are stored; their number is at most the logarithm of the longest length.
    """
    whole = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") + 1))).select("word", "n", "m", F.lit(1).cast("long").alias("cuts"), F.lit(0).alias("head"), F.lit(0).alias("tail"))
    placed, ready = stored(_halved(whole)), []
    while True:
        large = stored(placed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).where(f"size > {tile} AND m - head - tail > 1").drop("size"))
        if large.isEmpty():
            break
        ready.append(placed.join(large, KEY, "left_anti").select(*placed.columns))
        placed = stored(_halved(placed.join(large, KEY, "left_semi")))
    for part in ready:
        placed = placed.unionByName(part)
    return placed


# --- tiles --------------------------------------------------------------------------------------


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(len(parts), width)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common beginnings of all rows of ``x`` with all rows of ``y``; a word with itself has none."""
    alive = ~np.eye(len(x), len(y), dtype=bool)
    out = np.zeros(alive.shape, np.int32)
    for k in range(x.shape[1]):
        alive &= x[:, k, None] == y[None, :, k]
        if not alive.any():
            break
        out += alive
    return out


def _prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _owns(m: int, cuts: int, prefix: int) -> bool:
    """Whether a pair is this block's: of the blocks that hold it, the one reached by preferring longer heads."""
    p = s = 0
    for step in bin(cuts)[3:]:
        half = (m - p - s) // 2
        if (prefix >= p + half) != (step == "1"):
            return False
        if step == "1":
            p += half
        else:
            s += half
    return True


def near_pairs(words: list[bytes], m: int, cuts: int, head: int, tail: int) -> list[tuple[int, int]]:
    """Pairs one edit apart, the first of length ``m``, that this block has to tell of; ``words`` share head and tail."""
    rests = [w[head : len(w) - tail] for w in words]
    longer = [k for k, w in enumerate(words) if len(w) == m]
    order = longer + [k for k, w in enumerate(words) if len(w) == m - 1]
    if not longer or len(order) < 2:
        return []
    width = m - head - tail
    left = _matrix([rests[k] for k in order], width)
    right = _matrix([rests[k][::-1] for k in order], width)
    near = _common(left[: len(longer)], left) + _common(right[: len(longer)], right) >= width - 1
    np.fill_diagonal(near, False)
    found = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        if j < len(longer) and i > j:
            continue  # of two words of one length once
        a, b = words[order[i]], words[order[j]]
        prefix = _prefix(a, b)
        if a[prefix + 1 :] == b[prefix + (len(a) == len(b)) :] and _owns(m, cuts, prefix):
            found.append((order[i], order[j]))
    return found


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_words(placed: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)``: how many words are one edit away and the most frequent of them.

    Ties go to the smallest in code-point order.  Words without a near word have no row.
    """

    def told(key: tuple, words: list[str], counts: list[int]) -> pa.RecordBatch | None:
        found: dict[int, list] = {}
        for i, j in near_pairs([w.encode("latin-1") for w in words], *key[:4]):
            for own, other in ((i, j), (j, i)):
                rank = (-counts[other], words[other])
                if own in found:
                    found[own][0] += 1
                    found[own][1] = min(found[own][1], rank)
                else:
                    found[own] = [1, rank]
        if not found:
            return None
        rows = [(words[k], n, -rank[0], rank[1]) for k, (n, rank) in found.items()]
        return pa.RecordBatch.from_pydict(dict(zip(_NEAR.names, map(list, zip(*rows)))), schema=_NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts = None, [], []
        for batch in batches:
            for *own, word, n in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if own != key:
                    if len(words) > 1 and (out := told(key, words, counts)) is not None:
                        yield out
                    key, words, counts = own, [], []
                words.append(word)
                counts.append(n)
        if len(words) > 1 and (out := told(key, words, counts)) is not None:
            yield out

    dealt = placed.select(*KEY, "word", "n").repartition(*KEY).sortWithinPartitions(*KEY)
    parts = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: the end of a chain of forms.

    A form is at least twice as frequent as its word, so chains have at most 63 links and no circle; pointers double
    each round.
    """
    found = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("of_word"), F.col("root").alias("further"))
        moved = stored(found.join(onward, F.col("root") == F.col("of_word"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        found = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return found


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = MISSPELT, tile: int = TILE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of all words long and frequent enough.

    ``form`` is the near word of largest ``n`` if that is at least twice the word's own, ``root`` the end of the chain
    of forms.  Null and empty texts have no words, rows that repeat an id count like any others, a null id counts as
    empty in the checksum, further columns are not read.  An empty table gives an empty result.  Texts and words of any
    length are taken whole.
    """
    prepared(docs.sparkSession)
    words = stored(word_counts(docs, least_length, least_count, every))
    near = near_words(blocks(words, tile)).withColumnRenamed("word", "of_word")
    taken = F.col("best_n") >= 2 * F.col("n")
    formed = stored(
        words.join(near, F.col("word") == F.col("of_word"), "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"))
    )
    ends = roots(formed.where("form IS NOT NULL")).withColumnRenamed("word", "of_word")
    return formed.join(ends, F.col("word") == F.col("of_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
