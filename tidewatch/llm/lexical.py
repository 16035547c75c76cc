"""Ranked lexical search by bit-sliced Bloom signatures.

Documents of like size are put side by side into blocks.  A block is a matrix of bits, a row for each bit place of the
signature and a column for each document, stored by rows: a term's documents are the columns set in all of its rows.
They hold all documents with the term and a few without.  A term that occurs ``tf`` times is entered once for each level
up to ``tf``, so the rows also bound how often it occurs, and summing weights over rows gives every document a bound
from above on its score.

A first pass over the index finds the documents of highest bounds; their exact scores give each query a threshold.  A
second pass keeps every document whose bound reaches it; all of these are scored exactly from their whole texts.  What
is left out has a bound below (or, at an equal score, a larger id than) twenty scored documents.  Queries are worked on
in blocks of at most ``QUERY_BYTES``, each against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import prepared, stored, text_of

TOP = 20
QUERY_BYTES = 1 << 20  # of query texts that one pass over the index takes along
PLACES = 3  # of an entry
BITS_EACH = 16  # rows of a block for each entry of its largest document
MOST_BITS = 1 << 20
BLOCK_CELLS = 1 << 23
BLOCK_DOCS = 1024
CACHED_TERMS = 300_000
NO_ID = (1 << 63) - 1  # a null id, after all others
LEVELS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512, 1024, 4096, 16384, 65536, 1 << 20]
_STEP = 0x9E3779B97F4A7C15
# Letters and digits of ASCII, the capitals lower-cased, and all bytes beyond ASCII stay; the rest separates.
_KEPT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_KEPT).split()


class _TermHashes(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) >= CACHED_TERMS:
            self.clear()
        self[term] = found = xxhash.xxh3_64_intdigest(term)
        return found


_HASHES = _TermHashes()


def entry_hashes(hashes: np.ndarray, level: int) -> np.ndarray:
    x = (hashes + np.uint64(level * _STEP & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def rows_of(entries: np.ndarray, bits: int) -> np.ndarray:
    """The rows of entries in a block of so many (a power of two), one column for each."""
    return np.stack([(entries >> np.uint64(21 * k)) & np.uint64(bits - 1) for k in range(PLACES)]).astype(np.int64)


# --- the index --------------------------------------------------------------------------------------


_INDEX = "bits int, docs int, n_terms long, ids binary, lengths binary, slices binary, terms array<int>, dfs array<long>"


def _entries(counts: Counter) -> np.ndarray:
    hashes = np.fromiter(map(_HASHES.__getitem__, counts), np.uint64, len(counts))
    often = np.fromiter(counts.values(), np.int64, len(counts))
    found = []
    for number in range(len(LEVELS)):
        if not len(hashes):
            break
        found.append(entry_hashes(hashes, number))
        if number + 1 < len(LEVELS):
            more = often >= LEVELS[number + 1]
            hashes, often = hashes[more], often[more]
    return np.concatenate(found)


def _block(bits: int, docs: list[tuple[int, int, np.ndarray]]) -> dict:
    cells = np.zeros((bits, -(-len(docs) // 8) * 8), bool)
    for column, (_, _, entries) in enumerate(docs):
        cells[rows_of(entries, bits), column] = True
    return {
        "bits": bits, "docs": len(docs), "n_terms": sum(d[1] for d in docs), "ids": np.array([d[0] for d in docs], np.int64).tobytes(),
        "lengths": np.array([d[1] for d in docs], np.int64).tobytes(), "slices": np.packbits(cells, axis=1).tobytes(),
    }


def index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Blocks of all documents that have terms, and how many documents hold each term of the vocabulary.

    The number of rows of a block follows its largest document; beyond ``MOST_BITS`` signatures fill up, bounds grow and
    more is scored exactly.
    """
    number_of = {t: k for k, t in enumerate(vocabulary)}
    schema = pa.schema([("bits", pa.int32()), ("docs", pa.int32()), ("n_terms", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("slices", pa.binary()), ("terms", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        holding: Counter = Counter()

        def row(block: dict) -> pa.RecordBatch:
            out = block | {"terms": list(holding), "dfs": list(holding.values())}
            holding.clear()
            return pa.RecordBatch.from_pylist([out], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(terms(text))
                if not counts:
                    continue
                holding.update([number_of[t] for t in counts.keys() & number_of.keys()])
                entries = _entries(counts)
                bits = min(MOST_BITS, BITS_EACH << max(2, int(len(entries) - 1).bit_length()))
                group = waiting.setdefault(bits, [])
                group.append((NO_ID if doc_id is None else doc_id, counts.total(), entries))
                if len(group) >= min(BLOCK_DOCS, max(8, BLOCK_CELLS // bits)):
                    yield row(_block(bits, waiting.pop(bits)))
        for bits, group in waiting.items():
            yield row(_block(bits, group))

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, _INDEX)


# --- queries and bounds -----------------------------------------------------------------------------


@dataclass
class Queries:
    """A block of queries against a corpus: terms found in it, their weights, and each query's terms."""

    vocabulary: list[bytes]
    weights: list[int]
    uses: list[list[tuple[int, int]]]  # of each query (term, how often)
    n_docs: int
    n_terms: int

    def length_part(self, n: int) -> int:
        return 75 + (25 * n * self.n_docs) // self.n_terms


def upper_bounds(queries: Queries, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's documents and a bound on every score, a row for each query."""
    docs, bits = block["docs"], block["bits"]
    slices = np.frombuffer(block["slices"], np.uint8).reshape(bits, -1)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in queries.vocabulary), np.uint64, len(queries.vocabulary))
    held = np.arange(len(hashes))
    level = np.zeros((len(hashes), docs), np.uint8)
    packed: np.ndarray | None = None
    for number in range(len(LEVELS)):
        own = np.bitwise_and.reduce(slices[rows_of(entry_hashes(hashes[held], number), bits)], axis=0)
        packed = own if packed is None else own & packed
        some = packed.any(axis=1)
        held, packed = held[some], packed[some]
        if not len(held):
            break
        level[held] += np.unpackbits(packed, axis=1, count=docs)
    lengths = [queries.length_part(int(n)) for n in np.frombuffer(block["lengths"], np.int64)]
    tf = [0, *(above - 1 for above in LEVELS[1:])]
    most = np.array([[(10**9 * t) // (1000 * t + 12 * m) for m in lengths] for t in tf] + [[10**6] * docs], np.int64)
    impact = most[level, np.arange(docs)]
    out = np.zeros((len(queries.uses), docs), np.int64)
    weights = np.array(queries.weights, np.int64)
    for row, use in enumerate(queries.uses):
        if use:
            own, often = np.array(use, np.int64).T
            out[row] = (weights[own] * often) @ impact[own]
    return np.frombuffer(block["ids"], np.int64), out


_SCORED = pa.schema([("query", pa.int32()), ("doc", pa.int64()), ("value", pa.int64())])


class Best:
    """The highest values of each query so far, equal ones by ascending id; what cannot be among them is not kept."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.least = np.ones(queries, np.int64)
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(queries)]

    def add(self, query: int, value: int, doc: int) -> None:
        if value < self.least[query]:
            return
        own = self.found[query]
        own.append((-value, doc))
        if len(own) >= 8 * self.top:
            self._cut(query)

    def _cut(self, query: int) -> None:
        own = sorted(self.found[query])[: self.top]
        self.found[query] = own
        if len(own) == self.top:
            self.least[query] = -own[-1][0]

    def rows(self) -> pa.RecordBatch:
        for query in range(len(self.found)):
            self._cut(query)
        rows = [(q, doc, -less) for q, own in enumerate(self.found) for less, doc in own]
        return pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(_SCORED.names)}, schema=_SCORED)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def highest_bounds(blocks: DataFrame, queries: Queries, top: int) -> DataFrame:
    """``(query, doc, value)``: the documents of highest bounds of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.uses), top)
        for block in _blocks(batches):
            ids, bounds = upper_bounds(queries, block)
            for query, column in zip(*(x.tolist() for x in np.nonzero(bounds >= best.least[:, None]))):
                best.add(query, int(bounds[query, column]), int(ids[column]))
        yield best.rows()

    return blocks.select("bits", "docs", "ids", "lengths", "slices").mapInArrow(run, "query int, doc long, value long")


def not_excluded(blocks: DataFrame, queries: Queries, thresholds: list[tuple[int, int]]) -> DataFrame:
    """``(doc)``, distinct within a task: documents whose bound reaches a query's threshold, a score and the id it goes with."""
    least = np.array([t[0] for t in thresholds], np.int64)[:, None]
    last = np.array([t[1] for t in thresholds], np.int64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            ids, bounds = upper_bounds(queries, block)
            open_ = ((bounds > least) | ((bounds == least) & (ids[None, :] <= last))).any(axis=0)
            yield pa.RecordBatch.from_pydict({"doc": np.unique(ids[open_])})

    return blocks.select("bits", "docs", "ids", "lengths", "slices").mapInArrow(run, "doc long")


def exact_scores(docs: DataFrame, queries: Queries, top: int) -> DataFrame:
    """``(query, doc, value)``: the highest exact scores of each task, from whole texts; a null id is ``NO_ID``."""
    number_of = {t: k for k, t in enumerate(queries.vocabulary)}
    users: list[list[tuple[int, int]]] = [[] for _ in queries.vocabulary]
    for query, use in enumerate(queries.uses):
        for term, often in use:
            users[term].append((query, often * queries.weights[term]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.uses), top)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(terms(text))
                m = queries.length_part(counts.total())
                scores: dict[int, int] = {}
                for term in counts.keys() & number_of.keys():
                    tf, number = counts[term], number_of[term]
                    part = (10**9 * tf) // (1000 * tf + 12 * m)
                    for query, weight in users[number]:
                        scores[query] = scores.get(query, 0) + weight * part
                for query, score in scores.items():
                    best.add(query, score, doc)
        yield best.rows()

    return docs.mapInArrow(run, "query int, doc long, value long")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("value"), F.asc("doc"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search(docs: DataFrame, found: list, top: int) -> DataFrame:
    """``(query, rank, doc, value)`` for a block of queries (collected rows of texts) over all documents."""
    counted = [Counter(terms(row.text or "")) for row in found]
    vocabulary = sorted(set().union(*counted))
    blocks = stored(index(docs, vocabulary))
    total = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.sum("n_terms").alias("n_terms")).first()
    held = {r.term: r.df for r in blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df")).collect()}
    weights = [math.floor(1000 * math.log((2 * total.docs + 2) / (2 * held[k] + 1))) if k in held else 0 for k in range(len(vocabulary))]
    number_of = {t: k for k, t in enumerate(vocabulary)}
    uses = [[(number_of[t], n) for t, n in own.items() if weights[number_of[t]] > 0] for own in counted]
    queries = Queries(vocabulary, weights, uses, total.docs, max(1, total.n_terms or 0))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_of().alias("text"))

    def scored(ids: DataFrame) -> DataFrame:
        picked = stored(ids.select(F.col("doc").alias("of_doc")).distinct())
        return stored(_ranked(exact_scores(texts.join(picked, F.col("doc") == F.col("of_doc"), "left_semi"), queries, top), top))

    sure = scored(_ranked(highest_bounds(blocks, queries, top), top))
    thresholds = [(1, NO_ID)] * len(found)
    for row in sure.where(F.col("rank") == top).collect():
        thresholds[row["query"]] = (row.value, row.doc)
    return scored(not_excluded(blocks, queries, thresholds))


def search(docs: DataFrame, queries: DataFrame, key: str = "item_id", top: int = TOP) -> DataFrame:
    """``(key, rank, doc_id, score)``: the ``top`` documents of highest score above 0 for every row of queries (``key, text``).

    Equal scores go by ascending id, a null id after all others.  Null and empty texts have no terms, neither as
    documents nor as queries.  Rows that repeat an id are documents, or queries, of their own.  An empty table of either
    gives an empty result; further columns are not read.
    """
    spark = prepared(docs.sparkSession)
    kind = dict(queries.dtypes)[key]
    own = queries.select(F.col(f"`{key}`").alias("key"), F.col("text"))
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, -(-size // QUERY_BYTES))
    results = []
    for part in range(parts):
        found = own.where(F.pmod(F.xxhash64("key", "text"), F.lit(parts)) == part).collect()
        names = spark.createDataFrame([(k, r.key) for k, r in enumerate(found)], f"query int, item {kind}")
        results.append(_search(docs, found, top).join(names, "query") if found else None)
    results = [r for r in results if r is not None]
    if not results:
        return spark.createDataFrame([], f"`{key}` {kind}, rank int, doc_id long, score long")
    both = reduce(DataFrame.unionByName, results)
    return both.select(F.col("item").alias(key), "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), F.col("value").alias("score"))
