"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A text is the set of its five-word shingles, as 64-bit hashes.  Two permutations of a universe of ``2**32`` give all
coordinates of a signature: one scatters the set, the other is applied after a circular shift by 1, 2, 3 and so on,
and a coordinate is the least value.  Bands of eight coordinates make candidates.

Equal sets are one node.  Nodes that share a band with its first node form candidate groups, which hold every link
that banding can see; no pairs are made.  The whole sets of a group then meet in one task, or, for a group beyond a
size in shingles, block by block; links are counted exactly there and those that join two components come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, prepared, stored, text_of
from tidewatch.llm.components import components

WORDS = 5
BANDS = 48
ROWS = 8
PERCENT = 85
BLOCK_SHINGLES = 1_000_000
CACHED_WORDS = 300_000
CHUNK = 1 << 14
_SCATTER = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))  # the first permutation
_CIRCLE = (np.uint32(0x9E3779B1), np.uint32(0x2C1B3C6D))  # the second, after the shift


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words, the whole sequence is one; empty without words."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    out = np.full(len(found) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _scattered(sets: np.ndarray) -> np.ndarray:
    x = (sets ^ sets >> np.uint64(32)).astype(np.uint32)
    for factor in _SCATTER:
        x ^= x >> np.uint32(16)
        x = x * factor
    return x ^ x >> np.uint32(13)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash coordinates, a row for each set; sets must not be empty."""
    out = np.empty((len(sets), size), np.uint32)
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + len(sets[stop]) <= CHUNK):
            total += len(sets[stop])
            stop += 1
        offsets = np.cumsum([0, *(len(s) for s in sets[start : stop - 1])])
        # (x - shift) times an odd factor is x times it less shift times it: the shift costs one subtraction.
        base = _scattered(np.concatenate(sets[start:stop])) * _CIRCLE[0]
        value, moved = np.empty_like(base), np.empty_like(base)
        for k in range(size):
            np.subtract(base, np.uint32((k + 1) * int(_CIRCLE[0]) & 0xFFFFFFFF), out=value)
            np.right_shift(value, np.uint32(15), out=moved)
            np.bitwise_xor(value, moved, out=value)
            np.multiply(value, _CIRCLE[1], out=value)
            out[start:stop, k] = np.minimum.reduceat(value, offsets)
        start = stop
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key a band; the band's number is part of it."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for k in range(rows):
        key = (key ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketch(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, set_digest, bands)``: size and digest of the set and its band keys."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t, words) for t in batch["text"]]
        filled = [k for k, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if filled:
            for k, row in zip(filled, band_keys(signatures([sets[k] for k in filled], bands * rows), bands, rows)):
                keys[k] = row
        return {
            "doc_id": batch["doc_id"], "n_shingles": [len(s) for s in sets],
            "set_digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "bands": keys,
        }

    return map_rows(docs.select("doc_id", text_of().alias("text")), run, "doc_id long, n_shingles long, set_digest binary, bands array<long>")


def exact_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join two components among the sets, ``100 * intersection >= percent * union`` counted exactly.

    Sets that can be linked share one of the rarest tokens that a set cannot do without; only such partners that are
    not in the same component yet are compared, many at once by counting over postings.
    """
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), int(ids[k])))
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    owner = np.repeat(np.arange(len(order)), sizes)
    tokens, code, count = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(tokens))
    code = rank[code]
    posting = owner[np.argsort(code, kind="stable")]  # owners ascend within a token
    ends = np.cumsum(np.bincount(code, minlength=len(tokens)))
    begins = ends - np.bincount(code, minlength=len(tokens))
    own = np.split(code, np.cumsum(sizes)[:-1])
    label = np.arange(len(order))
    links = []
    for i, n in enumerate(sizes.tolist()):
        if i == 0:
            continue
        ranks = np.sort(own[i])
        needed = n - -(-percent * n // 100) + 1  # a link has at least percent of n tokens in common
        partners = [posting[begins[t] : ends[t]] for t in ranks[:needed].tolist() if ends[t] - begins[t] > 1]
        if not partners:
            continue
        near = np.unique(np.concatenate(partners))
        near = near[near < i]
        near = near[(label[near] != label[i]) & (100 * sizes[near] >= percent * n)]
        if not len(near):
            continue
        if len(near) > 8:
            every = np.concatenate([posting[begins[t] : ends[t]] for t in ranks.tolist()])
            common = np.bincount(every, minlength=i + 1)[near]
        else:
            common = np.array([len(np.intersect1d(own[i], own[j], assume_unique=True)) for j in near.tolist()])
        for j in near[100 * common >= percent * (n + sizes[near] - common)].tolist():
            if label[j] != label[i]:
                links.append((int(ids[order[j]]), int(ids[order[i]])))
                label[label == label[j]] = label[i]
    return links


def verified_links(members: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(a, b)`` of rows ``root, block_a, block_b, doc_id, text``; rows of a key meet in one task, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def ended() -> pa.RecordBatch | None:
            found = exact_links(np.array(ids), sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_pydict({"a": [x for x, _ in found], "b": [x for _, x in found]}, schema=_LINK) if found else None

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for root, block_a, block_b, doc_id, text in zip(*columns):
                if (root, block_a, block_b) != key:
                    if (out := ended()) is not None:
                        yield out
                    key, ids, sets = (root, block_a, block_b), [], []
                ids.append(doc_id)
                sets.append(shingles(text, words))
        if (out := ended()) is not None:
            yield out

    keys = ["root", "block_a", "block_b"]
    return members.select(*keys, "doc_id", "text").repartition(*keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(run, "a long, b long")


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of all rows.

    Texts without words are linked with nothing.  An id that is repeated with other texts is one node with the links
    of all of them.  A null id is no node: its row has the component of equal texts and is kept.  Further columns are not read.
    """
    prepared(docs.sparkSession)
    sketches = stored(sketch(docs, words, bands, rows))
    nodes = stored(
        sketches.where("set_digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_digest")
        .agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies"))
    )
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    # Leaders of shared bands, exchanged again for the join so that Spark can split a band that many nodes share.
    leaders = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.bitwise_not("key").alias("of_key"), "leader")
    stars = keyed.join(leaders, F.bitwise_not("key") == F.col("of_key")).where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    grouped = stored(components(stars))
    sized = grouped.join(nodes.groupBy(F.col("node").alias("of_node")).agg(F.sum("n_shingles").alias("size")), F.col("id") == F.col("of_node")).groupBy("root").agg(F.sum("size").alias("size"))
    blocks = sized.select(F.bitwise_not("root").alias("of_root"), F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("block_a"), F.greatest(k, own).alias("block_b")))
    placed = grouped.join(blocks, F.bitwise_not("root") == F.col("of_root")).select("id", "root", F.explode(others).alias("pair")).select("id", "root", "pair.*")
    texts = docs.select("doc_id", text_of().alias("text"))
    links = stored(verified_links(texts.join(placed.hint("shuffle_hash"), F.col("doc_id") == F.col("id")), words, percent))
    roots = components(links).withColumnRenamed("id", "of_node")
    copied = nodes.where("copies > 1").select(F.hex("set_digest").alias("of_digest"), "node")
    found = sketches.select("doc_id", "n_shingles", "set_digest").join(copied, F.hex("set_digest") == F.col("of_digest"), "left")
    found = found.withColumn("node", F.coalesce("node", "doc_id")).join(roots, F.bitwise_not("node") == F.bitwise_not("of_node"), "left")
    component = F.coalesce("root", "node")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
