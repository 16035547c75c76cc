"""Removal of long repeats by a run-length index.

A byte goes if a string of 100 bytes over it also starts earlier.  Every such string holds a sampled anchor, a k-gram
whose hash is the least among those of the string, and so does its equal elsewhere; anchors bring equal strings
together without comparing documents.

1. Texts give their anchors with a hash of the context, the bytes that strings around the anchor can reach.  Contexts
   that repeat in a batch are settled there, so an anchor that many texts share arrives once a batch.
2. Anchors meet by hash.  An occurrence whose whole context occurred earlier is a repeat throughout.  Where an anchor
   has several contexts, the first occurrence of each is asked for its bytes.
3. Contexts meet by anchor.  A run-compressed Burrows-Wheeler transform of them is built with the suffix positions of
   its run heads; from these samples alone the longest match with the preceding suffix is streamed along the text, as
   it falls by one a byte until the next sample.  Matches of 100 bytes and more join strings that are equal, and all but
   the earliest of those are repeats.
4. Repeats are taken out of the texts.

Texts are dealt by ``doc_id`` once; anchors, contexts and repeats are a fraction of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import keyed_rows, map_rows, prepared, stored, text_of

LENGTH = 100
GRAM = 36
REACH = LENGTH - GRAM  # bytes beyond an anchor that a string over it can reach, on either side
PART_BYTES = 1 << 20
FLUSH_ANCHORS = 500_000
BUCKET_BYTES = 16 << 20  # text whose anchors make a bucket
INDEX_BYTES = 1 << 20  # contexts that an index should hold
LARGE_BYTES = 3 << 19
PASS_STRINGS = 2_000_000
_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
ANCHOR = np.dtype([("anchor", "<u4"), ("context", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1")])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PART_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _slid(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours from a position on; shorter by ``width - 1``."""
    take = np.minimum if least else np.maximum
    out, size = values, 1
    while 2 * size <= width:
        out = take(out[:-size], out[size:])
        size *= 2
    return take(out[: len(values) - width + 1], out[width - size : width - size + len(values) - width + 1])


def anchors(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full 64-bit anchor hashes and records of some texts, in their order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = int(sizes.sum())
    if n < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, ANCHOR)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    power, inverse = _powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], dtype=np.uint64, out=prefix[1:])
    grams = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: n - GRAM + 1]) | np.uint64(1)
    least = _slid(grams, REACH + 1, True)  # of the string that starts here
    valid = np.zeros(n + 1, np.int8)
    long = sizes >= LENGTH
    valid[starts[long]] += 1
    np.subtract.at(valid, starts[long] + sizes[long] - LENGTH + 1, 1)
    least[np.cumsum(valid)[: len(least)] == 0] = 0
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(len(grams) - len(least), np.uint64)])
    at = np.flatnonzero(_slid(padded, REACH + 1, False) == grams)
    owner = np.searchsorted(starts, at, "right") - 1
    left = np.minimum(REACH, at - starts[owner])
    right = np.minimum(REACH, starts[owner] + sizes[owner] - at - GRAM)
    out = np.empty(len(at), ANCHOR)
    whole = (prefix[at + GRAM + right] - prefix[at - left]) * inverse[at - left]
    out["context"] = _mixed(whole ^ (left * 256 + right + 1).astype(np.uint64) * np.uint64(_BASE))
    out["anchor"] = (grams[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out["doc"], out["pos"], out["left"], out["right"] = docs[owner], at - starts[owner], left, right
    return grams[at], out


def _repeats(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the records by anchor, context and place, and which of them have an equal context earlier."""
    order = np.lexsort((records["pos"], records["doc"], records["context"], records["anchor"]))
    a, c = records["anchor"][order], records["context"][order]
    again = np.zeros(len(order), bool)
    again[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
    return order, again


def _spans(records: np.ndarray) -> np.ndarray:
    """``(doc, start, end)`` of whole contexts, those shorter than a string left out."""
    out = np.empty(len(records), SPAN)
    out["doc"] = records["doc"]
    out["start"] = records["pos"] - records["left"]
    out["end"] = records["pos"] + GRAM + records["right"]
    return out[out["end"] - out["start"] >= LENGTH]


SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
ASKED = np.dtype([("doc", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("bucket", "<i4")])


def anchor_blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, records, spans)``: anchors for the task of their hash, and spans that are settled already."""

    def flushed(keys: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        key, row = np.concatenate(keys), np.concatenate(rows)
        order, again = _repeats(row)
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        first = np.sort(order[~again])
        first = first[np.argsort(bucket[first], kind="stable")]
        settled = _spans(row[np.sort(order[again])])
        here = _mixed(settled["doc"].astype(np.uint64)) % np.uint64(buckets)
        settled = settled[np.argsort(here, kind="stable")]
        cuts = np.searchsorted(bucket[first], np.arange(buckets + 1))
        ends = np.searchsorted(np.sort(here), np.arange(buckets + 1).astype(np.uint64))
        used = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(ends) > 0))
        return pa.RecordBatch.from_pydict({
            "bucket": used.astype(np.int32), "records": [_packed(row[first[cuts[b] : cuts[b + 1]]]) for b in used],
            "spans": [_packed(settled[ends[b] : ends[b + 1]]) for b in used],
        }, schema=pa.schema([("bucket", pa.int32()), ("records", pa.binary()), ("spans", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, held = [], [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start, total = 0, 0
            for k in range(len(texts) + 1):
                if k == len(texts) or (k > start and total + len(texts[k]) > PART_BYTES):
                    if k > start:
                        key, row = anchors(texts[start:k], np.array(ids[start:k], np.int64))
                        keys.append(key)
                        rows.append(row)
                        held += len(key)
                    start, total = k, 0
                if k < len(texts):
                    total += len(texts[k])
            if held >= FLUSH_ANCHORS:
                yield flushed(keys, rows)
                keys, rows, held = [], [], 0
        if held:
            yield flushed(keys, rows)

    return docs.select("doc_id", F.col("text").cast("binary").alias("bytes")).mapInArrow(run, "bucket int, records binary, spans binary")


def _packed(records: np.ndarray) -> bytes:
    """Column by column, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(records[n]).tobytes() for n in records.dtype.names)


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    n = len(blob) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for name in kind.names:
        size = kind[name].itemsize
        out[name] = np.frombuffer(blob, kind[name], n, at)
        at += size * n
    return out


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Rows of one bucket at a time from rows sorted by their first column."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key:
                if held:
                    yield key, held
                key, held = row[0], []
            held.append(row[1:])
    if held:
        yield key, held


def _doc_rows(spans: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
    """One row a document with its spans and its requests."""
    spans, asked = spans[np.argsort(spans["doc"], kind="stable")], asked[np.argsort(asked["doc"], kind="stable")]
    docs = np.union1d(spans["doc"], asked["doc"])
    s, a = (np.append(np.searchsorted(x["doc"], docs), len(x)) for x in (spans, asked))
    return pa.RecordBatch.from_pydict({
        "doc": docs, "spans": [_packed(spans[s[k] : s[k + 1]]) for k in range(len(docs))],
        "asked": [_packed(asked[a[k] : a[k + 1]]) for k in range(len(docs))],
    }, schema=pa.schema([("doc", pa.int64()), ("spans", pa.binary()), ("asked", pa.binary())]))


def meet(blobs: DataFrame, slices: int) -> DataFrame:
    """``(doc, spans, asked)``: repeats of whole contexts, and contexts that must be compared; ``slices`` a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            records = np.concatenate([_unpacked(r, ANCHOR) for r, _ in rows])
            spans = [_unpacked(s, SPAN) for _, s in rows]
            asked = np.empty(0, ASKED)
            if len(records):
                order, again = _repeats(records)
                spans.append(_spans(records[order[again]]))
                first = records[order[~again]]
                same = first["anchor"][1:] == first["anchor"][:-1]
                several = np.zeros(len(first), bool)
                several[1:] |= same
                several[:-1] |= same
                several &= first["left"].astype(int) + first["right"] >= REACH
                chosen = first[several]
                asked = np.empty(len(chosen), ASKED)
                for name in ("doc", "pos", "left", "right"):
                    asked[name] = chosen[name]
                asked["bucket"] = bucket * slices + (chosen["anchor"] % slices).astype(np.int64)
            yield _doc_rows(np.concatenate(spans), asked)

    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, spans binary, asked binary")


def contexts(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``(bucket, places, bytes)``: the bytes around the anchors that were asked for."""
    joined = texts.join(asked.hint("shuffle_hash"), F.col("doc_id") == F.col("doc")).select(F.col("text").cast("binary"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, list] = {}
            for text, blobs in zip(*(c.to_pylist() for c in batch.columns)):
                for blob in blobs:
                    for row in _unpacked(blob, ASKED).tolist():
                        doc, pos, left, right, bucket = row
                        out.setdefault(bucket, []).append((doc, pos - left, text[pos - left : pos + GRAM + right]))
            places = [np.array([(d, s, s + len(x)) for d, s, x in rows], SPAN).tobytes() for rows in out.values()]
            yield pa.RecordBatch.from_pydict(
                {"bucket": np.array(list(out), np.int32), "places": places, "bytes": [b"".join(x for _, _, x in rows) for rows in out.values()]},
                schema=pa.schema([("bucket", pa.int32()), ("places", pa.binary()), ("bytes", pa.binary())]),
            )

    return joined.mapInArrow(run, "bucket int, places binary, bytes binary")


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with the suffix positions of its run heads.

    Each text ends in a sentinel below all bytes; equal suffixes go by their place, as with a sentinel of its own
    for each text.  ``matches`` streams the longest match of every suffix with the one before it from the samples.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        """``data``: bytes plus one with a 0 after every text; ``ends``: the places of the zeros."""
        n = len(data)
        padded = np.zeros(n + 8, np.uint16)
        padded[:n] = data
        stop = np.repeat(ends, np.diff(ends, prepend=-1)).astype(np.int32)
        key = np.zeros(n, np.uint64)
        for k in range(7):  # seven letters of nine bits
            letter = padded[k : k + n].astype(np.uint64)
            letter[np.arange(n) + k > stop] = 0
            key = key << np.uint64(9) | letter
        self.levels = []
        order = np.argsort(key, kind="stable")
        rank = self._ranked(order, key[order])
        size = 7
        while True:
            self.levels.append((size, rank))
            if rank.max(initial=0) == n - 1 or size > int((stop - np.arange(n)).max(initial=0)):
                break
            beyond = np.arange(n, dtype=np.int32) + np.int32(size)
            key = rank.astype(np.int64) * (n + 1)
            inside = beyond <= stop
            key[inside] += rank[beyond[inside]].astype(np.int64) + 1
            order = np.argsort(key, kind="stable")
            rank = self._ranked(order, key[order])
            size *= 2
        self.stop, self.padded = stop, padded
        # The transform and its run heads: all that the matches below are made from.
        before = np.where(order > 0, data[np.maximum(order, 1) - 1], 0)
        head = np.ones(n, bool)
        head[1:] = before[1:] != before[:-1]
        head[1:] |= (before[1:] == 0)
        rows = np.flatnonzero(head)
        self.run_letters, self.run_rows = before[rows], rows
        self.sample = order[rows]
        self.sample_before = np.where(rows > 0, order[np.maximum(rows, 1) - 1], -1)
        self.order = order

    @staticmethod
    def _ranked(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int32)
        step = np.zeros(len(order), np.int32)
        step[1:] = keys[1:] != keys[:-1]
        rank[order] = np.cumsum(step, dtype=np.int32)
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes, within their texts."""
        n = len(self.stop)
        size = np.zeros(len(a), np.int64)
        limit = np.minimum(self.stop[a] - a, self.stop[b] - b)
        for step, rank in reversed(self.levels):
            for _ in range(2 if (step, rank) is self.levels[-1] else 1):
                fits = size + step <= limit
                equal = fits & (rank[np.minimum(a + size, n - 1)] == rank[np.minimum(b + size, n - 1)])
                size += np.where(equal, step, 0)
        for _ in range(7):
            more = (size < limit) & (self.padded[np.minimum(a + size, n - 1)] == self.padded[np.minimum(b + size, n - 1)])
            size += more
        return size

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place the suffix before it in the order (-1: none) and the length they have in common."""
        by_place = np.argsort(self.sample)
        at, previous = self.sample[by_place], self.sample_before[by_place]
        there = previous >= 0
        length = np.zeros(len(at), np.int64)
        length[there] = self.common(at[there], previous[there])
        place = np.arange(len(self.stop))
        k = np.searchsorted(at, place, "right") - 1
        gone = place - at[k]
        return np.where(there[k], previous[k] + gone, -1), np.maximum(0, length[k] - gone)


def index_repeats(places: np.ndarray, data: bytes) -> np.ndarray:
    """``(doc, start, end)`` of strings in the contexts that also start earlier in one of them, runs of starts joined."""
    sizes = (places["end"] - places["start"]).astype(np.int64)
    order = np.lexsort((places["start"], places["doc"]))
    begins = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, np.uint8)
    sizes, sorted_places = sizes[order], places[order]
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = int(ends[-1]) + 1
    source = np.repeat(begins[order] - starts, sizes + 1) + np.arange(n)
    letters = np.zeros(n, np.uint16)
    inside = np.ones(n, bool)
    inside[ends] = False
    letters[inside] = raw[source[inside]].astype(np.uint16) + 1
    index = RunLengthIndex(letters, ends)
    _, length = index.matches()
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    place = np.arange(n) - starts[text] + sorted_places["start"][text]
    docs, rank = np.unique(sorted_places["doc"], return_inverse=True)
    when = rank[text].astype(np.int64) << 32 | place
    new = length[index.order] < LENGTH
    new[0] = True
    first = np.flatnonzero(new)
    earliest = np.empty(n, np.int64)
    earliest[index.order] = np.repeat(np.minimum.reduceat(when[index.order], first), np.diff(np.append(first, n)))
    return _joined(docs, np.unique(when[(earliest < when) & (index.stop - np.arange(n) >= LENGTH)]))


def _joined(docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Spans of sorted starts ``rank << 32 | place``, neighbours in one."""
    if not len(starts):
        return np.empty(0, SPAN)
    cut = np.flatnonzero(np.diff(starts) != 1)
    low, high = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
    out = np.empty(len(low), SPAN)
    out["doc"], out["start"], out["end"] = docs[low >> 32], low & 0xFFFFFFFF, (high & 0xFFFFFFFF) + LENGTH
    return out


def hashed_repeats(places: np.ndarray, data: bytes) -> np.ndarray:
    """As ``index_repeats``, for more contexts than an index should hold: strings are compared by 64-bit mixes of two
    hashes, in passes over a share of the hash values each, so memory stays at the contexts and one pass."""
    sizes = (places["end"] - places["start"]).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    docs, rank = np.unique(places["doc"], return_inverse=True)
    passes = max(1, -(-int(np.maximum(0, sizes - LENGTH + 1).sum()) // PASS_STRINGS))
    found = [np.empty(0, np.int64)]
    for number in range(passes):
        keys, whens = [], []
        low = 0
        while low < len(sizes):
            high = max(low + 1, int(np.searchsorted(begins, begins[low] + PART_BYTES)))
            raw = np.frombuffer(data, np.uint8, int(sizes[low:high].sum()), int(begins[low]))
            key, at = _string_keys(raw)
            owner = np.searchsorted(begins[low:high], at + begins[low], "right") - 1 + low
            offset = at + begins[low] - begins[owner]
            mine = (offset + LENGTH <= sizes[owner]) & (key % np.uint64(passes) == number)
            keys.append(key[mine])
            whens.append(rank[owner[mine]].astype(np.int64) << 32 | (places["start"][owner[mine]] + offset[mine]))
            low = high
        key, when = np.concatenate(keys), np.concatenate(whens)
        order = np.lexsort((when, key))
        key, when = key[order], when[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        found.append(when[when > when[first]])
    return _joined(docs, np.unique(np.concatenate(found)))


def _string_keys(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all strings of the length and their places."""
    power, inverse = _powers(len(raw) + 1)
    at = np.arange(len(raw) - LENGTH + 1)
    both = []
    for letters in (raw, raw ^ 0x5A):
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[letters] * power[: len(raw)], dtype=np.uint64, out=prefix[1:])
        both.append(_mixed((prefix[LENGTH:] - prefix[:-LENGTH]) * inverse[: len(at)]))
    return _mixed(both[0] + both[1] * np.uint64(_BASE)), at


def compare(found: DataFrame) -> DataFrame:
    """``(doc, spans, asked)`` of contexts that meet in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            places = np.concatenate([np.frombuffer(p, SPAN) for p, _ in rows])
            data = b"".join(b for _, b in rows)
            spans = (index_repeats if len(data) <= LARGE_BYTES else hashed_repeats)(places, data)
            if len(spans):
                yield _doc_rows(spans, np.empty(0, ASKED))

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, spans binary, asked binary")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``(doc, blobs)``: packed spans of every document that has repeats.  ``texts``: unique ``doc_id``, ``text``."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    met = stored(meet(anchor_blobs(texts, buckets), slices=max(1, BUCKET_BYTES // INDEX_BYTES)))
    asked = met.where(F.octet_length("asked") > 0).groupBy("doc").agg(F.collect_list("asked").alias("asked"))
    compared = compare(contexts(texts, asked))
    spans = met.select("doc", "spans").unionByName(compared.select("doc", "spans")).where(F.octet_length("spans") > 0)
    return spans.groupBy("doc").agg(F.collect_list("spans").alias("blobs"))


def _merged(text: bytes, blobs: list[bytes] | None) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs and what is left."""
    if not blobs:
        return [], text
    spans = np.concatenate([_unpacked(b, SPAN) for b in blobs])
    spans = spans[np.argsort(spans["start"], kind="stable")]
    start, end = spans["start"].astype(np.int64), np.maximum.accumulate(spans["end"].astype(np.int64))
    cut = np.flatnonzero(start[1:] > end[:-1])
    low, high = start[np.append(0, cut + 1)].tolist(), end[np.append(cut, len(end) - 1)].tolist()
    left = [text[a:b] for a, b in zip([0, *high], [*low, len(text)])]
    return list(zip(low, high)), b"".join(left)


def remove_repeats(docs: DataFrame, as_text: bool = False, every_row: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans array<struct<start,end>>, kept binary, kept_text)``, spans in bytes, end
    beyond the last.  ``kept_text``, if asked for, leaves out letters of which only a part is kept.

    Order is that of ids, then of places; null texts are empty; a null id comes after all others.  Texts shorter than
    100 bytes stay whole.  With ``every_row`` each row has a result, and rows that share an id (or have none) go by the
    SHA-256 of their texts; columns to carry follow.  Otherwise rows that repeat an id are one document, that with the
    smallest text.
    """
    prepared(docs.sparkSession)
    if carry and not every_row:
        raise ValueError("columns are carried with every row only")
    last = (1 << 63) - 1
    own = F.col("doc_id").cast("long")
    texts = docs.select(F.coalesce(own, F.lit(last)).alias("doc_id"), text_of().alias("text"), own.alias("own_id"), *carry)
    ids = texts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("distinct")).first()
    if ids.n != ids.distinct and every_row:
        keyed = keyed_rows(docs.select(own.alias("doc_id"), text_of().alias("text"), *carry), "row_key")
        texts = keyed.select(F.col("row_key").alias("doc_id"), "text", F.col("doc_id").alias("own_id"), *carry)
    elif ids.n != ids.distinct:
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("own_id").alias("own_id"))
    found = repeated_spans(texts.select("doc_id", "text"))
    joined = texts.join(found.hint("shuffle_hash"), F.col("doc_id") == F.col("doc"), "left").select("own_id", F.col("text").cast("binary").alias("text"), "blobs", *carry)

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["own_id"], "n_bytes": [], "n_removed": [], "spans": [], "kept": [], "kept_text": []}
        for text, blobs in zip(batch["text"], batch["blobs"]):
            spans, kept = _merged(text, blobs)
            for name, value in (
                ("n_bytes", len(text)), ("n_removed", len(text) - len(kept)), ("spans", [{"start": a, "end": b} for a, b in spans]),
                ("kept", kept), ("kept_text", kept.decode("utf-8", "ignore") if as_text else None),
            ):
                out[name].append(value)
        return out

    return map_rows(joined, run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_text string", carry)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
