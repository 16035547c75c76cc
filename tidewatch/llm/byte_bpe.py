"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges wait in one bucket per rank.  A bitmap of 256-bit words over the ranks, with one bitmap over its words above
it, finds the lowest rank that has entries by two find-first-set steps.  A bucket holds positions in the linked list
of parts, which are taken from left to right.  An entry whose pair has changed since is stale and skipped.  All new
pre-tokens of some texts lie in one list, parted by stops that merge with nothing, so that a rank is drawn once for
all of them; what a pre-token becomes does not depend on the others.  n bytes cost O(n log n) at worst, whether they
are one pre-token or many.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, text_of

WORD_BITS = 8  # ranks a word of the bitmap covers, as a power of two
CACHED_PIECES = 500_000  # of one generation; there are two
CACHED_LENGTH = 64
QUEUE_CHARS = 1 << 17  # pre-tokens that share a queue, the last of them whole
GROUP_CHARS = 1 << 21  # texts whose pre-tokens are looked up together; a longer one is alone
SLICE_IDS = 1 << 16  # ids that are digested at once
_ENCODERS: dict[tuple[str, str], "Encoder"] = {}


def _drawn(heap: list[int]) -> Iterator[int]:
    while heap:
        yield heappop(heap)


class Encoder:
    """Rank table, split pattern and a bounded cache of pre-tokens for one Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = self.size = max(self.ranks.values()) + 1
        self.pattern = regex.compile(pattern)
        # The queue: a bucket is a list only while its bit is set; all bits are clear between two lists of parts.
        self.buckets: list[list[int] | None] = [None] * size
        self.words = [0] * ((size >> WORD_BITS) + 1)
        self.bits = [1 << k for k in range(max(1 << WORD_BITS, len(self.words)))]
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(size)]
        # Numbers of parts: ranks, then the stop, then bytes that the file lacks.
        number = {bytes((b,)): size + 1 + b for b in range(256)} | self.ranks
        self.single = np.array([number[bytes((b,))] for b in range(256)])
        self.absent = bool((self.single > size).any())
        self.follow: list[dict[int, int]] = [{}] * (size + 257)  # rank of a part (place) with the next one (key)
        self.start = np.full(1 << 16, -1)  # rank of two bytes
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.start[token[0] << 8 | token[1]] = rank
            for cut in range(1, len(token)):
                left, right = number.get(token[:cut]), number.get(token[cut:])
                if left is not None and right is not None:
                    if not self.follow[left]:
                        self.follow[left] = {}
                    self.follow[left][right] = rank
        # Ids as the bytes of 32-bit numbers: smaller than tuples, and nothing for the garbage collector to visit.
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of pre-tokens that are not empty, each as 32-bit numbers."""
        rank_of, size, follow, buckets, words, bits = self.ranks.get, self.size, self.follow, self.buckets, self.words, self.bits
        data = b"\0".join([*pieces, b""])
        n = len(data)
        codes = np.frombuffer(data, np.uint8).astype(np.int64)
        stops = np.cumsum([len(p) + 1 for p in pieces]) - 1
        parts = self.single[codes]
        parts[stops] = size
        pair = np.full(n, -1)  # rank of the pair that begins here; -1: none
        pair[:-1] = self.start[codes[:-1] << 8 | codes[1:]]
        pair[stops] = pair[stops - 1] = -1
        order = np.flatnonzero(pair >= 0)
        order = order[np.argsort(pair[order], kind="stable")]
        ranks, begins = np.unique(pair[order], return_index=True)
        order, top = order.tolist(), 0
        for rank, begin, end in zip(ranks.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)]):
            buckets[rank] = order[begin:end]
            words[rank >> WORD_BITS] |= bits[rank & 255]
            top |= bits[rank >> WORD_BITS]
        parts, pair = parts.tolist(), pair.tolist()
        after = list(range(1, n + 1))
        before = [n - 1, 0, *after[: n - 2]]  # what lies before the first place is the last one, a stop
        heaps: dict[int, list[int]] = {}  # what a rank left when a lower one came up in its midst
        while top:
            at = (top & -top).bit_length() - 1
            word = words[at]
            bit = word & -word
            rank = (at << WORD_BITS) + bit.bit_length() - 1
            words[at] = word = word ^ bit
            if not word:
                top ^= bits[at]
            bucket, buckets[rank] = buckets[rank], None
            heap = heaps.pop(rank, None) if heaps else None
            if heap is None:
                bucket.sort()
                entries = iter(bucket)
            else:
                for i in bucket:
                    heappush(heap, i)
                entries = _drawn(heap)
            follows = follow[rank].get
            lower = False
            for i in entries:
                if pair[i] != rank:
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                before[end] = i
                pair[gone] = -1
                parts[i] = rank
                new = follows(parts[end])
                if new is None:
                    pair[i] = -1
                else:
                    pair[i] = new
                    waiting = buckets[new]
                    if waiting is not None:
                        waiting.append(i)
                    else:
                        buckets[new] = [i]
                        at = new >> WORD_BITS
                        words[at] |= bits[new & 255]
                        top |= bits[at]
                        lower = new < rank
                left = before[i]
                new = follow[parts[left]].get(rank)
                if new is None:
                    pair[left] = -1
                else:
                    pair[left] = new
                    waiting = buckets[new]
                    if waiting is not None:
                        waiting.append(left)
                    else:
                        buckets[new] = [left]
                        at = new >> WORD_BITS
                        words[at] |= bits[new & 255]
                        top |= bits[at]
                        lower = lower or new < rank
                if lower:
                    rest = list(entries) if heap is None else heap
                    if rest:
                        heaps[rank], buckets[rank] = rest, []
                        words[rank >> WORD_BITS] |= bits[rank & 255]
                        top |= bits[rank >> WORD_BITS]
                    break
        live, i = [], 0
        while i < n:
            live.append(parts[i])
            i = after[i]
        ids = np.array(live, np.int32)
        ends = (np.flatnonzero(ids == size) * 4).tolist()
        packed = ids.tobytes()
        found = [packed[begin:end] for begin, end in zip([0, *(end + 4 for end in ends)], ends)]
        for k, piece in enumerate(pieces):
            whole = rank_of(piece)
            if whole is not None:
                found[k] = np.int32(whole).tobytes()
        return found

    def _learn(self, pieces: set[str]) -> None:
        """Put what is not cached into the younger generation."""
        older = self.older
        queue, length = [], 0
        for piece in pieces.difference(self.pieces):
            ids = older.get(piece)
            if ids is not None:
                self.pieces[piece] = ids
                continue
            queue.append(piece)
            length += len(piece)
            if length >= QUEUE_CHARS:
                self.pieces.update(zip(queue, self.merge([p.encode() for p in queue])))
                queue, length = [], 0
        if queue:
            self.pieces.update(zip(queue, self.merge([p.encode() for p in queue])))

    def encode_all(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        begin = 0
        while begin < len(texts):
            end, length = begin, 0
            while end < len(texts) and (end == begin or length + len(texts[end]) <= GROUP_CHARS):
                length += len(texts[end])
                end += 1
            split = list(map(self.pattern.findall, texts[begin:end]))
            begin = end
            if len(self.pieces) >= CACHED_PIECES:
                self.older, self.pieces = self.pieces, {}
            wanted, cached = set().union(*split), self.pieces
            self._learn(wanted)
            for pieces in split:
                yield np.frombuffer(b"".join(map(cached.__getitem__, pieces)), np.int32)
            for piece in wanted:
                if len(piece) > CACHED_LENGTH:
                    cached.pop(piece, None)

    def listed(self, ids: np.ndarray) -> np.ndarray | list[int | None]:
        """Ids with null for a byte that the rank file lacks."""
        return [k if k < self.size else None for k in ids.tolist()] if self.absent else ids

    def encode(self, text: str) -> list[int]:
        [ids] = self.encode_all([text])
        return self.listed(ids) if self.absent else ids.tolist()

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the decimal ids joined by a space and of the bytes they decode to."""
        numbers, decoded = hashlib.sha256(), hashlib.sha256()
        for begin in range(0, len(ids), SLICE_IDS):
            part = ids[begin : begin + SLICE_IDS].tolist()
            numbers.update((" " * (begin > 0) + " ".join(map(self.decimal.__getitem__, part))).encode())
            decoded.update(self.decode(part))
        return numbers.hexdigest(), decoded.hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process, tables and cache included."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every whole text; no shuffle.

    A null or empty text has no ids, a repeated row its own result, a null id stays null; further columns are not read.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        tool = encoder(path, pattern)
        return {"key": batch["key"], "ids": [tool.listed(ids) for ids in tool.encode_all(batch["text"])]}

    pruned = docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text"))
    return map_rows(pruned, rows, f"key {dict(docs.dtypes)[id_column]}, ids array<int>").withColumnRenamed("key", id_column)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As ``encode``, but the ids stay in the worker: their number, the digest of the ids and of the bytes they decode to."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        tool = encoder(path, pattern)
        n_tokens, ids_sha256, decoded_sha256 = [], [], []
        for ids in tool.encode_all(batch["text"]):
            numbers, decoded = tool.digests(ids)
            n_tokens.append(len(ids))
            ids_sha256.append(numbers)
            decoded_sha256.append(decoded)
        return {"key": batch["key"], "n_tokens": n_tokens, "ids_sha256": ids_sha256, "decoded_sha256": decoded_sha256}

    pruned = docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text"))
    schema = f"key {dict(docs.dtypes)[id_column]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(pruned, rows, schema).withColumnRenamed("key", id_column)


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``(id, decoded binary)`` of rows with ``ids``."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        tool = encoder(path, pattern)
        return {"key": batch["key"], "decoded": [tool.decode(ids or []) for ids in batch["ids"]]}

    pruned = encoded.select(F.col(id_column).alias("key"), "ids")
    return map_rows(pruned, rows, f"key {dict(encoded.dtypes)[id_column]}, decoded binary").withColumnRenamed("key", id_column)
