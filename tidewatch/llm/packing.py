"""Best-two-fit packing of token sequences.

A bin is filled greedily with the longest pieces that still fit.  If a gap is left, its smallest piece gives way to
two unpacked pieces that fill the grown gap more tightly.  Lengths are all that the choice needs, so the plan is made
on the histogram of lengths (at most ``capacity`` counts, whatever the corpus) and a pattern of lengths is repeated
as often as its counts allow: at most ``capacity * ln(capacity)`` patterns or so.  Pieces then find their bin by
their rank within their length, which Spark computes in salted slices.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import map_rows, stored, text_of

CAPACITY = 2048
SLICE_ROWS = 200_000
_TOKENIZERS: dict[str, "FileTokenizer"] = {}


class FileTokenizer:
    """Ids of a ``tokenizers`` byte-level BPE file; none are put around a text.

    The file is read by ``tokenizers``; texts are encoded by ``tiktoken`` with that vocabulary, which gives the same
    ids several times faster (every token of such a file is reached by its merges, so its lowest-rank merges are the
    same).  Added tokens of the file that occur in a text either have their ids, as in the library by default, and the
    text between them is encoded piece by piece, or count as plain text (``encode_special_tokens`` of the library).
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        self.added = tool.get_added_tokens_decoder()
        self.added_ids = {t.content: i for i, t in self.added.items()}
        # The leftmost, and of those the longest, as in the library.
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added_ids, key=len, reverse=True))) + ")")
        byte_of = _bytes_of_letters()
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in tool.get_vocab().items() if t not in self.added_ids}
        self.tool = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, added_tokens: bool = False) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not added_tokens or not any(t in text for t in self.added_ids):
            return np.array(self.tool.encode_ordinary(text), "<u4").tobytes()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in self.added.values()):
            raise ValueError("added tokens that depend on their neighbours or on a normalizer are not supported")
        ids: list[int] = []
        for k, part in enumerate(self.split.split(text)):
            ids.extend([self.added_ids[part]] if k % 2 else self.tool.encode_ordinary(part))
        return np.array(ids, "<u4").tobytes()


def _bytes_of_letters() -> dict[str, int]:
    """The letters in which byte-level BPE files write bytes: visible ones stand for themselves, the rest follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def file_tokenizer(path: str, pattern: str) -> FileTokenizer:
    """One per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = FileTokenizer(path, pattern)
    return _TOKENIZERS[path]


def pieces_of(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, added_tokens: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: ids of the whole text and the end id, cut only beyond the capacity.

    The first piece takes what is over, the others are full.  A null or empty text is the end id alone.
    ``added_tokens``: those of the file that a text holds have their ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def rows(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        tool = file_tokenizer(path, pattern)
        for key, text in zip(batch["doc_id"], batch["text"]):
            ids = tool.encode(text, added_tokens) + end
            total = len(ids) // 4
            start, piece = 0, 0
            while start < total:
                length = (total - 1) % capacity + 1 if piece == 0 else capacity
                for name, value in zip(out, (key, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                    out[name].append(value)
                start, piece = start + length, piece + 1
        return out

    pruned = docs.select("doc_id", text_of().alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return map_rows(pruned, rows, schema)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """``(times, lengths)`` patterns that use up the counts; lengths descend, a pattern never exceeds the capacity."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    free = np.zeros(capacity + 1, np.int64)
    for n, c in left.items():
        free[n] = c
    plan = []
    while lengths:
        used: Counter[int] = Counter()
        gap = capacity
        at = len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            if n <= gap and used[n] < free[n]:
                take = min(gap // n, int(free[n]) - used[n])
                used[n] += take
                gap -= take * n
            at = min(at - 1, bisect_right(lengths, gap) - 1)
        smallest = min(used)
        if gap and (pair := _two_for(smallest, gap, free, used)):
            used[smallest] -= 1
            used.update(pair)
            used += Counter()
        times = min(int(free[n]) // k for n, k in used.items())
        plan.append((times, sorted(used.elements(), reverse=True)))
        for n, k in used.items():
            free[n] -= times * k
        lengths = [n for n in lengths if free[n] > 0]
    return plan


def _two_for(smallest: int, gap: int, free: np.ndarray, used: Counter) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest above ``smallest`` within the gap that its removal leaves."""
    rest = free[: smallest + gap + 1].copy()
    for n, k in used.items():
        if n < len(rest):
            rest[n] -= k
    there = rest > 0
    for total in range(smallest + gap, smallest, -1):
        half = total // 2
        low = there[1 : half + 1] & there[total - half : total][::-1]
        if total % 2 == 0 and half >= 1 and low[half - 1] and rest[half] < 2:
            low[half - 1] = False
        found = np.flatnonzero(low)
        if len(found):
            return int(found[0]) + 1, total - int(found[0]) - 1
    return None


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.  ``pieces`` should be stored: it is read three times, skinny.

    Ties within a length go by ``doc_id``, ``piece``; an empty table gives an empty result.
    """
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter[int] = Counter()
    sequences = 0
    for times, lengths in best_two_fit(counts, capacity):
        offset = 0
        for n in lengths:
            by_length.setdefault(n, []).append((taken[n], sequences, offset))
            taken[n] += times
            offset += n
        sequences += times
    slots = {n: tuple(np.array(x, np.int64) for x in zip(*s)) for n, s in by_length.items()}
    slices = [max(1, -(-counts.get(n, 0) // SLICE_ROWS)) for n in range(capacity + 1)]
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(slices), F.col("length").cast("int") + 1)).cast("int")
    salted = pieces.withColumn("slice", salt)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("length").alias("of_length"), F.col("slice").alias("of_slice"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("within", within - 1).join(
        starts, (F.col("length") == F.col("of_length")) & (F.col("slice") == F.col("of_slice"))
    ).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("within")).alias("rank"))

    def place(batch: dict[str, list]) -> dict[str, list]:
        sequence, offset = [], []
        for n, rank in zip(batch["length"], batch.pop("rank")):
            firsts, bins, offsets = slots[n]
            at = int(np.searchsorted(firsts, rank, "right")) - 1
            sequence.append(int(bins[at]) + rank - int(firsts[at]))
            offset.append(int(offsets[at]))
        return batch | {"sequence_id": sequence, "offset": offset}

    kind = dict(pieces.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_rows(ranked, place, schema)


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, added_tokens: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece.  ``added_tokens`` as in ``pieces_of``.

    Repeated rows are packed each; a null ``doc_id`` stays null; further columns are not read.
    """
    return pack(stored(pieces_of(docs, path, pattern, capacity, added_tokens=added_tokens)), capacity)
