"""Repeated spans of words by a compacted De Bruijn graph.

A window of ``WINDOW`` words is an edge from its first ``WINDOW - 1`` words to its last.  Edges are gathered as walks: a
walk is a run of consecutive windows whose least hashed sub-sequence of ``MER`` words is the same occurrence.  Equal
windows have equal least sub-sequences, so only walks whose sub-sequence occurs twice can hold a repeat; the others go
no further.  Equal walks are one with a count.

The edges of the different walks, with the first place each occurs at, are the graph.  Edges that occur twice are kept.
A node with one edge in and one out joins the two; joined edges that follow each other in the text of their first place
are a piece (window functions over short stretches of a document), and pieces that go on in another document are linked
to paths by joins with doubling pointers.  Walks are then threaded along the paths, which tells for every window where
it occurs first, and each document's windows that are not the first are taken from its text.

Places count as the same edge if the hashes of both nodes and a third one, from other hashes of the words, agree at their
source coordinates.  Nothing is compared in pairs; no node, edge or walk is gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import discard, keyed_rows, map_rows, prepared, stored, text_of

WINDOW = 20
MER = 8
STRETCH = 4096  # places of a document in which a piece is found at once
CHUNK_BYTES = 1 << 20
SLICE_WORDS = 1 << 18
NO_ID = (1 << 63) - 1
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_PLACE_BITS = 24


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


_LETTERS = [_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)) for base in _BASES]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < size:
        held = np.full(max(size, 2 * CHUNK_BYTES), base, np.uint64)
        held[0] = 1
        _POWERS[base] = held = np.cumprod(held, dtype=np.uint64)
    return held[:size]


class Sums:
    """Hashes of any ranges of a sequence of numbers."""

    def __init__(self, numbers: np.ndarray, base: int):
        self.base = base
        self.sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(numbers * _powers(base, len(numbers)), dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
        back = _powers(pow(self.base, -1, 1 << 64), len(self.sums))
        return _mixed((self.sums[ends] - self.sums[starts]) * back[starts] + np.asarray(more).astype(np.uint64))

    def of_all(self, size: int) -> np.ndarray:
        """Of all ranges of one size."""
        back = _powers(pow(self.base, -1, 1 << 64), len(self.sums))
        return _mixed((self.sums[size:] - self.sums[:-size]) * back[: len(self.sums) - size])


def _cut(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about ``CHUNK_BYTES``, cut between words."""
    start = 0
    while start < len(raw):
        found = _GAP.search(raw, start + CHUNK_BYTES) if start + CHUNK_BYTES < len(raw) else None
        end = found.end() if found else len(raw)
        yield raw[start:end]
        start = end


def word_hashes(texts: list[bytes], kinds: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words, one array for each kind, and where each text's words begin and the last one's end."""
    raw = b" ".join([*texts, b""])
    hashes: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] for _ in range(kinds)]
    begins, offset = [np.empty(0, np.int64)], 0
    for part in _cut(raw):
        letters = np.frombuffer(part, np.uint8)
        gap = np.concatenate([[True], _SPACE[letters], [True]])
        starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        for kind in range(kinds):
            hashes[kind].append(Sums(_LETTERS[kind][letters], _BASES[kind]).of(starts, ends, ends - starts))
        begins.append(starts + offset)
        offset += len(part)
    at = np.concatenate(begins)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return [np.concatenate(h) for h in hashes], np.searchsorted(at, edges)


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of each run of so many."""
    done = 1
    while 2 * done <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = size - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def walks(hashes: list[np.ndarray], bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Walks of the texts whose words begin at ``bounds``: text, start in it, number of windows, least sub-sequence.

    With two kinds of hashes, ``content`` tells walks of the same sub-sequence apart.
    """
    parts = []
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for low in range(0, max(0, len(owner) - WINDOW + 1), SLICE_WORDS):
        high = min(len(owner), low + SLICE_WORDS + WINDOW - 1)
        own = owner[low:high]
        mers = Sums(hashes[0][low:high], _BASES[0]).of_all(MER)
        # Of equal ones the first: the place is the lowest part of what is compared.
        place = np.uint64((1 << _PLACE_BITS) - 1)
        least = _least(mers & ~place | np.arange(len(mers), dtype=np.uint64), WINDOW - MER + 1) & place
        inside = np.flatnonzero(own[: len(least)] == own[WINDOW - 1 :])
        at = least[inside].astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
        first = np.flatnonzero(new)
        start, at, windows = inside[first], at[first], np.diff(np.append(first, len(new)))
        out = {"text": own[start], "start": start + low - bounds[own[start]], "windows": windows, "mer": mers[at]}
        if len(hashes) > 1:
            more = windows.astype(np.uint64) << np.uint64(8) | (at - start).astype(np.uint64)
            out["content"] = Sums(hashes[1][low:high], _BASES[1]).of(start, start + windows + WINDOW - 1, _mixed(more))
        parts.append(out)
    if not parts:
        return {n: np.empty(0, np.int64) for n in ("text", "start", "windows", "mer", "content")[: 3 + len(hashes)]}
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def _texts(batch: pa.RecordBatch, column: int = 1) -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


# --- walks of documents -------------------------------------------------------------------------------


def least_sequences(texts: DataFrame) -> DataFrame:
    """``(mer)`` of every walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"mer": _signed(walks(*word_hashes(_texts(batch, 0), 1))["mer"])})

    return texts.select("text").mapInArrow(run, "mer long")


def all_walks(texts: DataFrame) -> DataFrame:
    """``(mer, content, doc, start, windows)`` of every walk of ``texts`` (unique long ``doc``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = walks(*word_hashes(_texts(batch)))
            doc = np.asarray(batch.column(0))[found["text"]]
            yield pa.RecordBatch.from_pydict({
                "mer": _signed(found["mer"]), "content": _signed(found["content"]), "doc": doc,
                "start": found["start"].astype(np.int32), "windows": found["windows"].astype(np.int32),
            })

    return texts.select("doc", "text").mapInArrow(run, "mer long, content long, doc long, start int, windows int")


def walk_edges(placed: DataFrame) -> DataFrame:
    """``(doc, walk, copies, nodes, checks)`` of rows ``doc, text, firsts array<struct<start,windows,copies>>``."""
    schema = pa.schema([("doc", pa.int64()), ("walk", pa.int32()), ("copies", pa.int64()), ("nodes", pa.list_(pa.int64())), ("checks", pa.list_(pa.int32()))])

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (h, other), bounds = word_hashes(_texts(batch))
            firsts = batch.column(2)
            sizes = np.diff(np.asarray(firsts.offsets))
            values = firsts.flatten()
            start, windows, copies = (np.asarray(values.field(k)).astype(np.int64) for k in range(3))
            doc = np.repeat(np.asarray(batch.column(0)), sizes)
            at = np.repeat(bounds[:-1], sizes) + start
            order = np.argsort(at, kind="stable")
            at, start, windows, copies, doc = (x[order] for x in (at, start, windows, copies, doc))
            for low in range(0, len(h), SLICE_WORDS):
                a, b = np.searchsorted(at, [low, low + SLICE_WORDS])
                if a == b:
                    continue
                high = low + SLICE_WORDS + 2 * WINDOW
                nodes, checks = Sums(h[low:high], _BASES[0]).of_all(WINDOW - 1), Sums(other[low:high], _BASES[1]).of_all(WINDOW)
                n = windows[a:b]
                ends = np.cumsum(n)
                edge = np.arange(ends[-1]) + np.repeat(at[a:b] - low - (ends - n), n)
                ends = np.cumsum(n + 1)
                node = np.arange(ends[-1]) + np.repeat(at[a:b] - low - (ends - n - 1), n + 1)
                columns = [pa.array(doc[a:b]), pa.array(start[a:b].astype(np.int32)), pa.array(copies[a:b]), lists(_signed(nodes[node]), n + 1), lists((checks[edge] >> np.uint64(32)).astype(np.uint32).view(np.int32), n)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return placed.select("doc", "text", "firsts").mapInArrow(run, "doc long, walk int, copies long, nodes array<long>, checks array<int>")


# --- the graph ------------------------------------------------------------------------------------------


def _edges(walked: DataFrame) -> DataFrame:
    """One row for each window of the walks."""
    zipped = F.arrays_zip(F.expr("slice(nodes, 1, size(checks))").alias("left"), F.expr("slice(nodes, 2, size(checks))").alias("right"), F.col("checks").alias("check"))
    return walked.select("doc", "walk", "copies", F.posexplode(zipped).alias("number", "edge")).select("doc", "walk", "copies", "number", "edge.*")


def repeated_edges(walked: DataFrame) -> DataFrame:
    """``(left, right, doc, pos)`` of edges that occur twice, with their first place; places of an edge agree in the check."""
    place = F.struct("doc", (F.col("walk") + F.col("number")).alias("pos"))
    found = _edges(walked).groupBy("left", "right", "check").agg(F.sum("copies").alias("n"), F.min(place).alias("first"))
    return found.where("n > 1").select("left", "right", "first.*")


def joints(edges: DataFrame) -> DataFrame:
    """``(doc, pos, from_doc, from_pos)``: edges that go on from another one over a node with no other edges.

    Steps back to an earlier place are left out, so what is joined has no circles.
    """
    place = F.struct("doc", "pos")
    ends = edges.select(F.col("right").alias("node"), place.alias("into"), F.lit(None).cast("struct<doc:long,pos:int>").alias("out"))
    ends = ends.unionByName(edges.select(F.col("left").alias("node"), F.lit(None).cast("struct<doc:long,pos:int>").alias("into"), place.alias("out")))
    nodes = ends.groupBy("node").agg(F.count("into").alias("n_in"), F.count("out").alias("n_out"), F.max("into").alias("into"), F.max("out").alias("out"))
    single = nodes.where("n_in = 1 AND n_out = 1 AND (out.doc > into.doc OR out.doc = into.doc AND out.pos > into.pos)")
    return single.select("out.*", F.col("into.doc").alias("from_doc"), F.col("into.pos").alias("from_pos"))


def _straight() -> str:
    return f"doc = from_doc AND pos = from_pos + 1 AND pos % {STRETCH} <> 0"


def pieces(edges: DataFrame, joined: DataFrame) -> DataFrame:
    """``edges`` with the place where their piece begins: joined edges at places that follow each other."""
    marks = joined.where(_straight()).select(F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "doc", "pos", F.lit(0).alias("kind"))
    both = marks.unionByName(edges.withColumn("kind", F.lit(1))).withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    order = Window.partitionBy("doc", "stretch").orderBy("pos", "kind")
    opens = F.when((F.lag("pos").over(order) == F.col("pos")) & (F.lag("kind").over(order) == 0), None).otherwise(F.col("pos"))
    rows = both.withColumn("opens", opens).where("kind = 1")
    so_far = Window.partitionBy("doc", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("left", "right", "doc", "pos", F.max("opens").over(so_far).alias("piece"))


def paths(edges: DataFrame, joined: DataFrame) -> DataFrame:
    """``(doc, piece, length, path_doc, path, offset)``: every piece, the first piece of its path and where it lies on it.

    ``edges`` have pieces.  Links between pieces double their reach each round and are stored; there are as many rounds
    as the logarithm of the longest chain of pieces.
    """
    found = stored(edges.groupBy("doc", "piece").agg(F.count(F.lit(1)).cast("int").alias("length")))
    last = found.select(F.col("doc").alias("from_doc"), F.col("piece").alias("up"), "length", (F.col("piece") + F.col("length") - 1).alias("from_pos"))
    turns = joined.where(f"NOT ({_straight()})").join(last, ["from_doc", "from_pos"])
    links = stored(turns.select("doc", F.col("pos").alias("piece"), F.col("from_doc").alias("up_doc"), "up", F.col("length").cast("long").alias("offset")))
    while True:
        above = links.select(F.col("doc").alias("up_doc"), F.col("piece").alias("up"), F.col("up_doc").alias("top_doc"), F.col("up").alias("top"), F.col("offset").alias("more"))
        reached = links.join(above, ["up_doc", "up"], "left").select(
            "doc", "piece", F.coalesce("top_doc", "up_doc").alias("up_doc"), F.coalesce("top", "up").alias("up"),
            (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("top").isNotNull().alias("moved"),
        )
        reached = stored(reached)
        links = reached.drop("moved")
        if reached.where("moved").isEmpty():
            break
    return found.join(links, ["doc", "piece"], "left").select(
        "doc", "piece", "length", F.coalesce("up_doc", "doc").alias("path_doc"), F.coalesce("up", "piece").alias("path"), F.coalesce("offset", F.lit(0)).alias("offset")
    )


def threads(walked: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc, walk, spans)``: the spans of every different walk that lie on a path, with the first place of each.

    A walk has at most ``WINDOW - MER + 1`` windows, so its spans are few.
    """
    own = _edges(walked).drop("check")
    placed = edges.select("left", "right", F.col("doc").alias("first_doc"), F.col("pos").alias("first_pos"), "piece")
    on = own.join(placed, ["left", "right"]).where("copies > 1 OR first_doc <> doc OR first_pos <> walk + number")
    spans = on.groupBy("doc", "walk", "first_doc", "piece", (F.col("first_pos") - F.col("number")).alias("shift")).agg(F.min("number").alias("at"), F.count(F.lit(1)).cast("int").alias("windows"))
    known = found.select(F.col("doc").alias("first_doc"), "piece", "path_doc", "path", "offset")
    span = F.struct("at", "windows", "first_doc", (F.col("shift") + F.col("at")).alias("first_pos"), "path_doc", "path", (F.col("offset") + F.col("shift") + F.col("at") - F.col("piece")).alias("offset"))
    return spans.join(known, ["first_doc", "piece"]).groupBy("doc", "walk").agg(F.collect_list(span).alias("spans"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``(doc, spans)`` of every document of ``texts`` (unique long ``doc``, ``text``) with windows that also start earlier.

    A span: ``start``, ``windows`` that follow each other, its path (the place where that begins) and the offset on it.
    """
    twice = stored(least_sequences(texts).groupBy("mer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mer"))
    met = stored(all_walks(texts).join(twice, "mer"))
    discard(twice)
    place = F.struct("doc", "start", "windows")
    contents = stored(met.groupBy("mer", "content").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).select("mer", "content", "first.*", "copies"))
    firsts = contents.groupBy(F.col("doc").alias("of_doc")).agg(F.collect_list(F.struct("start", "windows", "copies")).alias("firsts"))
    walked = stored(walk_edges(texts.join(firsts, F.col("doc") == F.col("of_doc"))))
    repeated = stored(repeated_edges(walked))
    joined = stored(joints(repeated))
    edges = stored(pieces(repeated, joined))
    discard(repeated)
    found = stored(paths(edges, joined))
    discard(joined)
    threaded = threads(walked, edges, found).withColumnRenamed("walk", "start")
    known = stored(contents.join(threaded, ["doc", "start"]).select("mer", "content", "spans"))
    discard(edges, found, walked, contents)
    spans = met.join(known, ["mer", "content"]).select("doc", F.expr("filter(spans, s -> s.first_doc <> doc OR s.first_pos <> start + s.at)").alias("spans"), "start")
    moved = F.expr("transform(spans, s -> named_struct('start', start + s.at, 'windows', s.windows, 'path_doc', s.path_doc, 'path', s.path, 'offset', s.offset))")
    return spans.where(F.size("spans") > 0).select("doc", moved.alias("spans")).groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))


# --- removal --------------------------------------------------------------------------------------------


def _without(text: bytes, spans: list[dict] | None) -> tuple[int, list[dict], bytes]:
    """Number of words, maximal removed runs of words, and the words that are left, joined by one space."""
    if not spans:
        words = text.split()
        return len(words), [], b" ".join(words)
    starts = np.array([s["start"] for s in spans], np.int64)
    ends = starts + np.array([s["windows"] for s in spans], np.int64) + WINDOW - 1
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1])
    low, high = starts[np.append(0, cut + 1)], ends[np.append(cut, len(ends) - 1)]
    left, n, run = [], 0, 0
    for part in _cut(text):
        words = part.split()
        at = 0
        while run < len(low) and low[run] < n + len(words):
            left += words[at : max(at, low[run] - n)]
            at = min(len(words), high[run] - n)
            if high[run] > n + len(words):
                break
            run += 1
        left += words[at:]
        n += len(words)
    return n, [{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist())], b" ".join(left)


def remove_repeats(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_words, n_removed, spans array<struct<start,end>>, kept string)``, spans in words, end beyond the last.

    A word goes if a window of 20 words that covers it also starts earlier: in a document of smaller id, or earlier in
    the same one.  Null texts are empty, texts shorter than a window stay whole.  Every row has a result; rows that share
    an id (or have none, they come last) go by the SHA-256 of their texts.  Columns to carry follow, others are not read,
    whatever their names.  An empty table gives an empty result.  Texts are worked on whole, in slices.
    """
    prepared(docs.sparkSession)
    own = F.col("doc_id").cast("long")
    texts = docs.select(F.coalesce(own, F.lit(NO_ID)).alias("doc"), text_of().alias("text"), own.alias("own_id"), *carry)
    ids = texts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc").alias("distinct")).first()
    if ids.n != ids.distinct:
        keyed = keyed_rows(docs.select(own.alias("doc_id"), text_of().alias("text"), *carry), "row_key")
        texts = keyed.select(F.col("row_key").alias("doc"), "text", F.col("doc_id").alias("own_id"), *carry)
    found = repeated_spans(texts.select("doc", "text")).withColumnRenamed("doc", "of_doc")
    pairs = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["windows"].alias("windows")))
    both = texts.join(found.select("of_doc", pairs.alias("spans")), F.col("doc") == F.col("of_doc"), "left").select("own_id", F.col("text").cast("binary").alias("text"), "spans", *carry)

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": batch["own_id"], "n_words": [], "n_removed": [], "spans": [], "kept": []}
        for text, spans in zip(batch["text"], batch["spans"]):
            n, runs, left = _without(text, spans)
            out["n_words"].append(n)
            out["n_removed"].append(sum(r["end"] - r["start"] for r in runs))
            out["spans"].append(runs)
            out["kept"].append(left.decode())
        return out

    return map_rows(both, run, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string", carry)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
