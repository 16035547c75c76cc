"""Keyed state with timers: arrival labels on interval sets, gaps that expire, rolling windows on panes.

Each operator keeps what later rows need and nothing else, so a trigger costs what its own rows cost, however long the
stream has run.  State is in the RocksDB store; a stream restarts from its checkpoint, or, without one, from an initial
state made of a journal.  One trigger's rows of a key are ordered in memory: limit the trigger's input.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS


def with_state_store(spark: SparkSession) -> SparkSession:
    """Set the store that map state and timers need; the processors travel by value, as Spark's driver worker has no package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


# --- sets of sequence numbers -----------------------------------------------------------------


def packed(members: np.ndarray) -> bytes:
    """Sorted places of a block as ranges (first, last), or as bits where those are shorter."""
    cuts = np.flatnonzero(np.diff(members) > 1)
    ranges = np.stack([members[np.append(0, cuts + 1)], members[np.append(cuts, len(members) - 1)]], axis=1).astype("<u2")
    if ranges.nbytes < BLOCK // 8:
        return ranges.tobytes()
    bits = np.zeros(BLOCK, bool)
    bits[members] = True
    return np.packbits(bits).tobytes()


def unpacked(data: bytes | None) -> np.ndarray:
    """Places of a block as booleans."""
    if data is None:
        return np.zeros(BLOCK, bool)
    if len(data) == BLOCK // 8:
        return np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
    ends = np.frombuffer(data, "<u2").reshape(-1, 2).astype(np.int64)
    steps = np.zeros(BLOCK + 1, np.int32)
    np.add.at(steps, ends[:, 0], 1)
    np.add.at(steps, ends[:, 1] + 1, -1)
    return np.cumsum(steps[:-1]) > 0


class _Accepted:
    """Accepted sequence numbers of a stream in its state: the last one, and sets by block of numbers."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.last = handle.getValueState("last", "last long")
        self.blocks = handle.getMapState("blocks", "block long", "members binary")

    def start(self, rows: pd.DataFrame) -> None:
        self.last.update((int(rows["last"].max()),))
        for block, members in zip(rows["block"], rows["members"]):
            self.blocks.updateValue((int(block),), (packed(np.array(sorted(members), np.int64)),))

    def label(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether accepted, whether a repeat of an accepted number, and the number accepted before (masked: none)."""
        held = self.last.get()
        least = int(numbers.min()) - 1 if held is None else int(held[0])
        before = np.maximum.accumulate(np.concatenate([[least], numbers]))[:-1]
        accepted = numbers > before
        if accepted.any():
            self.last.update((int(numbers[accepted].max()),))
        known = np.zeros(len(numbers), bool)
        block = numbers >> BLOCK_BITS
        by_block = np.argsort(block, kind="stable")
        for own in np.split(by_block, np.flatnonzero(np.diff(block[by_block])) + 1):
            one = int(block[own[0]])
            found = self.blocks.getValue((one,)) if self.blocks.containsKey((one,)) else None
            members = unpacked(None if found is None else bytes(found[0]))
            new = numbers[own[accepted[own]]] & (BLOCK - 1)
            if len(new):
                members[new] = True
                self.blocks.updateValue((one,), (packed(np.flatnonzero(members)),))
            known[own] = members[numbers[own] & (BLOCK - 1)]
        none = np.zeros(len(numbers), bool)
        none[0] = held is None
        return accepted, known & ~accepted, np.ma.masked_array(before, mask=none)


class ArrivalLabels(StatefulProcessor):
    """ACCEPTED, DUPLICATE or OUT_OF_ORDER for every arrival of a stream."""

    def __init__(self, keys: list[str], order: list[str], sequence: str, ungapped: tuple, columns: list[str]):
        self.keys, self.order, self.sequence, self.ungapped, self.columns = keys, order, sequence, ungapped, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = _Accepted(handle)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.accepted.start(initialState)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        numbers = found[self.sequence].to_numpy("int64")
        accepted, repeated, before = self.accepted.label(numbers)
        gapped = accepted & ~np.ma.getmaskarray(before) & (key[0] not in self.ungapped)
        found["arrival_state"] = np.where(accepted, "ACCEPTED", np.where(repeated, "DUPLICATE", "OUT_OF_ORDER"))
        found["previous_sequence"] = pd.array(before.filled(0), dtype="Int64")
        found.loc[np.ma.getmaskarray(before), "previous_sequence"] = pd.NA
        found["missing"] = np.where(gapped, numbers - before.filled(0) - 1, 0).astype("int64")
        yield found[[*self.columns, "arrival_state", "previous_sequence", "missing"]]

    def close(self) -> None:
        pass


def arrival_labels(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], sequence: str, ungapped: Sequence[str] = (),
    initial: DataFrame | None = None,
) -> DataFrame:
    """Rows with ``arrival_state``, ``previous_sequence`` and ``missing``, equal to the batch labels at any distance.

    Accepted numbers are kept as merged ranges by block of 65,536 numbers, so a repeat is known however late it comes;
    a stream without holes needs a few bytes a block.  ``initial`` (see :func:`accepted_state`) starts a new checkpoint
    where an old one ended.
    """
    with_state_store(stream.sparkSession)
    fields = [*stream.schema.fields, T.StructField("arrival_state", T.StringType()), T.StructField("previous_sequence", T.LongType()), T.StructField("missing", T.LongType())]
    return stream.groupBy(*keys).transformWithStateInPandas(
        ArrivalLabels(list(keys), list(order), sequence, tuple(ungapped), list(stream.columns)), T.StructType(fields), "append", "None",
        initialState=None if initial is None else initial.groupBy(*keys),
    )


def accepted_state(labelled: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Initial state from a journal of labelled rows: a row for each stream and block of numbers it accepted.

    A block has at most 65,536 numbers; they are combined before they are dealt.
    """
    accepted = labelled.filter("arrival_state = 'ACCEPTED'")
    block, place = F.shiftright(F.col(sequence), BLOCK_BITS), F.col(sequence).bitwiseAND(F.lit(BLOCK - 1)).cast("int")
    found = accepted.groupBy(*keys, block.alias("block")).agg(F.max(sequence).alias("last"), F.collect_set(place).alias("members"))
    return found.select(*keys, "last", "block", "members")


# --- gaps that expire -------------------------------------------------------------------------


OPEN_BITS = 16


class GapExpiry(StatefulProcessor):
    """OPENED when an arrival skips numbers, EXPIRED when the gap's impact has passed.

    Open gaps wait in the state by block of 65,536 ms of their end, so a trigger reads and writes a block once.
    """

    def __init__(self, keys: list[str], order: list[str], sequence: str, received: str, impact_ms: int):
        self.keys, self.order, self.sequence, self.received, self.impact_ms = keys, order, sequence, received, impact_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = _Accepted(handle)
        self.open = handle.getMapState("open", "block long", "until_ms array<long>, gap_from array<long>, gap_to array<long>")

    def rows(self, key, at_ms: np.ndarray, event: str, first: np.ndarray, last: np.ndarray) -> pd.DataFrame:
        own = {k: [v] * len(at_ms) for k, v in zip(self.keys, key)}
        return pd.DataFrame({**own, "at_ms": at_ms, "event": [event] * len(at_ms), "gap_from": first, "gap_to": last})

    def held(self, block: int) -> np.ndarray:
        """Open gaps of a block: until, from and to."""
        found = self.open.getValue((block,)) if self.open.containsKey((block,)) else ((), (), ())
        return np.array([list(column) for column in found], np.int64).reshape(3, -1)

    def keep(self, block: int, gaps: np.ndarray) -> None:
        """Store a block and have it looked at when its next gap ends."""
        self.open.updateValue((block,), tuple(column.tolist() for column in gaps))
        self.handle.registerTimer(int(gaps[0].min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = list(dict.fromkeys([*self.order, self.sequence, self.received]))
        found = pd.concat([part[columns] for part in rows]).sort_values(self.order, kind="stable")
        numbers, received = found[self.sequence].to_numpy("int64"), found[self.received].to_numpy("int64")
        del found
        accepted, _, before = self.accepted.label(numbers)
        low = before.filled(0) + 1
        gap = accepted & ~np.ma.getmaskarray(before) & (numbers > low)
        if not gap.any():
            return
        gaps = np.stack([received[gap] + self.impact_ms, low[gap], numbers[gap] - 1])
        gaps = gaps[:, np.argsort(gaps[0], kind="stable")]
        for added in np.split(gaps, np.flatnonzero(np.diff(gaps[0] >> OPEN_BITS)) + 1, axis=1):
            block = int(added[0, 0]) >> OPEN_BITS
            self.keep(block, np.concatenate([self.held(block), added], axis=1))
        yield self.rows(key, received[gap], "OPENED", low[gap], numbers[gap] - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        block = expiredTimerInfo.getExpiryTimeInMs() >> OPEN_BITS
        gaps = self.held(block)
        ended = gaps[0] <= timerValues.getCurrentWatermarkInMs()
        if not ended.any():
            return
        if ended.all():
            self.open.removeKey((block,))
        else:
            self.keep(block, gaps[:, ~ended])
        until, first, last = gaps[:, ended]
        yield self.rows(key, until, "EXPIRED", first, last)

    def close(self) -> None:
        pass


def gap_events(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], sequence: str, received: str, at: str, impact_ms: int, delay: str,
) -> DataFrame:
    """``(keys, at_ms, event, gap_from, gap_to)``: gaps as they open and as their impact ends.

    The end comes from a timer on event time, so it needs no later row of the stream itself: it is told once the
    watermark over all rows (``at``, ``delay``) has passed it.
    """
    with_state_store(stream.sparkSession)
    kinds = {f.name: f for f in stream.schema.fields}
    fields = [*(kinds[k] for k in keys), T.StructField("at_ms", T.LongType()), T.StructField("event", T.StringType()), T.StructField("gap_from", T.LongType()), T.StructField("gap_to", T.LongType())]
    return stream.withWatermark(at, delay).groupBy(*keys).transformWithStateInPandas(
        GapExpiry(list(keys), list(order), sequence, received, impact_ms), T.StructType(fields), "append", "EventTime"
    )


# --- records appended once ----------------------------------------------------------------------


RECORD_BUCKETS = 256


def _plain(value):
    """No value where a number is none."""
    return None if value is None or value != value else value


class JournalRecords(StatefulProcessor):
    """The hash under which each record of a bucket of ids was first appended."""

    def __init__(self, record_id: str, record_hash: str, order: str, columns: list[str], id_kind: str):
        self.record_id, self.record_hash, self.columns, self.id_kind = record_id, record_hash, columns, id_kind
        self.sorted_by = [order, record_hash, *(c for c in columns if c not in (record_id, order, record_hash))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", f"is_null boolean, id {self.id_kind}", "hash string")

    def _key(self, value) -> tuple:
        return (value is None, value)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.held.updateValue(self._key(initialState[self.record_id]), (_plain(initialState["hash"]),))

    def _place(self, row: Row) -> tuple:
        values = [_plain(row[c]) for c in self.sorted_by]
        return tuple((v is not None, v) for v in values)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        by_id: dict = {}
        told = Row(*self.columns, "append_state")
        for row in rows:
            by_id.setdefault(row[self.record_id], []).append(row)
        for record, own in by_id.items():
            own.sort(key=self._place)
            known = self.held.containsKey(self._key(record))
            basis = self.held.getValue(self._key(record))[0] if known else _plain(own[0][self.record_hash])
            if not known:
                self.held.updateValue(self._key(record), (basis,))
            for place, row in enumerate(own):
                state = "NO_OP" if _plain(row[self.record_hash]) == basis else "CONFLICT"
                yield told(*(row[c] for c in self.columns), "APPEND" if place == 0 and not known else state)

    def close(self) -> None:
        pass


def journal_labels(stream: DataFrame, record_id: str, record_hash: str, order: str, initial: DataFrame | None = None) -> DataFrame:
    """Rows with ``append_state``: APPEND for a record's first row, then NO_OP for the same hash and CONFLICT for another.

    Of a trigger's rows of a new id the first by ``order``, hash and the other columns is appended.  The state has one
    hash an id, so no trigger reads the journal; ``initial`` (see :func:`journal_state`) starts a new checkpoint from one.
    A null id is an id, a null hash equals itself only.  Ids are dealt to 256 buckets: a call and its rows are a
    bucket's, the state is an id's.
    """
    with_state_store(stream.sparkSession)
    bucket = F.pmod(F.xxhash64(record_id), F.lit(RECORD_BUCKETS)).alias("__bucket")
    kind = stream.schema[record_id].dataType.simpleString()
    return stream.select("*", bucket).groupBy("__bucket").transformWithState(
        JournalRecords(record_id, record_hash, order, list(stream.columns), kind), T.StructType([*stream.schema.fields, T.StructField("append_state", T.StringType())]),
        "append", "None", initialState=None if initial is None else initial.select("*", bucket).groupBy("__bucket"),
    )


def journal_state(journal: DataFrame, record_id: str, record_hash: str) -> DataFrame:
    """Initial state from the appended rows, one an id."""
    return journal.select(record_id, F.col(record_hash).alias("hash"))


# --- contexts that stay set ----------------------------------------------------------------------

NEVER = 1 << 62


class Latch(StatefulProcessor):
    """When a key was first ready and when the fact was last recorded."""

    def __init__(self, order: list[str], ready: str, recorded: str, columns: list[str]):
        self.order, self.ready, self.recorded, self.columns = order, ready, recorded, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ready long, recorded long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(self.order, kind="stable", na_position="first")
        timed = found[self.order[0]].notna().to_numpy()
        at = found[self.order[0]].fillna(0).astype("int64").to_numpy()
        first, last = self.held.get() if self.held.exists() else (NEVER, -NEVER)
        ready = np.where(timed & found[self.ready].eq(True).to_numpy(dtype=bool), at, NEVER)
        recorded = np.where(timed & found[self.recorded].eq(True).to_numpy(dtype=bool), at, -NEVER)
        ready = np.minimum.accumulate(np.append(first, ready))[1:]
        recorded = np.maximum.accumulate(np.append(last, recorded))[1:]
        self.held.update((int(ready[-1]), int(recorded[-1])))
        by_user, by_state = recorded > -NEVER, ready < NEVER
        since = np.where(by_user, recorded, ready)
        found = found[self.columns].copy()
        found["context"] = np.where(by_user, "USER_RECORDED", np.where(by_state, "SHADOW_REFERENCE", "NONE"))
        found["context_ms"] = pd.array([int(v) if known else None for v, known in zip(since, by_user | by_state, strict=True)], dtype="Int64")
        yield found

    def close(self) -> None:
        pass


def latched_context(stream: DataFrame, keys: Sequence[str], order: Sequence[str], ready: str, recorded: str) -> DataFrame:
    """The batch operator of this name over a stream: the context stays set from the first ready instant, across triggers.

    ``ready`` and ``recorded`` are boolean columns; a record by the user replaces the first ready instant and earlier
    records.  Two instants a key are kept.  Triggers come in the order of ``order[0]``: a row that comes late is told the
    context of the rows before it in arrival.  A row without a time sets nothing.
    """
    with_state_store(stream.sparkSession)
    columns = [c for c in stream.columns if c not in (ready, recorded)]
    fields = [*(stream.schema[c] for c in columns), T.StructField("context", T.StringType()), T.StructField("context_ms", T.LongType())]
    return stream.groupBy(*keys).transformWithStateInPandas(
        Latch(list(order), ready, recorded, columns), T.StructType(fields), "append", "None"
    )


# --- rolling windows on panes -------------------------------------------------------------------


class PaneWindows(StatefulProcessor):
    """Sums over the last ``span`` at every instant of a grid, from panes of one step."""

    def __init__(self, keys: list[str], sums: list[str], step_ms: int, span_ms: int, lag_ms: int):
        self.keys, self.sums, self.step_ms, self.span_ms, self.lag_ms = keys, sums, step_ms, span_ms, lag_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Of each pane: rows, last time and sums of its first instant alone, then of the whole pane.
        self.panes = handle.getMapState("panes", "pane_ms long", "n array<long>, last_ms array<long>, sums array<decimal(38,8)>")
        self.next = handle.getValueState("next", "instant_ms long")

    def _start(self, instant: int) -> None:
        self.next.update((instant,))
        self.handle.registerTimer(instant + self.lag_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._start(int(initialState["next_ms"].iloc[0]))

    def _held(self, pane: int) -> tuple[list, list, list] | None:
        if not self.panes.containsKey((pane,)):
            return None
        n, last, sums = self.panes.getValue((pane,))
        return [int(x) for x in n], [int(x) for x in last], list(sums)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[list, list, list]] = {}
        for part in rows:
            for row in part.itertuples(index=False):
                pane = int(row.pane_ms)
                if pane not in found:
                    found[pane] = self._held(pane) or ([0, 0], [-NEVER, -NEVER], [Decimal(0)] * (2 * len(self.sums)))
                n, last, sums = found[pane]
                for k, (count, at) in enumerate(((row.n_at, row.last_at), (row.n_all, row.last_all))):
                    n[k] += int(count)
                    last[k] = last[k] if pd.isna(at) else max(last[k], int(at))
                    for number, name in enumerate(self.sums):
                        value = getattr(row, f"{name}_{('at', 'all')[k]}")
                        sums[2 * number + k] += Decimal(0) if pd.isna(value) else value
        held = self.next.get()
        for pane, value in found.items():
            if held is None or pane >= int(held[0]) - self.span_ms:
                self.panes.updateValue((pane,), value)
        if found and held is None:
            self._start(min(found))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All instants that the watermark has passed by the lag; panes that no later instant reads go."""
        closed = timerValues.getCurrentWatermarkInMs()
        instant = int(self.next.get()[0])
        if instant + self.lag_ms > closed:
            return
        held = {int(k[0]): v for k, v in self.panes.iterator()}
        while instant + self.lag_ms <= closed:
            out: dict[str, list] = {n: [] for n in ("as_of_ms", "n", "last_ms", *self.sums)}
            while instant + self.lag_ms <= closed and len(out["n"]) < 10_000:
                low = instant - self.span_ms
                parts = [(held[p], 1) for p in range(low, instant, self.step_ms) if p in held] + ([(held[instant], 0)] if instant in held else [])
                out["as_of_ms"].append(instant)
                out["n"].append(sum(int(v[0][k]) for v, k in parts))
                last = max((int(v[1][k]) for v, k in parts), default=-NEVER)
                out["last_ms"].append(None if last == -NEVER else last)
                for number, name in enumerate(self.sums):
                    out[name].append(sum((v[2][2 * number + k] for v, k in parts), Decimal(0)))
                if low in held:
                    self.panes.removeKey((low,))
                    del held[low]
                instant += self.step_ms
            frame = pd.DataFrame({**{k: [v] * len(out["n"]) for k, v in zip(self.keys, key)}, **out})
            frame["last_ms"] = pd.array(out["last_ms"], dtype="Int64")
            yield frame
        self._start(instant)

    def close(self) -> None:
        pass


def rolling_panes(
    stream: DataFrame, keys: Sequence[str], at: str, received_ms: str, measures: dict[str, Column], step_ms: int, span_ms: int, delay: str,
    lag_ms: int | None = None, initial: DataFrame | None = None,
) -> DataFrame:
    """``(keys, as_of_ms, n, last_ms, measures)`` over ``[as_of - span, as_of]`` at every instant from a key's first row on.

    Each batch of rows is summed to panes of one step before it is dealt, so a hot key is a few rows a pane; panes wait in
    the state until the last instant that reads them, and instants are told by timers, also where no row comes.
    ``span_ms`` is a multiple of ``step_ms``; an instant is told when the watermark has passed it by ``lag_ms`` (a step,
    where none is given).  A row that comes later than that counts for the instants still to be told.  ``initial`` has
    ``(keys, next_ms)``: keys told from that instant of the grid on, whether or not they have rows.
    """
    if span_ms % step_ms:
        raise ValueError("the span must be a multiple of the step")
    with_state_store(stream.sparkSession)
    kinds = {f.name: f for f in stream.schema.fields}
    first = F.pmod(F.col(received_ms), F.lit(step_ms)) == 0
    values = [c for n, m in measures.items() for c in (F.when(first, m.cast("decimal(38,8)")).alias(f"{n}_at"), m.cast("decimal(38,8)").alias(f"{n}_all"))]
    rows = stream.withWatermark(at, delay).filter(F.col(received_ms).isNotNull()).select(
        *keys, (F.col(received_ms) - F.pmod(F.col(received_ms), F.lit(step_ms))).alias("pane_ms"),
        F.when(first, F.col(received_ms)).alias("last_at"), F.col(received_ms).alias("last_all"), *values,
    )
    names = [f"{n}_{k}" for n in measures for k in ("at", "all")]
    by, taken = [*keys, "pane_ms"], [("last_at", "count", "n_at"), ("last_all", "count", "n_all"), ("last_at", "max", "last_at"), ("last_all", "max", "last_all"), *((n, "sum", n) for n in names)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(by).aggregate([(column, how) for column, how, _ in taken])
            columns = {k: table[k] for k in by} | {name: table[f"{column}_{how}"] for column, how, name in taken}
            yield from pa.table(columns).combine_chunks().to_batches()

    long = T.LongType()
    sums = [T.StructField(n, T.DecimalType(38, 8)) for n in names]
    panes = rows.mapInArrow(summed, T.StructType([*(kinds[k] for k in keys), *(T.StructField(n, long) for n in ("pane_ms", "n_at", "n_all", "last_at", "last_all")), *sums]))
    fields = [*(kinds[k] for k in keys), T.StructField("as_of_ms", long), T.StructField("n", long), T.StructField("last_ms", long)]
    fields += [T.StructField(n, T.DecimalType(38, 8)) for n in measures]
    return panes.groupBy(*keys).transformWithStateInPandas(
        PaneWindows(list(keys), list(measures), step_ms, span_ms, step_ms if lag_ms is None else lag_ms), T.StructType(fields), "append", "EventTime",
        initialState=None if initial is None else initial.groupBy(*keys),
    )
