"""Keyed processors with state and timers: waiting for a condition, look-ahead queues with an end-of-input drain, packetizer state,
clamped buckets and the assembly of frames.

Each keeps its state in Spark's state store (RocksDB) in the smallest form that serves: a value, a list that is read and
written entry by entry, or a map with one entry for each fragment. The steps of the queue and of the packetizer are the same functions
as in the batch forms (operators.folds.look_ahead and operators.folds.packetizer), so both give the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from codalake.operators.folds import PacketizerState

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and list and map state need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Processor(StatefulProcessor):
    """One whose output rows are made from their values in order."""

    names: list[str] = []

    def row(self, *values) -> Row:
        return Row(**dict(zip(self.names, values, strict=True)))


def _run(df: DataFrame, key: str, processor: _Processor, out: str, time_mode: str = "None") -> DataFrame:
    """The rows of a processor for each key; out: the columns behind the key's."""
    use_rocksdb(df.sparkSession)
    schema = StructType.fromDDL(f"`{key}` {dict(df.dtypes)[key]}, {out}")
    processor.names = schema.names
    return df.groupBy(key).transformWithState(processor, schema, "Append", time_mode)


class _Wait(_Processor):
    def __init__(self, kind: str, ready: str, value: str, ts: str | None, timeout_ms: int):
        self.kind, self.ready, self.value, self.ts, self.timeout_ms = kind, ready, value, ts, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("wait", f"deadline bigint, done boolean, latest {self.kind}")

    def _at(self, row: Row, timers) -> int:
        if self.ts is None:
            return timers.getCurrentProcessingTimeInMs()
        return int(row[self.ts].replace(tzinfo=row[self.ts].tzinfo or dt.timezone.utc).timestamp() * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        polls = sorted(((self._at(r, timerValues), i, r) for i, r in enumerate(rows)), key=lambda x: x[:2])
        deadline, done, latest = self.state.get() if self.state.exists() else (None, False, None)
        for at, _, row in polls:
            if done:
                break
            if deadline is None:
                deadline = at + self.timeout_ms
                self.handle.registerTimer(deadline)
            if at >= deadline:
                break  # its timer tells
            latest = row[self.value]
            if row[self.ready]:
                done = True
                self.handle.deleteTimer(deadline)
                yield self.row(key[0], "ready", latest)
        self.state.update((deadline, done, latest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        deadline, done, latest = self.state.get()
        if not done:
            self.state.update((deadline, True, latest))
            yield self.row(key[0], "timeout", latest)


def wait_stream(polls: DataFrame, key: str, ready: str, value: str, timeout_ms: int, ts: str | None = None) -> DataFrame:
    """key, outcome (ready or timeout), value: of the first poll that is ready, or of the latest one when the time that the first
    poll began has passed. Each key has one outcome; polls behind it are ignored. With ts (which needs a watermark) times are
    those of the rows, and the timeout comes when the watermark passes it; otherwise they are the clock's."""
    kind = dict(polls.dtypes)[value]
    return _run(polls, key, _Wait(kind, ready, value, ts, timeout_ms), f"outcome string, `{value}` {kind}", "EventTime" if ts else "ProcessingTime")


class _LookAhead(_Processor):
    def __init__(self, order: str, kind: str, flush: str, depth: int, idle_ms: int | None):
        self.order, self.kind, self.flush, self.depth, self.idle_ms = order, kind, flush, depth, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", f"frame {self.kind}")
        self.timer = handle.getValueState("timer", "at bigint")

    def _arm(self, timers, waiting: bool) -> None:
        if self.idle_ms is None:
            return
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if waiting:
            at = timers.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [x[0] for x in self.queue.get()] if self.queue.exists() else []  # depth - 1 frames at most
        for row in sorted(rows, key=lambda r: r[self.order]):
            if not row[self.flush]:
                held.append(row[self.order])
            if held and (row[self.flush] or len(held) == self.depth):
                yield self.row(key[0], row[self.order], held.pop(0), bool(row[self.flush]))
        self._keep(held)
        self._arm(timerValues, bool(held))

    def _keep(self, held: list) -> None:
        if held:
            self.queue.put([(x,) for x in held])
        elif self.queue.exists():
            self.queue.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = [x[0] for x in self.queue.get()] if self.queue.exists() else []
        self.timer.clear()
        if held:
            yield self.row(key[0], None, held[0], True)
            self._keep(held[1:])
            self._arm(timerValues, len(held) > 1)


def look_ahead_stream(calls: DataFrame, key: str, order: str, flush: str, depth: int, idle_ms: int | None = None) -> DataFrame:
    """key, call, frame, drained: what each call gives of a queue that lets a frame go when it holds `depth`. A call is a frame
    (named by its order) or, where `flush` is true, a drain of one. idle_ms: where no call came for so long, the rest is drained, one frame at
    each expiry, with call null."""
    kind = dict(calls.dtypes)[order]
    return _run(calls, key, _LookAhead(order, kind, flush, depth, idle_ms), f"call {kind}, frame {kind}, drained boolean", "ProcessingTime" if idle_ms is not None else "None")


class _Packetizer(_Processor):
    def __init__(self, order: str, columns: list[str]):
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("packetizer", "picture int, pending boolean, signature string, key_needed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        p = PacketizerState(*self.state.get()) if self.state.exists() else PacketizerState()
        for row in sorted(rows, key=lambda r: r[self.order]):
            yield self.row(key[0], row[self.order], *p.step(*(row[c] for c in self.columns)))
        self.state.update((p.picture, p.pending, p.signature, p.key_needed))


def packetizer_stream(calls: DataFrame, key: str, order: str) -> DataFrame:
    """key, order, outcome, picture_id, key_needed after each call, as operators.folds.packetizer."""
    kind = dict(calls.dtypes)[order]
    return _run(calls, key, _Packetizer(order, list(PacketizerState.COLUMNS)), f"`{order}` {kind}, outcome string, picture_id int, key_needed boolean")


class _Bucket(_Processor):
    def __init__(self, order: str, bits: str, credit: float, start: float, cap: float):
        self.order, self.bits, self.credit, self.begin, self.cap = order, bits, credit, start, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        level = self.level.get()[0] if self.level.exists() else self.begin
        for at, bits in sorted((r[self.order], r[self.bits]) for r in rows):
            level = float(min(level + self.credit, self.cap) - bits)
            yield self.row(key[0], at, level)
        self.level.update((level,))


def bucket_stream(frames: DataFrame, stream: str, order: str, bits: str, credit: float, start: float, cap: float) -> DataFrame:
    """level after each frame, like operators.ordered.leaky_bucket; the level is the only state.

    Within a micro-batch frames are put in order; across batches they must arrive in order.
    """
    kind = dict(frames.dtypes)[order]
    return _run(frames, stream, _Bucket(order, bits, credit, start, cap), f"`{order}` {kind}, level double")


class _Assembler(_Processor):
    def __init__(self, seq: str, payload: str, marker: str, timeout_ms: int):
        self.seq, self.payload, self.marker, self.timeout_ms = seq, payload, marker, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "seq int", "payload binary")
        self.known = handle.getValueState("known", "n int, last int, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, last, timer = self.known.get() if self.known.exists() else (0, None, None)
        for row in rows:
            at = int(row[self.seq])
            n += not self.parts.containsKey((at,))
            self.parts.updateValue((at,), (bytes(row[self.payload]),))
            if row[self.marker]:
                last = at if last is None else max(last, at)
        if timer is not None:
            self.handle.deleteTimer(timer)
        # Numbers from 0 to last without a gap, and none beyond it.
        if last is not None and n == last + 1 and all(self.parts.containsKey((i,)) for i in range(n)):
            yield self.row(key[0], b"".join(bytes(self.parts.getValue((i,))[0]) for i in range(n)))
            self.parts.clear()
            self.known.clear()
            return
        timer = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
        self.handle.registerTimer(timer)
        self.known.update((n, last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.parts.clear()
        self.known.clear()
        return iter(())


def assemble_stream(fragments: DataFrame, key: str, seq: str, payload: str, marker: str, timeout_ms: int) -> DataFrame:
    """key, payload of each frame whose fragments have all come; incomplete ones are forgotten when none came for the timeout. A fragment
    is written to the state once, when it comes, and read once; of one that comes twice the last stays."""
    return _run(fragments, key, _Assembler(seq, payload, marker, timeout_ms), "payload binary", "ProcessingTime")
