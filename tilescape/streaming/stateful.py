"""Ring membership, retry budgets, stuck detection, dedupe and deferred release on streams.

State is small per key: a viewer's place and one bit per tile around it, one counter, or one running sum.
Rows of a key are put in sequence order inside each micro-batch; limit the batch size with
the source's maxFilesPerTrigger or maxBytesPerTrigger.

With an event-time column `ts` the three stateful operators also take rows that come in the
wrong batch: they wait until the watermark (`delay` behind the latest) has passed them and
are then handled in order, so results are those of the batch operators. The sequence must
rise with the event time. Rows later than the watermark are left out and counted in the
query's progress (numRowsDroppedByWatermark). A key whose rows leave a gap of more than `idle`
seconds of event time starts over behind it, and its state goes as soon as the watermark has passed
the gap, so state does not grow with keys that have left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tilescape.operators import tracks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEALS = 4096


def use_rocksdb(spark: SparkSession) -> None:
    """The state API needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def _schema(stream: DataFrame, columns, extra: str) -> T.StructType:
    return T.StructType([stream.schema[c] for c in columns] + T.StructType.fromDDL(extra).fields)


class _Ring(StatefulProcessor):
    """Resident tiles per viewer: load inside the ring, evict beyond ring + margin.

    All of them lie in the square of ring + margin around the viewer, so state is its place and one
    bit per tile of the square. A stay gives at most two rows of bits, loaded and evicted tiles, for
    every WORD tiles of a square; `_tiles` makes events of them in Spark. A key may hold many viewers.
    """

    WORD = 62

    def __init__(self, who: T.DataType, radius: int, margin: int):
        self.who, self.reach = T.StructType([T.StructField("who", who)]), radius + margin
        self.side = 2 * self.reach + 1
        self.ring = self._bits(range(-radius, radius + 1), range(-radius, radius + 1))
        self.kept: dict[tuple[int, int], tuple[int, int]] = {}

    def _bits(self, xs: range, ys: range) -> int:
        return sum(1 << (dx + self.reach) * self.side + dy + self.reach for dx in xs for dy in ys)

    def _move(self, dx: int, dy: int) -> tuple[int, int]:
        """Bits of the square that stay in it when it moves, and how far they shift."""
        if (dx, dy) not in self.kept:
            span = lambda d: range(max(-self.reach, d - self.reach), min(self.reach, d + self.reach) + 1)
            self.kept[dx, dy] = self._bits(span(dx), span(dy)), dx * self.side + dy
        return self.kept[dx, dy]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", self.who, "x bigint, y bigint, near string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        path = pd.concat(list(rows), ignore_index=True).sort_values(["who", "at"], kind="stable")
        stays = zip(range(len(path)), *(path[c].tolist() for c in ("who", "x", "y", "here")))
        events: list[tuple[int, ...]] = []
        for who, way in groupby(stays, itemgetter(1)):
            before = self.places.getValue((who,))
            after = self._walk(way, before or (0, 0, "0"), events)
            if after != before:
                self.places.updateValue((who,), after)
        if events:
            k, *columns = (np.array(c, dtype="int64") for c in zip(*events))
            yield pd.DataFrame({"who": path["who"].to_numpy()[k], "at": path["at"].to_numpy()[k], **dict(zip(_BITS, columns))})

    def _walk(self, way: Iterator[tuple], place: tuple[int, int, str], events: list) -> tuple[int, int, str]:
        x, y, near, far = place[0], place[1], int(place[2], 16), self.side
        for k, _, to_x, to_y, here in way:
            if here:
                ring, dx, dy = self.ring, to_x - x, to_y - y
                stay, shift = self._move(dx, dy) if -far < dx < far and -far < dy < far else (0, 0)
            else:  # without a place no tile is near
                ring, to_x, to_y, stay, shift = 0, x, y, 0, 0
            gone, stay = near & ~stay, near & stay
            stay = stay >> shift if shift >= 0 else stay << -shift
            if gone:
                self._add(events, k, x, y, 1, gone)
            if ring & ~stay:
                self._add(events, k, to_x, to_y, 0, ring & ~stay)
            x, y, near = to_x, to_y, stay | ring
        return x, y, f"{near:x}"

    def _add(self, events: list, k: int, x: int, y: int, evict: int, bits: int) -> None:
        for word in range(-(-bits.bit_length() // self.WORD)):
            events.append((k, x, y, 2 * word + evict, bits >> word * self.WORD & (1 << self.WORD) - 1))

    def forget(self) -> None:
        self.places.clear()

    def close(self) -> None:
        pass


_BITS = ("x", "y", "part", "bits")


def _tiles(rows: DataFrame, viewer: str, order: str, reach: int) -> DataFrame:
    """Events of rows of bits. Every bit of a word is a row of an exploded constant, so its arithmetic is compiled."""
    side = 2 * reach + 1
    each = F.explode(F.sequence(F.lit(0), F.lit(min(_Ring.WORD, side ** 2) - 1)))
    cells = rows.withColumn("bit", each).filter("shiftright(bits, bit) & 1 = 1").withColumn("cell", F.expr(f"part div 2 * {_Ring.WORD} + bit"))
    return cells.select(F.col("who").alias(viewer), F.expr(f"x + cell div {side} - {reach}").alias("tx"), F.expr(f"y + cell % {side} - {reach}").alias("ty"),
                        F.when(F.col("part") % 2 == 0, "load").otherwise("evict").alias("event"), F.col("at").alias(order))


class _Retry(StatefulProcessor):
    """Failures since the last success; the failure that exhausts the budget is a hole."""

    def __init__(self, key: str, order: str, failed: str, limit: int):
        self.key, self.order, self.failed, self.limit = key, order, failed, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("failures", "failures bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, self.order)
        start = self.count.get()[0] if self.count.exists() else 0
        failed = pdf[self.failed].astype(bool)
        run = (~failed).cumsum()
        counts = failed.groupby(run).cumsum().astype("int64")
        counts = counts.where(run > 0, counts + start)
        counts = counts.where(failed, 0)
        self.count.update((int(counts.iloc[-1]),))
        yield pd.DataFrame({self.key: key[0], self.order: pdf[self.order], "failures": counts, "hole": failed & (counts == self.limit)})

    def forget(self) -> None:
        self.count.clear()

    def close(self) -> None:
        pass


class _Stuck(StatefulProcessor):
    """Accumulated stuck time of a track, floored at zero."""

    def __init__(self, key: str, order: str, names: tuple[str, str, str, str], trigger: float):
        self.key, self.order, self.names, self.trigger = key, order, names, trigger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "stuck double, touched boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        actual, commanded, contact, dt = self.names
        stuck, touched = self.memory.get() if self.memory.exists() else (0.0, False)
        out = []
        for at, a, c, hit, step in _in_order(rows, self.order)[[self.order, actual, commanded, contact, dt]].itertuples(index=False):
            now = c >= step * tracks.STUCK_MIN_SPEED and a < c * tracks.STUCK_RATIO and hit and touched
            stuck = stuck + step if now else max(0.0, stuck - step * tracks.STUCK_DECAY)
            touched = bool(hit)
            out.append((key[0], at, stuck, stuck > self.trigger))
        self.memory.update((float(stuck), touched))
        yield pd.DataFrame(out, columns=[self.key, self.order, "stuck", "fires"])

    def forget(self) -> None:
        self.memory.clear()

    def close(self) -> None:
        pass


class _Waiting(StatefulProcessor):
    """Rows wait in list state until the watermark has passed them; `step` then handles them in order."""

    def __init__(self, step: StatefulProcessor, waiting: T.StructType, idle_ms: int):
        self.step, self.waiting, self.idle = step, waiting, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("waiting", self.waiting)
        self.last = handle.getValueState("last", "last bigint")
        self.step.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, width = None, len(self.waiting)
        for pdf in rows:  # by place (key, columns, event time, milliseconds): pandas renames some columns
            fresh = list(pdf.iloc[:, [*range(1, width), width + 1]].itertuples(index=False, name=None))
            self.rows.appendList(fresh)
            first = min(r[-1] for r in fresh) if first is None else min(first, *(r[-1] for r in fresh))
        if first is not None:
            self.handle.registerTimer(int(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.rows.get(), key=lambda r: r[-1]) if self.rows.exists() else []
        due, later = [r for r in rows if r[-1] <= now], [r for r in rows if r[-1] > now]
        last, at = self.last.get()[0] if self.last.exists() else None, 0
        for i, r in enumerate([*due, None]):
            gap = r is not None and last is not None and r[-1] - last > self.idle
            if (gap or r is None) and i > at:
                yield from self.step.handleInputRows(key, iter([pd.DataFrame(due[at:i], columns=self.waiting.names)]), timerValues)
                at = i
            if gap:
                self.step.forget()
            last = last if r is None else r[-1]
        if due:
            self.rows.put(later) if later else self.rows.clear()
            self.last.update((last,))
        ahead = [r[-1] for r in later[:1]]
        if last is not None and now >= last + self.idle:  # rows to come are all beyond the gap
            self.last.clear()
            self.step.forget()
        elif last is not None:
            ahead.append(last + self.idle)
        if ahead:
            self.handle.registerTimer(int(min(ahead)))

    def close(self) -> None:
        self.step.close()


def _run(stream: DataFrame, key: str, columns: list[str], step: StatefulProcessor, schema: T.StructType, ts: str | None, delay: str, idle: int) -> DataFrame:
    if ts is None:
        return stream.select(key, *columns).groupBy(key).transformWithStateInPandas(step, schema, "Append", "None")
    waiting = T.StructType([stream.schema[c] for c in columns] + [T.StructField("_ms", T.LongType())])
    timed = _event_time(stream.select(key, *columns, F.col(ts).alias("_at")), "_at", delay).withColumn("_ms", F.ceil(F.unix_micros("_at") / 1000))
    return timed.groupBy(key).transformWithStateInPandas(_Waiting(step, waiting, idle * 1000), schema, "Append", "EventTime")


def ring_events_stream(positions: DataFrame, viewer: str, order: str, cx: str, cy: str, radius: int = tracks.RING_RADIUS,
                       margin: int = tracks.EVICT_MARGIN, ts: str | None = None, delay: str = "10 minutes", idle: int = 86400) -> DataFrame:
    """Load and evict events of moving viewers.

    Viewers are dealt to DEALS keys, because a key costs more than a row; with event time every viewer
    is a key, as it has timers of its own.
    """
    place = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    moves = positions.select(F.col(viewer).alias("who"), F.col(order).alias("at"), place(cx).alias("x"), place(cy).alias("y"),
                             (F.col(cx).isNotNull() & F.col(cy).isNotNull()).alias("here"), *([F.col(ts).alias("time")] if ts else []),
                             (F.col(viewer) if ts else F.pmod(F.xxhash64(viewer), F.lit(DEALS))).alias("deal"))
    schema = _schema(moves, ["who", "at"], ", ".join(f"{c} bigint" for c in _BITS))
    rows = _run(moves, "deal", ["who", "at", "x", "y", "here"], _Ring(moves.schema["who"].dataType, radius, margin), schema, "time" if ts else None, delay, idle)
    return _tiles(rows, viewer, order, radius + margin)


def retry_budget_stream(requests: DataFrame, key: str, order: str, failed: str, limit: int = tracks.RETRY_LIMIT,
                        ts: str | None = None, delay: str = "10 minutes", idle: int = 86400) -> DataFrame:
    """Failure counts and holes per key."""
    return _run(requests, key, [order, failed], _Retry(key, order, failed, limit), _schema(requests, [key, order], "failures bigint, hole boolean"), ts, delay, idle)


def stuck_stream(samples: DataFrame, key: str, order: str, actual: str, commanded: str, contact: str, dt: str,
                 trigger: float = tracks.STUCK_TRIGGER, ts: str | None = None, delay: str = "10 minutes", idle: int = 86400) -> DataFrame:
    """Stuck time and firings per track."""
    names = (actual, commanded, contact, dt)
    return _run(samples, key, [order, *names], _Stuck(key, order, names, trigger), _schema(samples, [key, order], "stuck double, fires boolean"), ts, delay, idle)


def _event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def dedupe_requests(requests: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Repeated requests dropped while their first one is within the watermark."""
    return _event_time(requests, ts, delay).dropDuplicatesWithinWatermark(keys)


def release_when_open(items: DataFrame, gates: DataFrame, key: str, ts: str, gate_ts: str, wait: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Items joined to the gate events of their key within `wait`; items without one come out once the watermark passes."""
    left = _event_time(items, ts, delay)
    right = _event_time(gates.select(F.col(key).alias("_key"), gate_ts), gate_ts, delay)
    near = (F.col(key) == F.col("_key")) & F.col(gate_ts).between(F.col(ts) - F.expr(f"interval {wait}"), F.col(ts) + F.expr(f"interval {wait}"))
    return left.join(right, near, "leftOuter").drop("_key")
