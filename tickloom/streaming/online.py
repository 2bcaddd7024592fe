"""Keyed stream state: indicators, drawdown alarms and quality alerts per series.

Feed these bars (the output of ``stream_bars``, in the same job or from a table), not ticks: one series then has one row per bar
interval. Bars may come out of order: they wait in state until the watermark has passed them and are folded in time order then,
whatever batches they came in. A bar that comes after the watermark is too late; Spark drops and counts it (``late_rows``). Bars of the
last ``delay`` wait until the stream goes on or is closed (``bars.run`` with a closing row). Needs the RocksDB state store.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.series import By

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state store the operators below need, for queries started inside the block."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class _Keyed(StatefulProcessor):
    """One row of doubles per key; ``step`` folds a bar into it and returns the output values. Bars wait for the watermark in a list."""

    state_schema = ""
    start: tuple = ()
    inputs: tuple[str, ...] = ("close",)
    outputs: tuple[str, ...] = ()

    def __init__(self, by: By, ts: str):
        self.by, self.ts = tuple(by), ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.waiting = handle.getListState("waiting", "micros long, " + ", ".join(f"{c} double" for c in self.inputs))
        self.bar = namedtuple("bar", [self.ts, *self.inputs])

    def step(self, s: tuple, row) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for pdf in rows:
            micros = pdf[self.ts].astype("datetime64[us]").astype("int64")
            found += zip(micros.tolist(), *(pdf[c].astype(float).tolist() for c in self.inputs))
        if found:
            self.waiting.appendList(found)
            self._wake(min(found)[0])
        yield from ()

    def _wake(self, micros: int) -> None:
        """A timer at a bar fires once the watermark has passed it."""
        self.handle.registerTimer(micros // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.release(key, timerValues)

    def release(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Fold the waiting bars up to the watermark, in order of time and then of their values."""
        passed = timerValues.getCurrentWatermarkInMs()
        bars = sorted(tuple(x) for x in self.waiting.get())
        due = [x for x in bars if x[0] // 1000 <= passed]
        if not due:
            return
        s = tuple(self.state.get()) if self.state.exists() else self.start
        out = []
        for micros, *values in due:
            row = self.bar(pd.Timestamp(micros, unit="us"), *values)
            s, found = self.step(s, row)
            out += [(*key, row[0], *f) for f in found]
        self.state.update(s)
        rest = bars[len(due) :]
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.by, self.ts, *self.outputs])

    def close(self) -> None:
        pass


class Indicators(_Keyed):
    """EMA, Wilder RSI and ATR, and the side of the close relative to the EMA."""

    state_schema = "n double, close double, ema double, gain double, loss double, atr double"
    start = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    inputs = ("high", "low", "close")
    outputs = ("ema", "rsi", "atr", "signal")

    def __init__(self, by: By, ts: str, ema: int, rsi: int, atr: int):
        super().__init__(by, ts)
        self.ema, self.rsi, self.atr = ema, rsi, atr

    def step(self, s, row):
        n, close, ema, gain, loss, atr = s
        c, h, low = row.close, row.high, row.low
        if n == 0:
            ema, gain, loss, atr = c, 0.0, 0.0, h - low
        else:
            ema += 2.0 / (self.ema + 1.0) * (c - ema)
            gain += (max(c - close, 0.0) - gain) / self.rsi
            loss += (max(close - c, 0.0) - loss) / self.rsi
            atr += (max(h - low, abs(h - close), abs(low - close)) - atr) / self.atr
        n += 1
        rsi = None if n < self.rsi else 100.0 if loss == 0 else 100.0 * gain / (gain + loss)
        e = ema if n >= self.ema else None
        signal = 0 if e is None else int(c > e) - int(c < e)
        return (n, c, ema, gain, loss, atr), [(e, rsi, atr if n >= self.atr else None, signal)]


class Drawdown(_Keyed):
    """Running peak, drawdown and an alarm beyond the limit."""

    state_schema = "peak double"
    start = (float("-inf"),)
    outputs = ("peak", "drawdown", "alarm")

    def __init__(self, by: By, ts: str, limit: float):
        super().__init__(by, ts)
        self.limit = limit

    def step(self, s, row):
        peak = max(s[0], row.close)
        dd = (row.close - peak) / peak
        return (peak,), [(peak, dd, dd < -self.limit)]


class Alerts(_Keyed):
    """Jumps and gaps between bars; a timer reports a series that has gone quiet."""

    state_schema = "close double, seconds double"
    start = (float("nan"), float("nan"))
    outputs = ("alert", "value")

    def __init__(self, by: By, ts: str, jump: float, gap_hours: float, stale_hours: float):
        super().__init__(by, ts)
        self.jump, self.gap, self.stale = jump, gap_hours * 3600.0, stale_hours * 3600.0

    def step(self, s, row):
        close, last = s
        now, found = getattr(row, self.ts).timestamp(), []
        if close == close:
            ret = row.close / close - 1.0
            if abs(ret) > self.jump:
                found.append(("jump", ret))
            if now - last > self.gap:
                found.append(("gap", (now - last) / 3600.0))
        return (row.close, now), found

    def release(self, key, timerValues):
        folded = list(super().release(key, timerValues))
        if self.state.exists():
            last = self.state.get()[1]
            due, passed = (last + self.stale) * 1000.0, timerValues.getCurrentWatermarkInMs()
            told = self.told.get()[0] if self.told.exists() else -1.0
            if due > passed:
                self.handle.registerTimer(int(due))
            elif told < last and not self.waiting.exists():  # nothing has come since, and none is waiting
                self.told.update((last,))
                row = (*key, pd.Timestamp(int(due), unit="ms"), "stale", self.stale / 3600.0)
                folded.append(pd.DataFrame([row], columns=[*self.by, self.ts, *self.outputs]))
        yield from folded

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.told = handle.getValueState("told", "seconds double")  # the bar whose silence was reported


def _apply(bars: DataFrame, processor: _Keyed, outputs: str, *, by: By, ts: str, delay: str | None) -> DataFrame:
    keys = ", ".join(f"{k} {bars.schema[k].dataType.simpleString()}" for k in by)
    bars = bars if delay is None else bars.withWatermark(ts, delay)
    return bars.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"{keys}, {ts} timestamp, {outputs}", outputMode="Append", timeMode="EventTime"
    )


def online_indicators(bars: DataFrame, *, ema: int = 20, rsi: int = 14, atr: int = 14, delay: str | None = "1 hour", by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """``delay``: how late bars may come; None if they carry a watermark already, as those of ``stream_bars`` do."""
    return _apply(bars, Indicators(by, ts, ema, rsi, atr), "ema double, rsi double, atr double, signal int", by=by, ts=ts, delay=delay)


def online_drawdown(bars: DataFrame, limit: float = 0.2, *, delay: str | None = "1 hour", by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    return _apply(bars, Drawdown(by, ts, limit), "peak double, drawdown double, alarm boolean", by=by, ts=ts, delay=delay)


def online_alerts(
    bars: DataFrame, jump: float = 0.1, gap_hours: float = 48.0, stale_hours: float = 48.0, *, delay: str | None = "1 hour", by: By = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """Jumps and gaps by bar; ``stale`` at the time a series has been quiet for so long, reported when the watermark has passed it."""
    return _apply(bars, Alerts(by, ts, jump, gap_hours, stale_hours), "alert string, value double", by=by, ts=ts, delay=delay)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the progress that the query remembers."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
