"""Streams of symbols: n-gram counts per window of event time, and the suffix filter as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.filters import UNKNOWN, SuffixModel


def windowed_words(symbols: DataFrame, length: int, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, xs, ys, n: words of ``length`` + 1 symbols counted per tumbling window of the time ``ts``.

    Symbols of a series are gathered per window (its bounded part of the
    stream); words that would cross a window's edge are not counted, see
    :func:`carried_words`.  Rows later than the watermark are dropped by Spark.
    """
    timed = symbols.withWatermark("ts", late)
    held = timed.groupBy(F.window("ts", every).alias("w"), "series_id").agg(F.array_sort(F.collect_list(F.struct("ts", "t", "x", "y"))).alias("rows"))
    text = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "")
    strings = held.select("w", text("x").alias("x"), text("y").alias("y"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.length("y") - length, F.lit(1)))).alias("i")
    cut = strings.where(F.length("y") > length).select("w", starts, "x", "y")
    words = cut.select("w", F.substring("x", F.col("i"), F.lit(length + 1)).alias("xs"), F.substring("y", F.col("i"), F.lit(length + 1)).alias("ys"))
    return words.groupBy("w", "xs", "ys").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "xs", "ys", "n")


def filter_stream(symbols: DataFrame, model: SuffixModel, idle_ms: int | None = None) -> DataFrame:
    """series_id, t, state before each symbol, carried from batch to batch per series.

    What is kept for a series is its last symbols (as many as the model looks
    back on), its position and its state.  Symbols of a batch are put in order of
    t; those that come after a later one has been filtered are dropped.  A series
    without symbols for ``idle_ms`` of processing time is forgotten, if that is given.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        xs, ys, at, last = state.get if state.exists else ("", "", 0, UNKNOWN)
        rows = pd.concat(list(batches)).sort_values("t")
        rows = rows[rows["t"] >= at]
        out = []
        for t, x, y in zip(rows["t"].tolist(), rows["x"], rows["y"], strict=True):
            if t != at:  # a gap: what went before is unknown
                xs, ys, last, at = "", "", UNKNOWN, t
            last = model.walk(last, xs, ys, at - len(ys), len(ys))[0]
            out.append((key[0], t, last if last != UNKNOWN else None))
            xs, ys, at = (xs + x)[-model.length :], (ys + y)[-model.length :], t + 1
        state.update((xs, ys, at, last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["series_id", "t", "state"]).astype({"state": "Int64"})

    key = symbols.schema["series_id"].dataType.simpleString()
    return symbols.groupBy("series_id").applyInPandasWithState(
        step, f"series_id {key}, t bigint, state bigint", "xs string, ys string, at bigint, last bigint", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


class WordCutter(StatefulProcessor):
    """Holds a series' symbols until the watermark has passed their window, then cuts them into words.

    What stays of a closed window is its last symbols, as many as a word has
    before its last one, so that words go on over the edge.
    """

    def __init__(self, length: int, every_ms: int) -> None:
        self.length, self.every = length, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, t bigint, x string, y string")
        self.carry = handle.getValueState("carry", "t bigint, xs string, ys string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        ends = set()
        for part in rows:
            at = (part["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            ends |= {(ms // self.every + 1) * self.every for ms in at}
            self.waiting.appendList([(ms, int(t), x, y) for ms, t, x, y in zip(at, part["t"], part["x"], part["y"], strict=True)])
        for end in ends:
            self.handle.registerTimer(end)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(self.waiting.get(), key=lambda r: r[1])
        due, rest = [r for r in held if r[0] < end], [r for r in held if r[0] >= end]
        self.waiting.put(rest) if rest else self.waiting.clear()
        at, xs, ys = self.carry.get() if self.carry.exists() else (-1, "", "")
        words: dict[tuple[str, str], int] = {}
        for _, t, x, y in due:
            if t != at:  # a gap: words don't go over it
                xs = ys = ""
            xs, ys, at = xs + x, ys + y, t + 1
            if len(ys) > self.length:
                words[xs, ys] = words.get((xs, ys), 0) + 1
                xs, ys = xs[1:], ys[1:]
        self.carry.update((at, xs, ys))
        if words:
            yield pd.DataFrame([(key[0], pd.Timestamp(end - self.every, unit="ms"), a, b, n) for (a, b), n in words.items()], columns=["series_id", "window_start", "xs", "ys", "n"])

    def close(self) -> None:
        pass


def carried_words(symbols: DataFrame, length: int, every_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """series_id, window_start, xs, ys, n: words of ``length`` + 1 symbols by the tumbling window in which they end.

    Each word of a series is counted once, those that cross windows too: summed
    over windows the counts are those of the whole series.  A window is told when
    the watermark of ``ts`` has passed its end; until then its symbols may come in
    any order.  Later ones are dropped by Spark and leave a gap that no word goes
    over.  Needs a state store that keeps timers (RocksDB).
    """
    key = symbols.schema["series_id"].dataType.simpleString()
    shape = f"series_id {key}, window_start timestamp, xs string, ys string, n bigint"
    timed = symbols.select("series_id", "ts", "t", "x", "y").withWatermark("ts", late)
    return timed.groupBy("series_id").transformWithStateInPandas(statefulProcessor=WordCutter(length, every_seconds * 1000), outputStructType=shape, outputMode="Append", timeMode="EventTime")
