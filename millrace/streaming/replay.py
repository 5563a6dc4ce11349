"""Structured Streaming twins of the ordered operators. Extras: the reference has no event-time streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def events(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", f"{name}*").load(folder)


def windowed_counts(stream: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts for each window and kind; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def sessions(stream: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by gap: the streaming form of a trailing debounce."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.max(ts).alias("last_ts"), F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), "last_ts", "n")


def lines(stream: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """Complete lines of chunked text as they arrive; the open tail of each stream is state."""

    def split(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = state.get[0] if state.exists else ""
        arrived = pd.concat(list(parts)).sort_values("seq")
        *whole, tail = (tail + "".join(arrived["chunk"])).split("\n")
        state.update((tail,))
        yield pd.DataFrame({"stream_id": [group[0]] * len(whole), "line": whole})

    rows = stream.select(F.col(key).cast("string").alias("stream_id"), F.col(seq).alias("seq"), F.col(chunk).alias("chunk"))
    return rows.groupBy("stream_id").applyInPandasWithState(split, "stream_id string, line string", "tail string", "append", GroupStateTimeout.NoTimeout)


LINES = "stream_id string, place long, line string"


class Framing(StatefulProcessor):
    """The lines of one stream of numbered chunks that arrive in any order.

    State: the number that is wanted next, how many lines came out, the open tail, and the chunks that arrived before their turn. A
    chunk that was seen before is passed over. A stream without new chunks for ``idle`` milliseconds is over and its state goes: an
    unfinished last line is dropped, and of the chunks behind a gap that never closed only the lines that lie wholly
    between two line ends come out.
    """

    def __init__(self, idle: int | None, first: int = 0):
        self.idle, self.first = idle, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "wanted long, place long, tail string")
        self.early = handle.getMapState("early", "seq long", "chunk string")

    def _out(self, key: tuple, place: int, lines: list[str]) -> pd.DataFrame:
        names = pd.Series([key[0]] * len(lines), dtype=object)  # text of one array, which Arrow-backed columns needn't be
        return pd.DataFrame({"stream_id": names, "place": pd.Series(range(place, place + len(lines)), dtype="int64"), "line": pd.Series(lines, dtype=object)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wanted, place, tail = self.head.get() if self.head.exists() else (self.first, 0, "")
        arrived = {}
        for part in rows:
            arrived |= {int(n): c for n, c in zip(part["seq"], part["chunk"], strict=True) if n >= wanted}
        taken = [tail]
        while wanted in arrived or self.early.containsKey((wanted,)):
            taken.append(arrived.pop(wanted) if wanted in arrived else self.early.getValue((wanted,))[0])
            self.early.removeKey((wanted,))
            wanted += 1
        for n, chunk in arrived.items():
            self.early.updateValue((n,), (chunk,))
        *whole, tail = "".join(taken).split("\n")
        self.head.update((wanted, place + len(whole), tail))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._out(key, place, whole)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        place = self.head.get()[1] if self.head.exists() else 0
        waiting = sorted((k[0], v[0]) for k, v in self.early.iterator())
        lines, run = [], ""
        for k, (n, chunk) in enumerate(waiting):
            run += chunk
            if k + 1 == len(waiting) or waiting[k + 1][0] != n + 1:
                lines, run = lines + run.split("\n")[1:-1], ""
        self.head.clear()
        self.early.clear()
        yield self._out(key, place, lines)

    def close(self) -> None:
        pass


def framed(stream: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk", idle: int | None = 600_000, first: int = 0) -> DataFrame:
    """(stream_id, place, line) of numbered chunks in any order over any batches; see ``Framing``. Null streams and chunks are left out.

    With ``idle`` None streams never end by themselves; a query that runs until all files are read needs that, as timers keep a query going. Sets the session's state store to RocksDB, which this kind of state needs.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(F.col(key).cast("string").alias("stream_id"), F.col(seq).cast("long").alias("seq"), F.col(chunk).alias("chunk")).na.drop()
    return rows.groupBy("stream_id").transformWithStateInPandas(Framing(idle, first), LINES, "Append", "None" if idle is None else "ProcessingTime")


def json_frames(lines_: DataFrame, schema: str) -> DataFrame:
    """The objects of lines; blank and broken ones are skipped."""
    parsed = lines_.withColumn("frame", F.when(F.try_parse_json("line").isNotNull(), F.from_json("line", schema)))
    return parsed.filter(F.col("frame").isNotNull()).select("stream_id", "place", "frame.*")


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there, batch by batch, through a function that must be safe to repeat."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
