"""Traces as they come: context kept per log by a stateful operator, passes per micro-batch."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spoor.functions.fields import split_fields
from spoor.plans.stepwise import ContextState
from spoor.session import ship

CONTEXT = "log_id string, line_no long, op string, fields array<string>, isolate string, script_id int, origin string, epoch long"
STATE = "isolate string, script_id int, origins map<string,string>, epochs map<string,long>"


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """log_id, line_no, line of a stream of tab-separated files: log, line number, record."""
    parts = F.split("value", "\t", 3)
    return spark.readStream.text(path).select(F.get(parts, F.lit(0)).alias("log_id"), F.get(parts, F.lit(1)).cast("long").alias("line_no"), F.get(parts, F.lit(2)).alias("line"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Lines of one log in order; lines of one micro-batch are put in order here, batches come in order."""
    at = ContextState()
    if state.exists:
        at.isolate, at.script, origins, epochs = state.get
        at.origins, at.epochs = dict(origins or {}), dict(epochs or {})
    rows = pd.concat(list(batches)).sort_values("line_no")
    out = []
    for line_no, op, fields in zip(rows["line_no"], rows["op"], rows["fields"], strict=True):
        out.append((key[0], line_no, op, None if fields is None else list(fields), *at.see(op, fields)))
    state.update((at.isolate, at.script, at.origins, at.epochs))
    frame = pd.DataFrame(out, columns=["log_id", "line_no", "op", "fields", "isolate", "script_id", "origin", "epoch"])
    yield frame.astype({"script_id": "Int32"})


def live_context(lines: DataFrame) -> DataFrame:
    """Lines of a stream with their context; what with_context() gives for a whole log."""
    ship(lines.sparkSession)
    rows = lines.select("log_id", "line_no", F.substring("line", 1, 1).alias("op"), split_fields(F.substring("line", 2, 1 << 30)).alias("fields"))
    return rows.groupBy("log_id").applyInPandasWithState(_fold, CONTEXT, STATE, "append", GroupStateTimeout.NoTimeout)


#: Numbers of lines whose early lines are kept together.
BUCKET = 1024


class InOrder(StatefulProcessor):
    """Lines of a log in whatever order and batches they come, put out with their context once all before them have come.

    State of a log: its context and the number of the next line; early lines by BUCKET of their numbers, of which one
    is in memory at a time. A line whose number has been passed was seen before or given up on, and is left out. If a
    line doesn't come for patience, a timer gives up on those that are missing before the next early one; without
    patience, early lines wait for ever.
    """

    def __init__(self, patience_ms: int | None) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "state binary")
        self.early = handle.getMapState("early", "bucket long", "rows binary")

    def _load(self) -> tuple[ContextState, int]:
        context, nth = ContextState(), 0
        if self.at.exists():
            parts, nth = pickle.loads(self.at.get()[0])
            vars(context).update(parts)
        return context, nth

    def _bucket(self, bucket: int) -> dict[int, tuple]:
        return pickle.loads(self.early.getValue((bucket,))[0]) if self.early.containsKey((bucket,)) else {}

    def _keep(self, bucket: int, rows: dict[int, tuple]) -> None:
        if rows:
            self.early.updateValue((bucket,), (pickle.dumps(rows),))
        elif self.early.containsKey((bucket,)):
            self.early.removeKey((bucket,))

    def _drained(self, log: str, context: ContextState, nth: int) -> tuple[list[tuple], int]:
        """What can go out from line nth on, and the number of the line that is waited for then."""
        out = []
        while True:
            bucket = nth // BUCKET
            rows = self._bucket(bucket)
            before = nth
            while (row := rows.pop(nth, None)) is not None:
                line_no, op, fields = row
                out.append((log, line_no, op, fields, *context.see(op, fields)))
                nth += 1
            if nth == before:
                return out, nth
            self._keep(bucket, rows)
            if nth // BUCKET == bucket:
                return out, nth

    def _done(self, context: ContextState, nth: int, now: int) -> None:
        self.at.update((pickle.dumps((vars(context), nth)),))
        if self.patience is None:
            return
        timers = list(self.handle.listTimers())
        waiting = next(iter(self.early.keys()), None) is not None
        if waiting and not timers:
            self.handle.registerTimer(now + self.patience)
        elif not waiting:
            for t in timers:
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["log_id", "line_no", "op", "fields", "isolate", "script_id", "origin", "epoch"])
        return frame.astype({"script_id": "Int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        context, nth = self._load()
        for frame in rows:
            by: dict[int, dict[int, tuple]] = {}
            for n, line_no, op, fields in zip(frame["nth"], frame["line_no"], frame["op"], frame["fields"], strict=True):
                if n >= nth:
                    by.setdefault(int(n) // BUCKET, {}).setdefault(int(n), (int(line_no), op, None if fields is None else list(fields)))
            for bucket, found in by.items():
                self._keep(bucket, {**found, **self._bucket(bucket)})
            out, nth = self._drained(key[0], context, nth)
            if out:
                yield self._frame(out)
        self._done(context, nth, timerValues.getCurrentProcessingTimeInMs() if self.patience is not None else 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        context, nth = self._load()
        buckets = [k[0] for k in self.early.keys()]
        if buckets:
            nth = max(nth, min(self._bucket(min(buckets))))
            out, nth = self._drained(key[0], context, nth)
            if out:
                yield self._frame(out)
        self._done(context, nth, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


#: Fixed value: the state store that the processor above needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def live_context_any_order(lines: DataFrame, patience_seconds: int | None = 600) -> DataFrame:
    """Lines (log_id, nth, line_no, line) of a stream with their context, whatever order they come in. nth numbers a log's lines from 0.

    The session must use the state store of STORE when the query is started. A query with patience goes on until it
    is stopped, as timers may always come up; for a finished stream, there is no patience to have.
    """
    from spoor.plans import stepwise

    rows = lines.select("log_id", "nth", "line_no", F.substring("line", 1, 1).alias("op"), split_fields(F.substring("line", 2, 1 << 30)).alias("fields"))
    own = sys.modules[__name__], stepwise  # the driver's own worker, which asks the processor for its schema, can't import shipped files
    for m in own:
        cloudpickle.register_pickle_by_value(m)
    try:
        work, time = (InOrder(None), "none") if patience_seconds is None else (InOrder(patience_seconds * 1000), "processingTime")
        return rows.groupBy("log_id").transformWithStateInPandas(work, CONTEXT, "append", time)
    finally:
        for m in own:
            cloudpickle.unregister_pickle_by_value(m)


def live_counts(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Windowed counts with a watermark, for streams that have event time."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).count()


def live_sessions(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """keys, start, end, n: stretches of events of a key with less than gap between them, put out when the watermark has passed their end.

    Events whose own stretch would end at or before the watermark are late and dropped. An event that isn't late may still
    come within gap of a stretch that has been put out; it is then in a stretch of its own that overlaps the other one.
    whole_sessions() puts these together. Watermarks are whole milliseconds.
    """
    tick = "interval 1 microsecond"  # Spark joins stretches that touch: each begins a tick late and ends in time
    moved = events.withColumn("_at", F.col(time) + F.expr(tick)).withWatermark("_at", late)
    found = moved.groupBy(F.session_window("_at", f"{gap} -1 microseconds").alias("s"), *keys).agg(F.count("*").alias("n"))
    return found.select(*keys, (F.col("s.start") - F.expr(tick)).alias("start"), F.col("s.end").alias("end"), "n")


def whole_sessions(found: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches that live_sessions() put out, those of a key that overlap as one.

    One that is settled is final; one that ends less than gap before the watermark may yet grow, also by stretches that are still open.
    """
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    marked = found.withColumn("_fresh", F.when(F.col("start") < F.max("end").over(before), 0).otherwise(1))
    nth = F.sum("_fresh").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = marked.withColumn("_nth", nth).groupBy(*keys, "_nth")
    return parts.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).select(*keys, "start", "end", "n")


def closing(events: DataFrame, time: str, after: str) -> DataFrame:
    """One row of the columns of events, with nulls but for a time that is after the last one: as the last micro-batch
    of inputs that have ended it makes the watermark pass all others, so that what is open is put out too. No row without events."""
    last = events.agg(F.max(time).alias("_last")).filter("_last is not null")
    return last.select(*((F.col("_last") + F.expr(f"interval {after}") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema))


def live_distinct(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key; others that come until late after it are dropped, then its state goes."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def finished(stream: DataFrame, at: str) -> DataFrame:
    """What a stream over inputs that have ended puts out, as a table in a folder; its state is beside it."""
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def in_batches(rows: DataFrame, batch: str, n: int, at: str) -> DataFrame:
    """A stream of rows that come in n micro-batches, by the number in a column: each is one file, read one after another."""
    for i in range(n):
        rows.filter(F.col(batch) == i).coalesce(1).write.parquet(f"{at}/in/batch{i:04}")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{at}/in/*")


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Run passes on each micro-batch once."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["line_stream", "live_context", "live_context_any_order", "live_counts", "live_sessions", "whole_sessions", "closing", "live_distinct", "finished", "in_batches", "for_each_batch"]
