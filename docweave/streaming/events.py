"""The event log of batches as streams: sequence numbers, current state, bounded buffers, completion."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from docweave.operators.ordering import chunked
from docweave.sources.documents import scratch

if TYPE_CHECKING:
    import pandas as pd

#: Keeps keyed state on disk; several named states for each key need it.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_starting = threading.Lock()


def event_stream(spark: SparkSession, path: str, schema: object, files: int = 1) -> DataFrame:
    """Parquet files that a glob names, as a stream of at most `files` files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def table_stream(spark: SparkSession, path: str, micro_batches: int = 4) -> DataFrame:
    """The Parquet table at path as a stream of about so many micro-batches, by bytes, at any number and size of files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("maxBytesPerTrigger", max(1, -(-length // micro_batches))).parquet(f"{path}*")


def run_to_end(stream: DataFrame, name: str, mode: str, write: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """Process all that is there and stop; a checkpoint makes a restart go on where it was."""
    spark = stream.sparkSession
    with _starting:  # a query takes the settings that hold when it starts
        before = spark.conf.get(PROVIDER[0], None)
        spark.conf.set(*PROVIDER)
        try:
            query = (
                stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True)
                .option("checkpointLocation", state or scratch(spark, f"{name}-state")).start()
            )
        finally:
            spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def to_table(stream: DataFrame, name: str, mode: str = "append", state: str | None = None) -> DataFrame:
    """The stream's rows as a table: appended ones, or in complete mode the last result. state: where the checkpoint goes."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    kind = "overwrite" if mode == "complete" else "append"
    run_to_end(stream, name, mode, lambda df, _: df.write.mode(kind).parquet(path), state)
    return spark.read.schema(stream.schema).parquet(path)


def numbered(stream: DataFrame, chunks: int | None = None) -> DataFrame:
    """(event_id, batch_id, seq): events of a batch numbered from 0 in order of time, going on across micro-batches.

    Numbers have two levels: a micro-batch is dealt into chunks by range, counts for each key and chunk give each
    chunk's offset, and rows are numbered inside their chunk, so no task holds all of a key. The state is the next
    number of each key. Chunks, numbers and state are written under the number of the micro-batch: one that is done
    again writes over its own and reads only earlier ones.
    """
    spark = stream.sparkSession
    folder = scratch(spark, "numbered")
    done: set[int] = set()

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession

        def kept(kind: str, rows: DataFrame) -> DataFrame:
            rows.write.mode("overwrite").parquet(f"{folder}/{kind}/{n}")
            return spark.read.schema(rows.schema).parquet(f"{folder}/{kind}/{n}")

        rows = kept("chunks", chunked(batch.select("batch_id", "ts", "event_id"), ["batch_id", "ts", "event_id"], chunks))
        earlier = Window.partitionBy("batch_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy("batch_id", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        paths = [f"{folder}/next/{i}" for i in sorted(done) if i < n]
        state = spark.read.schema("batch_id long, next long").parquet(*paths) if paths else spark.createDataFrame([], "batch_id long, next long")
        held = counts.join(state.groupBy("batch_id").agg(F.max("next").alias("next")), "batch_id", "left").fillna(0, ["next"])
        held = kept("offsets", held.select("batch_id", "chunk", "n", (F.col("next") + F.col("before")).alias("first")))
        place = F.row_number().over(Window.partitionBy("batch_id", "chunk").orderBy("ts", "event_id"))
        placed = rows.withColumn("place", place).join(held.select("batch_id", "chunk", "first"), ["batch_id", "chunk"])
        kept("numbers", placed.select("event_id", "batch_id", (F.col("first") + F.col("place") - 1).alias("seq")))
        kept("next", held.groupBy("batch_id").agg(F.max(F.col("first") + F.col("n")).alias("next")))
        done.add(n)

    run_to_end(stream, "numbered", "append", step)
    schema, paths = "event_id long, batch_id long, seq long", [f"{folder}/numbers/{i}" for i in sorted(done)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest_states(stream: DataFrame) -> DataFrame:
    """The last state of every task."""
    states = stream.where("event = 'TASK_STATE'")
    return states.groupBy("batch_id", "task_id").agg(F.max_by("payload", "event_id").alias("status"))


def bounded(stream: DataFrame, keep: int) -> DataFrame:
    """(batch_id, event_ids): the newest `keep` events of each batch, as its state after each micro-batch; the last counts."""

    def hold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        old = [int(x) for x in state.get[0].split(",")] if state.exists else []
        new = sorted(old + [int(x) for pdf in pdfs for x in pdf["event_id"]])[-keep:]
        state.update((",".join(map(str, new)),))
        yield pd.DataFrame({"batch_id": [key[0]], "event_ids": [",".join(map(str, new))], "last": [new[-1]]})

    schema = "batch_id long, event_ids string, last long"
    return stream.groupBy("batch_id").applyInPandasWithState(hold, schema, "ids string", "update", GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, totals: DataFrame) -> DataFrame:
    """(batch_id, done, total): batches whose completed events have reached their total."""
    done = stream.where("payload = 'COMPLETED'").groupBy("batch_id").agg(F.count(F.lit(1)).alias("done"))
    return done.join(totals, "batch_id").where("done >= total")


class SectionTexts(StatefulProcessor):
    """Tokens of a section, held until its end event sends them out as one text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tokens = handle.getListState("tokens", "event_id long, token string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new: list[tuple[int, str]] = []
        for row in sorted(rows, key=lambda r: r.event_id):
            if row.event == "TOKEN":
                new.append((row.event_id, row.payload or ""))
                continue
            held = [*map(tuple, self.tokens.get()), *new]
            if held:
                yield Row(batch_id=key[0], task_id=key[1], section=key[2], n_tokens=len(held), text="".join(t for _, t in held))
                self.tokens.clear()
                new = []
        if new:
            self.tokens.appendList(new)

    def close(self) -> None:
        pass


def section_texts(stream: DataFrame) -> DataFrame:
    """(batch_id, task_id, section, n_tokens, text): tokens in order, sent out and forgotten at each end event.

    Rows whose event isn't TOKEN are ends. State holds open sections only; tokens after an end begin a new text, and an
    end without tokens gives none. A section's tokens come in order of micro-batches; inside one, event_id orders them.
    """
    schema = "batch_id long, task_id long, section long, n_tokens int, text string"
    return stream.groupBy("batch_id", "task_id", "section").transformWithState(SectionTexts(), schema, "append", "none")


class ExpiringBuffer(StatefulProcessor):
    """The newest events of a batch, forgotten when none has come for so long."""

    def __init__(self, keep: int, seconds: int):
        self.keep, self.life = keep, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "event_id long")
        self.last = handle.getValueState("last", "at long, size int")

    def _timer(self, last: int) -> int:
        return -(-(last + self.life) // 1000) + 1

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last, size = self.last.get() if self.last.exists() else (None, 0)
        if last is not None:
            self.handle.deleteTimer(self._timer(last))
        new: list[int] = []
        for row in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if last is not None and row.at - last > self.life:
                yield Row(batch_id=key[0], last=last, n=min(size + len(new), self.keep))
                self.events.clear()
                size, new = 0, []
            last = row.at if last is None else max(last, row.at)
            new.append(row.event_id)
        if size + len(new) > self.keep:
            kept = [*(e[0] for e in self.events.get()), *new][-self.keep :]
            self.events.put([(e,) for e in kept])
            size = len(kept)
        else:
            self.events.appendList([(e,) for e in new])
            size += len(new)
        self.last.update((last, size))
        self.handle.registerTimer(self._timer(last))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.last.exists():
            last, size = self.last.get()
            if self._timer(last) <= expiredTimerInfo.getExpiryTimeInMs():
                self.events.clear()
                self.last.clear()
                yield Row(batch_id=key[0], last=last, n=size)

    def close(self) -> None:
        pass


def expiries(stream: DataFrame, keep: int, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(batch_id, last, n): buffers of the newest `keep` events, when no event has come for longer than so many seconds.

    Time is that of the events: a buffer expires between two of its own events, or when the watermark passes. What it
    held is gone then, and the next event begins an empty buffer. delay: how late events may be; later ones are dropped.
    """
    kind = stream.schema["ts"].dataType
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    out = timed.groupBy("batch_id").transformWithState(ExpiringBuffer(keep, seconds), "batch_id long, last long, n int", "append", "eventTime")
    return out.select("batch_id", F.timestamp_micros("last").cast(kind).alias("last"), "n")


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """What a stream with that checkpoint holds under a named list state: one row for each entry."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
    with _starting:
        before = spark.conf.get(PROVIDER[0], None)
        spark.conf.set(*PROVIDER)
        try:
            return reader.option("flattenCollectionTypes", "true").load()
        finally:
            spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
