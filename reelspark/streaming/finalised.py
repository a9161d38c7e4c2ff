"""Videos as they become complete, each exactly once, from an at-least-once, unordered stream of messages."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelspark.operators.events import COMPLETE, EVENT

OUTPUT = "video_id string, received_count long, expected_total long, job_id string, result_s3_uri string"
#: Several messages of a video as one: the different indices of its events (8 bytes each), the largest total of all messages and of markers.
SUMMARY = "video_id string, indices binary, total long, told long, completion boolean, job_id string, result_s3_uri string"
#: Messages of a task that are summed up together.
TOGETHER = 1 << 17
#: Bits of a page of the map of received indices.
PAGE = 8192
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Timers fire with the next messages; without this a query with timers never finds that it is done.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


# The processor goes to the workers as it is, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (SUMMARY) for each video among so many messages of a task: the keyed state takes its input row by row."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield from summed(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from summed(pa.Table.from_batches(held))


def summed(messages: pa.Table) -> list[pa.RecordBatch]:
    messages = messages.filter(pc.is_valid(messages["video_id"]))
    kind, total, none = messages["event_type"], messages["total_events"], pa.scalar(None, pa.int64())
    done = pc.fill_null(pc.equal(kind, COMPLETE), False)
    only = lambda where, x: pc.if_else(where, x, pa.scalar(None, x.type))
    most = {"total": total, "told": only(done, total), "completion": done, "job_id": only(done, messages["job_id"]), "result_s3_uri": only(done, messages["result_s3_uri"])}
    rows = pa.table({"video_id": messages["video_id"], "index": pc.if_else(pc.equal(kind, EVENT), messages["event_index"], none), **most})
    by = rows.group_by("video_id", use_threads=False).aggregate([("index", "distinct"), *((c, "max") for c in most)])
    lists = by["index_distinct"].combine_chunks()
    index = lists.flatten()
    # places of the lists' ends among the indices that are not null
    there = np.concatenate(([0], np.cumsum(index.is_valid().to_numpy(zero_copy_only=False))))
    ends = there[np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))]
    packed = pa.py_buffer(index.drop_null().to_numpy().astype("<i8"))
    indices = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((8 * ends).astype(np.int32)), packed])
    return pa.table([by["video_id"], indices, *(by[f"{c}_max"] for c in most)], names=["video_id", "indices", *most]).combine_chunks().to_batches()


class Finaliser(StatefulProcessor):
    """State of a video: pages of a bitmap of the indices received, and a row of totals.

    When the last message has come the video is given out and its pages go; a mark stays for `keep_ms`, so that late
    repetitions give nothing, until a timer drops it too.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "received long, total long, told long, completion boolean, job_id string, result_s3_uri string, done boolean")
        self.pages = handle.getMapState("pages", "page long", "bits binary")

    def _new(self, pages: dict, index: int, stored: bool) -> bool:
        """Whether the index is received for the first time; `pages` holds those that this batch has touched, `stored` says that there may be others."""
        page, bit = divmod(index, PAGE)
        if page not in pages:
            pages[page] = bytearray(self.pages.getValue((page,))[0]) if stored and self.pages.containsKey((page,)) else bytearray(PAGE // 8)
        old = pages[page][bit >> 3]
        pages[page][bit >> 3] = old | 1 << (bit & 7)
        return pages[page][bit >> 3] != old

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.seen.exists()
        received, total, told, completion, job, uri, done = self.seen.get() if stored else (0, None, None, False, None, None, False)
        if done:
            return
        pages: dict = {}
        for r in rows:
            received += sum(self._new(pages, i, stored) for i in np.frombuffer(r["indices"], "<i8").tolist())
            completion = completion or r["completion"]
            pairs = (total, r["total"]), (told, r["told"]), (job, r["job_id"]), (uri, r["result_s3_uri"])
            total, told, job, uri = (max((x for x in pair if x is not None), default=None) for pair in pairs)
        expected = told if told is not None else total
        if completion and expected is not None and received >= expected:
            if stored:
                self.pages.clear()
            self.seen.update((received, total, told, True, job, uri, True))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
            yield Row(video_id=key[0], received_count=received, expected_total=expected, job_id=job, result_s3_uri=uri)
            return
        for page, bits in pages.items():
            self.pages.updateValue((page,), (bytes(bits),))
        self.seen.update((received, total, told, completion, job, uri, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def finalised_stream(messages: DataFrame, keep_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """Of a stream of parsed messages: each video once, when all its events and the completion marker have come.

    The same rows as `finalise(video_status(...))` over all messages, whatever their order and however often they come. A video's
    state goes when it is complete; a mark against repetitions goes `keep_ms` later, so a feed that repeats a whole
    video after that gives it again. Messages without a video are left out. Needs the RocksDB state store.
    """
    # messages without a video are left out by `summed`: a filter here would parse each body twice
    rows = messages.selectExpr("video_id", "event_type", "event_index", "total_events", "completion.job_id as job_id", "completion.result_s3_uri as result_s3_uri")
    return rows.mapInArrow(summaries, SUMMARY).groupBy("video_id").transformWithState(Finaliser(keep_ms), OUTPUT, "append", "ProcessingTime")


def run_finalised_stream(messages: DataFrame, path: str, checkpoint: str, keep_ms: int = 7 * 24 * 3600 * 1000) -> None:
    """Write the videos that what is there of the stream completes to Parquet files in `path`, and stop; started again, it goes on."""
    conf = messages.sparkSession.conf
    before = {k: conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        conf.set(k, v)
    try:
        out = finalised_stream(messages, keep_ms).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        query = out.outputMode("append").trigger(availableNow=True).start()
    finally:  # the query has its own settings by now
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    query.awaitTermination()
