"""Bands of images as a stream: claimed, reordered, emitted, closed.

Writers hand over bands ``(stream, y0, y1, height, data)`` in any order.  Per
stream, state holds the ranges claimed so far, the bands that wait for rows
before them, and the next row to emit.  A band that leaves the image or meets a
claimed range is an error; after the first error a stream takes no more.  Bands
go out as soon as all rows before them are out; nothing is dropped as late.
``unfinished`` tells which streams have rows missing when they are closed.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

INPUT = StructType([StructField("stream", StringType()), StructField("y0", LongType()), StructField("y1", LongType()), StructField("height", LongType()), StructField("data", BinaryType())])
OUTPUT = StructType([StructField("stream", StringType()), StructField("seq", IntegerType()), StructField("y0", LongType()), StructField("y1", LongType()), StructField("data", BinaryType()), StructField("error", StringType())])


class Order:
    """Claims and the emission frontier of one stream."""

    def __init__(self, frontier: int = 0, seq: int = 0, error: str | None = None, waiting: dict[int, tuple[int, bytes]] | None = None):
        self.frontier, self.seq, self.error = frontier, seq, error
        self.waiting = waiting or {}

    def claim(self, y0: int, y1: int, height: int) -> str | None:
        """What is wrong with a range, if anything; emitted rows are claimed up to the frontier."""
        if self.error:
            return f"closed by an error: {self.error}"
        if not 0 <= y0 < y1 <= height:
            return "outside the image or empty"
        starts = sorted(self.waiting)
        at = bisect.bisect_left(starts, y1)
        if y0 < self.frontier or at and self.waiting[starts[at - 1]][0] > y0:
            return "overlaps rows that were written"
        return None

    def add(self, y0: int, y1: int, height: int, data: bytes) -> Iterator[tuple[int, int, int, bytes, str | None]]:
        """Take a band; give what can be emitted now as ``(seq, y0, y1, data, error)``."""
        wrong = self.claim(y0, y1, height)
        if wrong:
            self.error = self.error or wrong
            yield -1, y0, y1, b"", wrong
            return
        self.waiting[y0] = y1, data
        while self.frontier in self.waiting:
            start = self.frontier
            stop, out = self.waiting.pop(start)
            yield self.seq, start, stop, out, None
            self.frontier, self.seq = stop, self.seq + 1


class Reorder(StatefulProcessor):
    """The state of each stream, kept by Spark between batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "frontier long, seq int, error string")
        self.waiting = handle.getMapState("waiting", "y0 long", "y1 long, data binary")

    def handleInputRows(self, key, rows, timerValues):
        head = self.head.get() if self.head.exists() else None
        held = {k[0]: (v[0], bytes(v[1])) for k, v in self.waiting.iterator()}
        order = Order(*(head or (0, 0, None)), dict(held))
        out = []
        for batch in rows:
            for y0, y1, height, data in zip(batch["y0"], batch["y1"], batch["height"], batch["data"]):
                out += [(key[0], *x) for x in order.add(int(y0), int(y1), int(height), bytes(data))]
        for y0 in held.keys() - order.waiting.keys():
            self.waiting.removeKey((y0,))
        for y0 in order.waiting.keys() - held.keys():
            self.waiting.updateValue((y0,), order.waiting[y0])
        self.head.update((order.frontier, order.seq, order.error))
        yield pd.DataFrame(out, columns=OUTPUT.names)

    def close(self) -> None:
        pass


def reorder(stream: DataFrame) -> DataFrame:
    """Bands of a streaming DataFrame in row order, errors as rows with ``seq`` -1.

    Needs the RocksDB state store: set
    ``spark.sql.streaming.stateStore.providerClass`` accordingly.
    """
    return stream.groupBy("stream").transformWithStateInPandas(Reorder(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def reorder_batch(bands: DataFrame) -> DataFrame:
    """The same over a finished table of bands: a group's state is a loop over its rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = Order()
        out = []
        for r in pdf.itertuples(index=False):
            out += [(r.stream, *x) for x in order.add(int(r.y0), int(r.y1), int(r.height), bytes(r.data))]
        return pd.DataFrame(out, columns=OUTPUT.names)

    return bands.groupBy("stream").applyInPandas(run, OUTPUT)


def unfinished(emitted: DataFrame, heights: DataFrame) -> DataFrame:
    """``(stream, reached, height)`` of streams that end short of their height."""
    reached = emitted.filter("error is null").groupBy("stream").agg(F.max("y1").alias("reached"))
    return heights.join(reached, "stream", "left").select("stream", F.coalesce("reached", F.lit(0)).alias("reached"), "height").filter("reached < height")


def header(width: int, height: int, colour: int, depth: int) -> bytes:
    """What is written before any band: the schema is fixed when a stream is opened."""
    from ..functions.png import SIGNATURE, chunk

    if not (0 < width < 1 << 31 and 0 < height < 1 << 31):
        raise ValueError("the size of a stream is from 1 to 2**31 - 1 a side")
    return SIGNATURE + chunk(b"IHDR", struct.pack(">2I5B", width, height, depth, colour, 0, 0, 0))
