"""What the operators share: shared scratch storage and Arrow batch mapping."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a local
    folder made and set as the session's checkpoint folder; on a cluster a session
    without one is an error, as executors would not find each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, what: str, codec: str | None = None, rows: int | None = None, in_file: int = 1 << 16) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage at a copy that outlives any executor.  A table of at most
    about ``rows`` rows goes into a file for every ``in_file`` of them, or one a core
    if these are more, however many partitions it has: each file takes a task, and
    Hadoop's local files an own process for each permission that it sets.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // in_file)))
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    writer = df.write
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the table that ``written`` gave, once nothing will read it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.fullmatch("[a-z-]+-[0-9a-f]{32}", folder.rsplit("/", 1)[-1]):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Map Arrow batches one by one; Spark bounds a batch by rows and by bytes."""

    def run(batches):
        for batch in batches:
            out = make(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


_tables: dict[str, Callable[[], None]] = {}
_owner: list[str] = []


def worker_table(name: str, clear: Callable[[], None]) -> None:
    """Make known how to drop what an operator keeps in a Python worker between tasks."""
    _tables[name] = clear


def claim_worker(name: str) -> None:
    """Drop what other operators have left in this worker: workers outlive stages."""
    if _owner == [name]:
        return
    for other, clear in _tables.items():
        if other != name:
            clear()
    _owner[:] = [name]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """A string column as Python strings; a null is an empty text."""
    return ["" if x is None else x for x in column.to_pylist()]
