"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import images


class Queries(dict):
    """Queries by name, with their SQL beside them."""

    def __init__(self):
        super().__init__()
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """A table of at most so many rows dealt out to all cores; a larger one as it is.

    A table of one row group is one task however many splits it has.  Larger tables
    come in splits enough, and are never shuffled for this.
    """
    small = df.select(df.columns[0]).limit(rows + 1).count() <= rows
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


def text_images(spark: SparkSession, folder: str, row_bytes: int = 64) -> DataFrame:
    """Documents as images of their UTF-8 bytes."""
    return images.from_text(spread(table(spark, folder, "documents").select("doc_id", "text")), row_bytes=row_bytes)


#: Bytes ``v`` of the documents at ``i``, rows filled up with zeros to 64.
PIXELS = """
l AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
p AS (SELECT doc_id, list_concat(h, list_transform(range((64 - len(h) % 64) % 64), lambda x: '00')) AS h FROM l),
u AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) - 1 AS i FROM p),
px AS (SELECT doc_id, i, (i // 64)::INT AS y, (i % 64)::INT AS x, ('0x' || h)::INT AS v FROM u)
"""

#: The bytes as they are, not filled up.
BYTES = """
l AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
u AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) - 1 AS i FROM l),
px AS (SELECT doc_id, i, ('0x' || h)::INT AS v FROM u)
"""
