"""From raw documents to token files, in five stages.

Each stage takes (spark, documents, folder of tables) and works on all that
the stage before it kept; its result is written as Parquet and read again.
All stages but the last return the columns of ``documents``.

1. ``quality``: documents that the rule ensemble scores under 0.5 go.
2. ``near_duplicates``: one document of each group stays: SimHash blocks
   propose pairs, a similarity of 0.8 or more of their five-word shingles links.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``mixing``: sources weighted by the square roots of what is left of them, so
   that small ones come up more often; all rows stay and are written in the order
   of the mix.
5. ``tokens``: token files in that order, read back: one row per document.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontamination, mixing, quality, similar, token_files
from rasterloom.llm._base import shared_dir
from rasterloom.llm.queries import held_out, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.5 or more; the model learns from labels not held out."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~held_out(labels["doc_id"])))
    return quality.accepted(docs, model, 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return similar.representatives(docs, width=5, similarity=0.8)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def interleaved(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted by the slots of a mix of the sources."""
    mix = mixing.mixed(docs, F.sqrt(F.col("bytes").cast("double")), prefix="_out_")
    return mix.orderBy("_out_slot", "_out_at_byte", "doc_id").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the documents are stored, read back."""
    part = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).try_cast("long")
    order = [part, F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:  # not read from files: they have no stored order
        order = None
    shards = token_files.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), order=order)
    return token_files.read_back(shards)


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("decontamination", not_contaminated), ("mixing", interleaved), ("tokens", tokens)]

#: The model of the first stage is learnt and the last one's ids are the tokenizer's: not in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
