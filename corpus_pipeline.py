"""From documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; `run` writes each result as Parquet below
the shared checkpoint folder and reads it again, so every stage starts from a table. All but the last return documents' columns.

Null texts count as empty; empty and blank texts go with the first stage where the scorer rejects them. Long texts count whole in
every stage. Rows that repeat an id and a text become one in the second stage; rows that repeat an id with other texts stay apart
there, and go together in the third. Rows with a null id are documents like others. Columns beside doc_id, text and source are
carried along under any name. An empty table gives no rows and no error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm._common import ensure_checkpoint_dir, own_checkpoints, remove
from frameloom.llm.exact import drop_exact
from frameloom.llm.mixing import REPEAT, mix
from frameloom.llm.neardup import drop_near
from frameloom.llm.packing import pack
from frameloom.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles the smallest doc_id stays."""
    return drop_near(docs, words=5, hundredths=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at least once and at most REPEAT times, so small sources gain weight and no document is lost."""
    return mix(docs, max_repeat=REPEAT)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and the offset where they go."""
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]
#: Trained weights and hashes cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last stage's table. What a stage has read, and what it has checkpointed, goes
    once its own result is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{spark.sql('select uuid()').first()[0]}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with own_checkpoints(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
