"""A corpus from raw documents to packed sequences: each stage is written as Parquet and read again by the next.

toxicity drops the documents that the factorization machine marks; line dedup drops boilerplate lines of a source, of
which exact and near copies of one text are one page, as they are not dropped yet;
SimHash near-dedup keeps one document of each group; mixing takes documents, up to twice, to the sources' targets, in the
order of its schedule; best-fit packing gives the pieces of the training sequences.

A stage's table in the shared folder is removed when the next stage has been written; the last one is the result's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import line_dedup, mixing, packing, simhash, toxicity
from barloom.llm.common import fresh, read, remove, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    done = line_dedup.line_dedup(docs, "text", "source", copies_once=True, counts=(n_lines, n_dropped))
    if "n_chars" in docs.columns:
        shorter = F.when(F.col(n_dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", shorter)
    return done.drop(n_lines, n_dropped)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies), ("mixing", mix_sources), ("best_fit_packing", pack_sequences)]

#: The model, XXH64 fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents in sf_dir."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
