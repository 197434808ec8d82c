"""Corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontam, mixing, sharding, simhash, toxicity
from inkwell.runtime import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts to be toxic go. Null and empty texts are judged by the share of toxic
    examples, rows that repeat each by itself, so copies share one fate; null ids make no difference."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, carry=True).where(F.col("predicted") == 0).select("_row.*")


#: Near copies: five-word shingles, a similarity of 0.8 or more. Candidates come from fingerprints of the distinct words,
#: which an edit changes in one place where it changes five shingles.
NEAR = {"width": 1, "distinct": True, "bits": 7, "verify": (5, 0.8)}


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays. Rows that share an id but not the text are
    judged apart; of rows equal in both one stays; null ids come last; empty and null texts are copies of each other."""
    return simhash.drop_near_duplicates(docs, **NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null and empty texts hold none and stay; rows that repeat share
    one fate; null ids make no difference; an empty benchmark leaves all."""
    marked = decontam.mark_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True, min_items=1)
    return marked.where(~F.col("contaminated")).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document goes; those of domains below their target weight are repeated as often as their rate says. Null and
    empty texts weigh nothing and follow the rate of their membership; rows equal in id and text share a rate; without
    labelled documents every row stays as it is."""
    return mixing.repeat_to_rates(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), least=1.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row, those of null ids, null and empty texts and of rows that repeat among them."""
    return sharding.shard_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: The stages score with fitted models, so SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written to the shared folder and read back by the next, and
    go once the next has written its own."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        before, path = path, f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return STAGES[-1][1](spark, docs, sf_dir)
