"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import baseline, joins
from inkwell.operators.stylometry import NATIVE, native_features
from inkwell.plans import coverage, evaluation, nativesql, relational, textual
from inkwell.plans import roles as ro
from inkwell.runtime import cut

MODULES = [relational, textual, evaluation, coverage]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts, native stylometric features, band statistics, and z-scores against them."""
    docs = ro.texts(spark, sf_dir).withColumn("text_hash", tx.text_hash(F.col("text")))
    rows = native_features(docs.withColumn("_id", F.struct("doc_id", "text_hash")), "_id").withColumnRenamed("n_words", "word_count")
    # numbers alone go on: of rows with one hash the first stays
    rows = joins.keep_first(rows.select("_id.*", "word_count", *NATIVE), ["text_hash"], ["doc_id"])
    rows = cut(rows)  # read by the statistics and by the scores
    out = baseline.zscore(rows, NATIVE, baseline.baseline_stats(rows, NATIVE))
    return out.select("doc_id", "word_count", *(ro.r6(F.col(c)).alias(c) for n in NATIVE for c in (n, f"{n}_z")))


def queries() -> dict:
    return {"stylometric_zscores": flagship} | {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {"stylometric_zscores": nativesql.FLAGSHIP} | {k: v for m in MODULES for k, v in m.SQL.items()}
