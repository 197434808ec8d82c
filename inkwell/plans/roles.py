"""The library's roles played by the driver's tables, in both engines.

document: documents; generator family: source; topic: lang; human or machine: labels.quality; demographic flag:
labels.toxic; score: a fixed mix of the label and hash digits of the id, in hundredths, so that there are ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import stats as st
from inkwell.operators import textpass
from inkwell.sources.corpora import spread, table

THRESHOLD = 0.45


def r6(c: Column) -> Column:
    return F.round(c, 6)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents for work that is heavy on each text."""
    return spread(docs(spark, d).select("doc_id", "text", "lang", "source"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, source, topic, label, ell) of labelled documents."""
    rows = docs(spark, d).select("doc_id", "text", "source", F.col("lang").alias("topic")).join(labels(spark, d), "doc_id")
    return rows.select("doc_id", "text", "source", "topic", (1 - F.col("quality")).cast("long").alias("label"), F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("ell"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, score, label, ell, source)."""
    rows = corpus(spark, d).select("doc_id", "label", "ell", "source")
    score = F.floor((0.6 * st.hash_unit(7, F.col("doc_id")) + 0.4 * F.col("label")) * 100).cast("double") / F.lit(100.0)
    return rows.select("doc_id", score.alias("score"), "label", "ell", "source")


def features(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, word_count, mattr, mean_word) of every document."""
    rows = texts(spark, d).withColumn("_id", F.struct("doc_id", "lang"))
    rows = textpass.each(rows, "_id", F.col("text"), textpass.WORD_FIELDS, textpass.of_words)
    return rows.select("_id.*", F.col("n_words").alias("word_count"), "mattr", "mean_word")


HASH = r"sha256(lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')))"
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}]+')"
UNIT = "(('0x' || substr(sha256('{1}:' || {0}::VARCHAR), 1, 4))::INTEGER / 65535.0::DOUBLE)"
CORPUS = "corpus AS (SELECT d.doc_id, d.text, d.source, d.lang AS topic, (1 - l.quality)::BIGINT AS label, CASE WHEN l.toxic = 1 THEN 'Yes' ELSE 'No' END AS ell FROM documents d JOIN labels l USING (doc_id))"
SCORED = f"{CORPUS}, scored AS (SELECT doc_id, floor((0.6::DOUBLE * {UNIT.format('doc_id', 7)} + 0.4::DOUBLE * label) * 100)::DOUBLE / 100::DOUBLE AS score, label, ell, source FROM corpus)"
FEATURES = f"""w AS (SELECT doc_id, lang, {WORDS.format('text')} AS w FROM documents),
features AS (SELECT doc_id, lang, len(w)::BIGINT AS word_count,
  CASE WHEN len(w) < 2 THEN 0::DOUBLE WHEN len(w) <= 50 THEN list_unique(w)::DOUBLE / len(w)
    ELSE list_sum(list_transform(range(1, len(w) - 48), lambda i: list_unique(w[i:i + 49])))::DOUBLE / (50.0::DOUBLE * (len(w) - 49)) END AS mattr,
  CASE WHEN len(w) = 0 THEN 0::DOUBLE ELSE length(array_to_string(w, ''))::DOUBLE / len(w) END AS mean_word FROM w),
banded AS (SELECT *, CASE WHEN word_count < 250 THEN 'short' WHEN word_count < 500 THEN 'medium' ELSE 'long' END AS band FROM features)"""
SENTENCES = r"""raw AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sent FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS l FROM documents)),
sentences AS (SELECT doc_id, sent, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM raw WHERE regexp_replace(s, '^\s+|\s+$', '', 'g') <> '')"""
