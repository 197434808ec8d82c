"""Scans with declared schemas. CSV is read once, given a row number, and written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "text string, label long, prompt_name string, source string, RDizzl3_seven boolean"
DEMOGRAPHICS = (
    "essay_id_comp string, full_text string, holistic_essay_score long, word_count long, prompt_name string, task string, assignment string, source_text string, "
    "gender string, grade_level long, ell_status string, race_ethnicity string, economically_disadvantaged string, student_disability_status string"
)
#: Texts that stand for a missing value in the second corpus.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted fields with line breaks and doubled quotes. Malformed rows fail."""
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", encoding="UTF-8").csv(path)


def with_row_number(df: DataFrame, name: str = "row_ord") -> DataFrame:
    """Add the row's place, gapless from 0, in the order of the files. Counts of the partitions come first (one small
    table), and each partition numbers its rows by itself."""
    rows = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    starts, first = [], 0
    for r in sizes:
        starts.append((r._part, first))
        first += r["count"]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    table = df.sparkSession.createDataFrame(starts, "_part long, _first long")  # a row for each partition
    rows = rows.withColumn("_part", part).join(F.broadcast(table), "_part")
    return rows.withColumn(name, F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return with_row_number(read_csv(spark, path, CORPUS))


def load_demographics(spark: SparkSession, path: str) -> DataFrame:
    df = with_row_number(read_csv(spark, path, DEMOGRAPHICS))
    return df.withColumns({c: F.when(~F.col(c).isin(MISSING), F.col(c)) for c, kind in df.dtypes if kind == "string"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew if the files give fewer partitions than there are cores (a single small file, say), for work that
    is heavy on each row. Larger inputs stay as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
