"""Corpus-relative features: band statistics, z-scores, consistency inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.stats import known, length_band
from inkwell.runtime import cut

ALL = "_all"


def baseline_stats(df: DataFrame, columns: list[str], words: str = "word_count") -> DataFrame:
    """(band, <column>__mean, <column>__std, ...): mean and sample deviation by length band, and of all rows as band
    ``_all``, in one aggregate over grouping sets. Missing values and NaN are left out."""
    rows = df.select(length_band(F.col(words)).alias("band"), *(known(F.col(c).cast("double")).alias(c) for c in columns))
    aggs = [f(c).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    out = rows.groupingSets([[F.col("band")], []], F.col("band")).agg(F.grouping("band").alias("_g"), *aggs)
    return out.withColumn("band", F.when(F.col("_g") == 1, ALL).otherwise(F.col("band"))).drop("_g")


def zscore(df: DataFrame, columns: list[str], stats: DataFrame, words: str = "word_count", fallback: str = "pooled") -> DataFrame:
    """Add <column>_z against the row's band. A band without a usable deviation falls back: ``pooled`` to the mean and
    deviation of all rows (1 if that is unusable too), ``unit`` to the mean of all rows and a deviation of 1.

    The statistics are four rows at most and are broadcast."""
    if fallback not in ("pooled", "unit"):
        raise ValueError(f"unknown fallback: {fallback}")
    bands = stats.where(F.col("band") != ALL).withColumnRenamed("band", "_band")
    pooled = stats.where(F.col("band") == ALL).select(*(F.col(f"{c}__{n}").alias(f"_{c}__{n}") for c in columns for n in ("mean", "std")))
    rows = df.withColumn("_band", length_band(F.col(words))).join(F.broadcast(bands), "_band", "left").join(F.broadcast(pooled))  # one row
    out = list(df.columns)
    for c in columns:
        std, mean = known(F.col(f"{c}__std")), F.col(f"{c}__mean")
        usable = std.isNotNull() & (std != 0)
        spare = F.coalesce(F.nullif(known(F.col(f"_{c}__std")), F.lit(0.0)), F.lit(1.0)) if fallback == "pooled" else F.lit(1.0)
        z = (F.col(c) - F.when(usable, mean).otherwise(F.col(f"_{c}__mean"))) / F.when(usable, std).otherwise(spare)
        out.append(z.alias(f"{c}_z"))
    return rows.select(*out)


def consistency(df: DataFrame, columns: list[str], doc: str) -> DataFrame:
    """Add ``consistency``: mean distance of a row's standardised features from its document's medians. Rows are read three
    times, so they are kept: what made them runs once."""
    df = cut(df)
    one = df.agg(*(F.avg(c).alias(f"_{c}_m") for c in columns), *(F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"_{c}_s") for c in columns))
    rows = df.join(F.broadcast(one))  # one row
    for c in columns:
        rows = rows.withColumn(f"_{c}", (F.col(c) - F.col(f"_{c}_m")) / F.col(f"_{c}_s"))
    medians = rows.groupBy(doc).agg(*(F.median(f"_{c}").alias(f"_{c}_d") for c in columns))
    rows = rows.join(medians, doc)
    total = sum((F.abs(F.col(f"_{c}") - F.col(f"_{c}_d")) for c in columns), F.lit(0.0))
    return rows.withColumn("consistency", total / len(columns)).select(*df.columns, "consistency")

