"""Seeded samples of exact size. The order is a hash of seed and key, so a sample is the same in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import stats as st

SEED = 42
#: Parts in which a stratum is ranked side by side before its own rank.
SALTS = 64
#: Ranges of the hash in which rows are numbered side by side (three hex digits of it).
RANGES = 16**3


def uniform(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows at most. A top-n by hash: each task keeps n, no global sort."""
    return df.withColumn("_h", st.hash_order(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def ranked(df: DataFrame, by: list[str], key: str, seed: int, most: Column) -> DataFrame:
    """Add rn, the place by hash inside each stratum, of the rows up to ``most`` (a column of the stratum). Parts of a
    stratum are ranked first and cut, so that no task sorts a whole stratum."""
    df = df.withColumn("_h", st.hash_order(seed, F.col(key))).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    part = Window.partitionBy(*by, "_salt").orderBy("_h", key)
    few = df.withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= most)
    whole = Window.partitionBy(*by).orderBy("_h", key)
    return few.withColumn("rn", F.row_number().over(whole)).where(F.col("rn") <= most).drop("_h", "_salt")


def balanced(df: DataFrame, key: str, flag: str, n: int, seed: int = SEED) -> DataFrame:
    """Half Yes and half No; too few Yes are made up with No, but not the other way round."""
    have = df.where(F.col(flag).isin("Yes", "No")).groupBy(flag).count()
    yes = F.coalesce(F.max(F.when(F.col(flag) == "Yes", F.col("count"))), F.lit(0))
    quota = have.agg(F.least(yes, F.lit(n // 2)).alias("_yes"))
    rows = df.where(F.col(flag).isin("Yes", "No")).join(F.broadcast(quota))  # one row
    rows = rows.withColumn("_most", F.when(F.col(flag) == "Yes", F.col("_yes")).otherwise(n - F.col("_yes")))
    return ranked(rows, [flag], key, seed, F.col("_most")).drop("rn", "_yes", "_most")


def stratified(df: DataFrame, key: str, topic: str, share: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Per topic the quota round-half-even(share * n) or what there is; topics without a share go, nothing is
    redistributed, and a sum beyond n is trimmed by hash. share: (topic, share)."""
    quota = share.select(F.col("topic").alias(topic), F.rint(F.col("share") * n).cast("long").alias("_quota")).where("_quota > 0")
    rows = ranked(df.join(quota, topic), [topic], key, seed, F.col("_quota")).drop("rn", "_quota")
    return uniform(rows, key, n, seed).select(*df.columns)


def split_humans(df: DataFrame, key: str, flag: str, baseline_n: int, training_n: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A uniform baseline pool, and a balanced training pool from the rest."""
    baseline = uniform(df, key, baseline_n, seed)
    rest = df.join(baseline.select(key), key, "left_anti").select(*df.columns)
    return baseline, balanced(rest, key, flag, training_n, seed)


def split_machines(df: DataFrame, key: str, topic: str, source: str, share: DataFrame, *, held_out: str, excluded: list[str], training_n: int, heldout_n: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Stratified pools of trainable families and of the held-out family. Rows without a family count as trainable."""
    name = F.coalesce(F.col(source), F.lit(""))
    machine = df.where((F.col("label") == 1) & ~name.isin(excluded))
    return stratified(machine.where(name != held_out), key, topic, share, training_n, seed), stratified(machine.where(name == held_out), key, topic, share, heldout_n, seed)


def train_test(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add split: round(test_size * n) rows of each label, first by hash, are test."""
    most = df.groupBy(label).agg(F.rint(F.count("*") * test_size).cast("long").alias("_most"))
    test = ranked(df.select(key, label).join(F.broadcast(most), label), [label], key, seed, F.col("_most")).select(key, F.lit("test").alias("split"))
    return df.join(test, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def numbered(df: DataFrame, key: str, name: str, by: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """Add the place in hash order, gapless from 0, of all rows or of those of each stratum. Rows are numbered inside ranges
    of the hash, side by side, and the ranges' counts, a table of RANGES rows a stratum, are summed up before them."""
    by = by or []
    rows = df.withColumn("_h", st.hash_order(seed, F.col(key))).withColumn("_range", F.substring("_h", 1, 3))
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_range").orderBy("_h", key)
    rows = rows.withColumn("_at", F.row_number().over(inside) - 1)
    return rows.join(starts, [*by, "_range"]).withColumn(name, F.col("_start") + F.col("_at")).select(*df.columns, name)


def balanced_labels(df: DataFrame, key: str, labels: list[str], name: str, seed: int = SEED) -> DataFrame:
    """Each label as often as any other, give or take one, in hash order."""
    rows = numbered(df, key, "_place", seed=seed)
    return rows.withColumn(name, F.element_at(F.array(*map(F.lit, labels)), (F.pmod("_place", F.lit(len(labels))) + 1).cast("int"))).drop("_place")


def tercile(place: Column, n: Column) -> Column:
    """0, 1 or 2 of a place among n; thirds are n // 3 long and the last takes the remainder. -1 with three or fewer."""
    third = F.floor(n / 3)
    return F.when(n <= 3, -1).when(place < third, 0).when(place < 2 * third, 1).otherwise(2).cast("int")


def sample_sentences(sentences: DataFrame, doc: str, place: str, seed: int = SEED) -> DataFrame:
    """Of each document all sentences if there are three or fewer, else one from each third, first by hash."""
    w = Window.partitionBy(doc)
    rows = sentences.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(place)) - 1)
    rows = rows.withColumn("tercile", tercile(F.col("_at"), F.col("_n")))
    first = Window.partitionBy(doc, "tercile").orderBy(st.hash_order(seed, F.concat_ws(":", F.col(doc).cast("string"), F.col(place).cast("string"))))
    return rows.withColumn("_r", F.row_number().over(first)).where((F.col("tercile") == -1) | (F.col("_r") == 1)).drop("_n", "_at", "_r")


def exemplar(df: DataFrame, key: str, topic: str, wanted: str, seed: int = SEED) -> DataFrame:
    """One row on the topic, or on any if it has none."""
    return df.withColumn("_other", (F.coalesce(F.col(topic), F.lit("")) != wanted).cast("int")).withColumn("_h", st.hash_order(seed, F.col(key))).orderBy("_other", "_h", key).limit(1).drop("_other", "_h")
