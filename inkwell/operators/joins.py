"""Relational operators of the corpus build: keep-first, hash join, lookups, anti and semi joins, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx

#: Gates of the corpus build.
MIN_MATCH_RATE, MIN_USABLE_ELL, MAX_TOPIC_GAP = 0.80, 200, 5.0


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, so copies are folded before the shuffle and no key is a hot window."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def hash_join(left: DataFrame, right: DataFrame, *, left_text: str, right_text: str, right_order: list[str], suffix: str = "_persuade") -> DataFrame:
    """Inner join on normalized-text hashes; of right rows with one hash the first counts, so nothing fans out.
    Right columns whose names clash get the suffix."""
    one = left.withColumn("text_hash", tx.text_hash(F.col(left_text)))
    two = keep_first(right.withColumn("text_hash", tx.text_hash(F.col(right_text))), ["text_hash"], right_order)
    two = two.select("text_hash", *(F.col(c).alias(c + suffix if c in one.columns else c) for c in two.columns if c != "text_hash"))
    return one.join(two, "text_hash")


def match_report(left: DataFrame, right: DataFrame, *, left_text: str, right_text: str, ell: str) -> DataFrame:
    """One row: sizes, matches, match rate, and matched rows by flag. Blank and missing flags are unknown, never No."""
    flags = keep_first(right.select(tx.text_hash(F.col(right_text)).alias("h"), F.col(ell).alias("ell")).withColumn("o", F.coalesce("ell", F.lit(""))), ["h"], ["o"])
    one = left.select(tx.text_hash(F.col(left_text)).alias("h")).join(flags.select("h", tx.strip(F.coalesce("ell", F.lit(""))).alias("ell"), F.lit(True).alias("hit")), "h", "left")
    hit = F.coalesce("hit", F.lit(False))
    n = one.agg(F.count("*").alias("left_rows"), F.count_if(hit).alias("matched"), F.count_if(hit & (F.col("ell") == "Yes")).alias("ell_yes"), F.count_if(hit & (F.col("ell") == "No")).alias("ell_no"))
    rate = F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("left_rows").cast("double")), F.lit(0.0))
    return n.select("left_rows", "matched", rate.alias("match_rate"), "ell_yes", "ell_no", (F.col("matched") - F.col("ell_yes") - F.col("ell_no")).alias("ell_unknown"), (F.col("ell_yes") < MIN_USABLE_ELL).alias("recommend_more"))


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Left lookup in a table that is unique by key; the default where there is none. Catalyst picks the side by its size."""
    return left.join(right.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def remaining(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Targets whose key isn't done yet."""
    return targets.join(done.select(key), key, "left_anti")


def members(df: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table has."""
    return df.join(of.select(key), key, "left_semi")


def fetch_strict(ids: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Inner lookup that fails on a missing key while it runs, without a second pass."""
    found = ids.join(texts.withColumn("_there", F.lit(True)), key, "left")
    ok = F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no text for "), F.col(key).cast("string"))).cast("boolean"))
    return found.where(ok).drop("_there")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that aren't unique; empty if the constraint holds."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    if not (bad := duplicates(df, key).limit(1)).isEmpty():
        raise ValueError(f"{key} isn't unique: {bad.first()[0]!r}")
    return df


def topic_share(df: DataFrame, topic: str) -> DataFrame:
    """Share of each topic among rows that have one."""
    n = df.where(F.col(topic).isNotNull()).groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("topic", "n", (F.col("n") / F.col("total").cast("double")).alias("share"))  # one row


def topic_gap(df: DataFrame, author: str, topic: str) -> DataFrame:
    """Percentage of each topic by author type, both sides' topics, and the gap; a missing side is 0. Largest gap first."""
    n = df.where(F.col(topic).isNotNull()).groupBy(F.col(topic).alias("topic")).agg(*(F.count_if(F.col(author) == a).alias(a) for a in ("human", "machine")))
    total = n.agg(F.sum("human").alias("h"), F.sum("machine").alias("m"))
    pct = lambda a, t: F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(t).cast("double")), F.lit(0.0))
    out = n.where("human + machine > 0").join(F.broadcast(total)).select("topic", pct("human", "h").alias("human_pct"), pct("machine", "m").alias("machine_pct"))
    return out.withColumn("gap", F.abs(F.col("human_pct") - F.col("machine_pct"))).orderBy(F.desc("gap"), "topic")


def gate(report: DataFrame, ok: Column) -> int:
    """Exit code of a quality gate over a one-row report: 0 if it holds, else 1."""
    return 0 if report.select(ok.alias("ok")).first().ok else 1


def union_pools(pools: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of pools, each marked by its name."""
    out = None
    for name, df in pools.items():
        df = df.withColumn("pool", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def union_first(pools: dict[str, DataFrame], key: str) -> DataFrame:
    """UNION ALL of pools, of which each key keeps the row of the first pool that has it, marked by that pool's name. A pool's
    own rows must be unique by key."""
    order = F.array_position(F.array(*map(F.lit, pools)), F.col("pool"))
    rows = union_pools(pools).withColumn("_order", order)
    return keep_first(rows, [key], ["_order"]).drop("_order")
