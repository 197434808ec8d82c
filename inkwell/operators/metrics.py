"""Evaluation at a fixed false-positive rate, and what belongs to it. Input: a score and a 0/1 label column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.stats import ratio, wilson

INF = float("inf")


#: Ranges of a score in which distinct scores are summed up side by side.
RANGES = 1024


def running(steps: DataFrame, part: list[str], columns: list[str]) -> DataFrame:
    """Add cum_<column>, sums by falling ``score`` over rows of distinct scores. Ranges of the score are summed up side by
    side, and what the higher ranges hold, RANGES rows a part at most, comes on top."""
    span = steps.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    place = F.least(F.lit(RANGES - 1), F.floor(ratio(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * RANGES))
    rows = steps.join(F.broadcast(span)).withColumn("_range", F.coalesce(place, F.lit(0))).drop("_lo", "_hi")  # one row
    above = Window.partitionBy(*part).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*part, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    sums = sums.select(*part, "_range", *(F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy(*part, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *(F.sum(c).over(inside).alias(f"cum_{c}") for c in columns)).join(sums, [*part, "_range"])
    return rows.select(*steps.columns, *((F.col(f"cum_{c}") + F.col(f"_{c}")).alias(f"cum_{c}") for c in columns))


def curve(df: DataFrame, score: str, label: str, by: str | None = None) -> DataFrame:
    """Running positives and negatives by falling score, one row for each distinct score: ties are one step."""
    part = [by] if by else []
    steps = df.groupBy(*part, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    total = steps.groupBy(*part).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    steps = running(steps, part, ["p", "n"])
    return steps.join(total, part) if part else steps.join(F.broadcast(total))  # one row


def operating_point(df: DataFrame, score: str, label: str, max_fpr: float = 0.01) -> DataFrame:
    """(threshold, tpr, fpr): of the ROC vertices within the false-positive rate the highest tpr, then threshold. The
    origin, with an infinite threshold, always qualifies."""
    c = curve(df, score, label)
    v = c.select(F.col("score").alias("threshold"), ratio(F.col("cum_p"), F.col("all_p")).alias("tpr"), ratio(F.col("cum_n"), F.col("all_n")).alias("fpr"))
    origin = df.sparkSession.range(1).select(F.lit(INF).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return v.unionAll(origin).where(F.col("fpr") <= max_fpr).orderBy(F.desc("tpr"), F.desc("threshold")).limit(1)


def auc(df: DataFrame, score: str, label: str, by: str | None = None) -> DataFrame:
    """Chance that a positive outscores a negative, ties half; null with one class alone."""
    part = [by] if by else []
    c = curve(df, score, label, by)
    wins = F.sum(F.col("p") * (F.col("all_n") - F.col("cum_n")) + F.col("p") * F.col("n") * 0.5)
    return c.groupBy(*part).agg(F.try_divide(wins, F.max(F.col("all_p") * F.col("all_n")).cast("double")).alias("auc"))


def brier(score: Column, label: Column) -> Column:
    return F.avg(F.pow(score - label, F.lit(2.0)))


def condition_metrics(df: DataFrame, score: str, label: str, condition: str, negatives: str, threshold: float) -> DataFrame:
    """AUC and tpr at a fixed threshold of each condition's positives, against the negatives of one condition for all."""
    # negatives are summed up once over all scores; each condition's positives look up what is below them
    negative = (F.col(condition) == negatives) & (F.col(label) == 0)
    pos = df.where((F.col(condition) != negatives) & (F.col(label) == 1)).groupBy(condition, F.col(score).alias("score")).agg(F.count("*").alias("p"))
    neg = df.where(negative).select(F.col(score).alias("score"), F.lit(1).cast("long").alias("n")).unionAll(pos.select("score", F.lit(0).cast("long").alias("n")))
    steps = running(neg.groupBy("score").agg(F.sum("n").alias("n")), [], ["n"])
    total = df.agg(F.count_if(negative).alias("all_n"))
    rows = pos.join(steps, "score").join(F.broadcast(total))  # one row
    wins = F.sum(F.col("p") * (F.col("all_n") - F.col("cum_n")) + F.col("p") * F.col("n") * 0.5)
    return rows.groupBy(condition).agg(
        F.sum("p").alias("n_positive"), F.max("all_n").alias("n_negative"), F.try_divide(wins, (F.sum("p") * F.max("all_n")).cast("double")).alias("auc"),
        ratio(F.sum(F.when(F.col("score") >= threshold, F.col("p")).otherwise(0)), F.sum("p")).alias("tpr"),
    )


def bias_audit(df: DataFrame, score: str, group: str, threshold: float, groups: tuple[str, ...] = ("Yes", "No")) -> DataFrame:
    """False-positive rate of negatives by group, with the Wilson interval."""
    rows = df.where(F.col(group).isin(*groups)).groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col(score) >= threshold).alias("flagged"))
    low, high = wilson(F.col("flagged"), F.col("n"))
    return rows.select("grp", "n", "flagged", ratio(F.col("flagged"), F.col("n")).alias("fpr"), low.alias("ci_low"), high.alias("ci_high"))


def confident_failures(df: DataFrame, key: str, score: str, label: str, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """The n wrong rows furthest from one half."""
    wrong = (F.col(score) >= threshold).cast("int") != F.col(label)
    name = lambda c: F.when(c == 0, "human").otherwise("machine")
    rows = df.where(wrong).withColumn("confidence", F.abs(F.col(score) - 0.5)).orderBy(F.desc("confidence"), key).limit(n)
    return rows.select(key, F.col(score).alias("score"), "confidence", name(F.col(label)).alias("truth"))


def degradation(df: DataFrame, key: str, version: str, score: str, attack: str) -> DataFrame:
    """Pivot original and attacked scores, and summarise by attack and over all (``overall``)."""
    wide = df.groupBy(key).pivot(version, ["original", "attacked"]).agg(F.first(score)).join(df.groupBy(key).agg(F.first(attack).alias("attack")), key)
    flipped = (F.col("original") >= 0.5) & (F.col("attacked") < 0.5)
    out = wide.groupingSets([[F.col("attack")], []], F.col("attack")).agg(
        F.grouping("attack").alias("_g"), F.count("*").alias("n"), F.avg("original").alias("mean_original"), F.avg("attacked").alias("mean_attacked"),
        F.avg(F.col("original") - F.col("attacked")).alias("mean_degradation"), F.count_if(flipped).alias("flipped"),
    )
    return out.withColumn("attack", F.when(F.col("_g") == 1, "overall").otherwise(F.col("attack"))).drop("_g")
