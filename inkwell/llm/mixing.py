"""Soft-membership mixing, with DataFrame functions only: domain posteriors, and document rates that meet target weights."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut, documents

logger = logging.getLogger(__name__)

#: Labelled documents that the classifier is fitted on, at most (those first in hash order), and its vocabulary.
MOST_LABELLED, VOCABULARY = 20_000, 512
#: Domains with memberships of their own, the most frequent; all others are together one more domain, OTHER.
MOST_DOMAINS, OTHER = 63, "(other)"
#: A text's mean log-likelihood counts as this many words of evidence, which keeps memberships soft whatever its length.
EVIDENCE = 20.0
#: Default targets are the domains' shares to this power, made to sum to one.
TEMPERATURE = 0.7
#: Rounds of the fit at most, and the share of all tokens by which it may still be off. A fit that ends before it is that
#: close says so.
ROUNDS, CLOSE = 200, 1e-5
#: Rounds after which the rates are written down, so that their expression, and with it the driver's plans, stay small.
CUT_AFTER = 5
#: Stands at the end of every text, so that texts without a known word stay.
END = "\u0000"


def key_of(docs: DataFrame) -> Column:
    """One key for rows of equal id and text."""
    return F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"].cast("string"), F.lit("")))


def words_of(text: Column) -> Column:
    """Words in lower case between runs of ASCII white space; one empty string of a text without any."""
    return F.split(F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def fit_classifier(docs: DataFrame, labels: DataFrame, domain_col: str) -> tuple[list[str], DataFrame]:
    """Naive Bayes over the most frequent words of labelled documents: the domains, most frequent first, and the table
    (word, mark, l0, l1, ...) of log-probabilities, of VOCABULARY rows and one for END that holds the log-priors' parts."""
    few = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    sample = docs.select("doc_id", docs[domain_col].cast("string").alias("domain"), "text").where("domain is not null").join(F.broadcast(few), "doc_id")
    domains = [r.domain for r in sample.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(MOST_DOMAINS + 1).collect()]
    held = sample
    if len(domains) > MOST_DOMAINS:
        domains = domains[:MOST_DOMAINS]
        held = sample.withColumn("domain", F.when(F.col("domain").isin(domains), F.col("domain")).otherwise(OTHER))
        domains.append(OTHER)
    words = held.select("domain", F.explode(F.concat(words_of(F.col("text")), F.array(F.lit(END)))).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n"), *(F.sum(F.when(F.col("domain") == d, 1.0).otherwise(0.0)).alias(f"c{k}") for k, d in enumerate(domains)))
    top = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(VOCABULARY).unionAll(counts.where(F.col("word") == END))
    top = cut(top)
    ks = range(len(domains))
    sums = top.where(F.col("word") != END).agg(F.count("*").alias("size"), *(F.sum(f"c{k}").alias(f"c{k}") for k in ks)).first()
    logs = [F.log((F.col(f"c{k}") + 1) / F.lit(float((sums[f"c{k}"] or 0.0) + max(sums["size"], 1)))) for k in ks]
    # END's counts are documents: its row holds the log-priors
    n = total([F.col(f"c{k}") for k in ks])
    priors = [F.log((F.col(f"c{k}") + 1) / (n + len(domains))) for k in ks]
    marked = F.col("word") == END
    return domains, top.select("word", marked.cast("int").alias("mark"), *(F.when(marked, p).otherwise(x).alias(f"l{k}") for k, (p, x) in enumerate(zip(priors, logs))))


def memberships(docs: DataFrame, domains: list[str], table: DataFrame) -> DataFrame:
    """(key, n_tokens, copies, p0, p1, ...): posteriors of every distinct row, for all of its text. The classifier's table
    is broadcast, its size is fixed; words are summed by row before anything is shuffled."""
    rows = docs.select(key_of(docs).alias("key"), words_of(docs["text"]).alias("words"))
    rows = rows.select("key", F.when(F.col("words")[0] == "", 0).otherwise(F.size("words")).cast("long").alias("n_tokens"), F.concat("words", F.array(F.lit(END))).alias("words"))
    hits = rows.select("key", "n_tokens", F.explode("words").alias("word")).join(F.broadcast(table), "word")
    ks = range(len(domains))
    sums = [F.sum(F.when(F.col("mark") == 0, F.col(f"l{k}")).otherwise(0.0)).alias(f"s{k}") for k in ks] + [F.max(F.when(F.col("mark") == 1, F.col(f"l{k}"))).alias(f"b{k}") for k in ks]
    found = hits.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"), F.sum("mark").alias("copies"), F.count_if(F.col("mark") == 0).alias("m"), *sums)
    logit = [F.col(f"b{k}") + EVIDENCE * F.col(f"s{k}") / F.greatest("m", F.lit(1)) for k in ks]
    most = F.greatest(*logit) if len(domains) > 1 else logit[0]
    found = found.select("key", "n_tokens", "copies", *(F.exp(x - most).alias(f"e{k}") for k, x in enumerate(logit)))
    return found.select("key", "n_tokens", "copies", *(F.col(f"e{k}") / total([F.col(f"e{j}") for j in ks]) for k in ks)).toDF("key", "n_tokens", "copies", *(f"p{k}" for k in ks))


def fit_rates(found: DataFrame, domains: list[str], targets: dict[str, float] | None, least: float, tokens: float | None) -> DataFrame:
    """found and its column ``rate``: projected-gradient least squares on the domains' relative errors.

    Each round one aggregate gives the expected tokens of each domain under the present rates, and the rates move down
    the gradient (scaled by document length and domain size, so a step of one can't overshoot) and back to ``least`` or
    more. Only one number for each domain comes to the driver.
    """
    ks = range(len(domains))
    expected = lambda found, rate: [x or 0.0 for x in found.agg(*(F.sum(F.col("n_tokens") * F.col("copies") * rate * F.col(f"p{k}")) for k in ks)).first()]
    rate = F.lit(1.0)
    now = natural = expected(found, rate)
    everything = sum(natural)
    if not everything:
        return found.withColumn("rate", F.greatest(rate, F.lit(float(least))))
    if targets is None:
        flat = [(x / everything) ** TEMPERATURE if x else 0.0 for x in natural]
    else:
        if lost := sorted(set(targets) - set(domains)):
            raise ValueError(f"no labelled document, or no domain of its own, for the targets {lost}; there are {domains}")
        flat = [max(0.0, float(targets.get(d, 0.0))) for d in domains]
    share = [x / (sum(flat) or 1.0) for x in flat]
    if tokens is None:
        tokens = everything if least < 1 else least * max((n / w for n, w in zip(natural, share) if w), default=everything)
    goal = [w * tokens for w in share]
    for turn in range(ROUNDS):
        slope = [(a - g) / n if n else 0.0 for a, g, n in zip(now, goal, natural)]
        if sum(abs(a - g) for a, g in zip(now, goal)) <= CLOSE * tokens:
            break
        rate = F.greatest(F.lit(float(least)), rate - total([F.col(f"p{k}") * F.lit(slope[k]) for k in ks]))
        if turn % CUT_AFTER == CUT_AFTER - 1:
            found, rate = cut(found.withColumn("rate", rate)), F.col("rate")
        now = expected(found, rate)
    if (off := sum(abs(a - g) for a, g in zip(now, goal))) > CLOSE * tokens:
        logger.warning("the mixture is off by %.3g of %.3g tokens: %s instead of %s", off, tokens, dict(zip(domains, now)), dict(zip(domains, goal)))
    return found.withColumn("rate", rate)


def mix(docs: DataFrame, labels: DataFrame, *, domain_col: str = "lang", targets: dict[str, float] | None = None, least: float = 0.0, tokens: float | None = None) -> DataFrame:
    """(key, n_tokens, domain, posterior, rate) of every distinct row of id and text.

    A classifier learns the domains (the values of ``domain_col``; beyond MOST_DOMAINS the rarer ones count as one, OTHER)
    from documents of the labelled table and gives every document a posterior over them. Rates, ``least`` or more, are fitted by least squares so that
    the expected tokens of each domain meet ``targets`` (weights; by default tempered shares) of ``tokens`` (by default
    all there are, or with a ``least`` of one or more the fewest that can meet the targets).

    Null texts are empty: no tokens, memberships by the priors alone. Null domains teach nothing. Rows that repeat count
    as often as they occur and get one rate. Without any labelled document all rates are 1 and the domain is null.
    """
    domains, table = fit_classifier(docs, labels, domain_col)
    if not domains:
        return docs.select(key_of(docs).alias("key"), F.when(words_of(docs["text"])[0] == "", 0).otherwise(F.size(words_of(docs["text"]))).cast("long").alias("n_tokens")).distinct().select("key", "n_tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), F.lit(1.0).alias("rate"))
    found = cut(memberships(docs, domains, table))
    found = fit_rates(found, domains, targets, least, tokens)
    best = F.greatest(*(F.col(f"p{k}") for k in range(len(domains)))) if len(domains) > 1 else F.col("p0")
    name = F.coalesce(*(F.when(F.col(f"p{k}") == best, F.lit(d)) for k, d in enumerate(domains)))
    return found.select("key", "n_tokens", name.alias("domain"), best.alias("posterior"), "rate")


def with_rates(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate), one row for each input row."""
    rates = mix(docs, labels, **how)
    return docs.select("doc_id", key_of(docs).alias("key")).join(rates, "key").drop("key")


def repeat_to_rates(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The mixture itself: each row as often as its rate says, the fraction settled by a hash of the row. All columns stay."""
    rates = mix(docs, labels, **how).select("key", "rate")
    luck = F.pmod(F.xxhash64("key", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), key_of(docs).alias("key")).join(rates, "key")
    rows = rows.withColumn("n", F.floor(F.col("rate") + luck).cast("int")).where("n > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).select("row.*")


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
