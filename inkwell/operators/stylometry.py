"""Stylometric features of documents, native where text suffices and through the annotator where it doesn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.functions.stats import ratio
from inkwell.operators import annotate, textpass
from inkwell.runtime import cut

WINDOW = 50
#: Words of a lexicon that go to all tasks.
MOST_KNOWN = 50_000

STYLOMETRIC = [
    "sent_len_mean", "sent_len_std", "sent_len_burstiness", "mattr", "hapax_rate", "function_word_rate", "pos_trigram_entropy",
    "clause_count_mean", "subordination_ratio_mean", "em_dash_rate", "semicolon_rate", "oxford_comma_rate", "construction_template_rate",
    "discourse_marker_rate", "spelling_error_rate", "homophone_error_rate", "proper_noun_rate", "numeral_rate", "named_entity_rate",
]
LIKELIHOOD = ["mean_logprob", "mean_logrank", "lrr", "mean_entropy", "mean_curvature", "logprob_variance", "cross_ppl_ratio"]
FEATURES = STYLOMETRIC + LIKELIHOOD
NATIVE = ["sent_len_mean", "sent_len_std", "sent_len_burstiness", "mattr", "hapax_rate", "em_dash_rate", "semicolon_rate", "oxford_comma_rate", "discourse_marker_rate", "homophone_error_rate", "numeral_rate"]


def mattr(w: Column, window: int = WINDOW) -> Column:
    """Moving-average type-token ratio over every window of words; the plain ratio of a text no longer than one.

    A word counts in those windows where it is the first of its kind: the windows that hold its place and not the place
    of the same word before it. So one pass over the sorted (word, place) pairs sums up all windows. w must be a column
    of its own, not an expression, which each step would evaluate again."""
    n = F.size(w)
    pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    start = F.struct(F.lit("").alias("w"), F.lit(-1).alias("i"), F.lit(0).cast("long").alias("t"))

    def step(a: Column, x: Column) -> Column:
        before = F.when(a["w"] == x["w"], a["i"]).otherwise(-1)
        held = F.least(x["i"], n - window) - F.greatest(x["i"] - (window - 1), before + 1, F.lit(0)) + 1
        return F.struct(x["w"].alias("w"), x["i"].alias("i"), (a["t"] + F.greatest(held, F.lit(0))).alias("t"))

    moving = F.aggregate(pairs, start, step, lambda a: a["t"]) / (F.lit(float(window)) * (n - window + 1))
    return F.when(n < 2, 0.0).when(n <= window, F.size(F.array_distinct(w)) / n).otherwise(moving)


def hapax_rate(w: Column) -> Column:
    """Types that occur once, for each token, by one pass over the sorted words."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("once"))

    def step(a: Column, x: Column) -> Column:
        same = a["w"] == x
        return F.struct(x.alias("w"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), (a["once"] + F.when(~same & (a["run"] == 1), 1).otherwise(0)).alias("once"))

    once = F.aggregate(F.array_sort(w), start, step, lambda a: a["once"] + F.when(a["run"] == 1, 1).otherwise(0))
    return ratio(once, F.size(w))


def native_features(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Features that need no annotation, in one pass without a shuffle. An empty or null text has zero rates and an
    oxford_comma_rate of -1, which means there is no list."""
    return textpass.each(docs, key, F.col(text), textpass.NATIVE_FIELDS, textpass.native)


def lexicon(docs: DataFrame, text: str, least: int) -> DataFrame:
    """Known words: those in ``least`` documents or more, and in how many (df)."""
    return textpass.document_counts(docs, F.col(text)).where(F.col("df") >= least)


def frequent(known: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """A lexicon, kept, and of those of its words that are in most documents MOST_KNOWN at most, which are settled where a text
    is read. A lexicon without df has none."""
    if "df" not in known.columns:
        return known, frozenset()
    known = cut(known)
    least, n = None, 0
    for r in known.groupBy("df").count().orderBy(F.desc("df")).toLocalIterator():  # a row for each distinct count
        n += r["count"]
        if n > MOST_KNOWN:
            break
        least = r.df
    words = known.where(F.col("df") >= least).select("word").collect() if least is not None else []
    return known.drop("df"), frozenset(r.word for r in words)


def with_spelling(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """rows (key, n_checkable, checked and others) without ``checked`` but with n_unknown and spelling_error_rate: distinct
    unknown words for each checkable one. A document's checked words meet the lexicon one by one; its other columns ride
    along once, under a word of their own, so nothing is computed twice and no row waits for another join. key names a
    document."""
    rest = [c for c in rows.columns if c not in (key, "checked")]
    own = F.struct(F.concat(F.lit("\u0000"), F.col(key).cast("string")).alias("word"), F.struct(*rest).alias("_row"))
    kind = rows.select(own.alias("x")).schema["x"].dataType["_row"].dataType
    each = F.transform("checked", lambda w: F.struct(w.alias("word"), F.lit(None).cast(kind).alias("_row")))
    found = rows.select(key, F.inline(F.concat(F.array(own), each))).join(known.withColumn("_known", F.lit(1)), "word", "left")
    out = found.groupBy(key).agg(F.first("_row", ignorenulls=True).alias("_row"), F.count_if(F.col("_row").isNull() & F.col("_known").isNull()).alias("n_unknown"))
    return out.select(key, "_row.*", "n_unknown").withColumn("spelling_error_rate", ratio(F.col("n_unknown"), F.col("n_checkable")))


def spelling_rate(docs: DataFrame, key: str, known: DataFrame, text: str = "text") -> DataFrame:
    """Spelling by the rules' tags: proper nouns, numbers and single letters aren't checked."""
    known, settled = frequent(known)
    rows = textpass.each(docs, key, F.col(text), textpass.SPELLING_FIELDS, lambda t: textpass.tags(t, True, settled)[-2:])
    return with_spelling(rows, key, known)


def document_features(docs: DataFrame, key: str, known: DataFrame, text: str = "text", tagger: annotate.Tagger | None = None) -> DataFrame:
    """All 19 features: one pass over the texts, and one join with the lexicon of those of their distinct words that its most
    frequent ones don't settle. With a tagger, annotated features are its own and join by the key."""
    known, settled = frequent(known)
    fields = textpass.NATIVE_FIELDS + textpass.TAG_FIELDS + textpass.SPELLING_FIELDS
    rows = textpass.each(docs, key, F.col(text), fields, lambda t: textpass.native(t) + textpass.tags(t, True, settled))
    if tagger is not None:
        rows = rows.drop(*annotate.COLUMNS).join(annotate.annotate_with(docs, key, text, tagger), key)
    rows = with_spelling(rows, key, known)
    per100 = ratio(F.lit(100.0), F.col("n_words"))
    return rows.withColumn("construction_template_rate", F.col("template_rate") + F.col("n_participial") * per100).select(key, "n_sentences", "n_words", *STYLOMETRIC, "n_lists_detected")
