"""Likelihood features: an n-gram scorer that fills the token-score contract, and the aggregates over it.

Contract: one row for each scored token, (doc, sent, tok, lp_base, rank_base, ent_base, lp_alt): natural-log probability,
1 + number of strictly likelier next words, entropy of the next word, and the log probability of a second model. A neural
scorer fills the same table through ``score_paragraphs``, or ``score_with`` for sentences that come one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as tx
from inkwell.functions.stats import ratio
from inkwell.operators import segment
from inkwell.runtime import ship

CONTRACT = "doc_id string, paragraph_index int, sentence_index int, tok int, lp_base double, rank_base long, ent_base double, lp_alt double, error string"


def bigrams(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent, tok, prev, word) of every word of a sentence but its first."""
    s = docs.select(key, F.posexplode(tx.sentences(F.coalesce(F.col(text), F.lit("")))).alias("sent", "_s")).where("_s <> ''")
    w = s.select(key, "sent", tx.alpha_words(F.col("_s")).alias("_w"))
    pairs = F.transform(F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), lambda x, i: F.struct(F.get("_w", i).alias("prev"), x.alias("word")))
    return w.select(key, "sent", F.posexplode(pairs).alias("tok", "_p")).select(key, "sent", (F.col("tok") + 1).alias("tok"), "_p.prev", "_p.word")


def sentence_bigrams(sentences: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, tok, prev, word) of given sentences, each named by the columns ``by``."""
    w = sentences.select(*by, tx.alpha_words(F.col(text)).alias("_w"))
    pairs = F.transform(F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), lambda x, i: F.struct(F.get("_w", i).alias("prev"), x.alias("word")))
    return w.select(*by, F.posexplode(pairs).alias("tok", "_p")).select(*by, (F.col("tok") + 1).alias("tok"), "_p.prev", "_p.word")


def train_bigram(grams: DataFrame) -> DataFrame:
    """Add-one bigram model: (prev, word, n, prev_n, types, likelier, entropy) for seen pairs. ``likelier`` counts the
    pair's context mates with more occurrences; ``types`` is the vocabulary's size. Ranks are counted over distinct
    counts, (context, n, how many), so no context's words are sorted in one task."""
    pairs = grams.groupBy("prev", "word").agg(F.count("*").alias("n"))
    types = grams.agg(F.count_distinct("word").alias("types"))
    levels = pairs.groupBy("prev", "n").agg(F.count("*").alias("_m"))
    above = Window.partitionBy("prev").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("likelier", F.coalesce(F.sum("_m").over(above), F.lit(0)))
    contexts = levels.join(F.broadcast(types)).groupBy("prev", "types").agg(F.sum(F.col("n") * F.col("_m")).alias("prev_n"), F.sum("_m").alias("_seen"), F.collect_list(F.struct("n", "_m")).alias("_levels"))  # one row; levels are few: distinct counts
    bottom = F.col("prev_n") + F.col("types")
    seen = F.aggregate("_levels", F.lit(0.0), lambda a, x: a - x["_m"] * ((x["n"] + 1) / bottom) * F.ln((x["n"] + 1) / bottom))
    rest = (F.col("types") - F.col("_seen")) * (F.lit(1.0) / bottom) * F.ln(bottom.cast("double"))
    contexts = contexts.select("prev", "types", "prev_n", "_seen", (seen + rest).alias("entropy"))
    return pairs.join(levels.drop("_m"), ["prev", "n"]).join(contexts, "prev").select("prev", "word", "n", "prev_n", "types", "likelier", "_seen", "entropy")


def score_tokens(grams: DataFrame, base: DataFrame, alt: DataFrame, *by: str) -> DataFrame:
    """The contract table by two bigram models. Pairs a model hasn't seen get the add-one probability of their context."""
    pairs = grams.groupBy("prev", "word").agg(F.count("*").alias("_c")).drop("_c")

    def looked_up(model: DataFrame, name: str) -> DataFrame:
        contexts = model.select("prev", "prev_n", "_seen", "entropy").distinct()
        types = model.agg(F.max("types").alias("types"))
        rows = pairs.join(model.select("prev", "word", "n", "likelier"), ["prev", "word"], "left").join(contexts, "prev", "left").join(F.broadcast(types))  # one row
        n, total = F.coalesce("n", F.lit(0)), F.coalesce("prev_n", F.lit(0)) + F.col("types")
        lp = F.ln((n + 1) / total.cast("double"))
        rank = 1 + F.coalesce("likelier", "_seen", F.lit(0))
        entropy = F.coalesce("entropy", F.ln(F.col("types").cast("double")))
        return rows.select("prev", "word", lp.alias(f"lp_{name}"), rank.alias(f"rank_{name}"), entropy.alias(f"ent_{name}"))

    scores = looked_up(base, "base").join(looked_up(alt, "alt").select("prev", "word", "lp_alt"), ["prev", "word"])
    return grams.join(scores, ["prev", "word"]).select(*(by if len(by) > 1 else (*by, "sent")), "tok", "lp_base", "rank_base", "ent_base", "lp_alt")


def score_corpus(grams: DataFrame, in_alt: Column, key: str) -> DataFrame:
    """The contract table of a corpus under the bigram model of all of it (base) and of the part where ``in_alt`` holds
    (alt): as ``score_tokens`` gives it, with both models counted in one aggregate. Ranks and entropies come from distinct
    counts, (context, n, how many), so no context's words are sorted in one task, and joins on a common context can be
    split as they run."""
    pairs = grams.groupBy("prev", "word").agg(F.count("*").alias("n"), F.count_if(in_alt).alias("m"))
    words = pairs.groupBy("word").agg(F.max("m").alias("m"))
    types = words.agg(F.count("*").alias("v"), F.count_if(F.col("m") > 0).alias("w"))
    levels = pairs.groupBy("prev", "n").agg(F.count("*").alias("_c"), F.sum("m").alias("_m"))
    above = Window.partitionBy("prev").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.select("prev", "n", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("likelier"))
    total = levels.groupBy("prev").agg(F.sum(F.col("n") * F.col("_c")).alias("_n"), F.sum("_m").alias("_alt"), F.sum("_c").alias("_seen"), F.sum(F.col("_c") * (F.col("n") + 1) * F.ln((F.col("n") + 1).cast("double"))).alias("_x"), F.sum(F.col("_c") * (F.col("n") + 1)).alias("_mass"))
    total = total.join(F.broadcast(types)).withColumn("all", (F.col("_n") + F.col("v")).cast("double"))  # one row
    # minus the sum of p ln p, p = (n + 1) / all, with the unseen words' one in all
    entropy = (F.col("_mass") * F.ln("all") - F.col("_x")) / F.col("all") + (F.col("v") - F.col("_seen")) / F.col("all") * F.ln("all")
    total = total.select("prev", "all", (F.col("_alt") + F.col("w")).cast("double").alias("alt"), entropy.alias("ent_base"))
    rows = pairs.join(ranks, ["prev", "n"]).join(total, "prev")
    scores = rows.select("prev", "word", F.ln((F.col("n") + 1) / F.col("all")).alias("lp_base"), (F.col("likelier") + 1).alias("rank_base"), "ent_base", F.ln((F.col("m") + 1) / F.col("alt")).alias("lp_alt"))
    return grams.join(scores, ["prev", "word"]).select(key, "sent", "tok", "lp_base", "rank_base", "ent_base", "lp_alt")


def sentence_features(tokens: DataFrame, by: list[str]) -> DataFrame:
    """The seven likelihood features of each sentence with a scored token."""
    lp, rank = F.avg("lp_base"), F.avg(F.ln(F.col("rank_base").cast("double")))
    out = tokens.groupBy(*by).agg(
        F.count("*").alias("n_tokens"), lp.alias("mean_logprob"), rank.alias("mean_logrank"), F.avg("ent_base").alias("mean_entropy"),
        F.avg(F.col("lp_base") + F.col("ent_base")).alias("mean_curvature"), F.var_pop("lp_base").alias("logprob_variance"),
        F.exp(F.avg("lp_alt") - F.avg("lp_base")).alias("_cross"),
    )
    lrr = F.when(F.col("mean_logrank") == 0, 0.0).otherwise(ratio(F.col("mean_logprob"), F.col("mean_logrank")))
    return out.withColumn("lrr", lrr).withColumn("cross_ppl_ratio", F.coalesce(F.nullif("_cross", F.lit(0.0)), F.lit(1.0))).drop("_cross")


def document_means(sentences: DataFrame, key: str) -> DataFrame:
    from inkwell.operators.stylometry import LIKELIHOOD

    return sentences.groupBy(key).agg(*(F.avg(c).alias(c) for c in LIKELIHOOD))


Score = Callable[[str, int], list[tuple]]
#: (doc_id, paragraph_index, sentence_index, context, char_start) of a sentence that is to be scored.
Asked = tuple[str | None, int, int, str, int]

#: Scorers that a worker process has made, by name.
_made: dict[str, Score] = {}
#: Scored tokens that go back at once.
ROWS = 32_768


def _made_once(scorer: Callable[[], Score], cache: str | None) -> Score:
    from inkwell.operators import likelihood  # the worker's own module, which outlives the task

    score = likelihood._made.get(cache) if cache else None
    if score is None:
        score = scorer()
        if cache:
            likelihood._made[cache] = score
    return score


def _filled(asked: Iterable[Asked], score: Score) -> Iterator[pa.RecordBatch]:
    """The contract's rows of sentences, column by column."""
    names = [c.split()[0] for c in CONTRACT.split(", ")]
    docs, paragraphs, sentences, sizes, failed = [], [], [], [], {}
    columns: tuple[list, ...] = ([], [], [], [])
    base, ranks, entropies, alts = columns

    def out() -> Iterator[pa.RecordBatch]:
        n = np.array(sizes, np.int64)
        at = np.repeat(np.arange(len(n)), n)
        tok, none = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n), np.zeros(len(at), bool)
        none[list(failed)] = True
        error = [None] * len(at) if failed else pa.nulls(len(at), pa.string())
        for k, e in failed.items():
            error[k] = e
        lp, rank, entropy, alt = (pa.array(c, from_pandas=True).cast(kind) for c, kind in zip(columns, (pa.float64(), pa.int64(), pa.float64(), pa.float64())))
        b = pa.RecordBatch.from_arrays([
            pa.array(docs, pa.string()).take(pa.array(at)), pa.array(np.array(paragraphs, np.int32)[at]), pa.array(np.array(sentences, np.int32)[at]),
            pa.array(tok.astype(np.int32), mask=none), lp, rank, entropy, alt, pa.array(error, pa.string()),
        ], names)
        for x in (docs, paragraphs, sentences, sizes, failed, *columns):
            x.clear()
        yield from (b.slice(k, ROWS) for k in range(0, b.num_rows, ROWS))

    for doc, paragraph, sentence, context, start in asked:
        try:
            got = list(score(context, start))
            if not got:
                continue
            lp, rank, entropy, alt = zip(*got, strict=True)
        except Exception as e:  # noqa: BLE001
            failed[len(base)] = f"{type(e).__name__}: {e}"
            lp = rank = entropy = alt = (None,)
        docs.append(doc)
        paragraphs.append(paragraph)
        sentences.append(sentence)
        sizes.append(len(lp))
        base += lp
        ranks += rank
        entropies += entropy
        alts += alt
        if len(base) >= ROWS:
            yield from out()
    if sizes:
        yield from out()


def score_paragraphs(paragraphs: DataFrame, scorer: Callable[[], Score], *, cache: str | None = None) -> DataFrame:
    """Fill the contract in one Arrow pass over paragraphs, as ``segment.paragraphs`` makes them with doc_id as the key. A
    paragraph goes to Python once and is cut into sentences there (as ``segment.sentence_offsets`` cuts it), so no row
    carries what is before a sentence. If there is a column ``wanted``, it lists the sentences to score.

    ``scorer`` is called once in a task (load the model there), or with a name to ``cache`` it under once in a worker
    process, whatever tasks it runs, and gives a function of (paragraph up to the sentence's end, start of the sentence in
    it) that returns (lp, rank, entropy, lp_alt) rows. A sentence that fails gives one row with the error, and the others
    go on."""
    ship(paragraphs.sparkSession)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[Asked]:
        for b in batches:
            for row in zip(*b.columns):
                doc, place, paragraph, *wanted = (x.as_py() for x in row)
                chosen = set(wanted[0]) if wanted else None
                for k, (start, end) in enumerate(segment.offsets(paragraph)):
                    if chosen is None or k in chosen:
                        yield doc, place, k, paragraph[:end], start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _filled(asked(batches), _made_once(scorer, cache))

    wanted = ["wanted"] if "wanted" in paragraphs.columns else []
    return paragraphs.select(F.col("doc_id").cast("string"), "paragraph_index", "paragraph", *wanted).mapInArrow(run, CONTRACT)


def score_with(sentences: DataFrame, scorer: Callable[[], Score], *, cache: str | None = None) -> DataFrame:
    """As ``score_paragraphs``, of sentences one by one, as ``segment.sentence_offsets`` makes them with doc_id as the key.
    Each goes to Python with all of its paragraph before it, so this is for few sentences of a paragraph."""
    ship(sentences.sparkSession)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[Asked]:
        for b in batches:
            for row in zip(*b.columns):
                yield tuple(x.as_py() for x in row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _filled(asked(batches), _made_once(scorer, cache))

    context = F.substr("paragraph", F.lit(1), F.col("char_end").cast("int")).alias("context")
    return sentences.select(F.col("doc_id").cast("string"), "paragraph_index", "sentence_index", context, "char_start").mapInArrow(run, CONTRACT)
