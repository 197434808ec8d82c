"""Whole runs over resumable tables: scoring of all pools, modern and adversarial generation, features of attacked texts,
robustness, and the analysis of single essays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import stats as st
from inkwell.functions import text as tx
from inkwell.operators import attacks, baseline, corpus_scores, generate, joins, likelihood, manifest, metrics, model, sampling, segment, stylometry
from inkwell.runtime import cut
from inkwell.sources import checkpoint

# What a scoring run takes of each pool, kinds of attack, and the schemas of the runs' tables.
POOL_SIZES = {
    "baseline": 15,
    "human_training": 25,
    "machine_training": 25,
    "machine_heldout": 20,
    "polished": 60,
    "modern_gen": 45,
}
ATTACKS = ["typo", "paraphrase"]
LIKELIHOOD_TABLE = "doc_id string, pool string, paragraph_index int, sentence_index int, text string, " + ", ".join(f"{c} double" for c in stylometry.LIKELIHOOD)
MODERN_TABLE = "essay_id string, model string, condition string, topic string, text string, word_count bigint"
ADVERSARIAL_TABLE = "essay_id string, source_family string, topic string, attack_type string, original_text string, attacked_text string, word_count bigint"
FEATURE_TABLE = "doc_id string, essay_id string, version string, attack_type string, " + ", ".join(f"{c} double" for c in stylometry.LIKELIHOOD) + ", stylo_json string"

#: Of documents (doc_id, text): rows of sentences with the likelihood features, and ``error`` for a document that failed.
Scorer = Callable[[DataFrame], DataFrame]


def target_documents(humans: DataFrame, machines: DataFrame, polished: DataFrame, modern: DataFrame, *, held_out: str, excluded: list[str], sizes: dict[str, int] = POOL_SIZES, seed: int = sampling.SEED) -> DataFrame:
    """(doc_id, text, pool, word_count) of all six pools that are scored.

    humans: text_hash, text, word_count, ell_status, prompt_name; machines: doc_id, text, label, source, prompt_name, which
    is stratified by the humans' topics; polished and modern: the tables of the generation runs."""
    base, training = sampling.split_humans(humans, "text_hash", "ell_status", sizes["baseline"], sizes["human_training"], seed)
    share = joins.topic_share(humans, "prompt_name").select("topic", "share")
    trained, heldout = sampling.split_machines(machines, "doc_id", "prompt_name", "source", share, held_out=held_out, excluded=excluded, training_n=sizes["machine_training"], heldout_n=sizes["machine_heldout"], seed=seed)
    row = lambda df, key, text, words: df.select(F.col(key).cast("string").alias("doc_id"), text.alias("text"), words.cast("long").alias("word_count"))
    own, counted = F.col("text"), tx.word_count(F.col("text"))
    revised = F.col("paragraphs_json")
    return joins.union_pools({
        "baseline": row(base, "text_hash", own, F.col("word_count")), "human_training": row(training, "text_hash", own, F.col("word_count")),
        "machine_training": row(trained, "doc_id", own, counted), "machine_heldout": row(heldout, "doc_id", own, counted),
        "polished": row(sampling.uniform(polished, "essay_id", sizes["polished"], seed), "essay_id", manifest.revised_text(revised), manifest.revised_words(revised)),
        "modern_gen": row(modern, "essay_id", own, F.col("word_count")),
    }).select("doc_id", "text", "pool", "word_count")


def sampled(docs: DataFrame, every: bool = False) -> DataFrame:
    """Sentences of documents (doc_id, text): one from each third of a document, or all."""
    rows = segment.sentences(docs, "doc_id", "text").withColumn("_place", F.col("paragraph_index").cast("long") * (1 << 32) + F.col("sentence_index"))
    rows = rows if every else sampling.sample_sentences(rows, "doc_id", "_place")
    return rows.select("doc_id", "paragraph_index", "sentence_index", "text")


def bigram_scorer(base: DataFrame, alt: DataFrame, every: bool = False) -> Scorer:
    """Scores by two trained bigram models (train_bigram). No document fails."""

    def score(docs: DataFrame) -> DataFrame:
        place, rows = ["doc_id", "paragraph_index", "sentence_index"], sampled(docs, every)
        tokens = likelihood.score_tokens(likelihood.sentence_bigrams(rows, place), base, alt, *place)
        return rows.join(likelihood.sentence_features(tokens, place), place).withColumn("error", F.lit(None).cast("string"))

    return score


def corpus_scorer(model: corpus_scores.Trained, every: bool = False) -> Scorer:
    """As ``bigram_scorer``, by both models of a corpus, without a row for each token. No document fails."""

    def score(docs: DataFrame) -> DataFrame:
        rows = sampled(docs, every)
        keyed = (rows if every else cut(rows)).select(F.struct("doc_id", "paragraph_index", "sentence_index", "text").alias("_place"), "text")
        out = corpus_scores.score_under(model, keyed, "_place", "text", corpus_scores.SENTENCES, corpus_scores.sentence_rows)
        return out.select("_place.*", *out.columns[2:]).withColumn("error", F.lit(None).cast("string"))

    return score


def token_scorer(make: Callable[[], Callable[[str, int], list[tuple]]], every: bool = False) -> Scorer:
    """Scores by a function of a context and the place of a sentence in it, as ``score_paragraphs`` calls it. A sentence that
    fails fails its document."""

    def score(docs: DataFrame) -> DataFrame:
        place = ["doc_id", "paragraph_index", "sentence_index"]
        wanted = sampled(docs, every)
        paragraphs = segment.paragraphs(docs.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text")
        if not every:
            chosen = wanted.groupBy(F.col("doc_id").cast("string"), "paragraph_index").agg(F.collect_set("sentence_index").alias("wanted"))
            paragraphs = paragraphs.join(chosen, ["doc_id", "paragraph_index"])
        tokens = likelihood.score_paragraphs(paragraphs, make)
        found = likelihood.sentence_features(tokens.where("error is null"), place)
        failed = tokens.groupBy("doc_id").agg(F.max("error").alias("error"))
        return wanted.join(failed, "doc_id").join(found, place, "left").where("error is not null or n_tokens is not null")

    return score


def run_likelihood(targets: DataFrame, path: str, scorer: Scorer) -> DataFrame:
    """Score the targets (doc_id, text, pool) that the table doesn't have, in one commit. A document that fails leaves no row,
    so the next run takes it up again. Returns the table."""
    spark = targets.sparkSession

    def job(rest: DataFrame) -> DataFrame:
        rows = scorer(rest.select("doc_id", "text"))
        return rows.join(rest.select("doc_id", "pool"), "doc_id")

    checkpoint.run_batch(targets, path, "doc_id", LIKELIHOOD_TABLE, job, error="error")
    return checkpoint.load(spark, path, LIKELIHOOD_TABLE)


def run_modern(joined: DataFrame, path: str, client: Callable[[], generate.Client], *, per_model: int = generate.PER_MODEL, seed: int = sampling.SEED) -> DataFrame:
    """Generate the essays that the table doesn't have; joined: doc_id, text, prompt_name, assignment. A style exemplar is the
    beginning of a human essay on the topic, or on any if there is none. A call that fails is made again by the next run."""
    spark = joined.sparkSession
    targets = generate.targets(spark, per_model, seed)
    tasks = joined.where(F.col("prompt_name").isin(generate.TOPICS)).groupBy(F.col("prompt_name").alias("topic")).agg(F.min_by("assignment", "doc_id").alias("assignment"))
    shown = joined.select("prompt_name", F.struct(st.hash_order(seed, F.col("doc_id")).alias("h"), tx.first_words(F.col("text"), 150).alias("t")).alias("s"))
    by_topic = shown.groupBy(F.col("prompt_name").alias("topic")).agg(F.min("s")["t"].alias("own"))
    any_ = shown.agg(F.min("s")["t"].alias("any"))

    def job(rest: DataFrame) -> DataFrame:
        rows = rest.join(tasks, "topic").join(by_topic, "topic", "left").join(F.broadcast(any_))  # one row
        ask = generate.prompt(F.col("assignment"), F.col("condition"), F.when(F.col("condition") == "style_exemplar", F.coalesce("own", "any")))
        answers = generate.generate(rows.withColumn("prompt", ask), "essay_id", "model", "prompt", client)
        return rest.join(answers, "essay_id").withColumn("text", F.col("response")).withColumn("word_count", tx.word_count(F.col("text")).cast("long"))

    checkpoint.run_batch(targets, path, "essay_id", MODERN_TABLE, job, error="error")
    return checkpoint.load(spark, path, MODERN_TABLE)


def adversarial_pool(machines: DataFrame, used: DataFrame, key: str, n: int, *, excluded: list[str], seed: int = sampling.SEED) -> DataFrame:
    """n machine essays that no other pool uses, each kind of attack as often as the other, give or take one."""
    name = F.coalesce(F.col("source"), F.lit(""))
    free = machines.where((F.col("label") == 1) & ~name.isin(excluded)).join(used.select(key), key, "left_anti").select(*machines.columns)
    return sampling.balanced_labels(sampling.uniform(free, key, n, seed), key, ATTACKS, "attack_type", seed)


def run_adversarial(pool: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Attack the essays (key, text, source, prompt_name, attack_type) that the table doesn't have."""
    targets = pool.withColumn("essay_id", F.concat_ws("::", F.coalesce(F.col("source"), F.lit("")), F.lit("adv"), F.col(key).cast("string")))

    def job(rest: DataFrame) -> DataFrame:
        seed = F.col("essay_id")
        attacked = F.coalesce(*(F.when(F.col("attack_type") == a, attacks.apply_attack(F.col("text"), a, seed)) for a in ATTACKS))
        rows = rest.withColumn("attacked_text", attacked)
        return rows.select("essay_id", F.col("source").alias("source_family"), F.col("prompt_name").alias("topic"), "attack_type", F.col("text").alias("original_text"), "attacked_text", tx.word_count(F.col("attacked_text")).cast("long").alias("word_count"))

    checkpoint.run_batch(targets, path, "essay_id", ADVERSARIAL_TABLE, job)
    return checkpoint.load(pool.sparkSession, path, ADVERSARIAL_TABLE)


def run_adversarial_features(attacked: DataFrame, path: str, scorer: Scorer, known: DataFrame) -> DataFrame:
    """Features of the original and the attacked text of each essay that the table doesn't have. Texts without a scored
    sentence leave no row."""
    both = attacks.attacked_versions(attacked, "essay_id", "original_text", "attacked_text").join(attacked.select("essay_id", "attack_type"), "essay_id")

    def job(rest: DataFrame) -> DataFrame:
        scored = scorer(rest.select("doc_id", "text"))
        failed = scored.where("error is not null").select("doc_id", "error").distinct()
        means = likelihood.document_means(scored.where("error is null"), "doc_id")
        style = stylometry.document_features(rest.select("doc_id", "text"), "doc_id", known)
        style = style.select("doc_id", F.to_json(F.struct(*style.columns)).alias("stylo_json"))
        return rest.join(means, "doc_id").join(style, "doc_id").join(failed, "doc_id", "left")

    checkpoint.run_batch(both, path, "doc_id", FEATURE_TABLE, job, error="error")
    return checkpoint.load(attacked.sparkSession, path, FEATURE_TABLE)


def feature_join(style: DataFrame, sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stylometric features and the means of the likelihood features of documents that have both; word_count for bands."""
    return style.join(likelihood.document_means(sentences, key), key).withColumn("word_count", F.col("n_words"))


def robustness(features: DataFrame, fitted: model.CalibratedModel, stats: DataFrame) -> DataFrame:
    """Scores of original and attacked texts (FEATURE_TABLE), summarised by attack and over all."""
    style = F.from_json("stylo_json", "n_words bigint, " + ", ".join(f"{c} double" for c in stylometry.STYLOMETRIC))
    rows = features.withColumn("_s", style).select("doc_id", "essay_id", "version", "attack_type", *stylometry.LIKELIHOOD, "_s.*").withColumn("word_count", F.col("n_words"))
    scored = fitted.score(baseline.zscore(rows, stylometry.FEATURES, stats, fallback="unit"), "score")
    return metrics.degradation(scored, "essay_id", "version", "score", "attack_type")


def analyze(docs: DataFrame, fitted: model.CalibratedModel, stats: DataFrame, known: DataFrame, scorer: Scorer, *, top: int = len(stylometry.FEATURES)) -> DataFrame:
    """The analysis of essays (doc_id, text): word_count, abstained and why, probability and its band, the features by the
    size of their contribution (name, value, baseline_mean, z, contribution), and each sentence's signal (curvature less
    log probability) scaled to 0 to 1 as heat. Short essays, and those without a scored sentence, abstain."""
    rows = docs.select("doc_id", "text", tx.word_count(F.col("text")).cast("long").alias("_words"))
    # read by the features, by the heat's span and by the heat
    sentences = cut(scorer(rows.select("doc_id", "text")).where("error is null")).withColumn("signal", F.col("mean_curvature") - F.col("mean_logprob"))
    frame = feature_join(stylometry.document_features(rows, "doc_id", known), sentences)
    frame = baseline.zscore(frame.join(rows.select("doc_id", "_words"), "doc_id").withColumn("word_count", F.col("_words")), stylometry.FEATURES, stats, fallback="unit")
    scored = fitted.score(frame)
    pooled = stats.where(F.col("band") == baseline.ALL).select(*(F.col(f"{c}__mean").alias(f"_m_{c}") for c in stylometry.FEATURES))
    scored = scored.join(F.broadcast(pooled))  # one row
    weights = fitted.coefficients()
    facts = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.col(f"_m_{c}").alias("baseline_mean"), F.col(f"{c}_z").alias("z"), (F.col(f"{c}_z") * weights[f"{c}_z"]).alias("contribution")) for c in stylometry.FEATURES))
    size = lambda x: F.abs(x["contribution"])
    order = F.array_sort(facts, lambda a, b: F.when(size(a) > size(b), -1).when(size(a) < size(b), 1).when(a["name"] < b["name"], -1).otherwise(1))
    low, high = st.uncertainty(F.col("probability"))
    found = scored.select("doc_id", "probability", low.alias("band_low"), high.alias("band_high"), F.slice(order, 1, top).alias("evidence"))
    heat = model.heat(sentences, "doc_id", "signal")
    parts = heat.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_index", "sentence_index", "text", "signal", "heat"))).alias("sentences"))
    out = rows.select("doc_id", F.col("_words").alias("word_count")).join(found, "doc_id", "left").join(parts, "doc_id", "left")
    short = F.col("word_count") < model.MIN_WORDS
    why = F.when(short, F.lit(f"under {model.MIN_WORDS} words")).when(F.col("probability").isNull(), F.lit("no sentence could be scored"))
    shown: Callable[[str], Column] = lambda c: F.when(why.isNull(), F.col(c)).alias(c)
    return out.select("doc_id", "word_count", why.isNotNull().alias("abstained"), why.alias("abstain_reason"), *map(shown, ("probability", "band_low", "band_high", "evidence", "sentences")))
