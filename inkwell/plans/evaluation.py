"""Queries of metrics, models, evidence and incremental runs, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.functions import stats as st
from inkwell.functions import text as tx
from inkwell.operators import baseline, corpus_scores, drivers, generate, manifest, metrics, model, sampling, stylometry
from inkwell.plans import nativesql, relational, textual
from inkwell.plans import roles as ro
from inkwell.plans.relational import values
from inkwell.runtime import cut, shared_folder

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {ro.SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM scored)
SELECT round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label)))::DOUBLE, 6) AS auc FROM r""")
def auc(spark, d):
    return metrics.auc(ro.scored(spark, d), "score", "label").select(ro.r6(F.col("auc")).alias("auc"))


CURVE = """g AS (SELECT score, count_if(label = 1) AS p, count_if(label = 0) AS n FROM scored GROUP BY 1),
c AS (SELECT score, sum(p) OVER w / sum(p) OVER ()::DOUBLE AS tpr, sum(n) OVER w / sum(n) OVER ()::DOUBLE AS fpr FROM g WINDOW w AS (ORDER BY score DESC))"""


def point_sql(most: float) -> str:
    return f"""WITH {ro.SCORED}, {CURVE} SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (SELECT score AS threshold, tpr, fpr FROM c UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0)
WHERE fpr <= {most}::DOUBLE ORDER BY tpr DESC, threshold DESC LIMIT 1"""


def point(spark, d, most):
    return metrics.operating_point(ro.scored(spark, d), "score", "label", most).select("threshold", ro.r6(F.col("tpr")).alias("tpr"), ro.r6(F.col("fpr")).alias("fpr"))


@query(point_sql(0.01))
def roc_operating_point(spark, d):
    return point(spark, d, 0.01)


@query(point_sql(0.1))
def roc_operating_point_10(spark, d):
    return point(spark, d, 0.1)


@query(f"WITH {ro.SCORED} SELECT round(avg(pow(score - label, 2)), 6) AS brier, round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM scored")
def brier(spark, d):
    right = (F.col("score") >= 0.5) == (F.col("label") == 1)
    return ro.scored(spark, d).agg(ro.r6(metrics.brier(F.col("score"), F.col("label"))).alias("brier"), ro.r6(F.avg(right.cast("double"))).alias("accuracy"))


COND = "cond AS (SELECT *, CASE WHEN label = 0 THEN 'in_distribution' WHEN source < 'src2' THEN 'heldout_family' ELSE 'modern' END AS c FROM scored)"


@query(f"""WITH {ro.SCORED}, {COND}, neg AS (SELECT score FROM cond WHERE c = 'in_distribution'), pos AS (SELECT c, score FROM cond WHERE c <> 'in_distribution'),
a AS (SELECT c, avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END) AS auc FROM pos p, neg n GROUP BY 1)
SELECT p.c AS condition, count(*) AS n_positive, (SELECT count(*) FROM neg) AS n_negative, round(any_value(a.auc), 6) AS auc, round(avg(CASE WHEN p.score >= {ro.THRESHOLD}::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS tpr FROM pos p JOIN a USING (c) GROUP BY p.c""")
def condition_eval(spark, d):
    rows = ro.scored(spark, d).withColumn("condition", F.when(F.col("label") == 0, "in_distribution").when(F.col("source") < "src2", "heldout_family").otherwise("modern"))
    out = metrics.condition_metrics(rows, "score", "label", "condition", "in_distribution", ro.THRESHOLD)
    return out.select("condition", "n_positive", "n_negative", ro.r6(F.col("auc")).alias("auc"), ro.r6(F.col("tpr")).alias("tpr"))


WILSON = """round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS ci_low,
round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS ci_high"""


@query(f"""WITH {ro.SCORED}, g AS (SELECT ell AS grp, count(*)::DOUBLE AS n, count_if(score >= {ro.THRESHOLD}::DOUBLE)::DOUBLE AS k FROM scored WHERE label = 0 GROUP BY 1), x AS (SELECT *, k / n AS p FROM g)
SELECT grp, n::BIGINT AS n, k::BIGINT AS flagged, round(p, 6) AS fpr, {WILSON} FROM x""")
def bias_audit_wilson(spark, d):
    out = metrics.bias_audit(ro.scored(spark, d).where("label = 0"), "score", "ell", ro.THRESHOLD)
    return out.withColumns({c: ro.r6(F.col(c)) for c in ("fpr", "ci_low", "ci_high")})


@query(f"""WITH {ro.SCORED} SELECT doc_id, score, round(abs(score - 0.5), 6) AS confidence, CASE WHEN label = 0 THEN 'human' ELSE 'machine' END AS truth FROM scored
WHERE (score >= 0.5) <> (label = 1) ORDER BY abs(score - 0.5) DESC, doc_id LIMIT 10""")
def confident_failures(spark, d):
    out = metrics.confident_failures(ro.scored(spark, d), "doc_id", "score", "label", 10)
    return out.withColumn("confidence", ro.r6(F.col("confidence")))


@query(f"""WITH {ro.SCORED}, v AS (SELECT score AS o, score * {ro.UNIT.format('doc_id', 9)} AS a, CASE WHEN doc_id % 2 = 0 THEN 'typo' ELSE 'paraphrase' END AS attack FROM scored WHERE label = 1)
SELECT coalesce(attack, 'overall') AS attack, count(*) AS n, round(avg(o), 6) AS mean_original, round(avg(a), 6) AS mean_attacked, round(avg(o - a), 6) AS mean_degradation, count_if(o >= 0.5 AND a < 0.5)::BIGINT AS flipped FROM v GROUP BY GROUPING SETS ((attack), ())""")
def degradation_pivot(spark, d):
    rows = ro.scored(spark, d).where("label = 1").withColumn("attack", F.when(F.col("doc_id") % 2 == 0, "typo").otherwise("paraphrase"))
    both = rows.select("doc_id", "attack", F.inline(F.array(F.struct(F.lit("original").alias("version"), F.col("score").alias("s")), F.struct(F.lit("attacked").alias("version"), (F.col("score") * st.hash_unit(9, F.col("doc_id"))).alias("s")))))
    out = metrics.degradation(both, "doc_id", "version", "s", "attack")
    return out.withColumns({c: ro.r6(F.col(c)) for c in ("mean_original", "mean_attacked", "mean_degradation")})


@query(f"""WITH {ro.SCORED}, w AS (SELECT doc_id, score, 0.15 * (1 - abs(score - 0.5) * 2) + 0.05 AS w FROM scored)
SELECT doc_id, round(greatest(0, score - w), 6) AS band_low, round(least(1, score + w), 6) AS band_high FROM w""")
def uncertainty_band(spark, d):
    low, high = st.uncertainty(F.col("score"))
    return ro.scored(spark, d).select("doc_id", ro.r6(low).alias("band_low"), ro.r6(high).alias("band_high"))


@query(f"""WITH {ro.FEATURES}, s AS (SELECT avg(mattr) AS m1, stddev_samp(mattr) AS s1, avg(mean_word) AS m2, stddev_samp(mean_word) AS s2 FROM features),
z AS (SELECT doc_id, word_count, round((mattr - m1) / s1 * 1.5::DOUBLE, 6) AS a, round((mean_word - m2) / s2 * -0.7::DOUBLE, 6) AS b FROM features, s)
SELECT doc_id, word_count < 150 AS abstained, CASE WHEN word_count < 150 THEN NULL WHEN abs(b) > abs(a) THEN 'mean_word_z' ELSE 'mattr_z' END AS top_name, CASE WHEN word_count < 150 THEN NULL WHEN abs(b) > abs(a) THEN b ELSE a END AS top_contribution FROM z""")
def evidence_contributions(spark, d):
    rows = ro.features(spark, d)
    one = rows.agg(*(f(c).alias(f"{c}__{n}") for c in ("mattr", "mean_word") for n, f in (("mean", F.avg), ("std", F.stddev_samp)))).withColumn("band", F.lit(baseline.ALL))
    z = baseline.zscore(rows, ["mattr", "mean_word"], one).withColumn("p", F.lit(0.5))
    out = model.evidence(z, "word_count", "p", {"mattr_z": 1.5, "mean_word_z": -0.7})
    top = F.get(F.col("evidence"), F.lit(0))
    return out.select("doc_id", "abstained", top["name"].alias("top_name"), ro.r6(top["contribution"]).alias("top_contribution"))


@query(f"""WITH {ro.SCORED}, r AS (SELECT source, min(score) AS lo, max(score) AS hi FROM scored GROUP BY 1)
SELECT doc_id, round((score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS heat FROM scored JOIN r USING (source)""")
def heat_scaling(spark, d):
    return model.heat(ro.scored(spark, d), "source", "score").select("doc_id", ro.r6(F.col("heat")).alias("heat"))


WILSON_ROWS = [(0, 3), (0, 2), (5, 10), (0, 0), (3, 3)]


@query(f"WITH t(k, m) AS {values(WILSON_ROWS)}, x AS (SELECT k, m, m::DOUBLE AS n, k::DOUBLE / nullif(m, 0) AS p FROM t) SELECT k, m, coalesce(a, 0::DOUBLE) AS ci_low, coalesce(b, 1::DOUBLE) AS ci_high FROM (SELECT k, m, {WILSON.replace('AS ci_low', 'AS a0').replace('AS ci_high', 'AS b0')}, CASE WHEN m > 0 THEN a0 END AS a, CASE WHEN m > 0 THEN b0 END AS b FROM x)")
def wilson_interval(spark, d):
    low, high = st.wilson(F.col("k"), F.col("m"))
    return spark.createDataFrame(WILSON_ROWS, "k int, m int").select("k", "m", ro.r6(low).alias("ci_low"), ro.r6(high).alias("ci_high"))


POOLS = [(p,) for p in [*manifest.POOL_LABELS, "adversarial"]]


@query(f"WITH t(pool) AS {values(POOLS)} SELECT pool, (CASE pool WHEN 'human_baseline' THEN 0 WHEN 'human_training' THEN 0 WHEN 'machine_training' THEN 1 WHEN 'machine_heldout_family' THEN 1 WHEN 'machine_modern' THEN 1 WHEN 'polished_mixed' THEN -1 END)::DOUBLE AS label FROM t")
def pool_labels(spark, d):
    return spark.createDataFrame(POOLS, "pool string").select("pool", manifest.pool_label(F.col("pool")).cast("double").alias("label"))


def training_rows(spark, d):
    """(all 26 features of documents, statistics of those without a label, features' labels, the lexicon)."""
    docs = ro.texts(spark, d)
    known = cut(stylometry.lexicon(docs, "text", 3))
    style = stylometry.document_features(docs, "doc_id", known)
    rows = cut(drivers.feature_join(style, textual.sentence_scores(spark, d)).select("doc_id", "word_count", *FEATURES))  # read by statistics and scores
    labels = ro.corpus(spark, d).select("doc_id", "label")
    return rows, baseline.baseline_stats(rows.join(labels, "doc_id", "left_anti"), FEATURES), labels, known


def training_frame(spark, d):
    """Labelled documents with all 26 features z-scored; the baseline are documents without a label."""
    rows, stats, labels, _ = training_rows(spark, d)
    return baseline.zscore(rows.join(labels, "doc_id"), FEATURES, stats).select("doc_id", "label", "word_count", *Z)


FEATURES, Z = stylometry.FEATURES, [f"{c}_z" for c in stylometry.FEATURES]
FRAME = f"""like_d AS (SELECT doc_id, {', '.join(f'avg({c}) AS {c}' for c in textual.LIKE)} FROM sent_f GROUP BY 1), frame AS (SELECT full_f.*, like_d.* EXCLUDE (doc_id) FROM full_f JOIN like_d USING (doc_id))"""


@query(f"""WITH {nativesql.native('')}, {nativesql.TAGGED}, {nativesql.SPELLED}, {nativesql.FULL}, {textual.TOKENS}, {textual.SENT}, {FRAME}, {nativesql.zscores('frame', FEATURES, 'doc_id NOT IN (SELECT doc_id FROM labels)', '(SELECT (1 - quality)::BIGINT FROM labels WHERE labels.doc_id = n.doc_id) AS label,', False).replace(', 6) AS', ', 5) AS')} WHERE n.doc_id IN (SELECT doc_id FROM labels)""")
def training_frame_z(spark, d):
    return training_frame(spark, d).withColumns({c: F.round(c, 5) for c in Z})


@query()
def calibrated_model_scores(spark, d):
    frame = training_frame(spark, d)
    fitted, split, _ = model.train(frame, "doc_id", Z)
    return fitted.score(frame).select("doc_id", "label", "probability").join(split, "doc_id")


@query()
def ablation_auc(spark, d):
    return spark.createDataFrame(model.ablation(training_frame(spark, d), "doc_id", Z), "family string, auc double")


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def models(spark, d):
    """Bigram models of all documents and of those of good quality, counted once."""
    return corpus_scores.train(ro.texts(spark, d), textual.good(spark, d), "doc_id", "text")


def people(spark, d):
    rows = ro.corpus(spark, d)
    return rows.where("label = 0").select(F.col("doc_id").cast("string").alias("text_hash"), "text", tx.word_count(F.col("text")).alias("word_count"), F.col("ell").alias("ell_status"), F.col("topic").alias("prompt_name"))


def machines(spark, d):
    return ro.corpus(spark, d).where("label = 1").select("doc_id", "text", "label", "source", F.col("topic").alias("prompt_name"))


def scoring_targets(spark, d):
    """The six pools, played by the driver's tables; essays of the generation runs are made by a stand-in."""
    essays = people(spark, d).limit(0).select(F.col("text_hash").alias("essay_id"), F.lit("[]").alias("paragraphs_json"))
    written = ro.docs(spark, d).where("source = 'src3'").select(F.concat(F.lit("modern_"), F.col("doc_id").cast("string")).alias("essay_id"), "text", tx.word_count(F.col("text")).alias("word_count"))
    return drivers.target_documents(people(spark, d), machines(spark, d), essays, written, held_out="src1", excluded=["src3"], sizes={"baseline": 15, "human_training": 25, "machine_training": 25, "machine_heldout": 20, "polished": 60, "modern_gen": 45})


@query(f"""WITH {ro.CORPUS}, h AS (SELECT * FROM corpus WHERE label = 0), base AS (SELECT doc_id FROM h ORDER BY {relational.ORDER.format('doc_id')} LIMIT 15), rest AS (SELECT * FROM h WHERE doc_id NOT IN (SELECT doc_id FROM base)),
{relational.BALANCED.format(n=25, t='rest')}, share AS (SELECT topic, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM h GROUP BY 1),
m AS (SELECT doc_id, topic, source FROM corpus WHERE label = 1 AND source NOT IN ('src3')), held AS (SELECT * FROM m WHERE source = 'src1'), train AS (SELECT * FROM m WHERE source <> 'src1'),
picked AS (SELECT 'baseline' AS pool, doc_id FROM base UNION ALL SELECT 'human_training', doc_id FROM k, q WHERE rn <= CASE WHEN ell = 'Yes' THEN y ELSE 25 - y END
UNION ALL SELECT 'machine_training', doc_id FROM {relational.stratified_sql('train', 25)} UNION ALL SELECT 'machine_heldout', doc_id FROM {relational.stratified_sql('held', 20)})
SELECT doc_id::VARCHAR AS doc_id, pool, {relational.WC} AS word_count FROM picked JOIN documents USING (doc_id) UNION ALL SELECT 'modern_' || doc_id, 'modern_gen', {relational.WC} FROM documents WHERE source = 'src3'""")
def target_union(spark, d):
    return scoring_targets(spark, d).select("doc_id", "pool", "word_count")


@query()
def likelihood_run(spark, d):
    """Scores of all pools, in two runs; the second takes up what the first has left."""
    targets, path, scorer = cut(scoring_targets(spark, d)), folder(spark, "likelihood"), drivers.corpus_scorer(models(spark, d))
    drivers.run_likelihood(targets.where("pool <> 'modern_gen'"), path, scorer)
    return drivers.run_likelihood(targets, path, scorer)


class Writer:
    """A stand-in for a generation server: the prompt's own words."""

    def generate(self, model: str, prompt: str) -> str:
        return f"Sure, here it is.\n\nAs {model} would say: {prompt}"


_N, _L = "chr(10) || chr(10)", generate.LENGTH_LINE
_TOPIC = f"{textual.listed(generate.TOPICS)}[doc_id % {len(generate.TOPICS)} + 1]"


@query(rf"""WITH {textual.TARGETS}, shown AS (SELECT {_TOPIC} AS topic, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda y: y <> '')[1:150], ' ') AS e, sha256('42:' || doc_id) AS h FROM documents),
own AS (SELECT topic, arg_min(e, h) AS e FROM shown GROUP BY 1), p AS (SELECT targets.*, 'Write about ' || lower(topic) || '.' AS a, e FROM targets JOIN own USING (topic)),
written AS (SELECT essay_id, model, condition, topic, 'As ' || model || ' would say: ' || CASE condition WHEN 'bare' THEN a || {_N} || '{_L}' WHEN 'persona' THEN '{generate.PERSONA_LINE}' || {_N} || a || {_N} || '{_L}'
WHEN 'style_exemplar' THEN '{generate.EXEMPLAR_LINE}' || {_N} || e || {_N} || '{generate.STYLE_LINE}' || {_N} || a || {_N} || '{_L}' ELSE a || {_N} || '{generate.EVASION_LINE}' || {_N} || '{_L}' END AS text FROM p)
SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda y: y <> ''))::BIGINT AS word_count FROM written""")
def modern_run(spark, d):
    topics = F.element_at(F.array(*map(F.lit, generate.TOPICS)), (F.pmod(F.col("doc_id"), F.lit(len(generate.TOPICS))) + 1).cast("int"))
    joined = ro.docs(spark, d).select("doc_id", "text", topics.alias("prompt_name")).withColumn("assignment", F.concat(F.lit("Write about "), F.lower("prompt_name"), F.lit(".")))
    return drivers.run_modern(joined, folder(spark, "modern"), Writer)


def attacked(spark, d):
    rows = machines(spark, d)
    used = sampling.uniform(rows, "doc_id", 5)
    pool = drivers.adversarial_pool(rows, used, "doc_id", 100, excluded=["src3"])
    return drivers.run_adversarial(pool, folder(spark, "adversarial"))


@query()
def adversarial_run(spark, d):
    return attacked(spark, d)


@query()
def adversarial_robustness(spark, d):
    """Attacks, features of both texts, scores of a model trained without them, and the loss by attack."""
    rows, stats, labels, known = training_rows(spark, d)
    essays = attacked(spark, d)
    features = drivers.run_adversarial_features(essays, folder(spark, "features"), drivers.corpus_scorer(models(spark, d)), known)
    frame = baseline.zscore(rows.join(labels, "doc_id"), FEATURES, stats).withColumn("key", F.col("doc_id").cast("string"))
    inside = essays.select(F.element_at(F.split("essay_id", "::"), -1).alias("key"))
    fitted = model.fit(frame.join(inside, "key", "left_anti"), "doc_id", Z, plain=False)
    return drivers.robustness(features, fitted, stats)


@query()
def analyze_essays(spark, d):
    """The analysis of all documents of one language."""
    rows, stats, labels, known = training_rows(spark, d)
    docs = ro.texts(spark, d)
    fitted = model.fit(baseline.zscore(rows.join(labels, "doc_id"), FEATURES, stats), "doc_id", Z)
    essays = docs.where("lang = 'es'").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = drivers.analyze(essays, fitted, stats, known, drivers.corpus_scorer(models(spark, d), every=True), top=10)
    return out.withColumn("n_sentences", F.size("sentences")).withColumn("top_name", F.get("evidence", F.lit(0))["name"])


@query("SELECT event_id, any_value(user_id) AS user_id, any_value(value) AS value FROM events GROUP BY event_id")
def incremental_events(spark, d):
    """Take up the events table as a file stream, twice; the second run finds nothing new."""
    from inkwell.streaming.incremental import process_new

    folder, schema = f"{shared_folder(spark)}/incremental-{uuid.uuid4()}", ro.table(spark, d, "events").schema.simpleString()[7:-1].replace(":", " ")
    out = "event_id bigint, user_id bigint, value double"
    for _ in range(2):
        process_new(spark, f"{d}/events.parquet*", schema, "event_id", lambda df: df.select("event_id", "user_id", "value"), f"{folder}/out", out, f"{folder}/state")
    return spark.read.schema(out).parquet(f"{folder}/out")
