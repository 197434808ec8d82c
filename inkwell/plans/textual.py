"""Queries of stylometric and likelihood features, baselines and perturbations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import annotate, attacks, baseline, corpus_scores, generate, likelihood, segment, stylometry
from inkwell.plans import roles as ro
from inkwell.plans.nativesql import HOMOPHONES, LIST_RE, MARKERS, NOT_JUST, NUMBER, NUMERAL, SPELLED, TAGGED, document
from inkwell.plans.relational import values

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *columns):
    return df.withColumns({c: ro.r6(F.col(c)) for c in columns})


SAFE = "coalesce(({0})::DOUBLE / nullif(({1})::DOUBLE, 0), 0)"


@query(f"WITH {ro.SENTENCES}, n AS (SELECT doc_id, count(*) AS n FROM sentences GROUP BY 1) SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, len({ro.WORDS.format('text')})::BIGINT AS n_words FROM documents LEFT JOIN n USING (doc_id)")
def word_stats(spark, d):
    return stylometry.native_features(ro.texts(spark, d), "doc_id").select("doc_id", "n_sentences", "n_words")


@query(f"""WITH {ro.SENTENCES}, l AS (SELECT doc_id, len({ro.WORDS.format('s')})::DOUBLE AS n FROM sentences)
SELECT doc_id, round(avg(n), 6) AS sent_len_mean, round(stddev_pop(n), 6) AS sent_len_std, round(coalesce(stddev_pop(n) / nullif(avg(n), 0), 0), 6) AS sent_len_burstiness FROM l GROUP BY 1""")
def sentence_length_stats(spark, d):
    out = stylometry.native_features(ro.texts(spark, d), "doc_id").where("n_sentences > 0").select("doc_id", "sent_len_mean", "sent_len_std", "sent_len_burstiness")
    return rounded(out, "sent_len_mean", "sent_len_std", "sent_len_burstiness")


@query(f"WITH {ro.FEATURES} SELECT doc_id, round(mattr, 6) AS mattr FROM features")
def mattr(spark, d):
    return rounded(ro.features(spark, d).select("doc_id", "mattr"), "mattr")


@query(f"""WITH t AS (SELECT doc_id, unnest({ro.WORDS.format('text')}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY 1, 2),
h AS (SELECT doc_id, count_if(n = 1)::DOUBLE / sum(n) AS h FROM c GROUP BY 1) SELECT doc_id, round(coalesce(h, 0), 6) AS hapax_rate FROM documents LEFT JOIN h USING (doc_id)""")
def hapax_rate(spark, d):
    return rounded(stylometry.native_features(ro.texts(spark, d), "doc_id").select("doc_id", "hapax_rate"), "hapax_rate")


@query(f"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '{LIST_RE}', 3) AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n_lists, round(CASE WHEN len(l) = 0 THEN -1 ELSE len(list_filter(l, lambda x: x = ','))::DOUBLE / len(l) END, 6) AS oxford_comma_rate FROM l""")
def list_oxford(spark, d):
    return rounded(stylometry.native_features(ro.texts(spark, d), "doc_id").select("doc_id", F.col("n_lists_detected").alias("n_lists"), "oxford_comma_rate"), "oxford_comma_rate")


@query(f"""WITH t AS (SELECT page_id, len({ro.WORDS.format('html')}) AS n, len(list_filter(regexp_extract_all(lower(html), '{NUMERAL}'), lambda x: regexp_matches(x, '{NUMBER}'))) AS k FROM pages)
SELECT page_id, round(k * 100.0::DOUBLE / nullif(n, 0), 6) AS numeral_rate FROM t""")
def numeral_rate(spark, d):
    pages = ro.table(spark, d, "pages")
    return rounded(stylometry.native_features(pages, "page_id", "html").select("page_id", "numeral_rate"), "numeral_rate")


@query(f"""WITH t AS (SELECT page_id, len({ro.WORDS.format('html')}) AS n, len(regexp_extract_all(html, '—')) + len(regexp_extract_all(html, '--')) AS dash, len(regexp_extract_all(html, ';')) AS sc FROM pages)
SELECT page_id, round(dash * (100.0::DOUBLE / n), 6) AS em_dash_rate, round(sc * (100.0::DOUBLE / n), 6) AS semicolon_rate FROM t""")
def punct_rates(spark, d):
    out = stylometry.native_features(ro.table(spark, d, "pages"), "page_id", "html")
    return rounded(out.select("page_id", "em_dash_rate", "semicolon_rate"), "em_dash_rate", "semicolon_rate")


def phrase_rate(name: str, count: str) -> str:
    return f"SELECT doc_id, round({SAFE.format(f'({count}) * 100.0::DOUBLE', f'len({ro.WORDS.format("text")})')}, 6) AS {name} FROM documents"


def phrases(spark, d):
    return stylometry.native_features(ro.texts(spark, d), "doc_id")


@query(phrase_rate("homophone_error_rate", HOMOPHONES))
def homophone_rate(spark, d):
    return rounded(phrases(spark, d).select("doc_id", "homophone_error_rate"), "homophone_error_rate")


@query(phrase_rate("discourse_marker_rate", f"len(list_filter({ro.WORDS.format('text')}, lambda w: w IN ({MARKERS})))"))
def discourse_rate(spark, d):
    return rounded(phrases(spark, d).select("doc_id", "discourse_marker_rate"), "discourse_marker_rate")


@query(phrase_rate("template_rate", f"len(regexp_extract_all(text, '{NOT_JUST}')) + len(regexp_extract_all(text, '{LIST_RE}'))"))
def not_just_but(spark, d):
    return rounded(phrases(spark, d).select("doc_id", "template_rate"), "template_rate")


@query(f"""WITH {TAGGED}, {SPELLED} SELECT doc_id, coalesce(n, 0)::BIGINT AS n_checkable, coalesce(u, 0)::BIGINT AS n_unknown, round({SAFE.format('u', 'n')}, 6) AS spelling_error_rate FROM documents LEFT JOIN spelled USING (doc_id)""")
def spelling_rate(spark, d):
    docs = ro.texts(spark, d)
    return rounded(stylometry.spelling_rate(docs, "doc_id", stylometry.lexicon(docs, "text", 3)), "spelling_error_rate")


COLUMNS = ["mattr", "mean_word"]
STATS = """one AS (SELECT band, avg(mattr) AS mattr__mean, stddev_samp(mattr) AS mattr__std, avg(mean_word) AS mean_word__mean, stddev_samp(mean_word) AS mean_word__std FROM base GROUP BY GROUPING SETS ((band), ())),
stats AS (SELECT coalesce(band, '_all') AS band, * EXCLUDE (band) FROM one)"""


def zsql(fallback: str) -> str:
    z = lambda c: f"round((f.{c} - CASE WHEN b.{c}__std > 0 THEN b.{c}__mean ELSE a.{c}__mean END) / CASE WHEN b.{c}__std > 0 THEN b.{c}__std ELSE {f'coalesce(nullif(a.{c}__std, 0), 1)' if fallback == 'pooled' else '1'} END, 6) AS {c}_z"
    return f"""WITH {ro.FEATURES}, base AS (SELECT * FROM banded WHERE lang = 'es' AND word_count < 400), {STATS}
SELECT f.doc_id, {z('mattr')}, {z('mean_word')} FROM banded f LEFT JOIN stats b ON f.band = b.band CROSS JOIN (SELECT * FROM stats WHERE band = '_all') a"""


def es_baseline(spark, d):
    # without long documents, so that the band's fallback is used
    return baseline.baseline_stats(ro.features(spark, d).where("lang = 'es' AND word_count < 400"), COLUMNS)


@query(f"""WITH {ro.FEATURES}, base AS (SELECT * FROM banded), {STATS} SELECT band, round(mattr__mean, 6) AS mattr__mean, round(mattr__std, 6) AS mattr__std, round(mean_word__mean, 6) AS mean_word__mean, round(mean_word__std, 6) AS mean_word__std FROM stats""")
def band_stats(spark, d):
    out = baseline.baseline_stats(ro.features(spark, d), COLUMNS)
    return rounded(out, *out.columns[1:])


@query(zsql("pooled"))
def zscore_features(spark, d):
    return rounded(baseline.zscore(ro.features(spark, d), COLUMNS, es_baseline(spark, d)).select("doc_id", "mattr_z", "mean_word_z"), "mattr_z", "mean_word_z")


@query(zsql("unit"))
def zscore_unit_fallback(spark, d):
    return rounded(baseline.zscore(ro.features(spark, d), COLUMNS, es_baseline(spark, d), fallback="unit").select("doc_id", "mattr_z", "mean_word_z"), "mattr_z", "mean_word_z")


@query(f"""WITH {ro.FEATURES}, g AS (SELECT avg(mattr) m1, coalesce(nullif(stddev_samp(mattr), 0), 1) s1, avg(mean_word) m2, coalesce(nullif(stddev_samp(mean_word), 0), 1) s2 FROM features),
z AS (SELECT doc_id, lang, (mattr - m1) / s1 AS a, (mean_word - m2) / s2 AS b FROM features, g), m AS (SELECT lang, median(a) AS ma, median(b) AS mb FROM z GROUP BY 1)
SELECT doc_id, round((abs(a - ma) + abs(b - mb)) / 2, 6) AS consistency FROM z JOIN m USING (lang)""")
def intra_doc_consistency(spark, d):
    return rounded(baseline.consistency(ro.features(spark, d), COLUMNS, "lang").select("doc_id", "consistency"), "consistency")


BIGRAMS = rf"""{ro.SENTENCES}, ws AS (SELECT doc_id, sent, {ro.WORDS.format('s')} AS w FROM sentences),
grams AS (SELECT doc_id, sent, k AS tok, w[k] AS prev, w[k + 1] AS word FROM (SELECT *, unnest(range(1, len(w))) AS k FROM ws))"""


def model_sql(name: str, where: str) -> str:
    return f"""{name}_g AS (SELECT * FROM grams {where}), {name}_v AS (SELECT count(DISTINCT word) AS v FROM {name}_g),
{name}_p AS (SELECT prev, word, count(*) AS n FROM {name}_g GROUP BY 1, 2),
{name}_c AS (SELECT prev, sum(n) AS pn, count(*) AS seen, sum(-((n + 1.0::DOUBLE) / 1)) AS x FROM {name}_p GROUP BY 1),
{name}_e AS (SELECT p.prev, any_value(c.pn) AS pn, any_value(c.seen) AS seen, sum(-(n + 1)::DOUBLE / (c.pn + v) * ln((n + 1)::DOUBLE / (c.pn + v))) + any_value((v - c.seen)::DOUBLE / (c.pn + v) * ln((c.pn + v)::DOUBLE)) AS ent FROM {name}_p p JOIN {name}_c c USING (prev), {name}_v GROUP BY 1),
{name}_r AS (SELECT *, rank() OVER (PARTITION BY prev ORDER BY n DESC) - 1 AS likelier FROM {name}_p)"""


TOKENS = f"""{BIGRAMS}, {model_sql('base', '')}, {model_sql('alt', 'WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)')},
tokens AS (SELECT g.doc_id, g.sent, g.tok, ln((coalesce(b.n, 0) + 1)::DOUBLE / (coalesce(be.pn, 0) + bv.v)) AS lp_base, 1 + coalesce(b.likelier, be.seen, 0) AS rank_base, coalesce(be.ent, ln(bv.v::DOUBLE)) AS ent_base,
ln((coalesce(a.n, 0) + 1)::DOUBLE / (coalesce(ae.pn, 0) + av.v)) AS lp_alt FROM grams g LEFT JOIN base_r b USING (prev, word) LEFT JOIN base_e be USING (prev) LEFT JOIN alt_r a USING (prev, word) LEFT JOIN alt_e ae USING (prev), base_v bv, alt_v av)"""
SENT = """sents AS (SELECT doc_id, sent, count(*) AS n_tokens, avg(lp_base) AS mean_logprob, avg(ln(rank_base::DOUBLE)) AS mean_logrank, avg(ent_base) AS mean_entropy, avg(lp_base + ent_base) AS mean_curvature,
var_pop(lp_base) AS logprob_variance, exp(avg(lp_alt) - avg(lp_base)) AS cross_ppl_ratio FROM tokens GROUP BY 1, 2),
sent_f AS (SELECT *, CASE WHEN mean_logrank = 0 THEN 0 ELSE mean_logprob / mean_logrank END AS lrr FROM sents)"""
LIKE = ["mean_logprob", "mean_logrank", "lrr", "mean_entropy", "mean_curvature", "logprob_variance", "cross_ppl_ratio"]


def tokens(spark, d):
    return corpus_scores.score(ro.texts(spark, d), good(spark, d), "doc_id", "text")


def sentence_scores(spark, d):
    """The likelihood features of each sentence with a scored token."""
    return corpus_scores.score(ro.texts(spark, d), good(spark, d), "doc_id", "text", corpus_scores.SENTENCES, corpus_scores.sentence_rows)


def good(spark, d):
    return ro.labels(spark, d).where("quality = 1").select("doc_id")


@query(f"WITH {TOKENS} SELECT doc_id, sent::INTEGER AS sent, tok::INTEGER AS tok, round(lp_base, 6) AS lp_base, rank_base::BIGINT AS rank_base, round(ent_base, 6) AS ent_base, round(lp_alt, 6) AS lp_alt FROM tokens")
def token_scores(spark, d):
    return rounded(tokens(spark, d), "lp_base", "ent_base", "lp_alt").withColumn("rank_base", F.col("rank_base").cast("long"))


@query(f"WITH {TOKENS}, {SENT} SELECT doc_id, sent::INTEGER AS sent, n_tokens, {', '.join(f'round({c}, 5) AS {c}' for c in LIKE)} FROM sent_f")
def sentence_likelihood(spark, d):
    out = sentence_scores(spark, d)
    return out.select("doc_id", "sent", "n_tokens", *(F.round(c, 5).alias(c) for c in LIKE))


@query(f"WITH {TOKENS}, {SENT} SELECT doc_id, {', '.join(f'round(avg({c}), 5) AS {c}' for c in LIKE)} FROM sent_f GROUP BY 1")
def doc_likelihood(spark, d):
    out = likelihood.document_means(sentence_scores(spark, d), "doc_id")
    return out.select("doc_id", *(F.round(c, 5).alias(c) for c in LIKE))


@query()
def scorer_seam(spark, d):
    """The contract filled through Arrow by an injected scorer (here one of constant scores), sentence by sentence."""
    rows = segment.paragraphs(ro.texts(spark, d), "doc_id", "text")
    return likelihood.score_paragraphs(rows, lambda: lambda context, start: [(-1.0, 1, 1.0, -1.0)] * max(0, len(context[start:].split()) - 1))


@query(f"WITH {TAGGED} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in annotate.COLUMNS)} FROM noted")
def annotated_features(spark, d):
    return rounded(annotate.annotate(ro.texts(spark, d), "doc_id"), *annotate.COLUMNS)


@query(document())
def document_features(spark, d):
    docs = ro.texts(spark, d)
    return rounded(stylometry.document_features(docs, "doc_id", stylometry.lexicon(docs, "text", 3)), *stylometry.STYLOMETRIC)


CORE = "regexp_replace(regexp_replace(t, '^[[:punct:]]+', ''), '[[:punct:]]+$', '')"
PLACED = "substr(t, 1, instr(t, core) - 1) || {0} || substr(t, instr(t, core) + length(core))"
KEYS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in attacks.NEIGHBOURS.items())
DIGITS = "('0x' || substr(h, {0}, 4))::INTEGER"


@query(rf"""WITH tok AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS k FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)),
a AS (SELECT *, {CORE} AS core, sha256(doc_id || ':' || k) AS h FROM tok), b AS (SELECT *, length(core) AS n, {DIGITS.format(5)} % 4 AS op, {DIGITS.format(9)} % greatest(length(core), 1) AS i FROM a),
c AS (SELECT *, substr(core, 1, i) AS head, substr(core, i + 1, 1) AS x, substr(core, i + 2) AS tail FROM b), d AS (SELECT *, CASE lower(x) {KEYS} ELSE 'abcdefghijklmnopqrstuvwxyz' END AS near FROM c),
e AS (SELECT *, substr(near, {DIGITS.format(13)} % length(near) + 1, 1) AS y FROM d),
f AS (SELECT *, CASE WHEN n < 3 THEN core WHEN op = 0 THEN CASE WHEN n >= 4 AND i < n - 1 THEN head || substr(core, i + 2, 1) || x || substr(core, i + 3) ELSE core END WHEN op = 1 THEN head || tail WHEN op = 2 THEN head || y || x || tail ELSE head || y || tail END AS typed FROM e)
SELECT doc_id, string_agg(CASE WHEN regexp_matches(core, '^\p{{L}}+$') AND {DIGITS.format(1)} < 7864 THEN {PLACED.format('typed')} ELSE t END, ' ' ORDER BY k) AS attacked FROM f GROUP BY 1""")
def typo_attack(spark, d):
    text, key = F.col("text"), F.col("doc_id")
    return ro.texts(spark, d).select("doc_id", attacks.apply_attack(text, "typo", key).alias("attacked"))


@query(rf"""WITH tok AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS k FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)),
lex AS (SELECT w FROM (SELECT doc_id, unnest({ro.WORDS.format('text')}) AS w FROM documents) GROUP BY w HAVING count(DISTINCT doc_id) >= 20),
a AS (SELECT *, {CORE} AS core, sha256('42:' || doc_id || ':' || k) AS h FROM tok)
SELECT doc_id, string_agg(CASE WHEN w IS NOT NULL AND {DIGITS.format(1)} < 19660 THEN {PLACED.format("CASE WHEN regexp_matches(core, '^\\p{Lu}') THEN upper(w[1:1]) || lower(w[2:]) || 'ly' ELSE w || 'ly' END")} ELSE t END, ' ' ORDER BY k) AS attacked
FROM a LEFT JOIN lex ON lower(core) = w GROUP BY 1""")
def synonym_attack(spark, d):
    frequent = stylometry.lexicon(ro.texts(spark, d), "text", 20).withColumn("synonym", F.concat("word", F.lit("ly")))
    return attacks.swap_from_table(ro.texts(spark, d), "doc_id", "text", frequent)


@query("SELECT doc_id AS essay_id, doc_id || '::orig' AS doc_id, 'original' AS version, text FROM documents UNION ALL SELECT doc_id, doc_id || '::attk', 'attacked', text || '!' FROM documents")
def attack_unpivot(spark, d):
    return attacks.attacked_versions(ro.texts(spark, d).select("doc_id", "text", F.concat("text", F.lit("!")).alias("other")), "doc_id", "text", "other")


def listed(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


TARGETS = f"""targets AS (SELECT format('{{}}_{{:03d}}', translate(m, ':.', '--'), i) AS essay_id, m AS model, {listed(generate.CONDITIONS)}[i % 4 + 1] AS condition, {listed(generate.TOPICS)}[i % 8 + 1] AS topic
FROM (SELECT unnest({listed(generate.MODELS)}) AS m), (SELECT unnest(range(0, 50)) AS i))"""


@query(f"WITH {TARGETS} SELECT * FROM targets")
def generation_targets(spark, d):
    return generate.targets(spark)


@query(f"""WITH {TARGETS} SELECT essay_id, CASE condition WHEN 'bare' THEN topic || chr(10) || chr(10) || '{generate.LENGTH_LINE}' WHEN 'persona' THEN '{generate.PERSONA_LINE}' || chr(10) || chr(10) || topic || chr(10) || chr(10) || '{generate.LENGTH_LINE}'
WHEN 'style_exemplar' THEN '{generate.EXEMPLAR_LINE}' || chr(10) || chr(10) || 'Sample.' || chr(10) || chr(10) || '{generate.STYLE_LINE}' || chr(10) || chr(10) || topic || chr(10) || chr(10) || '{generate.LENGTH_LINE}'
ELSE topic || chr(10) || chr(10) || '{generate.EVASION_LINE}' || chr(10) || chr(10) || '{generate.LENGTH_LINE}' END AS prompt FROM targets""")
def generation_prompts(spark, d):
    rows = generate.targets(spark).withColumn("exemplar", F.lit("Sample."))
    return rows.select("essay_id", generate.prompt(F.col("topic"), F.col("condition"), F.col("exemplar")).alias("prompt"))


class Shout:
    """A stand-in for a generation server: upper case."""

    def generate(self, model: str, prompt: str) -> str:
        return "Sure, here it is.\n\n" + prompt.rpartition("Paragraph:\n")[2].upper()


@query()
def polish_essays(spark, d):
    docs = ro.texts(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.lit("flow").alias("intensity"))
    return generate.polish(docs, "doc_id", "intensity", "any", Shout)
