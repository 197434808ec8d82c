"""Queries of the smaller operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import stats as st
from inkwell.functions import text as tx
from inkwell.operators import generate, joins, manifest, sampling, segment
from inkwell.plans import roles as ro
from inkwell.plans.relational import ORDER, WC, values

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


STRINGS = [(1, "(hello,)"), (2, "a.b:c d  e"), (3, ""), (4, "...")]


@query(rf"""WITH t(id, x) AS {values(STRINGS)} SELECT id, regexp_replace(regexp_replace(x, '^[[:punct:]]+', ''), '[[:punct:]]+$', '') AS core, regexp_replace(x, 'l', 'L') AS first_replaced,
upper(x[1:1]) || lower(x[2:]) AS capitalized, translate(x, ':.', '--') AS slug, array_to_string(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')[1:2], ' ') AS two_words FROM t""")
def string_functions(spark, d):
    x = F.col("x")
    return spark.createDataFrame(STRINGS, "id int, x string").select("id", tx.strip_punct(x).alias("core"), tx.replace_first(x, F.lit("l"), F.lit("L")).alias("first_replaced"), tx.capitalize(x).alias("capitalized"), tx.slug(x).alias("slug"), tx.first_words(x, 2).alias("two_words"))


NUMBERS = [(1, 2.5), (2, 3.5), (3, -0.5), (4, 0.0), (5, 7.25)]


@query(f"WITH t(id, x) AS {values(NUMBERS)} SELECT id, round_even(x::DOUBLE, 0) AS half_even, coalesce(1.0::DOUBLE / nullif(x::DOUBLE, 0), 9) AS guarded, round(ln(1 + abs(x::DOUBLE)), 6) AS ln1, round(sqrt(abs(x::DOUBLE)), 6) AS root, round(log2(1 + abs(x::DOUBLE)), 6) AS bits, greatest(x::DOUBLE, 1) AS clipped FROM t")
def numeric_functions(spark, d):
    x = F.col("x")
    return spark.createDataFrame(NUMBERS, "id int, x double").select("id", F.rint(x).alias("half_even"), st.ratio(F.lit(1.0), x, 9.0).alias("guarded"), ro.r6(F.ln(1 + F.abs(x))).alias("ln1"), ro.r6(F.sqrt(F.abs(x))).alias("root"), ro.r6(F.log2(1 + F.abs(x))).alias("bits"), F.greatest(x, F.lit(1.0)).alias("clipped"))


FAMILIES = [(k,) for k in [*manifest.GENERATORS, "other_family"]]


@query(f"WITH t(source) AS {values(FAMILIES)} SELECT source, CASE source {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in manifest.GENERATORS.items())} ELSE source END AS generator FROM t")
def generator_names(spark, d):
    return spark.createDataFrame(FAMILIES, "source string").select("source", manifest.generator_name(F.col("source")).alias("generator"))


POLISHED = [("h1", "flow", '[{"revised_text":"one two three"},{"revised_text":"four  five"}]'), ("h2", "grammar", "[]"), ("h9", "rewrite", '[{"revised_text":""}]')]
JOINED = [("h1", "T1", "Yes", 1), ("h1", "T2", "No", 2), ("h2", "T3", " ", 3)]


@query(rf"""WITH c(essay_id, intensity, j) AS {values(POLISHED)}, m(text_hash, topic, ell, o) AS {values(JOINED)}, f AS (SELECT text_hash, arg_min(topic, o) AS topic, arg_min(ell, o) AS ell FROM m GROUP BY 1)
SELECT essay_id AS doc_id, 'polished_mixed' AS pool, 'persuade_corpus+llama3.2:3b' AS source, 'mixed' AS author_type, 'llama3.2:3b' AS generator, intensity AS prompt_condition, coalesce(nullif(trim(ell), ''), 'unknown') AS ell_flag, topic,
coalesce(list_sum(list_transform(from_json(j, '[{{"revised_text":"VARCHAR"}}]'), lambda x: len(list_filter(regexp_split_to_array(x.revised_text, '\s+'), lambda y: y <> '')))), 0)::BIGINT AS word_count, '{manifest.HUMAN_LICENSE}' AS license FROM c LEFT JOIN f ON essay_id = text_hash""")
def polished_manifest(spark, d):
    return manifest.polished(spark.createDataFrame(POLISHED, "essay_id string, intensity string, paragraphs_json string"), spark.createDataFrame(JOINED, "text_hash string, prompt_name string, ell_status string, o int"), "o")


ATTACKED = [("falcon::adv::1", "falcon_180b_v1", "T", "typo", 12), ("src::adv::2", "src", "U", "paraphrase", 7)]


@query(f"""WITH t(essay_id, source_family, topic, attack_type, word_count) AS {values(ATTACKED)} SELECT essay_id AS doc_id, 'adversarial' AS pool, source_family AS source, 'machine' AS author_type,
CASE source_family WHEN 'falcon_180b_v1' THEN 'Falcon-180B' ELSE source_family END || ' + ' || attack_type AS generator, attack_type AS prompt_condition, 'n/a' AS ell_flag, topic, word_count::BIGINT AS word_count, '{manifest.MACHINE_LICENSE}' AS license FROM t""")
def adversarial_manifest(spark, d):
    return manifest.adversarial(spark.createDataFrame(ATTACKED, "essay_id string, source_family string, topic string, attack_type string, word_count int"))


@query(f"""WITH t AS (SELECT doc_id, {WC} AS n, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS p FROM documents)
SELECT doc_id FROM t WHERE n >= 200 AND p >= 2 ORDER BY {ORDER.format('doc_id')} LIMIT 50""")
def essay_selection(spark, d):
    rows = ro.texts(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), tx.word_count(F.col("text")).alias("word_count"))
    return generate.select_essays(rows, "doc_id", 50).select("doc_id")


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda y: y <> '')[1:150], ' ') AS excerpt FROM documents ORDER BY (lang <> 'de'), {ORDER.format('doc_id')} LIMIT 1")
def exemplar_excerpt(spark, d):
    return sampling.exemplar(ro.docs(spark, d), "doc_id", "lang", "de").select("doc_id", tx.first_words(F.col("text"), 150).alias("excerpt"))


@query(r"""WITH r AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS k FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[^.!?]+[.!?]*') AS l FROM documents)),
c AS (SELECT doc_id, k, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM r)
SELECT doc_id, k::INTEGER AS sentence_index, (e - length(regexp_replace(s, '^\s+', '')))::BIGINT AS char_start, e::BIGINT AS char_end FROM c""")
def sentence_offsets(spark, d):
    return segment.sentence_offsets(ro.texts(spark, d), "doc_id", "text").select("doc_id", "sentence_index", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query(f"""WITH {ro.CORPUS}, g AS (SELECT abs(a.s - b.s) AS gap FROM (SELECT topic, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS s FROM corpus WHERE label = 0 GROUP BY 1) a FULL JOIN (SELECT topic, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS s FROM corpus WHERE label = 1 GROUP BY 1) b USING (topic))
SELECT (SELECT count(DISTINCT text) FROM documents) AS distinct_texts, (SELECT min(n) FROM (SELECT count(*) AS n FROM corpus GROUP BY label)) AS smallest_class, (SELECT round(max(gap), 6) FROM g) AS max_gap, (SELECT round(avg(CASE WHEN n_chars >= 1000 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM documents) AS long_share""")
def summary_aggregates(spark, d):
    docs = ro.docs(spark, d)
    rows = ro.corpus(spark, d).withColumn("author", F.when(F.col("label") == 0, "human").otherwise("machine"))
    one = docs.agg(F.count_distinct("text").alias("distinct_texts"), ro.r6(F.avg((F.col("n_chars") >= 1000).cast("double"))).alias("long_share"))
    least = rows.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n").alias("smallest_class"))
    gap = joins.topic_gap(rows, "author", "topic").agg(ro.r6(F.max("gap")).alias("max_gap"))
    return one.join(F.broadcast(least)).join(F.broadcast(gap)).select("distinct_texts", "smallest_class", "max_gap", "long_share")  # one row each


FEATURES_JSON = [("a::orig", '{"mattr": 0.5, "n_words": 10}'), ("a::attk", '{"mattr": 0.25}'), ("b::orig", "{}")]


@query(f"WITH t(doc_id, j) AS {values(FEATURES_JSON)} SELECT doc_id, (j->>'mattr')::DOUBLE AS mattr, (j->>'n_words')::DOUBLE AS n_words, j->>'other' IS NULL AS no_other FROM t")
def json_features(spark, d):
    rows = spark.createDataFrame(FEATURES_JSON, "doc_id string, j string").withColumn("s", F.from_json("j", "mattr double, n_words double, other string"))
    return rows.select("doc_id", "s.mattr", "s.n_words", F.col("s.other").isNull().alias("no_other"))


@query("SELECT doc_id, source || '::' || doc_id AS row_key, source || '::adv::' || doc_id AS adv_key, lpad(doc_id::VARCHAR, 9, '0') AS padded FROM documents WHERE source IS NULL OR source <> 'src7'")
def key_columns(spark, d):
    rows = ro.docs(spark, d).where(F.coalesce(F.col("source"), F.lit("")) != "src7")
    key = F.col("doc_id").cast("string")
    return rows.select("doc_id", F.concat_ws("::", "source", key).alias("row_key"), F.concat_ws("::", F.col("source"), F.lit("adv"), key).alias("adv_key"), F.lpad(key, 9, "0").alias("padded"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS p FROM documents),
q AS (SELECT doc_id, len(p) AS n, greatest(1, round_even(len(p) * (0.4::DOUBLE + 0.6::DOUBLE * (('0x' || substr(sha256('42:' || doc_id), 1, 4))::INTEGER / 65535.0::DOUBLE)), 0)) AS quota FROM t WHERE len(p) > 0),
e AS (SELECT doc_id, quota, unnest(range(0, n)) AS i FROM q)
SELECT doc_id, i::INTEGER AS paragraph_index, row_number() OVER (PARTITION BY doc_id ORDER BY sha256('42:' || doc_id || ':' || i), i) <= quota AS revise FROM e""")
def revision_plan(spark, d):
    rows = ro.texts(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return generate.revision_plan(rows, "doc_id").drop("original_text")
