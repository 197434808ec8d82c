"""Queries of scans, joins, aggregates, samples and manifests, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import stats as st
from inkwell.functions import text as tx
from inkwell.operators import joins, manifest, sampling, segment
from inkwell.plans import roles as ro

ORDER = "sha256('42:' || {0}::VARCHAR), {0}"
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


@query(f"SELECT {ro.HASH.format('text')} AS text_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def text_hash_dedup(spark, d):
    rows = ro.texts(spark, d).select("doc_id", tx.text_hash(F.col("text")).alias("text_hash"))
    return joins.keep_first(rows.withColumn("o", F.col("doc_id")), ["text_hash"], ["o"]).select("text_hash", "doc_id")


@query(f"""WITH {ro.CORPUS}, r AS (SELECT {ro.HASH.format('text')} AS h, doc_id, ell FROM corpus),
f AS (SELECT h, min(doc_id) AS essay_id, arg_min(ell, doc_id) AS ell FROM r GROUP BY h)
SELECT d.doc_id, f.h AS text_hash, f.essay_id, f.ell AS ell FROM documents d JOIN f ON {ro.HASH.format('d.text')} = f.h""")
def hash_join_demographics(spark, d):
    right = ro.corpus(spark, d).select(F.col("doc_id").alias("essay_id"), F.col("text").alias("full_text"), "ell")
    left = ro.texts(spark, d).select("doc_id", "text")
    return joins.hash_join(left, right, left_text="text", right_text="full_text", right_order=["essay_id"]).select("doc_id", "text_hash", "essay_id", "ell")


@query(f"""WITH {ro.CORPUS}, r AS (SELECT {ro.HASH.format('text')} AS h, min(ell) AS ell FROM corpus GROUP BY 1),
m AS (SELECT r.ell, r.h IS NOT NULL AS hit FROM documents d LEFT JOIN r ON {ro.HASH.format('d.text')} = r.h)
SELECT count(*) AS left_rows, count_if(hit)::BIGINT AS matched, round(count_if(hit)::DOUBLE / count(*), 6) AS match_rate, count_if(ell = 'Yes')::BIGINT AS ell_yes, count_if(ell = 'No')::BIGINT AS ell_no,
(count_if(hit) - count_if(ell = 'Yes') - count_if(ell = 'No'))::BIGINT AS ell_unknown, count_if(ell = 'Yes') < 200 AS recommend_more FROM m""")
def join_match_report(spark, d):
    out = joins.match_report(ro.texts(spark, d), ro.corpus(spark, d).select("text", "ell"), left_text="text", right_text="text", ell="ell")
    return out.withColumn("match_rate", ro.r6(F.col("match_rate")))


@query("SELECT doc_id, source, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def label_left_lookup(spark, d):
    return joins.lookup(ro.docs(spark, d).select("doc_id", "source"), ro.labels(spark, d), "doc_id", "quality", -1)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return joins.remaining(ro.docs(spark, d).select("doc_id"), ro.labels(spark, d), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def split_semi_join(spark, d):
    return joins.members(ro.docs(spark, d).select("doc_id", "lang"), ro.labels(spark, d), "doc_id")


@query("SELECT l.doc_id, d.n_chars FROM labels l JOIN documents d USING (doc_id)")
def strict_text_fetch(spark, d):
    return joins.fetch_strict(ro.labels(spark, d).select("doc_id"), ro.docs(spark, d).select("doc_id", "n_chars"), "doc_id")


@query("SELECT lang AS topic, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def topic_share(spark, d):
    return joins.topic_share(ro.docs(spark, d), "lang").withColumn("share", ro.r6(F.col("share")))


@query(f"""WITH {ro.CORPUS}, n AS (SELECT topic, count_if(label = 0) AS h, count_if(label = 1) AS m FROM corpus GROUP BY 1),
p AS (SELECT topic, h * 100.0::DOUBLE / sum(h) OVER () AS hp, m * 100.0::DOUBLE / sum(m) OVER () AS mp FROM n)
SELECT topic, round(hp, 6) AS human_pct, round(mp, 6) AS machine_pct, round(abs(hp - mp), 6) AS gap FROM p""")
def topic_gap(spark, d):
    rows = ro.corpus(spark, d).withColumn("author", F.when(F.col("label") == 0, "human").otherwise("machine"))
    out = joins.topic_gap(rows, "author", "topic")
    return out.withColumns({c: ro.r6(F.col(c)) for c in ("human_pct", "machine_pct", "gap")})


@query("SELECT source, label, count(*) AS n FROM (SELECT d.source, (1 - l.quality)::BIGINT AS label FROM documents d JOIN labels l USING (doc_id)) GROUP BY 1, 2 HAVING label = 1 AND source NOT IN ('src0', 'src1')")
def machine_families(spark, d):
    rows = ro.corpus(spark, d)
    return rows.where((F.col("label") == 1) & ~F.col("source").isin("src0", "src1")).groupBy("source", "label").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM documents ORDER BY {ORDER.format('doc_id')} LIMIT 100")
def uniform_sample(spark, d):
    return sampling.uniform(ro.docs(spark, d).select("doc_id"), "doc_id", 100)


BALANCED = """q AS (SELECT least(count_if(ell = 'Yes'), {n} // 2) AS y FROM {t}),
k AS (SELECT *, row_number() OVER (PARTITION BY ell ORDER BY """ + ORDER.format("doc_id") + """) AS rn FROM {t})"""


@query(f"WITH {ro.CORPUS}, {BALANCED.format(n=60, t='corpus')} SELECT doc_id, ell FROM k, q WHERE rn <= CASE WHEN ell = 'Yes' THEN y ELSE 60 - y END")
def balanced_sample(spark, d):
    return sampling.balanced(ro.corpus(spark, d).select("doc_id", "ell"), "doc_id", "ell", 60)


def stratified_sql(rows: str, n: int) -> str:
    return f"""(SELECT doc_id FROM (SELECT r.doc_id, s.share, row_number() OVER (PARTITION BY r.topic ORDER BY {ORDER.format('r.doc_id')}) AS rn FROM {rows} r JOIN share s USING (topic))
WHERE rn <= round_even(share * {n}, 0) ORDER BY {ORDER.format('doc_id')} LIMIT {n})"""


SHARE = "share AS (SELECT lang AS topic, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM documents GROUP BY 1)"


@query(f"WITH {SHARE}, rows_ AS (SELECT doc_id, lang AS topic FROM documents) SELECT doc_id FROM {stratified_sql('rows_', 200)}")
def stratified_sample(spark, d):
    rows = ro.docs(spark, d)
    return sampling.stratified(rows.select("doc_id", "lang"), "doc_id", "lang", joins.topic_share(rows, "lang"), 200).select("doc_id")


MACHINES = "m AS (SELECT doc_id, topic, source FROM corpus WHERE label = 1 AND source NOT IN ('src0')), held AS (SELECT * FROM m WHERE source = 'src7'), train AS (SELECT * FROM m WHERE source <> 'src7')"


def machine_pools(spark, d):
    share = joins.topic_share(ro.docs(spark, d), "lang")
    return sampling.split_machines(ro.corpus(spark, d), "doc_id", "topic", "source", share, held_out="src7", excluded=["src0"], training_n=30, heldout_n=5)


@query(f"WITH {SHARE}, {ro.CORPUS}, {MACHINES} SELECT 'training' AS pool, doc_id FROM {stratified_sql('train', 30)} UNION ALL SELECT 'heldout' AS pool, doc_id FROM {stratified_sql('held', 5)}")
def heldout_split(spark, d):
    train, held = machine_pools(spark, d)
    return joins.union_pools({"training": train.select("doc_id"), "heldout": held.select("doc_id")}).select("pool", "doc_id")


HUMANS = f"""h AS (SELECT * FROM corpus WHERE label = 0), base AS (SELECT doc_id FROM h ORDER BY {ORDER.format('doc_id')} LIMIT 50),
rest AS (SELECT * FROM h WHERE doc_id NOT IN (SELECT doc_id FROM base)), {BALANCED.format(n=40, t='rest')}, tr AS (SELECT doc_id FROM k, q WHERE rn <= CASE WHEN ell = 'Yes' THEN y ELSE 40 - y END)"""


def human_pools(spark, d):
    return sampling.split_humans(ro.corpus(spark, d).where("label = 0"), "doc_id", "ell", 50, 40)


@query(f"WITH {ro.CORPUS}, {HUMANS} SELECT 'baseline' AS pool, doc_id FROM base UNION ALL SELECT 'training' AS pool, doc_id FROM tr")
def human_split(spark, d):
    base, train = human_pools(spark, d)
    return joins.union_pools({"baseline": base.select("doc_id"), "training": train.select("doc_id")}).select("pool", "doc_id")


@query(f"""WITH {ro.CORPUS}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {ORDER.format('doc_id')}) AS rn, count(*) OVER (PARTITION BY label) AS n FROM corpus)
SELECT doc_id, label, CASE WHEN rn <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM r""")
def train_test_split(spark, d):
    return sampling.train_test(ro.corpus(spark, d).select("doc_id", "label"), "doc_id", "label")


@query(f"SELECT doc_id, ['typo', 'paraphrase', 'none'][(row_number() OVER (ORDER BY {ORDER.format('doc_id')}) - 1) % 3 + 1] AS attack FROM labels")
def balanced_label_shuffle(spark, d):
    return sampling.balanced_labels(ro.labels(spark, d).select("doc_id"), "doc_id", ["typo", "paraphrase", "none"], "attack")


NAMES = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in manifest.GENERATORS.items()) + " ELSE source END"
WC = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT"


@query(f"""WITH {SHARE}, {ro.CORPUS}, {HUMANS}, {MACHINES}, human AS (
SELECT {ro.HASH.format('c.text')} || ':' || c.doc_id AS doc_id, p.pool, 'persuade_corpus' AS source, 'human' AS author_type, 'n/a' AS generator, 'n/a' AS prompt_condition, c.ell AS ell_flag, c.topic, {WC} AS word_count, '{manifest.HUMAN_LICENSE}' AS license
FROM corpus c JOIN (SELECT doc_id, 'human_baseline' AS pool FROM base UNION ALL SELECT doc_id, 'human_training' FROM tr) p USING (doc_id)), machine AS (
SELECT c.source || '::' || c.doc_id AS doc_id, p.pool, c.source, 'machine' AS author_type, {NAMES} AS generator, 'unknown (DAIGT-provided)' AS prompt_condition, 'n/a' AS ell_flag, c.topic, {WC} AS word_count, '{manifest.MACHINE_LICENSE}' AS license
FROM corpus c JOIN (SELECT doc_id, 'machine_training' AS pool FROM {stratified_sql('train', 30)} UNION ALL SELECT doc_id, 'machine_heldout_family' FROM {stratified_sql('held', 5)}) p USING (doc_id))
SELECT * FROM human UNION ALL SELECT * FROM machine""")
def manifest_union(spark, d):
    def shaped(df):
        key = F.concat_ws(":", tx.text_hash(F.col("text")), F.col("doc_id").cast("string"))
        return df.select(key.alias("text_hash"), F.col("doc_id").alias("row_ord"), "text", "source", F.col("ell").alias("ell_status"), F.col("topic").alias("prompt_name"), tx.word_count(F.col("text")).alias("word_count"))

    (base, train), (mtrain, held) = human_pools(spark, d), machine_pools(spark, d)
    return manifest.build({"human_baseline": shaped(base), "human_training": shaped(train), "machine_training": shaped(mtrain), "machine_heldout_family": shaped(held)})


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def uniqueness_violations(spark, d):
    return joins.duplicates(ro.docs(spark, d), "source")


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS paragraph_index, unnest(l) AS paragraph FROM p""")
def paragraphs(spark, d):
    return segment.paragraphs(ro.texts(spark, d), "doc_id", "text", "\n")


PARAS = [(1, "One. Two!\n\nThree?"), (2, "\n\n  \n\nOnly one here \n\n\n\n next one."), (3, ""), (4, "no end")]


@query(rf"""WITH t(doc_id, text) AS {values(PARAS)}, p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM t),
q AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS paragraph_index, unnest(l) AS p FROM p), s AS (SELECT doc_id, paragraph_index, regexp_extract_all(p, '[^.!?]+[.!?]*') AS l FROM q),
x AS (SELECT doc_id, paragraph_index, (generate_subscripts(l, 1) - 1)::INTEGER AS sentence_index, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS text FROM s)
SELECT *, {WC} AS word_count FROM x WHERE text <> ''""")
def segment_fixture(spark, d):
    return segment.sentences(spark.createDataFrame(PARAS, "doc_id int, text string"), "doc_id", "text")


@query(rf"WITH {ro.SENTENCES}, x AS (SELECT doc_id, sent::INTEGER AS sentence_index, s AS text FROM sentences) SELECT doc_id, 0 AS paragraph_index, sentence_index, text, {WC} AS word_count FROM x")
def sentences(spark, d):
    return segment.sentences(ro.texts(spark, d), "doc_id", "text")


@query(f"""WITH {ro.SENTENCES}, n AS (SELECT doc_id, sent, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY sent) - 1 AS k FROM sentences),
t AS (SELECT doc_id, sent, CASE WHEN n <= 3 THEN -1 WHEN k < n // 3 THEN 0 WHEN k < 2 * (n // 3) THEN 1 ELSE 2 END AS tercile FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tercile ORDER BY sha256('42:' || doc_id || ':' || sent)) AS rn FROM t)
SELECT doc_id, sent::INTEGER AS sentence_index, tercile FROM r WHERE tercile = -1 OR rn = 1""")
def tercile_sample(spark, d):
    rows = segment.sentences(ro.texts(spark, d), "doc_id", "text").select("doc_id", "sentence_index")
    return sampling.sample_sentences(rows, "doc_id", "sentence_index")


JSON_ROWS = [("e1", '[{"paragraph_index":0,"original_text":"a b","revised_text":"one two three","was_revised":true},{"paragraph_index":1,"original_text":"c","revised_text":"c  d","was_revised":false}]'), ("e2", "[]"), ("e3", '[{"paragraph_index":0,"revised_text":"x"}]')]


@query(rf"""WITH t(essay_id, j) AS {values(JSON_ROWS)}, p AS (SELECT essay_id, from_json(j, '[{{"paragraph_index":"INTEGER","revised_text":"VARCHAR","was_revised":"BOOLEAN"}}]') AS p FROM t)
SELECT essay_id, coalesce(list_sum(list_transform(p, lambda x: len(list_filter(regexp_split_to_array(x.revised_text, '\s+'), lambda y: y <> '')))), 0)::BIGINT AS words,
len(list_filter(p, lambda x: coalesce(x.was_revised, false)))::BIGINT AS revised, array_to_string(list_transform(p, lambda x: x.revised_text), chr(10) || chr(10)) AS body FROM p""")
def json_paragraphs(spark, d):
    j = F.col("j")
    return spark.createDataFrame(JSON_ROWS, "essay_id string, j string").select("essay_id", manifest.revised_words(j).alias("words"), manifest.revised_count(j).alias("revised"), manifest.revised_text(j).alias("body"))


NORM = [(1, "  A\tB \n c  "), (2, ""), (3, "a b c"), (4, "ÄÖ  ü"), (5, None)]


@query(rf"WITH t(id, x) AS {values(NORM)} SELECT id, lower(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS norm, {ro.HASH.format('x')} AS hash FROM t")
def normalize_fixture(spark, d):
    return spark.createDataFrame(NORM, "id int, x string").select("id", tx.normalize(F.col("x")).alias("norm"), tx.text_hash(F.col("x")).alias("hash"))


#: What replies begin with, by the remainder of their id; the last isn't a preamble.
PREAMBLES = ["Here is the revised paragraph:\n\n", "Sure, I can help.\n\n ", "Certainly! I've rewritten it below.\n\n", "", "Here in this town we live.\n\n"]
_PICK = " ".join(f"WHEN {k} THEN '" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for k, p in enumerate(PREAMBLES))
_STRIPPED = r"CASE WHEN regexp_matches(x, re) THEN regexp_replace(regexp_replace(x, re, ''), '^\s+|\s+$', '', 'g') ELSE x END"
_RE = "'" + tx.PREAMBLE + "' AS re"


@query(f"""WITH t AS (SELECT doc_id, (CASE doc_id % {len(PREAMBLES)} {_PICK} END) || text AS x, {_RE} FROM documents) SELECT doc_id, sha256({_STRIPPED}) AS sha256 FROM t""")
def strip_preamble(spark, d):
    begin = F.element_at(F.array(*map(F.lit, PREAMBLES)), (F.pmod("doc_id", F.lit(len(PREAMBLES))) + 1).cast("int"))
    return ro.docs(spark, d).select("doc_id", F.sha2(tx.strip_preamble(F.concat(begin, F.col("text"))), 256).alias("sha256"))


@query(f"WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'Certainly.' || chr(10) || chr(10) || text ELSE text END AS x, {_RE} FROM conversations) SELECT conv_id, turn, {_STRIPPED} AS y FROM t")
def strip_preamble_turns(spark, d):
    reply = F.when(F.col("role") == "assistant", F.concat(F.lit("Certainly.\n\n"), F.col("text"))).otherwise(F.col("text"))
    return ro.table(spark, d, "conversations").select("conv_id", "turn", tx.strip_preamble(reply).alias("y"))


@query("SELECT doc_id, CASE WHEN n < 250 THEN 'short' WHEN n < 500 THEN 'medium' ELSE 'long' END AS band, n AS word_count FROM (SELECT doc_id, " + WC + " AS n FROM documents)")
def length_bands(spark, d):
    n = tx.word_count(F.col("text"))
    return ro.texts(spark, d).select("doc_id", st.length_band(n).alias("band"), n.alias("word_count"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    from inkwell.streaming.incremental import windowed_counts

    return windowed_counts(ro.table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("""WITH u AS (SELECT doc_id, source, 1 AS o, 'spanish' AS pool FROM documents WHERE lang = 'es' UNION ALL SELECT doc_id, source, 2, 'labelled' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, source, 3, 'family' FROM documents WHERE source = 'src2')
SELECT doc_id, arg_min(source, o) AS source, arg_min(pool, o) AS pool FROM u GROUP BY 1""")
def union_keep_first(spark, d):
    rows = ro.docs(spark, d).select("doc_id", "source", "lang")
    labelled = joins.members(rows, ro.labels(spark, d), "doc_id")
    pools = {"spanish": rows.where("lang = 'es'"), "labelled": labelled, "family": rows.where("source = 'src2'")}
    return joins.union_first({k: v.select("doc_id", "source") for k, v in pools.items()}, "doc_id")
