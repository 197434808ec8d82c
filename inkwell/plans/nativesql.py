"""SQL of the native features and their z-scores."""

from __future__ import annotations

from inkwell.functions import text as tx
from inkwell.operators import annotate
from inkwell.operators.stylometry import NATIVE, STYLOMETRIC
from inkwell.plans import roles as ro


LIST_RE = r"(?i)([A-Za-z][\s\p{L}\p{N}_]{0,30}),\s*([A-Za-z][\s\p{L}\p{N}_]{0,30}?)(,)?\s+(and|or)\s+([A-Za-z][\s\p{L}\p{N}_]{0,30})"
NUMERAL = r"[\p{L}\p{N}]+(?:[.,/]\p{N}+)*"
NUMBER = r"^(?:[0-9]+(?:[.,/][0-9]+)*|" + "|".join(tx.NUMBER_WORDS) + ")$"
HOMOPHONES = " + ".join(rf"len(regexp_extract_all(text, '(?i)\b{p}\b'))" for p in tx.HOMOPHONE_ERRORS)
MARKERS = ", ".join(f"'{w}'" for w in tx.DISCOURSE_MARKERS)
NOT_JUST = r"(?i)\bnot\s+(?:just|only)\b[^\n]{0,60}?\bbut\b(?:\s+also)?"


def native(texts: str) -> str:
    """CTEs up to ``native``: native features of the documents that ``texts`` (a join or filter) leaves."""
    words = ro.WORDS.format("text")
    per100 = lambda count: f"coalesce(({count}) * (100.0::DOUBLE / nullif(len(w), 0)), 0)"
    mattr = "CASE WHEN len(w) < 2 THEN 0::DOUBLE WHEN len(w) <= 50 THEN list_unique(w)::DOUBLE / len(w) ELSE list_sum(list_transform(range(1, len(w) - 48), lambda i: list_unique(w[i:i + 49])))::DOUBLE / (50.0::DOUBLE * (len(w) - 49)) END"
    columns = {
        "sent_len_mean": "coalesce(sm, 0)", "sent_len_std": "coalesce(sd, 0)", "sent_len_burstiness": "coalesce(sd / nullif(sm, 0), 0)", "mattr": mattr, "hapax_rate": "coalesce(hapax, 0)",
        "em_dash_rate": per100("len(regexp_extract_all(text, '—')) + len(regexp_extract_all(text, '--'))"), "semicolon_rate": per100("len(regexp_extract_all(text, ';'))"),
        "oxford_comma_rate": "CASE WHEN len(l) = 0 THEN -1 ELSE len(list_filter(l, lambda x: x = ','))::DOUBLE / len(l) END", "discourse_marker_rate": per100(f"len(list_filter(w, lambda x: x IN ({MARKERS})))"),
        "homophone_error_rate": per100(HOMOPHONES), "numeral_rate": per100(f"len(list_filter(regexp_extract_all(lower(text), '{NUMERAL}'), lambda x: regexp_matches(x, '{NUMBER}')))"),
        "template_rate": per100(f"len(regexp_extract_all(text, '{NOT_JUST}')) + len(l)"),
    }
    return rf"""firsts AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY {ro.HASH.format("text")}),
t AS (SELECT doc_id, text, {words} AS w, regexp_extract_all(text, '{LIST_RE}', 3) AS l FROM documents {texts}),
s AS (SELECT doc_id, len(regexp_extract_all(lower(x), '[\p{{L}}]+'))::DOUBLE AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]*')) AS x FROM t) WHERE regexp_replace(x, '^\s+|\s+$', '', 'g') <> ''),
m AS (SELECT doc_id, avg(n) AS sm, stddev_pop(n) AS sd, count(*) AS n_sentences FROM s GROUP BY 1), c1 AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(w) AS x FROM t) GROUP BY 1, 2),
h1 AS (SELECT doc_id, count_if(k = 1)::DOUBLE / sum(k) AS hapax FROM c1 GROUP BY 1),
native AS (SELECT t.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, len(l)::BIGINT AS n_lists_detected, len(w)::BIGINT AS word_count, CASE WHEN len(w) < 250 THEN 'short' WHEN len(w) < 500 THEN 'medium' ELSE 'long' END AS band, {", ".join(f"{v} AS {k}" for k, v in columns.items())} FROM t LEFT JOIN m USING (doc_id) LEFT JOIN h1 USING (doc_id))"""


def zscores(rows: str, columns: list[str], base: str, extra: str, features: bool) -> str:
    """The z-scores of ``columns`` in a CTE ``rows``, against the baseline of rows where ``base`` holds; follows other CTEs."""
    z = lambda c: f"round((n.{c} - CASE WHEN b.{c}__s > 0 THEN b.{c}__m ELSE a.{c}__m END) / CASE WHEN b.{c}__s > 0 THEN b.{c}__s ELSE coalesce(nullif(a.{c}__s, 0), 1) END, 6) AS {c}_z"
    return f"""stats AS (SELECT band, {", ".join(f"avg({c}) AS {c}__m, stddev_samp({c}) AS {c}__s" for c in columns)} FROM {rows} WHERE {base} GROUP BY GROUPING SETS ((band), ()))
SELECT n.doc_id, {extra} n.word_count, {", ".join((f"round(n.{c}, 6) AS {c}, " if features else "") + z(c) for c in columns)} FROM {rows} n LEFT JOIN stats b ON n.band = b.band CROSS JOIN (SELECT * FROM stats WHERE band IS NULL) a"""


FLAGSHIP = f"WITH {native('SEMI JOIN firsts USING (doc_id)')}, {zscores('native', NATIVE, 'true', '', True)}"


def quoted(words: str) -> str:
    return ", ".join(f"'{w}'" for w in words.split())


_CLOSED = " ".join(f"WHEN lower(t) IN ({quoted(ws)}) THEN '{c}'" for c, ws in annotate.CLOSED.items())
_ENDINGS = " ".join(f"WHEN ends_with(lower(t), '{e}') AND length(t) > {len(e) + 2} THEN '{c}'" for e, c in annotate.ENDINGS)
CODE = rf"CASE WHEN t = ',' THEN ',' WHEN regexp_matches(t, '^\p{{Nd}}') THEN 'U' WHEN NOT regexp_matches(t, '^\p{{L}}') THEN '.' {_CLOSED} WHEN i > 1 AND regexp_matches(t, '^\p{{Lu}}') THEN 'P' {_ENDINGS} ELSE 'N' END"
#: Tagged sentences, features by document (the rules'), and spelling by the words of three documents or more.
TAGGED = rf"""tags AS (SELECT doc_id, sent, toks, list_transform(toks, lambda t, i: {CODE}) AS codes FROM (SELECT doc_id, generate_subscripts(l, 1) AS sent, regexp_extract_all(unnest(l), '{annotate.TOKEN}') AS toks FROM (SELECT doc_id, regexp_extract_all(text, '{tx.SENTENCE}') AS l FROM documents)) WHERE len(toks) > 0),
coded AS (SELECT *, array_to_string(codes, '') AS c FROM tags),
counted AS (SELECT *, greatest(1, len(regexp_extract_all(c, '[GVX]')))::DOUBLE AS clauses, len(regexp_extract_all(c, 'S')) + len(regexp_extract_all(regexp_replace(c, '[^SGVX]', '', 'g'), 'S[GVX]')) AS subordinate FROM coded),
worded AS (SELECT doc_id, string_agg(replace(regexp_replace(c, '[U.,]', '', 'g'), 'G', 'V'), '' ORDER BY sent) AS w, avg(clauses) AS clauses, avg(subordinate / clauses) AS subordination, count_if(regexp_matches(c, '^G.{{0,6}},'))::DOUBLE AS n_participial, sum(len(regexp_extract_all(c, 'P'))) AS proper, sum(len(regexp_extract_all(c, 'P+'))) AS entities FROM counted GROUP BY 1),
pos_grams AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(w) - 1), lambda k: substr(w, k, 3))) AS g FROM worded) GROUP BY 1, 2),
entropies AS (SELECT doc_id, log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n) AS h FROM pos_grams GROUP BY 1),
noted AS (SELECT doc_id, coalesce(len(regexp_extract_all(w, '[DARCSXT]'))::DOUBLE / nullif(length(w), 0), 0) AS function_word_rate, coalesce(h, 0) AS pos_trigram_entropy, coalesce(clauses, 0) AS clause_count_mean, coalesce(subordination, 0) AS subordination_ratio_mean, coalesce(n_participial, 0) AS n_participial,
coalesce(proper * 100.0::DOUBLE / nullif(length(w), 0), 0) AS proper_noun_rate, coalesce(entities * 100.0::DOUBLE / nullif(length(w), 0), 0) AS named_entity_rate FROM (SELECT doc_id FROM documents) LEFT JOIN worded USING (doc_id) LEFT JOIN entropies USING (doc_id))"""
SPELLED = rf"""checked AS (SELECT doc_id, unnest(list_transform(list_filter(list_zip(toks, codes), lambda x: length(x[1]) > 1 AND x[2] NOT IN ('P', 'U', '.', ',')), lambda x: lower(x[1]))) AS x FROM tags),
lex AS (SELECT x FROM (SELECT doc_id, unnest({ro.WORDS.format('text')}) AS x FROM documents) GROUP BY x HAVING count(DISTINCT doc_id) >= 3),
spelled AS (SELECT doc_id, count(*) AS n, count(DISTINCT CASE WHEN lex.x IS NULL THEN checked.x END) AS u FROM checked LEFT JOIN lex USING (x) GROUP BY 1)"""
FULL = f"""full_f AS (SELECT native.*, noted.* EXCLUDE (doc_id), template_rate + n_participial * coalesce(100.0::DOUBLE / nullif(word_count, 0), 0) AS construction_template_rate, coalesce(u::DOUBLE / nullif(n, 0), 0) AS spelling_error_rate
FROM native JOIN noted USING (doc_id) LEFT JOIN spelled USING (doc_id))"""


def document() -> str:
    return f"WITH {native('')}, {TAGGED}, {SPELLED}, {FULL} SELECT doc_id, n_sentences, word_count AS n_words, n_lists_detected, {', '.join(f'round({c}, 6) AS {c}' for c in STYLOMETRIC)} FROM full_f"
