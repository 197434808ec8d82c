"""Behaviour of the library's own operators on small inline frames."""

import hashlib
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkwell.functions import stats
from inkwell.functions import stats as st
from inkwell.functions import text as tx
from inkwell.operators import annotate, attacks, baseline, drivers, generate, joins, likelihood, manifest, metrics, model, sampling, segment, stylometry
from inkwell.plans import textual
from inkwell.runtime import shared_folder
from inkwell.sources import checkpoint, corpora
from inkwell.streaming import incremental


def value(spark, column, *rows, schema="x string"):
    return [r.v for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column.alias("v")).collect()]




def test_normalize_is_idempotent_and_unicode(spark):
    texts = ["  A\tB \n c ", "A b C", "a b c", " a b\x1cc "]
    assert value(spark, tx.normalize(F.col("x")), *texts) == ["a b c"] * 4
    assert value(spark, tx.normalize(tx.normalize(F.col("x"))), *texts) == ["a b c"] * 4
    assert len(set(value(spark, tx.text_hash(F.col("x")), *texts))) == 1


def test_paragraphs_and_sentences(spark):
    df = spark.createDataFrame([("d", "One here. Two!\n\n\n\n Three? \n\n"), ("e", ""), ("f", None)], "doc string, t string")
    got = [tuple(r) for r in segment.sentences(df, "doc", "t").orderBy("paragraph_index", "sentence_index").collect()]
    assert got == [("d", 0, 0, "One here.", 2), ("d", 0, 1, "Two!", 1), ("d", 1, 0, "Three?", 1)]
    spans = segment.sentence_offsets(df, "doc", "t").collect()
    assert {r.paragraph[r.char_start : r.char_end] for r in spans} == {"One here.", "Two!", "Three?"}


def test_preamble(spark):
    texts = ["Here is the revised paragraph:\n\n Body. ", "Sure! Yes.\n\nBody.", "Certainly\n\nBody.", " Here in this town. ", "Plain\n\ntext", "Surely not\n\nx"]
    assert value(spark, tx.strip_preamble(F.col("x")), *texts) == ["Body.", "Body.", "Body.", " Here in this town. ", "Plain\n\ntext", "Surely not\n\nx"]


def test_small_functions(spark):
    assert value(spark, tx.strip_punct(F.col("x")), "(ab-c)!", "...", "a") == ["ab-c", "", "a"]
    assert value(spark, tx.capitalize(F.col("x")), "wORD", "") == ["Word", ""]
    assert value(spark, tx.count_literal(F.col("x"), "--"), "--- -- a") == [2]
    assert value(spark, tx.first_words(F.col("x"), 2), " a  b c") == ["a b"]
    assert value(spark, tx.slug(F.col("x")), "m3.2:1b") == ["m3-2-1b"]
    assert value(spark, st.length_band(F.col("x")), 100, 249, 250, 499, 500, 10000, -1, None, schema="x int") == ["short", "short", "medium", "medium", "long", "long", "long", "long"]


def test_wilson_golden(spark):
    low, high = st.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(0, 3), (0, 2), (0, 0), (7, 9)], "k int, n int").select(low.alias("a"), high.alias("b")).collect()
    assert got[0].b == pytest.approx(0.5615060804490177) and got[1].b == pytest.approx(0.658, abs=5e-4) and tuple(got[2]) == (0.0, 1.0)
    assert all(0 <= r.a <= r.b <= 1 for r in got)


def features(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.asDict() for r in stylometry.native_features(rows, "id").orderBy("id").collect()]


def test_stylometry_cases(spark):
    a, b, c, none, null = features(spark, "Red, blue, and green.", "Red, blue and green.", "He could of gone -- yes; moreover he Should of. Two!", "", None)
    assert (a["n_lists_detected"], a["oxford_comma_rate"], b["oxford_comma_rate"]) == (1, 1.0, 0.0)
    assert c["homophone_error_rate"] == pytest.approx(2 * 100 / c["n_words"]) and c["discourse_marker_rate"] > 0 and c["numeral_rate"] > 0
    assert c["em_dash_rate"] == c["semicolon_rate"] > 0
    for f in (none, null):
        assert f.pop("oxford_comma_rate") == -1 and not any(v for k, v in f.items() if k != "id")


def test_mattr_and_hapax_against_plain_python(spark):
    import random

    r = random.Random(4)
    lists = [[r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)] for n in (0, 1, 2, 49, 50, 51, 120, 400)] + [["x"] * 99, [f"w{k}" for k in range(99)]]

    def plain(w):
        if len(w) < 2:
            return 0.0
        if len(w) <= 50:
            return len(set(w)) / len(w)
        return sum(len(set(w[i : i + 50])) / 50 for i in range(len(w) - 49)) / (len(w) - 49)

    df = spark.createDataFrame([(w,) for w in lists], "w array<string>")
    got = df.select(stylometry.mattr(F.col("w")).alias("m"), stylometry.hapax_rate(F.col("w")).alias("h")).collect()
    assert [g.m for g in got] == pytest.approx([plain(w) for w in lists])
    assert [g.h for g in got] == pytest.approx([sum(w.count(x) == 1 for x in w) / len(w) if w else 0 for w in lists])


def test_annotator(spark):
    df = spark.createDataFrame([("a", "Walking home, the Doctor said that Bob left because it rained."), ("b", ""), ("c", None)], "doc_id string, text string")
    a, b, c = (r.asDict() for r in annotate.annotate(df, "doc_id").orderBy("doc_id").collect())
    assert a["n_participial"] == 1 and a["proper_noun_rate"] > 0 and a["function_word_rate"] > 0 and a["pos_trigram_entropy"] > 0
    assert not any(v for k, v in b.items() if k != "doc_id") and not any(v for k, v in c.items() if k != "doc_id")


TEXTS = ["Walking home, the Doctor said that Bob Smith left because it rained. Although it was late, we stayed; 3 or 4,5 of us.", "while if. ran, walked, Jumped Over! organize quickly famous", "", None, "ALL CAPS Words Here", "1 2, three. because because is are", "naïve Über-straße né Élan; 𝒳 — ok"]


class PlainRules:
    """The rules, token by token."""

    def tag(self, sentence):
        out, rooted, marked = [], False, False
        names = {"D": "DET", "A": "ADP", "R": "PRON", "C": "CCONJ", "S": "SCONJ", "X": "AUX", "T": "PART", "B": "ADV", "G": "VERB", "V": "VERB", "J": "ADJ"}
        letter = lambda c: unicodedata.category(c)[0] == "L"
        digit = lambda c: unicodedata.category(c) == "Nd"
        k, tokens = 0, []
        while k < len(sentence):
            e = k + 1
            if letter(sentence[k]):
                while e < len(sentence) and letter(sentence[e]):
                    e += 1
            elif digit(sentence[k]):
                while e < len(sentence) and (digit(sentence[e]) or sentence[e] in ".,/" and e + 1 < len(sentence) and digit(sentence[e + 1])):
                    e += 1
            if sentence[k] not in " \t\n\x0b\f\r":
                tokens.append(sentence[k:e])
            k = e
        for k, word in enumerate(tokens):
            low, tag = word.lower(), ""
            pos = next((names[c] for c, ws in annotate.CLOSED.items() if low in ws.split()), None)
            if digit(word[0]):
                pos = "NUM"
            elif not letter(word[0]):
                pos = "PUNCT"
            elif pos is None and k and unicodedata.category(word[0]) == "Lu":
                pos = "PROPN"
            elif pos is None:
                c = next((c for end, c in annotate.ENDINGS if low.endswith(end) and len(word) > len(end) + 2), "N")
                pos, tag = names.get(c, "NOUN"), "VBG" if c == "G" else ""
            dep = "dep"
            if pos == "SCONJ":
                dep, marked = "mark", True
            elif pos in ("VERB", "AUX"):
                dep, marked, rooted = ("advcl" if marked else "conj" if rooted else "ROOT"), False, True
            out.append(annotate.Token(word, pos, tag, dep))
        return out


def test_rules_match_a_plain_tagger(spark):
    """The expressions and the annotator seam give the same, the rules being the tagger."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    native = annotate.annotate(df, "doc_id").orderBy("doc_id").collect()
    seam = annotate.annotate(df, "doc_id", tagger=PlainRules()).orderBy("doc_id").collect()
    assert [list(r.asDict()) for r in native] == [list(r.asDict()) for r in seam]
    for a, b in zip(native, seam):
        assert tuple(a) == pytest.approx(tuple(b))


def test_spelling_leaves_proper_nouns_out(spark):
    df = spark.createDataFrame([("a", "The cat met Zorblax and zorblax. Qwxyz 12 a"), ("b", "")], "doc_id string, text string")
    known = spark.createDataFrame([("the",), ("cat",), ("met",), ("and",)], "word string")
    a, b = stylometry.spelling_rate(df, "doc_id", known).orderBy("doc_id").collect()
    assert (a.n_checkable, a.n_unknown) == (6, 2) and a.spelling_error_rate == pytest.approx(2 / 6)
    assert (b.n_checkable, b.n_unknown, b.spelling_error_rate) == (0, 0, 0)


def test_numbering_is_gapless(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 3)
    rows = sampling.numbered(df, "id", "n", by=["g"]).collect()
    for g in range(3):
        assert sorted(r.n for r in rows if r.g == g) == list(range(1000))
    order = [r.id for r in sorted(sampling.numbered(df, "id", "n").collect(), key=lambda r: r.n)]
    assert order == [r.id for r in df.orderBy(stats.hash_order(42, F.col("id")), "id").collect()]


def test_folds_hold_both_labels(spark):
    """Three rows of one label are enough, wherever their hashes fall."""
    for seed in range(3):
        df = spark.createDataFrame([(i, int(i < 3), float(i < 3) + i / 1000) for i in range(60)], "id long, label int, a_z double")
        fitted = model.fit(df, "id", ["a_z"], seed=seed)
        assert len(fitted.folds) == 3 and metrics.auc(fitted.score(df), "probability", "label").first().auc > 0.9


def test_smoothed_targets(spark):
    held = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (0.0, 0.0)], "_m double, label double")
    got = {(r._m, r.label): r.weight for r in model.smoothed(held).collect()}
    assert got == pytest.approx({(1.0, 1.0): 3 / 4, (1.0, 0.0): 1 / 4, (2.0, 1.0): 3 / 4, (2.0, 0.0): 1 / 4, (0.0, 1.0): 1 / 3, (0.0, 0.0): 2 / 3})


def test_training_run_saves_and_loads(spark, tmp_path):
    import random

    r = random.Random(2)
    df = spark.createDataFrame([(i, i % 2, r.gauss(i % 2 * 2, 1)) for i in range(200)], "id long, label int, a_z double")
    fitted, split, report = model.train(df, "id", ["a_z"], path=f"{tmp_path}/m")
    row = report.first()
    assert (row.rows_train, row.rows_test) == (160, 40) and row.accuracy_test > 0.7
    again = model.CalibratedModel.load(spark, f"{tmp_path}/m")
    assert again.features == fitted.features and again.coefficients() == pytest.approx(fitted.coefficients())
    pairs = zip(fitted.score(df).orderBy("id").collect(), again.score(df).orderBy("id").collect())
    assert all(a.probability == pytest.approx(b.probability) for a, b in pairs)
    assert spark.read.parquet(f"{tmp_path}/m/split").where("split = 'test'").count() == 40
    with pytest.raises(FileNotFoundError, match="train and save"):
        model.CalibratedModel.load(spark, f"{tmp_path}/none")
    names = [n for n, _ in model.ablation(df.withColumn("cross_ppl_ratio_z", F.lit(0.0)), "id", ["a_z", "cross_ppl_ratio_z"])]
    assert names == ["full_model", "without_likelihood_all", "without_cross_ppl_ratio", "without_punctuation_construction", "without_error_rates", "without_concreteness"]
    assert {v for _, v in model.ablation(df.where("label = 1"), "id", ["a_z"])} == {None}


PROSE = "The river ran past the old mill and the road. We walked along it because the day was warm. Nobody spoke for a long while, and then everyone did. "


@pytest.fixture
def essays(spark):
    rows = [(f"e{k:02}", PROSE * (1 + k % 8) + f"Word{k} ends it.", "src0" if k % 3 else "src1", f"t{k % 2}", k % 2) for k in range(24)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string, prompt_name string, label int")


def test_target_union(spark, essays):
    humans = essays.where("label = 0").select(F.col("doc_id").alias("text_hash"), "text", F.lit(9).alias("word_count"), F.when(F.col("source") == "src0", "Yes").otherwise("No").alias("ell_status"), "prompt_name")
    machines = essays.where("label = 1")
    polished = spark.createDataFrame([("p1", '[{"revised_text":"one two"},{"revised_text":"three"}]')], "essay_id string, paragraphs_json string")
    modern = spark.createDataFrame([("m1", "some text", 2)], "essay_id string, text string, word_count int")
    sizes = {"baseline": 3, "human_training": 4, "machine_training": 5, "machine_heldout": 2, "polished": 2, "modern_gen": 9}
    humans = humans.withColumn("prompt_name", F.lit("t1"))  # machines are stratified by the humans' topics
    rows = drivers.target_documents(humans, machines, polished, modern, held_out="src1", excluded=[], sizes=sizes).collect()
    per = {}
    for r in rows:
        per.setdefault(r.pool, []).append(r)
    assert {k: len(v) for k, v in per.items()} == {"baseline": 3, "human_training": 4, "machine_training": 5, "machine_heldout": 2, "polished": 1, "modern_gen": 1}
    assert len({r.doc_id for r in rows}) == len(rows)
    assert (per["polished"][0].text, per["polished"][0].word_count) == ("one two\n\nthree", 3)


def test_likelihood_run_resumes_after_failures(spark, essays, tmp_path):
    targets = essays.select("doc_id", "text", F.lit("baseline").alias("pool"))
    path = f"{tmp_path}/likelihood"

    def scorer(broken):
        def make():
            def score(context, start):
                if broken and "Word7 " in context[start:]:
                    raise RuntimeError("down")
                return [(-1.0, 2, 0.5, -2.0)] * 3

            return score

        return drivers.token_scorer(make, every=True)

    first = drivers.run_likelihood(targets, path, scorer(True))
    assert {r.doc_id for r in first.select("doc_id").collect()} == {f"e{k:02}" for k in range(24)} - {"e07"}
    rows = drivers.run_likelihood(targets, path, scorer(False))
    assert rows.select("doc_id").distinct().count() == 24 and rows.groupBy("doc_id", "paragraph_index", "sentence_index").count().where("count > 1").isEmpty()
    assert rows.where("pool = 'baseline' and cross_ppl_ratio is not null").count() == rows.count()


def test_modern_run_resumes_after_failures(spark, tmp_path):
    joined = spark.createDataFrame([(k, f"words of essay {k} " * 90, t, f"Write: {t}") for k, t in enumerate(generate.TOPICS)], "doc_id long, text string, prompt_name string, assignment string")
    path = f"{tmp_path}/modern"

    class Half:
        def generate(self, model, prompt):
            if model == generate.MODELS[1]:
                raise RuntimeError("down")
            return "Certainly.\n\n" + prompt

    class Whole:
        def generate(self, model, prompt):
            return prompt

    assert drivers.run_modern(joined, path, Half, per_model=8).count() == 16
    rows = drivers.run_modern(joined, path, Whole, per_model=8).collect()
    assert len(rows) == len({r.essay_id for r in rows}) == 24 and not any(r.text.startswith("Certainly") for r in rows)
    styled = [r for r in rows if r.condition == "style_exemplar"]
    assert styled and all(f"words of essay {generate.TOPICS.index(r.topic)} " in r.text for r in styled) and all(r.word_count > 150 for r in styled)


def test_adversarial_runs(spark, essays, tmp_path):
    used = essays.where("doc_id in ('e01', 'e03')")
    pool = drivers.adversarial_pool(essays, used, "doc_id", 8, excluded=["src9"])
    rows = pool.collect()
    assert len(rows) == 8 and not {"e01", "e03"} & {r.doc_id for r in rows} and {r.label for r in rows} == {1}
    assert sorted(sum(r.attack_type == a for r in rows) for a in drivers.ATTACKS) == [4, 4]
    attacked = drivers.run_adversarial(pool, f"{tmp_path}/a")
    again = drivers.run_adversarial(pool, f"{tmp_path}/a")
    assert attacked.count() == again.count() == 8 and all(r.essay_id.split("::")[1] == "adv" for r in again.collect())
    grams = likelihood.bigrams(essays, "doc_id", "text")
    m = likelihood.train_bigram(grams)
    scorer = drivers.bigram_scorer(m, m, every=True)
    known = stylometry.lexicon(essays, "text", 2)
    features = drivers.run_adversarial_features(again, f"{tmp_path}/f", scorer, known)
    assert features.count() == 16 and drivers.run_adversarial_features(again, f"{tmp_path}/f", scorer, known).count() == 16
    style = stylometry.document_features(essays, "doc_id", known)
    joined = drivers.feature_join(style, likelihood.sentence_features(likelihood.score_corpus(grams, F.lit(True), "doc_id"), ["doc_id", "sent"]))
    assert joined.count() == 24
    stat = baseline.baseline_stats(joined, stylometry.FEATURES)
    frame = baseline.zscore(joined.join(essays.select("doc_id", "label"), "doc_id"), stylometry.FEATURES, stat, fallback="unit")
    fitted = model.fit(frame, "doc_id", [f"{c}_z" for c in stylometry.FEATURES])
    table = {r.attack: r for r in drivers.robustness(features, fitted, stat).collect()}
    assert set(table) == {"overall", *drivers.ATTACKS} and table["overall"].n == 8
    out = {r.doc_id: r for r in drivers.analyze(essays, fitted, stat, known, scorer).collect()}
    short, long = out["e00"], out["e07"]
    assert short.abstained and "150" in short.abstain_reason and short.probability is None and short.evidence is None
    assert not long.abstained and 0 <= long.band_low <= long.probability <= long.band_high <= 1 and len(long.evidence) == 26
    sizes = [abs(e.contribution) for e in long.evidence]
    assert sizes == sorted(sizes, reverse=True) and {s.heat for s in long.sentences} >= {0.0, 1.0}


def test_configuration_has_all_parts(tmp_path, caplog):
    (tmp_path / "c.yaml").write_text("scorer:\n  base_model: other\nsampling:\n  ell_target_ratio: 1\nunheard_of: 1\n")
    c = checkpoint.load_config(f"{tmp_path}/c.yaml")
    assert (c.scorer.base_model, c.scorer.instruct_model) == ("other", "Qwen/Qwen2.5-0.5B-Instruct") and c.sampling.ell_target_ratio == 1.0
    assert c.decision.min_words_for_verdict == 150 and len(c.ollama.models) == 3 and "unheard_of" in caplog.text
    (tmp_path / "d.yaml").write_text("decision:\n  operating_point: whatever\n")
    with pytest.raises(ValueError):
        checkpoint.load_config(f"{tmp_path}/d.yaml")


def test_shared_folder(spark):
    class Cluster:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "a"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)
    assert shared_folder(spark)


def test_hung_server_fails(monkeypatch):
    from urllib import request

    calls = []

    def urlopen(req, timeout):
        calls.append(timeout)
        raise TimeoutError

    monkeypatch.setattr(request, "urlopen", urlopen)
    monkeypatch.setattr("time.sleep", lambda s: None)
    with pytest.raises(TimeoutError):
        generate.HttpClient(timeout=5).generate("m", "p")
    assert calls == [5] * 3


def test_document_features_have_all_columns(spark):
    df = spark.createDataFrame([("a", "One two three. Four five."), ("b", "")], "doc_id string, text string")
    out = stylometry.document_features(df, "doc_id", stylometry.lexicon(df, "text", 1))
    assert set(stylometry.STYLOMETRIC) <= set(out.columns) and len(stylometry.FEATURES) == 26 and out.count() == 2


def test_hash_join_and_report(spark):
    left = spark.createDataFrame([("A  b", "p1"), ("c d", "p2"), ("zz", "p3")], "text string, prompt_name string")
    right = spark.createDataFrame([(1, "a B", "Yes", "q"), (2, "a b", "No", "q"), (3, "C D ", None, "q"), (4, "other", "Yes", "q")], "o int, full_text string, ell string, prompt_name string")
    got = joins.hash_join(left, right, left_text="text", right_text="full_text", right_order=["o"])
    assert sorted((r.prompt_name, r.prompt_name_persuade, r.o, r.ell) for r in got.collect()) == [("p1", "q", 1, "Yes"), ("p2", "q", 3, None)]
    r = joins.match_report(left, right, left_text="text", right_text="full_text", ell="ell").first()
    assert (r.left_rows, r.matched, r.ell_yes + r.ell_no, r.ell_unknown) == (3, 2, 1, 1) and r.match_rate == pytest.approx(2 / 3) and r.recommend_more
    assert joins.gate(joins.match_report(left, right, left_text="text", right_text="full_text", ell="ell"), F.col("match_rate") >= joins.MIN_MATCH_RATE) == 1
    none = joins.match_report(left.limit(0), right, left_text="text", right_text="full_text", ell="ell").first()
    assert none.match_rate == 0


def test_strict_fetch_and_unique(spark):
    ids, texts = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    assert joins.fetch_strict(ids, texts, "k").count() == 2
    with pytest.raises(Exception, match="no text for 2"):
        joins.fetch_strict(ids, texts.limit(1).where("k = 1"), "k").collect()
    with pytest.raises(ValueError, match="unique"):
        joins.assert_unique(texts.unionAll(texts), "k")


def test_topic_gap(spark):
    rows = [("human", "a")] * 90 + [("human", "b")] * 10 + [("machine", "a")] * 5 + [("machine", "c")] * 5
    got = {r.topic: (r.human_pct, r.machine_pct, r.gap) for r in joins.topic_gap(spark.createDataFrame(rows, "w string, t string"), "w", "t").collect()}
    assert got == {"a": (90, 50, 40), "b": (10, 0, 10), "c": (0, 50, 50)}


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(i, "Yes" if i < 200 else "No" if i < 1000 else None, f"t{i % 3}", "fam" if i % 4 else "held", 1) for i in range(1050)]
    return spark.createDataFrame(rows, "id int, ell string, topic string, source string, label int")


def test_samples(spark, pool):
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(sampling.uniform(pool, "id", 100)) == ids(sampling.uniform(pool.repartition(7), "id", 100)) and len(ids(sampling.uniform(pool, "id", 5000))) == 1050
    base, train = sampling.split_humans(pool, "id", "ell", 300, 200)
    flags = [r.ell for r in train.collect()]
    assert flags.count("Yes") == flags.count("No") == 100 and not ids(base) & ids(train)
    short = [r.ell for r in sampling.balanced(pool, "id", "ell", 800).collect()]
    assert (short.count("Yes"), short.count("No")) == (200, 600)
    share = spark.createDataFrame([("t0", 0.9), ("t1", 0.1), ("t9", 0.5)], "topic string, share double")
    got = [r.topic for r in sampling.stratified(pool, "id", "topic", share, 100).collect()]
    assert (got.count("t0"), got.count("t1"), len(got)) == (90, 10, 100)
    train, held = sampling.split_machines(pool, "id", "topic", "source", share, held_out="held", excluded=["gone"], training_n=50, heldout_n=20)
    assert {r.source for r in train.collect()} == {"fam"} and {r.source for r in held.collect()} == {"held"}
    split = sampling.train_test(pool.where("ell is not null"), "id", "ell").groupBy("ell", "split").count().collect()
    assert {(r.ell, r.split): r["count"] for r in split} == {("Yes", "test"): 40, ("Yes", "train"): 160, ("No", "test"): 160, ("No", "train"): 640}
    labels = [r.a for r in sampling.balanced_labels(pool, "id", ["x", "y"], "a").collect()]
    assert labels.count("x") == labels.count("y") == 525
    assert sampling.exemplar(pool, "id", "topic", "t1").first().topic == "t1" and sampling.exemplar(pool, "id", "topic", "no").count() == 1


def test_terciles(spark):
    rows = [(n, i) for n in (1, 3, 4, 5, 10) for i in range(n)]
    got = sampling.sample_sentences(spark.createDataFrame(rows, "doc int, s int"), "doc", "s").groupBy("doc").count().collect()
    assert {r.doc: r["count"] for r in got} == {1: 1, 3: 3, 4: 3, 5: 3, 10: 3}


def test_baseline_fallbacks(spark):
    df = spark.createDataFrame([(100, 1.0, 5.0), (120, 1.2, 5.0), (110, 0.9, 5.0), (600, 5.0, 5.0), (620, 5.2, float("nan"))], "word_count int, f double, flat double")
    stats = baseline.baseline_stats(df, ["f", "flat"])
    s = {r.band: r for r in stats.collect()}
    assert set(s) == {"short", "long", "_all"} and s["short"].f__mean == pytest.approx(3.1 / 3) and s["long"].flat__std is None and s["_all"].flat__mean == 5
    z = baseline.zscore(spark.createDataFrame([(300, 3.0, 5.0), (110, 3.1 / 3, 6.0)], "word_count int, f double, flat double"), ["f", "flat"], stats).collect()
    assert z[0].f_z == pytest.approx((3 - s["_all"].f__mean) / s["_all"].f__std) and z[1].f_z == pytest.approx(0) and z[1].flat_z == pytest.approx(1)
    unit = baseline.zscore(spark.createDataFrame([(300, 3.0, 5.0)], "word_count int, f double, flat double"), ["f"], stats, fallback="unit").first()
    assert unit.f_z == pytest.approx(3 - s["_all"].f__mean)
    with pytest.raises(ValueError):
        baseline.zscore(df, ["f"], stats, fallback="other")
    c = baseline.consistency(spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0), ("b", 5.0), ("b", 9.0)], "d string, f double"), ["f"], "d").collect()
    assert {r.consistency for r in c if r.d == "a"} == {0.0} and max(r.consistency for r in c if r.d == "b") > 1


def test_band_lookup_is_a_broadcast(spark):
    df = spark.range(10).select(F.col("id").alias("word_count"), F.rand(1).alias("f"))
    plan = baseline.zscore(df, ["f"], baseline.baseline_stats(df, ["f"]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "SortMergeJoin" not in plan


def test_likelihood_identities(spark):
    df = spark.createDataFrame([(1, "a b c a b d. a b c!"), (2, "a c b"), (3, ""), (4, "x")], "doc_id int, text string")
    grams = likelihood.bigrams(df, "doc_id", "text")
    m = likelihood.train_bigram(grams)
    tokens = likelihood.score_tokens(grams, m, m, "doc_id")
    assert tokens.count() == 9
    for r in tokens.collect():
        assert r.lp_base == r.lp_alt < 0 and r.rank_base >= 1 and r.ent_base >= 0
    one = likelihood.score_corpus(grams, F.lit(True), "doc_id")
    assert sorted(map(repr, ([round(x, 9) for x in r] for r in one.collect()))) == sorted(map(repr, ([round(x, 9) for x in r] for r in tokens.collect())))
    for r in likelihood.sentence_features(tokens, ["doc_id", "sent"]).collect():
        assert r.mean_curvature == pytest.approx(r.mean_logprob + r.mean_entropy) and r.cross_ppl_ratio == pytest.approx(1)
    v = 3  # words that follow another: a, b, c, d
    seen = {(r.prev, r.word): r for r in m.collect()}
    v = seen["a", "b"].types
    n = seen["a", "b"].prev_n + v
    want = -sum(p * math.log(p) for p in [(seen[k].n + 1) / n for k in seen if k[0] == "a"] + [1 / n] * (v - sum(k[0] == "a" for k in seen)))
    assert seen["a", "b"].entropy == pytest.approx(want)


def test_scorer_failures_stay_apart(spark):
    df = spark.createDataFrame([("a", "Good one. Bad two. Good three.")], "doc_id string, text string")

    def scorer():
        def score(context, start):
            if "Bad" in context[start:]:
                raise RuntimeError("no")
            return [(-1.0, 2, 0.5, -2.0)]

        return score

    got = likelihood.score_with(segment.sentence_offsets(df, "doc_id", "text"), scorer).orderBy("sentence_index").collect()
    assert [(r.sentence_index, r.lp_base, r.error) for r in got] == [(0, -1.0, None), (1, None, "RuntimeError: no"), (2, -1.0, None)]


def test_scorer_is_kept_in_a_worker(spark):
    rows = spark.createDataFrame([(str(k), f"Text {k}.") for k in range(64)], "doc_id string, text string").repartition(16)

    def scorer():
        import uuid

        made = float(uuid.uuid4().int % 10**6)
        return lambda context, start: [(-made, 1, 0.0, 0.0)]

    sentences = segment.sentence_offsets(rows, "doc_id", "text")
    kept = likelihood.score_with(sentences, scorer, cache="counting").select("lp_base").distinct().count()
    assert kept <= spark.sparkContext.defaultParallelism < 16


def test_metrics_closed_forms(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 1), (0.2, 0), (0.1, 0)], "s double, y int")
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx((3 + 2.5 + 2) / 9)
    p = metrics.operating_point(df, "s", "y", 0.01).first()
    assert (p.threshold, p.tpr, p.fpr) == (0.9, pytest.approx(1 / 3), 0)
    worst = spark.createDataFrame([(0.9, 0), (0.1, 1)], "s double, y int")
    assert metrics.operating_point(worst, "s", "y").first().threshold == float("inf")
    assert metrics.auc(df.where("y = 1"), "s", "y").first().auc is None
    rows = spark.createDataFrame([("a", "typo", "original", 0.9), ("a", "typo", "attacked", 0.4), ("b", "para", "original", 0.8), ("b", "para", "attacked", 0.7)], "id string, k string, v string, s double")
    d = {r.attack: r for r in metrics.degradation(rows, "id", "v", "s", "k").collect()}
    assert d["overall"].n == 2 and d["overall"].flipped == 1 and d["typo"].mean_degradation == pytest.approx(0.5)


def test_model_learns_and_saves(spark, tmp_path):
    import random

    r = random.Random(1)
    rows = [(i, i % 2, r.gauss(i % 2 * 2, 1), r.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label int, a_z double, b_z double")
    for method in ("isotonic", "sigmoid"):
        fitted = model.fit(df, "id", ["a_z", "b_z"], method=method)
        out = fitted.score(df)
        assert metrics.auc(out, "probability", "label").first().auc > 0.85 and out.where("probability < 0 or probability > 1").count() == 0
        assert fitted.coefficients()["a_z"] > 0.8 > abs(fitted.coefficients()["b_z"])
    fitted.save(f"{tmp_path}/m")
    with pytest.raises(ValueError):
        model.fit(df.where("label = 1"), "id", ["a_z"])
    got = model.evidence(df.withColumns({"w": F.when(F.col("id") == 0, 10).otherwise(400), "p": F.lit(0.5)}), "w", "p", fitted.coefficients()).orderBy("id").limit(2).collect()
    assert got[0].abstained and got[0].evidence is None and not got[1].abstained and got[1].band_low == pytest.approx(0.3)
    assert abs(got[1].evidence[0].contribution) >= abs(got[1].evidence[1].contribution)


def test_attacks(spark):
    t = "The (quick) brown fox, it is big; people use ideas. Ax"
    df = spark.createDataFrame([(i, t) for i in range(50)], "id int, x string")
    key = F.col("id")
    none = df.select(attacks.inject_typos(F.col("x"), key, 0.0).alias("a"), attacks.swap_synonyms(F.col("x"), key, 0.0).alias("b")).distinct().collect()
    assert [tuple(r) for r in none] == [(t, t)]
    all_ = [r.a for r in df.select(attacks.inject_typos(F.col("x"), key, 1.0).alias("a")).collect()]
    assert all(len(a.split(" ")) == len(t.split(" ")) and a.endswith(" Ax") for a in all_) and len(set(all_)) > 40
    assert all_ == [r.a for r in df.select(attacks.inject_typos(F.col("x"), key, 1.0).alias("a")).collect()]
    swapped = df.select(attacks.swap_synonyms(F.col("x"), key, 1.0).alias("a")).first().a
    assert swapped == "The (rapid) brown fox, it is large; persons employ ideas. Ax"
    table = spark.createDataFrame([("fox", "wolf"), ("the", "one")], "word string, synonym string")
    assert attacks.swap_from_table(df, "id", "x", table, rate=1.1).first().attacked.startswith("One (quick) brown wolf,")
    with pytest.raises(ValueError):
        attacks.apply_attack(F.col("x"), "other", key)


class Client:
    def generate(self, model, prompt):
        if "fail" in prompt:
            raise RuntimeError("down")
        return "Sure, done.\n\nNEW"


def test_generation(spark):
    t = generate.targets(spark)
    assert t.count() == 150 and t.select("essay_id").distinct().count() == 150
    per = t.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("condition").alias("c"), F.count_distinct("topic").alias("t")).collect()
    assert {(r.n, r.c, r.t) for r in per} == {(50, 4, 8)}
    with pytest.raises(Exception, match="unknown condition"):
        t.select(generate.prompt(F.col("topic"), F.lit("what"), F.lit(None).cast("string")).alias("p")).collect()
    essays = spark.createDataFrame([("a", "p1\n\np2\n\np3", "flow"), ("b", "only", "grammar"), ("c", "fail\n\nfail", "flow")], "id string, text string, intensity string")
    got = {r.id: r for r in generate.polish(essays, "id", "intensity", "m", Client).collect()}
    assert set(got) == {"a", "b"} and got["b"].n_revised == 1 and 1 <= got["a"].n_revised <= 3
    assert got["a"].paragraphs_json.count('"NEW"') == got["a"].n_revised


def test_manifests(spark):
    joined = spark.createDataFrame([("h1", "T1", "Yes", 1), ("h1", "T2", "No", 2), ("h2", "T3", " ", 3)], "text_hash string, prompt_name string, ell_status string, o int")
    j = '[{"paragraph_index":0,"revised_text":"one two three"},{"paragraph_index":1,"revised_text":"four  five"}]'
    done = spark.createDataFrame([("h1", "flow", j), ("h2", "flow", "[]"), ("h9", "flow", "[]")], "essay_id string, intensity string, paragraphs_json string")
    got = {r.doc_id: (r.topic, r.ell_flag, r.word_count) for r in manifest.polished(done, joined, "o").collect()}
    assert got == {"h1": ("T1", "Yes", 5), "h2": ("T3", "unknown", 0), "h9": (None, "unknown", 0)}
    adv = spark.createDataFrame([("e", "radekgpt4", "T", "typo", "x", "y", 3)], "essay_id string, source_family string, topic string, attack_type string, original_text string, attacked_text string, word_count long")
    assert manifest.adversarial(adv).first().generator == "GPT-4 (radek) + typo" and manifest.adversarial(adv).columns == manifest.COLUMNS


def test_csv_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label,prompt_name,source,RDizzl3_seven\n"two\nlines, ""quoted""",1,p,s,True\nplain,0,p,s,False\n')
    rows = corpora.load_corpus(spark, f"{tmp_path}/a.csv").orderBy("row_ord").collect()
    assert [(r.row_ord, r.text, r.label, r.RDizzl3_seven) for r in rows] == [(0, 'two\nlines, "quoted"', 1, True), (1, "plain", 0, False)]
    numbered = corpora.with_row_number(spark.range(100, numPartitions=7)).collect()
    assert sorted(r.row_ord for r in numbered) == list(range(100)) and all(r.id == r.row_ord for r in numbered)


def test_checkpoint_and_config(spark, tmp_path):
    path, schema = f"{tmp_path}/ck", "id long, v string"
    targets = spark.createDataFrame([(i,) for i in range(5)], "id long")
    assert checkpoint.load(spark, path, schema).count() == 0
    checkpoint.append(spark.createDataFrame([(1, "a"), (3, "b")], schema), path)
    assert sorted(r.id for r in checkpoint.resume(targets, path, "id", schema).collect()) == [0, 2, 4]
    assert checkpoint.read_threshold(spark, f"{tmp_path}/none") == 0.5
    checkpoint.write_metrics(spark.createDataFrame([(0.8126,)], "threshold double"), f"{tmp_path}/m")
    assert checkpoint.read_threshold(spark, f"{tmp_path}/m") == 0.8126
    assert checkpoint.load_config(f"{tmp_path}/none.yaml").sampling.pools[0].count == 4000
    (tmp_path / "c.yaml").write_text("sampling:\n  seed: 7\n")
    assert checkpoint.load_config(f"{tmp_path}/c.yaml").sampling.seed == 7
    (tmp_path / "bad.yaml").write_text("sampling:\n  seed: many\n")
    with pytest.raises(ValueError):
        checkpoint.load_config(f"{tmp_path}/bad.yaml")


def test_incremental(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    take = lambda: incremental.process_new(spark, source, "id bigint, v bigint", "id", lambda df: df.withColumn("v", F.col("v") * 2), out, "id bigint, v bigint", state)
    spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "id bigint, v bigint").write.mode("append").parquet(source)
    take()
    spark.createDataFrame([(2, 9), (3, 3)], "id bigint, v bigint").write.mode("append").parquet(source)
    take()
    take()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_generation_resumes_after_failures(spark, tmp_path):
    targets = spark.createDataFrame([("a", "ok"), ("b", "fail"), ("c", "ok")], "id string, prompt string").withColumn("model", F.lit("m"))
    path, schema, calls = f"{tmp_path}/gen", "id string, response string", []

    def job(df):
        calls.append(sorted(r.id for r in df.collect()))
        return generate.generate(df, "id", "model", "prompt", Client)

    checkpoint.run_batch(targets, path, "id", schema, job, error="error")
    checkpoint.run_batch(targets, path, "id", schema, job, error="error")
    assert calls == [["a", "b", "c"], ["b"]]
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", "NEW"), ("c", "NEW")]


def test_generated_manifests_skip_absent_sets(spark, tmp_path):
    joined = spark.createDataFrame([("h1", "T1", "Yes", 1)], "text_hash string, prompt_name string, ell_status string, o int")
    spark.createDataFrame([("e", "m", "bare", "T", 9)], "essay_id string, model string, condition string, topic string, word_count long").write.parquet(f"{tmp_path}/modern/checkpoint.parquet")
    got = manifest.build_generated(spark, str(tmp_path), joined, "o")
    assert list(got) == ["machine_modern"] and got["machine_modern"].first().generator == "m"


def test_one_pass_over_texts(spark):
    """Features are one Arrow pass without expressions over arrays, and say what the expressions say."""
    import random

    r = random.Random(5)
    parts = ["a", "B", "and", "or", "not", "just", "but", "also", ",", ", ", "; ", "—", "--", "\n", ".", "é", "Σ", "ß", "²", "٣", "4,5", "one", "could of", "_", "red", "blue", "中文", "𝒳"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = stylometry.native_features(df, "id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "lambda" not in plan
    t = F.col("text")
    want = df.select("id", F.size(tx.lists(t)).alias("n_lists_detected"), F.size(tx.alpha_words(t)).alias("n_words"), tx.count_homophones(t).alias("h"), tx.count_pattern(t, tx.NOT_JUST_BUT).alias("b"))
    for a, b in zip(rows.orderBy("id").collect(), want.orderBy("id").collect()):
        assert (a.n_lists_detected, a.n_words) == (b.n_lists_detected, b.n_words)
        per100 = 100 / b.n_words if b.n_words else 0
        assert (a.homophone_error_rate, a.template_rate) == pytest.approx((b.h * per100, (b.b + b.n_lists_detected) * per100))


def test_frequent_words_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"cats run fast and word{'abcdefgh'[k % 8]} stays {'odd' if k == 1 else 'even'}.") for k in range(20)], "doc_id int, text string")
    known = stylometry.lexicon(df, "text", 2)
    assert {r.df for r in known.collect()} >= {20}
    got = []
    for most in (0, 3, 1000):
        monkeypatch.setattr(stylometry, "MOST_KNOWN", most)
        got.append(sorted(map(tuple, stylometry.spelling_rate(df, "doc_id", known).collect())))
    assert got[0] == got[1] == got[2] and sum(r[2] for r in got[0]) == 1


def test_blocks_score_as_one_table(spark, monkeypatch):
    """Scores by blocks and buckets are those of the joined tables, and tokens are not shuffled."""
    from inkwell.operators import corpus_scores

    texts = ["The cat sat. The cat ran! A dog sat?", "a dog ran. The end", "", None, "one", "..", "Élan vital. the cat sat on the mat, the cat sat on the dog"] * 3
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    alt = df.where("doc_id % 3 = 0").select("doc_id")
    grams = likelihood.bigrams(df, "doc_id", "text").join(alt.withColumn("good", F.lit(True)), "doc_id", "left")
    want = likelihood.score_corpus(grams, F.coalesce("good", F.lit(False)), "doc_id").orderBy("doc_id", "sent", "tok").collect()
    for size in (10_000, 40):
        monkeypatch.setattr(corpus_scores, "BLOCK", size)
        monkeypatch.setattr(corpus_scores, "BUCKET", size)
        out = corpus_scores.score(df, alt, "doc_id", "text")
        assert out._jdf.queryExecution().executedPlan().toString().count("Join") == 0
        got = out.orderBy("doc_id", "sent", "tok").collect()
        assert len(got) == len(want) and all(tuple(a) == pytest.approx(tuple(b)) for a, b in zip(got, want))
    features = corpus_scores.score(df, alt, "doc_id", "text", corpus_scores.SENTENCES, corpus_scores.sentence_rows)
    plain = likelihood.sentence_features(spark.createDataFrame(want), ["doc_id", "sent"]).select(*features.columns)
    for a, b in zip(features.orderBy("doc_id", "sent").collect(), plain.orderBy("doc_id", "sent").collect()):
        assert tuple(a) == pytest.approx(tuple(b))


def test_offsets_without_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([("a", "One. Two two!  Three\n\n Four. " + "x. " * 20), ("b", ""), ("c", None), ("d", "...\n\n!?")], "doc_id string, text string")
    got = []
    for run in (256, 3):
        monkeypatch.setattr(segment, "RUN", run)
        rows = segment.sentence_offsets(df, "doc_id", "text")
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        got.append(rows.collect())
    assert got[0] == got[1] and len(got[0]) == 24
    assert all(r.paragraph[r.char_start : r.char_end].strip() == r.text for r in got[0])


def measured():
    """A scorer whose rows tell what it was given; sentences with Bad fail."""

    def score(context, start):
        if "Bad" in context[start:]:
            raise RuntimeError("no")
        return [(float(-len(context)), start, float(k), float(ord(context[-1]))) for k in range(len(context[start:].split()))]

    return score


ODD = [
    ("a", "One. Two two!  Three\n\n\n\n Four. " + "x. " * 20), ("a", "Other text. Of the same id"), ("b", ""), ("c", None), ("d", "...\n\n!?"), ("e", "...Well. Bad one? \u2003\u00a0Good\x1cone!!\n \nmore"),
    ("f", "\U0001f600 smile. \U00020000\U00020001? e\u0301 end"), (None, "No id. Bad"), ("g", " \n\n \u2028 . . .\n\nA\n\n"),
]


def test_paragraphs_go_to_the_scorer_once(spark, tmp_path):
    df = spark.createDataFrame(ODD, "doc_id string, text string")
    out = likelihood.score_paragraphs(segment.paragraphs(df, "doc_id", "text"), measured)
    got = sorted(map(repr, out.collect()))
    assert got == sorted(map(repr, likelihood.score_with(segment.sentence_offsets(df, "doc_id", "text"), measured).collect())) and len(got) > 40
    assert {(r.doc_id, r.tok, r.lp_base, r.error) for r in out.where("error is not null").collect()} == {("e", None, None, "RuntimeError: no"), (None, None, None, "RuntimeError: no")}
    # a row is a paragraph until the scorer has it: no sentence carries what is before it
    df.withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    rows = textual.Q["scorer_seam"](spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert sorted(r.tok for r in rows.where("doc_id = 'a'").collect()) == [0, 0, 0, 1, 2]  # "Two two!", "Other text.", "Of the same id"


def test_scored_rows_are_the_same_in_any_batches(monkeypatch):
    asked = [(d, 0, k, t[:end], start) for d, t in ODD for k, (start, end) in enumerate(segment.offsets(t or ""))]
    whole = [r for b in likelihood._filled(asked, measured()) for r in b.to_pylist()]
    monkeypatch.setattr(likelihood, "ROWS", 2)
    parts = list(likelihood._filled(asked, measured()))
    assert [r for b in parts for r in b.to_pylist()] == whole and max(b.num_rows for b in parts) == 2
    uneven = [r for b in likelihood._filled(asked[:1], lambda context, start: [(-1.0, 1, 1.0, -1.0), (-1.0, 1)]) for r in b.to_pylist()]
    assert len(uneven) == 1 and uneven[0]["error"].startswith("ValueError")


def test_token_scorer_scores_what_is_sampled(spark):
    df = spark.createDataFrame([(k, f"Some{k} text. " * 9 + "\n\n" + f"And {k} words more! " * (k + 1)) for k in range(12)], "doc_id long, text string")
    got = drivers.token_scorer(measured)(df)
    want = drivers.sampled(df)
    place = ["doc_id", "paragraph_index", "sentence_index"]
    assert sorted(got.select(*place).collect()) == sorted(want.select(*place).collect()) and got.count() == 36
    key = segment.sentence_offsets(df, "doc_id", "text").select(*place, "char_end")
    assert got.join(key, place).where("mean_logprob = -char_end").count() == 36
    assert "char_end" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_logistic_fits_are_the_optimum(spark):
    """Fits side by side end where plain gradient steps end, whatever rows each leaves out, and in few jobs."""
    import random

    import numpy as np

    r = random.Random(3)
    data = [(i % 3, float(r.random() < 0.5), r.gauss(0, 1), r.gauss(0, 3)) for i in range(240)]
    data = [(f, y, a + y, b) for f, y, a, b in data]
    df = spark.createDataFrame(data, "_fold int, label double, a double, b double").coalesce(2)
    fits = [model.Fit(["a", "b"]), model.Fit(["b", "a"], without=1), model.Fit(["a"], 0.0, only=2), model.Fit([])]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fits", "fits")
    found = model.solve(df, fits, "label")
    assert len(tracker.getJobIdsForGroup("fits")) < 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for f, m in zip(fits, found):
        rows = np.array([(1.0, *({"a": a, "b": b}[c] for c in f.features), y) for k, y, a, b in data if k != f.without and f.only in (None, k)])
        x, y, w = rows[:, :-1], rows[:, -1], np.zeros(len(f.features) + 1)
        for _ in range(20_000):
            w -= 0.002 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + f.penalty * w * (np.arange(len(w)) > 0))
        assert [m.intercept, *m.coefficients] == pytest.approx(list(w), abs=1e-5)
    # classes that lie apart, with targets short of 0 and 1: full steps would overshoot again and again
    apart = spark.createDataFrame([(0, 0.01 if k < 90 else 0.9, (-9.0 if k < 90 else 6.0) + k % 7 / 3) for k in range(100)], "_fold int, t double, m double").coalesce(1)
    spark.sparkContext.setJobGroup("apart", "apart")
    model.solve(apart, [model.Fit(["m"], 0.0, only=0)], "t")
    assert len(tracker.getJobIdsForGroup("apart")) < 40
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_jobs_for_an_ablation(spark):
    """Families and folds share their jobs; values are those of each fitted by itself."""
    import random

    r = random.Random(4)
    df = spark.createDataFrame([(i, i % 2, r.gauss(i % 2, 1), r.gauss(i % 2, 2)) for i in range(300)], "id long, label int, a_z double, em_dash_rate_z double")
    spark.sparkContext.setJobGroup("ablation", "ablation")
    got = dict(model.ablation(df, "id", ["a_z", "em_dash_rate_z"]))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ablation")) < 80
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    parts = sampling.train_test(df, "id", "label").cache()
    for name, left in (("full_model", ["a_z", "em_dash_rate_z"]), ("without_punctuation_construction", ["a_z"])):
        alone = model.fit(parts.where("split = 'train'"), "id", left, method="sigmoid", folds=2, plain=False)
        assert got[name] == pytest.approx(metrics.auc(alone.score(parts.where("split = 'test'")), "probability", "label").first().auc)


def test_trained_counts_score_other_texts(spark, monkeypatch):
    """Texts that the models haven't seen are scored as by joins with their tables, whatever the blocks."""
    from inkwell.operators import corpus_scores

    corpus = spark.createDataFrame([(k, t) for k, t in enumerate(["The cat sat. The cat ran! A dog sat?", "a dog ran. The end", "", "Élan vital. the cat sat on the mat, the cat sat on the dog"] * 3)], "doc_id int, text string")
    alt = corpus.where("doc_id % 3 = 0").select("doc_id")
    others = spark.createDataFrame([("x", "The cat saw a dog.\n\nUnheard of words here. A dog ran! One"), ("y", "the cat sat on the cat. " * 3), ("z", None), ("w", "")], "doc_id string, text string")
    grams = likelihood.bigrams(corpus, "doc_id", "text")
    tables = likelihood.train_bigram(grams), likelihood.train_bigram(grams.join(alt, "doc_id", "left_semi"))
    for every, size in ((True, 40), (False, 10_000)):
        plain = drivers.bigram_scorer(*tables, every=every)(others)
        want = plain.orderBy("doc_id", "paragraph_index", "sentence_index").collect()
        monkeypatch.setattr(corpus_scores, "BLOCK", size)
        monkeypatch.setattr(corpus_scores, "BUCKET", size)
        counted = corpus_scores.train(corpus, alt, "doc_id", "text")
        out = drivers.corpus_scorer(counted, every=every)(others)
        assert not set(plain.columns) ^ set(out.columns) and "Join" not in out._jdf.queryExecution().executedPlan().toString()
        got = out.select(plain.columns).orderBy("doc_id", "paragraph_index", "sentence_index").collect()
        assert len(got) == len(want) > 3 and all(a[:4] == b[:4] and a[4:-1] == pytest.approx(b[4:-1]) for a, b in zip(got, want))


def test_synonyms_without_a_row_for_each_token(spark, monkeypatch):
    """A text is changed alike whether its words go to all tasks or are looked up, and tokens are not shuffled."""
    texts = ["The (quick) Fox, the fox; A fox's den  fox!", "", None, "Élan  Ünder the fox.", "nothing known"] * 4
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, x string")
    table = spark.createDataFrame([("fox", "wolf", 3), ("the", "one", 9), ("the", "two", 9), ("élan", "verve", 2), ("ünder", "over", 1), ("quick", None, 5)], "word string, synonym string, df int")
    got = []
    for most, known in ((100, table), (1, table), (1, table.drop("df"))):
        monkeypatch.setattr(attacks, "MOST_KNOWN", most)
        out = attacks.swap_from_table(df, "id", "x", known, rate=0.6)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in plan) == (most == 1) and "posexplode" not in plan.lower()
        got.append({r.id: r.attacked for r in out.collect()})
    assert got[0] == got[1] == got[2] and set(got[0]) == {k for k, t in enumerate(texts) if t is not None}
    want = {}
    for k, t in enumerate(texts):
        tokens = (t or "").split(" ")
        for i, x in enumerate(tokens):
            core = x.strip("().,;!")
            other = {"fox": "wolf", "the": "one", "élan": "verve", "ünder": "over"}.get(core.lower())
            if other and int(hashlib.sha256(f"42:{k}:{i}".encode()).hexdigest()[:4], 16) < int(0.6 * 65536):
                tokens[i] = x.replace(core, other.capitalize() if core[0].isupper() else other, 1)
        want[k] = " ".join(tokens)
    assert got[0] == {k: want[k] for k in got[0]} and any(want[k] != t for k, t in enumerate(texts) if t)


def test_consistency_reads_its_rows_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(k, k % 3, float(k * k % 7)) for k in range(30)], "id int, doc int, x double").mapInArrow(seen, "id int, doc int, x double")
    assert baseline.consistency(df, ["x"], "doc").count() == 30 and runs.value == 30
