"""Language-model scoring, URL reputation and the pipeline."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import lm_scoring, urls
from inkwell.llm.gru import Gru

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def tokens(t):
    return [*(t or "").encode().translate(LOWER).split(), b"\n"]


def test_base_score(docs, rows):
    counts = collections.Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, t, _ in rows for w in [tokens(t)]), key=repr)
    got = sorted((tuple(r)[:6] for r in lm_scoring.score_texts(docs, *lm_scoring.fit_words(docs)).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_model_beats_base_on_held_out_text(spark):
    rng = np.random.default_rng(0)
    words, rows = [f"w{k}" for k in range(50)], []
    for i in range(400):
        k, text = int(rng.integers(50)), []
        for _ in range(60):
            text.append(words[k])
            k = (k * 7 + 3) % 50 if rng.random() < 0.9 else int(rng.integers(50))
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in lm_scoring.score_texts(df, *lm_scoring.fit_words(df)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_score_is_a_distribution():
    """All texts of one word over the model's events sum to the mass of that length."""
    rng = np.random.default_rng(1)
    g = Gru(100.0 / np.arange(1, 21), np.array([5.0, 3.0]), hidden=8, classes=4).fit([rng.integers(1, 22, 30) for _ in range(20)], epochs=3)
    first = np.array([g.score([np.array([k])])[0] for k in range(22)])
    end = g.score([np.zeros(0, np.int64)])[0]
    h, _ = g.steps(np.zeros((1, 1), np.int64), np.zeros((1, 8), np.float32))
    p = np.exp([g.logp(h[0], np.array([k]))[0] for k in range(22)])
    assert p.sum() == pytest.approx(1, abs=1e-4)
    assert math.exp(end) == pytest.approx(p[0], rel=1e-4) and (first < 0).all()
    assert g.bounded()
    g.p["bc"] += 100  # the same for all classes: nothing changes, but the logits have to be shifted
    assert not g.bounded() and np.exp([g.logp(h[0], np.array([k]))[0] for k in range(22)]) == pytest.approx(p, rel=1e-3)


def invented(rng, texts, words, size=60):
    """Texts whose words follow on from each other, of a vocabulary of which a part is rare."""
    vocabulary = ["".join(rng.choice(["ba", "ne", "ti", "ro", "su"], rng.integers(1, 5))) + str(k) for k in range(words)]
    rank = np.minimum(words - 1, rng.zipf(1.3, (texts, size)) - 1)
    return [" ".join(vocabulary[k] for k in row) for row in rank]


def test_words_beyond_the_head_are_a_distribution(spark, monkeypatch):
    """What the last group's mass is cut into sums to one: known words by count, and all strings by their bytes."""
    monkeypatch.setattr(lm_scoring, "WORDS", 20)
    monkeypatch.setattr(lm_scoring, "GROUP_RANKS", (30, 40, 60))
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(invented(rng, 300, 400))], "doc_id long, text string")
    model, counts, total = lm_scoring.fit_words(df)
    rest = [r for r in counts.collect() if bytes(r.word) not in model.number]
    assert 0 < model.unknown < 1
    assert model.known_share * sum(r.c for r in rest) + model.unknown == pytest.approx(1)
    assert 10 ** model.inside[20:30] @ np.ones(10) == pytest.approx(1)
    chars, symbols = model.chars, np.arange(257)
    for before, last in ((256, 256), (256, 98), (98, 97), (0, 255)):
        context = lm_scoring.CharModel.context(np.full(257, before), np.full(257, last))
        assert chars._next(context, np.full(257, last), symbols).sum() == pytest.approx(1)
    words = [b"ba", b"xq", bytes([200]), b"ba0"]
    for w, got in zip(words, chars.log10(words)):
        p, before, last = 1 / chars.start, 256, 256
        for x in (*w, 256):
            p *= chars._next(chars.context(np.array([before]), np.array([last])), np.array([last]), np.array([x]))[0]
            before, last = last, x
        assert got == pytest.approx(math.log10(p))


def test_unknown_words_lower_the_score(spark):
    rng = np.random.default_rng(6)
    rows, free = [], iter(range(100_000, 900_000))
    for t in invented(rng, 700, 300):
        while held(i := next(free)):
            pass
        rows.append((i, t))
    gibberish = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9))
    asked, share = {}, (0.0, 0.3, 0.6, 1.0)
    for k, t in enumerate(invented(rng, 80, 300)):
        while not held(i := next(free)):
            pass
        asked[i] = k % 4
        rows.append((i, " ".join(gibberish() if rng.random() < share[k % 4] else w for w in t.split())))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in lm_scoring.score_texts(df, *lm_scoring.fit_words(df)).collect()}
    mean = [np.mean([got[i] for i, k in asked.items() if k == group]) for group in range(4)]
    assert mean[0] > mean[1] > mean[2] > mean[3]
    assert max(got[i] for i, k in asked.items() if k == 3) < min(got[i] for i, k in asked.items() if k == 0)


def test_long_texts_and_copies_of_rows(spark):
    rng = np.random.default_rng(8)
    long = " ".join(invented(rng, 1, 50, 60_000))
    rows = [(1, long), (1, long), (2, "ba0 ne1"), (2, "ba0 ne1"), (2, "other words"), (None, None), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm_scoring.score_texts(df, *lm_scoring.fit_words(df)).collect()), key=repr)
    assert [g[:2] for g in got] == [(1, 60_001)] * 2 + [(2, 3)] * 3 + [(None, 1)] * 3
    assert got[0] == got[1] and len({g[2] for g in got[2:5]}) == 2


def test_state_is_carried_across_windows():
    rng = np.random.default_rng(2)
    g = Gru(100.0 / np.arange(1, 21), np.array([5.0, 3.0]), hidden=8, classes=4).fit([rng.integers(1, 22, 60) for _ in range(20)])
    texts = [rng.integers(1, 22, n) for n in (0, 1, 15, 16, 17, 100, 33)]
    one = [g.score([t])[0] for t in texts]
    assert g.score(texts) == pytest.approx(one, rel=1e-4)
    long = texts[5]
    h, total, last = np.zeros((1, 8), np.float32), 0.0, 0
    for y in [*long, 0]:
        states, h = g.steps(np.array([[last]]), h)
        total, last = total + float(g.logp(states[0], np.array([y]))[0]), y
    assert one[5] == pytest.approx(total, rel=1e-4)


def test_gradients():
    rng = np.random.default_rng(3)
    g = Gru(100.0 / np.arange(1, 13), np.array([5.0, 3.0]), hidden=5, classes=3)
    for k in g.p:
        g.p[k] = g.p[k].astype(np.float64)
    x, y, h = rng.integers(0, 14, (6, 3)), rng.integers(0, 14, (6, 3)), rng.normal(size=(3, 5))
    grad, _, _ = g.gradients(x, y, h)
    for name in g.p:
        flat, got = g.p[name].reshape(-1), grad[name].reshape(-1)
        for k in rng.choice(len(flat), min(12, len(flat)), replace=False):
            kept, losses = flat[k], []
            for step in (1e-4, -1e-4):
                flat[k] = kept + step
                losses.append(g.gradients(x, y, h)[2])
            flat[k] = kept
            assert got[k] == pytest.approx((losses[0] - losses[1]) / 2e-4, abs=2e-4), name


def test_lm_on_nothing(empty):
    assert lm_scoring.score_texts(empty[0], *lm_scoring.fit_words(empty[0])).count() == 0


URLS = [
    "https://M.Example.COM/en/7?x", "http://a.com/en/1", "http://b.net/de/2", "https://x.example.net/de/8#t", "ftp://u.org/es/", "org/es/1", None, "", "http://HOST", "http://notexample.com/en/7",
    "http://org/es/", "x://y://z/en", "http://h.com?/en/", "http://a.org/es", "http://example.com/en/70", "http://é.com/en/\nq",
]


def brute_rule(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in urls.RULES for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y")], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.judge_urls(pages, urls.fit_hosts(pages, urls.page_outcomes(pages, labels))).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule) == brute_rule(URLS[r.page_id])
        assert r.verdict == (urls.RULES[r.rule] if r.rule else "allow")


def test_url_reputation(spark):
    pages = [(i, f"http://h{i % 40}.d{i % 4}.com/xx/{i}") for i in range(4000)]
    rng = np.random.default_rng(4)
    labels = [(i, int(rng.random() > (0.9 if i % 40 == 3 else 0.1)), 0) for i in range(4000) if i % 2]
    p, q = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*labels, (None, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    hosts = urls.fit_hosts(p, urls.page_outcomes(p, q), worst=1 / 20)
    assert [r.host for r in hosts.where("blocked").collect()] == ["h3.d3.com"]
    r = {x.host: x for x in hosts.collect()}
    assert 0 < r["h0.d0.com"].posterior_rate < 0.2 and r["h0.d0.com"].n == 0  # no label of its own: its domain's rate
    blocked = urls.judge_urls(p, hosts).where("verdict = 'block'").collect()
    assert len(blocked) == 100 and {x.host for x in blocked} == {"h3.d3.com"}


def test_worst_hosts_are_blocked(spark):
    """The bar follows the hosts: by default two of 40, and none of like ones."""
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.com/{i}") for i in range(4000)], "page_id long, url string")
    bad = lambda f: spark.createDataFrame([(i, int(f(i))) for i in range(4000)], "page_id long, bad int")
    hosts = urls.fit_hosts(pages, bad(lambda i: i // 40 % 10 < 1 + 4 * (i % 40 in (3, 7)) + 3 * (i % 40 == 9)))
    assert {r.host for r in hosts.where("blocked").collect()} == {"h3.com", "h7.com"}
    assert urls.fit_hosts(pages, bad(lambda i: i // 40 % 10 < 3)).where("blocked").count() == 0


def test_beta_quantile(spark):
    for a, b in [(1, 1), (1, 20), (2, 5), (7, 3), (30, 200), (4000, 9000)]:
        x = (np.arange(400_000) + 0.5) / 400_000
        logp = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
        mass = np.cumsum(np.exp(logp - logp.max()))
        want = x[np.searchsorted(mass, 0.05 * mass[-1])]
        (got,) = spark.range(1).select(urls.lower_quantile(F.lit(float(a)), F.lit(float(b)), urls.Z)).first()
        assert got == pytest.approx(want, rel=0.05, abs=0.012)


def test_url_parts(spark):
    hosts = {"a.b.example.com": ("com", "example.com"), "x.a.co.uk": ("co.uk", "a.co.uk"), "b.co.uk:8080": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "localhost": ("localhost", "localhost"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r[0]: (r[1], r[2]) for r in df.select("host", *urls.parts_of(F.col("host"))).collect()} == hosts


def test_page_numbers(spark):
    urls_ = {"http://a.com/en/7": 7, "http://a.com/en/7/": 7, "http://a.com/en/7.html?x=9": 7, "http://a.com/7abc": None, "http://a.com/7/8": 8, "http://a.com/" + "1" * 19: 1111111111111111111, "http://a.com/" + "1" * 25: None, "http://a.com/": None}
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    labels = spark.createDataFrame([(n, 0, 0) for n in {7, 8, 1, int("1" * 18), int("1" * 19)}], "doc_id long, quality int, toxic int")
    got = {r.page_id for r in urls.page_outcomes(pages, labels).collect()}
    assert got == {k for k, n in enumerate(urls_.values()) if n is not None}


def test_url_nothing(spark):
    pages, labels = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.judge_urls(pages, urls.fit_hosts(pages, urls.page_outcomes(pages, labels))).count() == 0


def test_pipeline(spark, docs, labels, rows, tmp_path):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    passage = " ".join(rows[2][1].split()[:12])
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text, kept, now = {i: t or "" for i, t, _ in rows}, {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[name] = [r.doc_id for r in now.select("doc_id").collect()]
    toxic = {i for i, t in text.items() if any(w in t for w in ("idiot", "scum", "moron"))}
    assert not toxic & set(kept["toxicity"]) and set(kept["toxicity"]) == set(text) - toxic
    near = kept["simhash_near_dedup"]
    assert set(kept["toxicity"]) - set(near) == {*range(241, 260), 301, 302, 306} and near.count(10) == 1
    assert set(near) - set(kept["decontamination"]) == {2}
    assert set(kept["mixing"]) == set(kept["decontamination"]) and len(kept["mixing"]) >= len(kept["decontamination"])
    assert sorted(kept["sharding"], key=repr) == sorted(kept["mixing"], key=repr)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["sharding"])
    assert corpus_pipeline.ORACLE_SQL is None


CLASH = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, n int, stays boolean, score double, predicted int, fp long, copies int"


@pytest.mark.parametrize("texts", [[], [None] * 6, [None, "", " ", "a few words", "a few words", "other words here"]])
def test_pipeline_on_awkward_tables(spark, tmp_path, texts):
    """Empty tables, texts that are all null, and columns named like those that stages add."""
    rows = [(i if i % 2 else None, t, "en", "s", 0, "r", 1, 2, True, 0.5, 1, 3, 4) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
    # of copies one stays, null and empty texts being copies
    assert now.count() == len({(t or "").strip() for t in texts})
