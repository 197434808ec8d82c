"""Suffix-array dedup, SimHash, sharding and mixing against brute force, and on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import mixing, sharding, simhash, suffix_dedup

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def brute_repeats(rows):
    first, out = {}, []
    key = lambda i: LAST if i is None else i
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], LAST), key(i))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_repeats(docs, rows):
    assert collected(suffix_dedup.remove_repeats(docs)) == brute_repeats(rows)


def test_repeats_small_parts(spark, monkeypatch):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(60)]
    parts = [" ".join(r.choice(words) for _ in range(r.randint(5, 40))) for _ in range(25)]
    rows = [(i, " ".join(r.choice(parts) if r.random() < 0.6 else " ".join(r.choice(words) for _ in range(12)) for _ in range(r.randint(0, 6)))) for i in range(120)]
    rows += [(200, "a" * 3000), (201, "a" * 300), (202, "ab" * 200), (203, "ab" * 300), (204, "x" * 49), (205, "x" * 49), (206, "y" * 50), (207, "y" * 50), (7, parts[1]), (7, parts[2] + parts[1])]
    for name, value in (("BLOCK_BYTES", 1 << 13), ("BATCH", 1 << 10), ("PIECE", 1 << 9), ("BUCKET_KEYS", 1 << 8)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert collected(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_repeats(rows)


def test_repeats_empty(empty):
    assert suffix_dedup.remove_repeats(empty[0]).count() == 0


def test_suffix_family_grows_geometrically():
    r = np.random.default_rng(2)
    family, seen = suffix_dedup.SuffixFamily(), set()
    for k in range(64):
        text = [bytes(r.choice([0, 1, 97, 255], 2).tolist()) + bytes(46) + bytes(r.choice([0, 1, 200], 2).tolist()) for _ in range(50)]
        got = family.add(np.array(text, suffix_dedup.SUFFIX), np.full(50, k))
        assert got.tolist() == [t in seen for t in text]
        seen |= set(text)
        sizes = [len(level.suffix) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)
        for level in family.levels:  # in byte order
            inside = [bytes(x).ljust(50, b"\0") for x in level.suffix]
            assert inside == sorted(set(inside))


def test_repeats_of_common_strings(spark, monkeypatch):
    """Very common grams go window by window; repeats inside a document and rows without an id among them."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1 << 12)
    r = random.Random(4)
    line = "".join(r.choice("abcdefgh ") for _ in range(60))
    rows = [(i, " ".join([line if r.random() < 0.5 else "".join(r.choice("abcdefgh ") for _ in range(30)) for _ in range(8)])) for i in range(150)]
    rows += [(None, rows[3][1]), (None, rows[3][1] + "x"), (None, line * 3), (200, line * 4), (201, "\0" * 70), (202, "\0" * 60 + "\1"), (203, "é" * 40)]
    assert collected(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_repeats(rows)


def brute_fingerprint(t, width=3):
    w = (t or "").encode().translate(LOWER).split()
    parts = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    total = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * total[b] > len(parts))


def brute_components(nodes, near):
    """nodes: (name, fingerprint); the smallest name reachable of each place."""
    root = list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(nodes)):
        for b in range(a):
            if near(nodes[a][1], nodes[b][1]) or (nodes[a][0] is not None and nodes[a][0] == nodes[b][0]):
                root[find(a)] = find(b)
    least = {}
    for k, (name, _) in enumerate(nodes):
        if name is not None:
            least[find(k)] = min(least.get(find(k), LAST), name)
    return [least.get(find(k)) for k in range(len(nodes))]


def test_simhash_groups(docs, rows):
    prints = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    want = sorted(((i, f, c) for (i, f), c in zip(prints, roots)), key=repr)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.group_near_duplicates(docs).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("bits", [2, 3, 5, 7])
def test_links_connect_like_brute_force(spark, bits):
    r = random.Random(bits)
    prints = []
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 8])):
            g = f
            for _ in range(r.randint(0, bits + 1)):
                g ^= 1 << r.randrange(64)
            prints.append(g)
    hot = r.getrandbits(64)
    prints = list(dict.fromkeys(prints + [hot ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]))
    nodes = list(enumerate(prints))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in nodes], "fp long, node long")
    edges = simhash.links(df, bits)
    assert all((prints[e.u] ^ prints[e.v]).bit_count() <= bits for e in edges.collect())
    found = {x.node: x.root for x in simhash.components(edges).collect()}
    assert [found.get(k, k) for k, _ in nodes] == brute_components(nodes, lambda a, b: (a ^ b).bit_count() <= bits)


def test_simhash_verified(docs, rows):
    got = {r.doc_id: r.component_id for r in simhash.group_near_duplicates(docs, width=1, distinct=True, bits=5, verify=(5, 0.8)).collect() if r.doc_id is not None}
    assert {got[i] for i in range(240, 260)} == {240}
    assert got[305] == got[306] == 305
    assert sum(got[i] != i for i in range(240)) == 0


def edited_copies(n, words, edits, seed):
    """A text and copies of it or of other copies, each with some words replaced."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    out = [[r.choice(vocabulary) for _ in range(words)]]
    while len(out) < n:
        copy = list(out[0] if r.random() < 0.5 else r.choice(out))
        for _ in range(r.randint(1, edits)):
            copy[r.randrange(words)] = r.choice(vocabulary)
        out.append(copy)
    return [" ".join(w) for w in out]


def check_verified(spark, texts):
    """Single linkage of all pairs that fingerprints connect and whose sets of 5-word shingles are alike to 0.8, exactly."""
    prints = [brute_fingerprint(" ".join(dict.fromkeys(t.split())), 1) for t in texts]
    shingles = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    cand = brute_components(list(enumerate(prints)), lambda a, b: (a ^ b).bit_count() <= 7)

    def near(a, b):
        if cand[a] != cand[b]:
            return False
        both = len(shingles[a] & shingles[b])
        return 10 * both >= 8 * (len(shingles[a]) + len(shingles[b]) - both)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.group_near_duplicates(df, width=1, distinct=True, bits=7, verify=(5, 0.8)).collect()}
    want = brute_components([(k, k) for k in range(len(texts))], near)
    assert [got[k] for k in range(len(texts))] == want
    return want


def test_simhash_verified_dense(spark):
    check_verified(spark, edited_copies(400, 150, 3, 8))


def test_simhash_verified_in_turns(spark, monkeypatch):
    """Small blocks, few pivots and copies of copies, so that several turns are needed."""
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "PIVOTS", 1)
    assert len(set(check_verified(spark, edited_copies(300, 120, 6, 10)))) > 1


def test_drop_near_duplicates(spark):
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(5, base), (3, base + " more"), (5, base), (5, "another text"), (-1, base), (None, base), (None, "alone"), (None, "alone"), (None, "other"), (7, None), (6, ""), (8, "x"), (8, "x")]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, key string, stays int")
    out = simhash.drop_near_duplicates(df, width=1, bits=7, distinct=True, verify=(5, 0.8))
    assert out.columns == df.columns
    want = [(-1, base), (5, "another text"), (6, ""), (8, "x"), (None, "alone"), (None, "other")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_simhash_verified_long(spark):
    """Pairs on both sides of 0.8, of texts with many shingles."""
    r, texts = random.Random(9), []
    for k in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(900)]
        texts.append(" ".join(words))
        for place in r.sample(range(0, 900, 6), 19 + k % 4):
            words[place] = f"x{r.randrange(5000)}"
        texts.append(" ".join(words))
    check_verified(spark, texts)


def test_simhash_empty(empty):
    assert simhash.group_near_duplicates(empty[0]).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 99)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {k: 0 for k in range(1, 61)} | {100: 99}


def check_shards(got, rows, shards):
    counts = [0] * shards
    slots = [set() for _ in range(shards)]
    for r in got:
        counts[r.shard] += 1
        slots[r.shard].add(r.slot)
    assert max(counts) - min(counts) <= 1 and len(got) == len(rows)
    assert all(s == set(range(n)) for s, n in zip(slots, counts))
    want = sorted((repr(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}


def test_sharding(docs, rows):
    check_shards(sharding.shard_documents(docs).collect(), rows, 40)


def test_sharding_keeps_groups_together(spark):
    rows = [(i, f"text {i // 4}" if i < 400 else "all alike" if i < 700 else f"own {i}") for i in range(1000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    check_shards(got, rows, 10)
    at = {r.doc_id: r.shard for r in got}
    cut = sum(len({at[4 * g + k] for k in range(4)}) > 1 for g in range(100))
    assert cut <= 10  # by hash nearly all would be cut
    assert len({at[i] for i in range(400, 700)}) <= 10


def test_sharding_empty(empty):
    assert sharding.shard_documents(empty[0]).count() == 0


def test_mixing_meets_targets(docs, labels):
    got = mixing.with_rates(docs, labels, targets={"en": 0.5, "fr": 0.5})
    assert got.count() == docs.count()
    assert got.where("rate < 0 or rate is null").count() == 0
    clear = got.where("n_tokens >= 40").join(docs.where("text not like '%$$$%'").select("doc_id", "lang").distinct(), "doc_id")
    assert clear.where("domain <> lang").count() == 0
    share = {r.domain: r.t for r in got.groupBy("domain").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("t")).collect()}
    assert share["en"] / sum(share.values()) == pytest.approx(0.5, abs=0.03)


def test_mixing_matches_numpy(docs, labels):
    domains, table = mixing.fit_classifier(docs, labels, "lang")
    found = mixing.memberships(docs, domains, table).toPandas()
    p = found[[f"p{k}" for k in range(len(domains))]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    n = (found.n_tokens * found.copies).to_numpy()
    goal = np.array([0.3, 0.7]) * n.sum()
    rate = found.index.to_numpy() * 0 + 1.0
    natural = p.T @ n
    for _ in range(200):
        rate = np.maximum(0, rate - p @ ((p.T @ (n * rate) - goal) / natural))
    fitted = mixing.mix(docs, labels, targets=dict(zip(domains, (0.3, 0.7)))).toPandas()
    assert np.allclose(fitted.set_index("key").rate.loc[found.key], rate, atol=0.01)


def test_mixing_repeats_and_drops_nothing(docs, labels):
    out = mixing.repeat_to_rates(docs, labels, least=1.0)
    assert out.columns == docs.columns
    assert out.distinct().count() == docs.distinct().count() and out.count() > docs.count()


def test_mixing_without_labels(docs, empty):
    assert {r.rate for r in mixing.with_rates(docs, empty[1]).select("rate").collect()} == {1.0}
    assert mixing.with_rates(*empty).count() == 0


def test_mixing_of_many_domains(spark, monkeypatch):
    """Rarer domains count as one; a target that can't be met by name is an error; names of columns don't clash."""
    monkeypatch.setattr(mixing, "MOST_DOMAINS", 3)
    r = random.Random(3)
    rows = [(i, " ".join(f"{chr(97 + i % 6)}{r.randrange(20)}" for _ in range(50)), f"s{i % 6}" if i % 6 < 3 or i % 2 else "s0", 1, 2, 3.0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key int, n int, rate double")
    labels = spark.createDataFrame([(i,) for i in range(300)], "doc_id long")
    got = mixing.with_rates(df.select("doc_id", "text", "source"), labels, domain_col="source")
    assert got.count() == 300 and mixing.OTHER in {x.domain for x in got.collect()} and got.select("domain").distinct().count() == 4
    with pytest.raises(ValueError, match="s9"):
        mixing.with_rates(df, labels, domain_col="source", targets={"s0": 1.0, "s9": 1.0})
    out = mixing.repeat_to_rates(df, labels, domain_col="source", least=1.0)
    assert out.columns == df.columns and out.select("doc_id").distinct().count() == 300


def test_sharding_of_equal_rows(spark):
    """A third of all rows are one row many times."""
    rows = [(i, f"text {i}") for i in range(200)] + [(None, None)] * 100 + [(7, "same")] * 30
    check_shards(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect(), rows, 10)


def test_sharding_cuts_few_links(spark):
    """Groups of two to nine equal texts, small against a shard: by hash nearly all would be cut, and at most one in ten is."""
    r, rows = random.Random(6), []
    for g in range(150):
        rows += [(len(rows) + k, f"group {g}") for k in range(r.randint(2, 9))]
    rows += [(10_000 + k, f"own {k}") for k in range(1500)]
    at = {}
    for x in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect():
        at.setdefault(dict(rows)[x.doc_id], set()).add(x.shard)
    assert sum(len(s) > 1 for t, s in at.items() if t.startswith("group")) <= 15
