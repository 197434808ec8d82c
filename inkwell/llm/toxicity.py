"""Toxicity: votes of the nearest labelled examples by TF-IDF cosine, found with a block-max inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import WORDS, crc_mod, documents, map_docs, ship

#: Labelled examples in the index, at most, of label 1 and of label 0 (those first in hash order), and bytes of their texts.
MOST_EXAMPLES, MOST_BYTES = {1: 1500, 0: 2500}, 48 << 20
NEIGHBOURS = 15
#: What is added to a neighbour's distance (one less the cosine) before its vote is weighed by the inverse square, and the
#: weight of the prior in a vote, as so many neighbours at distance one.
NEAR, PRIOR_WEIGHT = 0.05, 1.0
#: Examples of a block, and terms (those of most examples) whose postings are kept as columns, as nearly every example has them.
BLOCK, COLUMNS = 256, 384
REJECT_FROM = 0.7

FIELDS = [("held_out", "boolean"), ("score", "double"), ("predicted", "int"), ("neighbours", "array<string>"), ("evidence", "array<string>")]


def term_counts(text: bytes) -> Counter:
    return Counter(text.translate(WORDS).split())


class Weights:
    """Weights of all terms of the examples: inverse document frequency times relevance frequency (log2 of two plus how
    many times as often texts of label 1 have the term, its count there less one standard deviation). No term is left
    out. Texts count once, however many copies the sample has."""

    def __init__(self, examples: Iterable[Counter], y: np.ndarray, weight: np.ndarray):
        number: dict[bytes, int] = {}
        rows, digests = [], []
        for c in examples:  # as numbers at once, which take a tenth of the memory
            k = np.fromiter((number.setdefault(t, len(number)) for t in c), np.int32, len(c))
            n = np.fromiter(c.values(), np.int32, len(c))
            order = np.argsort(k)
            rows.append((k[order], n[order]))
            digests.append(blake2b(k[order].tobytes() + n[order].tobytes(), digest_size=16).digest())
        self.terms = {t: k for k, t in enumerate(sorted(number))}
        to = np.fromiter((self.terms[t] for t in number), np.int32, len(number))
        del number
        n, seen, once = {0: 0, 1: 0}, np.zeros((2, len(to))), set()
        for j, label in enumerate(y.astype(int).tolist()):
            k, count = rows[j]
            order = np.argsort(to[k])
            rows[j] = k, count = to[k][order], count[order]
            if digests[j] not in once:
                once.add(digests[j])
                n[label] += 1
                seen[label][k] += 1
        c, a = seen
        df = sum(seen[x] * weight[y == x].sum() / max(n[x], 1) for x in (0, 1))
        ratio = ((a - np.sqrt(a)) / max(n[1], 1)) / ((c + 1) / (n[0] + 1))
        self.weight = np.log((1 + weight.sum()) / (1 + df)) * np.log2(2 + ratio) + 1e-6
        for j, (k, count) in enumerate(rows):
            rows[j] = self.unit(k, count)
        self.vectors = rows

    def unit(self, k: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(count)) * self.weight[k]
        return k, x / np.sqrt((x * x).sum()) if len(x) else x

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector, (1 + ln tf) * weight, over the terms of the examples: their ascending numbers and their values."""
        get = self.terms.get
        found = sorted([(k, n) for w, n in counts.items() if (k := get(w, -1)) >= 0])
        return self.unit(np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64))


class BlockMaxIndex:
    """Inverted index of unit vectors, its postings cut into blocks of examples. For each term and block the largest
    value is kept, so a block whose bound can't reach the best k is never opened. The postings of the COLUMNS most
    frequent terms, which nearly every example has, stand as columns and are summed for many queries at once. Results are
    exact."""

    def __init__(self, terms: int, examples: list[tuple[np.ndarray, np.ndarray]]):
        self.size, self.blocks = len(examples), -(-len(examples) // BLOCK)
        have = np.zeros(terms, np.int64)
        for t, _ in examples:
            have[t] += 1
        common = np.argsort(-have, kind="stable")[:COLUMNS]
        self.column = np.full(terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.wide = np.zeros((len(common), self.blocks * BLOCK))
        self.most = np.zeros((terms, self.blocks), np.float32)
        self.edge, self.example, self.value = [], [], []
        for b in range(self.blocks):
            own = examples[b * BLOCK : (b + 1) * BLOCK]
            term, value = np.concatenate([t for t, _ in own]), np.concatenate([v for _, v in own])
            example = np.repeat(np.arange(len(own)), [len(t) for t, _ in own])
            column = self.column[term]
            self.wide[column[column >= 0], b * BLOCK + example[column >= 0]] = value[column >= 0]
            order = np.argsort(term, kind="stable")
            order = order[column[order] < 0]
            np.maximum.at(self.most[:, b], term[order], np.nextafter(value[order].astype(np.float32), np.float32(2)))
            self.example.append(example[order].astype(np.uint8 if BLOCK <= 256 else np.int32))
            self.value.append(value[order])
            self.edge.append(np.searchsorted(term[order], np.arange(terms + 1)).astype(np.int32))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each vector the k examples of the largest cosine over 0, ties by example: (cosine, example). skip: an
        example that each vector leaves out."""
        wide = np.zeros((len(vectors), len(self.wide)))
        for q, (ts, qs) in enumerate(vectors):
            column = self.column[ts]
            wide[q, column[column >= 0]] = qs[column >= 0]
        out = []
        for q in range(0, len(vectors), 512):
            for row, (dots, vector) in enumerate(zip(wide[q : q + 512] @ self.wide, vectors[q : q + 512])):
                out.append(self._nearest(dots.reshape(self.blocks, BLOCK), *vector, k, skip[q + row] if skip else -1))
        return out

    def _nearest(self, dots: np.ndarray, ts: np.ndarray, qs: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        """dots: what the columns give, by block."""
        if not len(ts) or not self.size:
            return []
        rare = self.column[ts] < 0
        ts, qs = ts[rare], qs[rare]
        bound = dots.max(1) + qs @ self.most[ts] * (1 + 1e-5) + 1e-9
        cosine, found = np.zeros(0), np.zeros(0, np.int64)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 1e-9 or len(found) == k and bound[b] < cosine[-1] - 1e-8:
                break
            sums, edge = dots[b], self.edge[b]
            lo, hi = edge[ts], edge[ts + 1]
            some = np.flatnonzero(hi > lo)
            if len(some):
                lo, n = lo[some], hi[some] - lo[some]
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                sums = sums + np.bincount(self.example[b][at], np.repeat(qs[some], n) * self.value[b][at], BLOCK)
            sums = np.round(sums, 9)
            if 0 <= skip - b * BLOCK < BLOCK:
                sums[skip - b * BLOCK] = 0
            hit = np.flatnonzero(sums >= cosine[-1] if len(found) == k else sums > 0)
            if len(hit):
                cosine, found = np.append(cosine, sums[hit]), np.append(found, hit + b * BLOCK)
                best = np.lexsort((found, -cosine))[:k]
                cosine, found = cosine[best], found[best]
        return list(zip(cosine.tolist(), found.tolist()))


class ToxicityModel:
    """Weights, index, labels and importance weights of the examples, prior for texts without known terms, calibration."""

    def __init__(self, names: list[str], texts: Iterable[bytes], y: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS):
        self.weights = Weights(map(term_counts, texts), y, weight)
        vectors = self.weights.__dict__.pop("vectors")
        order = like_together(vectors)
        vectors = [vectors[e] for e in order]
        self.names, self.y, self.weight, self.k = [names[e] for e in order], y[order], weight[order], k
        self.index = BlockMaxIndex(len(self.weights.terms), vectors)
        self.words = list(self.weights.terms)
        self.prior = float((self.y * self.weight).sum() + 0.5) / float(self.weight.sum() + 1)
        bare = np.array([not len(v[0]) for v in vectors], bool)
        self.bare = float((self.y * self.weight)[bare].sum() + self.prior) / float(self.weight[bare].sum() + 1)
        votes = np.array([self.vote(near) for near in self.index.nearest([v for v in vectors if len(v[0])], k, np.flatnonzero(~bare).tolist())])
        self.knots, self.levels = isotonic(votes, self.y[~bare], self.weight[~bare])

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, weighted by the inverse square of their distance, shrunk to the prior."""
        up, all_ = PRIOR_WEIGHT * self.prior, PRIOR_WEIGHT
        for c, e in near:
            w = self.weight[e] / self.weight.max() / (NEAR + 1 - c) ** 2
            up += w * self.y[e]
            all_ += w
        return up / all_

    def score(self, counts: list[Counter]) -> list[tuple[float, list[int], list[bytes]]]:
        """Of each text's term counts: score, nearest examples, and the terms of most weight."""
        out, vectors = [], [self.weights.vector(c) for c in counts]
        for (ts, vs), near in zip(vectors, self.index.nearest(vectors, self.k)):
            score = float(np.interp(self.vote(near), self.knots, self.levels)) if len(ts) else self.bare
            out.append((score, [e for _, e in near], [self.words[ts[t]] for t in np.lexsort((ts, -vs))[:5].tolist() if near]))
        return out


def like_together(vectors: list[tuple[np.ndarray, np.ndarray]], wide: int = 256) -> list[int]:
    """An order in which like examples stand together, which makes the bounds of blocks sharp: by the main direction of
    the vectors over the most frequent terms, halved again and again."""
    every = Counter(t for ts, _ in vectors for t in ts.tolist())
    common = [t for t, _ in sorted(every.items(), key=lambda x: (-x[1], x[0]))[:wide]]
    del every
    place = {t: k for k, t in enumerate(common)}
    x = np.zeros((len(vectors), wide))
    for e, (ts, vs) in enumerate(vectors):
        for t, v in zip(ts.tolist(), vs.tolist()):
            if t in place:
                x[e, place[t]] = v

    def halved(rows: np.ndarray) -> list[int]:
        if len(rows) <= BLOCK:
            return rows.tolist()
        part = x[rows] - x[rows].mean(0)
        axis = np.ones(wide)
        for _ in range(20):
            axis = part.T @ (part @ axis) + 1e-12
            axis /= np.sqrt((axis * axis).sum())
        rows = rows[np.argsort(part @ axis, kind="stable")]
        half = -(-len(rows) // (2 * BLOCK)) * BLOCK
        return halved(rows[:half]) + halved(rows[half:])

    return halved(np.arange(len(vectors)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibration curve from leave-one-out votes: pool adjacent violators, shrunk so that it stays inside 0 to 1."""
    if not len(x):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    pools: list[list[float]] = []
    for k in np.lexsort((y, x)):
        if pools and pools[-1][3] == x[k]:
            pools[-1][0] += w[k] * y[k]
            pools[-1][1] += w[k]
        else:
            pools.append([w[k] * y[k], w[k], x[k], x[k]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            up, n, _, end = pools.pop()
            pools[-1][0] += up
            pools[-1][1] += n
            pools[-1][3] = end
    total = sum(p[1] for p in pools)
    rate = sum(p[0] for p in pools) / total
    knots, levels = [], []
    for up, n, a, b in pools:
        level = (up + rate) / (n + 1)
        knots += [a, b] if b > a else [a]
        levels += [level] * (1 + (b > a))
    return np.array(knots), np.maximum.accumulate(np.clip(levels, 0, 1))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, most: dict[int, int] = MOST_EXAMPLES, most_bytes: int = MOST_BYTES) -> ToxicityModel:
    """Learn from the labels of rows whose crc32(doc_id as text) mod 3 is not 1.

    The examples are a bounded sample: in hash order ``most`` of each label, as far as their texts have ``most_bytes``
    for each label's share; each stands for as many labelled rows as its label has for one example. All their terms are
    kept. Labels other than 0 and 1 and null ids are left out; of several labels for a document the largest counts, of
    several texts the least.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    few = None
    for y, n in most.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        few = part if few is None else few.unionAll(part)
    few = F.broadcast(few)
    size = docs.select("doc_id", F.octet_length("text").alias("size")).join(few, "doc_id").groupBy("doc_id", "y").agg(F.max("size").alias("size"))
    taken, room = [], {y: most_bytes * n // sum(most.values()) for y, n in most.items()}
    for r in size.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        room[r.y] -= r["size"] or 0
        if room[r.y] >= 0:
            taken.append((r.doc_id, r.y))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("y", T.LongType())])
    ids = docs.sparkSession.createDataFrame([(i, int(y)) for i, y in taken], schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (str(r.doc_id), r.text or ""))
    n = Counter(r.y for r in rows)
    y = np.array([r.y for r in rows], float)
    weight = np.array([total[r.y] / n[r.y] for r in rows], float)
    return ToxicityModel([str(r.doc_id) for r in rows], ((rows.pop(0).text or "").encode() for _ in range(len(rows))), y, weight)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, carry: bool = False, reject_from: float = REJECT_FROM) -> DataFrame:
    """Score every whole text: calibrated score, prediction, ids of the nearest examples and strongest terms as evidence.

    One row for each input row, nothing is shuffled; the broadcast model is bounded by MOST_EXAMPLES and MOST_BYTES.
    Texts without a term of any example, null and empty ones among them, get the share of label 1 among examples without
    one, and no evidence. Without labels the score is one half for all.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        from zlib import crc32

        seen: dict[bytes, tuple] = {}  # texts of the same words need one search; of bounded size

        def fn(ids: list, texts: list[bytes]) -> dict:
            m, out = held.value, []
            if len(seen) > 20_000:
                seen.clear()
            words = [t.translate(WORDS).split() for t in texts]
            keys = [blake2b(b" ".join(w), digest_size=16).digest() for w in words]
            new = {key: w for key, w in zip(keys, words) if key not in seen}
            seen.update(zip(new, m.score([Counter(w) for w in new.values()])))
            for i, key in zip(ids, keys):
                score, near, terms = seen[key]
                score = round(min(1.0, max(0.0, score)), 9)
                out.append((crc32(str("" if i is None else i).encode()) % 3 == 1, score, int(score >= reject_from), [m.names[e] for e in near], [w.decode("utf-8", "replace") for w in terms]))
            return {n: [r[k] for r in out] for k, (n, _) in enumerate(FIELDS)}

        return fn

    return map_docs(docs, make, FIELDS, carry=carry)


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
