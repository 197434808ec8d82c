"""Quality rules: document statistics and gradient-boosted trees on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import documents, map_docs, ship

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that the trees are fitted on, at most (those first in hash order).
MOST_LABELLED = 20_000
KEEP_FROM = 0.4

#: Features of a document, and how quality may move with each: -1 down only, 1 up only, 0 freely.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": -1, "distinct_share": 0, "log_line": 0, "wide_share": 0, "stop_share": 0, "mark_share": 0}

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("quality_score", "double")]


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more, and distinct words."""
    if not words:
        return 0, 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    distinct = len(np.unique(h))
    if len(h) < 3 or distinct == len(h):
        return 0, distinct
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    g = (h[:-2] * a + h[1:-1]) * a ^ h[2:] * b
    order = np.argsort(g)
    same = g[order][1:] == g[order][:-1]
    if not same.any():
        return 0, distinct
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(len(h), bool)
    for k in range(3):
        inside[k : k + len(g)] |= twice
    return int(inside.sum()), distinct


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """Words, word characters, symbols, repeated lines and repeated words; and the features, in the order of FEATURES."""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    wide = int(count[0xC0:].sum())
    chars = int(count[:0x80].sum()) - int(count[list(SPACE)].sum()) + wide
    symbols = int(count[list(SYMBOLS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    again, distinct = repeated_words(words)
    upper, digits = int(count[65:91].sum()), int(count[48:58].sum())
    short = sum(len(w) <= 3 for w in words)
    marks = int(count[[33, 44, 46, 58, 59, 63]].sum())
    c, w = max(chars, 1), max(n, 1)
    return [n, chars, symbols, dup, again], [np.log1p(n), chars / w, symbols / c, dup / max(len(lines), 1), again / w, upper / c, digits / c, distinct / w, np.log1p(n / max(len(lines), 1)), wide / c, short / w, marks / w]


class Trees:
    """Boosted trees as flat node arrays: feature, threshold (go left if not above), children, value; leaves point to themselves."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth, self.roots = base, depth, []
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def node(self) -> int:
        k = len(self.feature)
        for column, x in ((self.feature, 0), (self.threshold, 0.0), (self.left, k), (self.right, k), (self.value, 0.0)):
            column.append(x)
        return k

    def frozen(self) -> Trees:
        for name, kind in (("roots", np.int32), ("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("value", float)):
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all rows walk all trees at once."""
        at = np.repeat(self.roots[None], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], *, trees: int = 60, depth: int = 3, bins: int = 32, rate: float = 0.2, ridge: float = 2.0, least: int = 10) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins; splits that break a constraint are refused, and the
    halves' mean bounds what lies below on either side, so the whole ensemble is monotonic."""
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    out = Trees(float(np.log(p / (1 - p))), depth)
    if not len(y) or y.min() == y.max():
        return out.frozen()
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(y), out.base)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        root = out.node()
        out.roots.append(root)
        todo = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best, gain = None, 1e-6
            weight = lambda a, b, low=low, high=high: np.clip(-a / (b + ridge), low, high)
            profit = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
            whole = profit(total_g, total_h, weight(total_g, total_h))
            if level < depth and len(rows) >= 2 * least:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    vl, vr = weight(gl, hl), weight(total_g - gl, total_h - hl)
                    ok = (nl >= least) & (len(rows) - nl >= least) & ((vr - vl) * monotone[f] >= 0)
                    got = np.where(ok, profit(gl, hl, vl) + profit(total_g - gl, total_h - hl, vr) - whole, -1)
                    k = int(got.argmax())
                    if got[k] > gain:
                        best, gain = (f, k, float(vl[k]), float(vr[k])), got[k]
            if best is None:
                out.value[node] = rate * float(weight(total_g, total_h))
                margin[rows] += out.value[node]
                continue
            f, k, vl, vr = best
            middle = (vl + vr) / 2
            out.feature[node], out.threshold[node] = f, float(cuts[f][k])
            out.left[node], out.right[node] = out.node(), out.node()
            goes = binned[rows, f] <= k
            lo_hi = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[f]]
            todo += [(out.left[node], rows[goes], *lo_hi[0], level + 1), (out.right[node], rows[~goes], *lo_hi[1], level + 1)]
    return out.frozen()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Up to ``most`` labelled documents, first in hash order, with their label as ``y``. The join's small side is bounded by ``most``."""
    few = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Trees:
    """Fit the trees on the statistics of at most ``most`` labelled documents; only those few numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics((t or "").encode())[1] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y").cast(pa.int32()), b.column("doc_id").cast(pa.string())], names=["x", "y", "doc_id"])

    ship(docs.sparkSession)
    rows = sorted(labelled_sample(docs, labels, "quality", most).mapInArrow(run, "x array<double>, y int, doc_id string").collect(), key=lambda r: (r.doc_id, r.x))
    x, y = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([float(r.y) for r in rows])
    return fit_trees(x, y, list(FEATURES.values()))


def judge_quality(docs: DataFrame, model: Trees, *, carry: bool = False, keep_from: float = KEEP_FROM) -> DataFrame:
    """Statistics, base rule and verdict of every whole text; one row for each input row, nothing is shuffled.

    Null and empty texts have no words, so the base rule fails them. Repeated rows are each judged. Without labels of
    both classes the trees give one value to all, and the base rule decides where that value keeps.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def fn(ids: list, texts: list[bytes]) -> dict:
            rows = [statistics(t) for t in texts]
            base = np.array([r[0] for r in rows], np.int64).reshape(-1, 5)
            score = held.value.score(np.array([r[1] for r in rows]).reshape(-1, len(FEATURES)))
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            return {n: base[:, k] for k, (n, _) in enumerate(FIELDS[:5])} | {"base_failed": failed, "kept": ~failed & (score >= keep_from), "quality_score": score}

        return fn

    return map_docs(docs, make, FIELDS, carry=carry)


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


__all__ = ["Trees", "contract", "fit_quality", "fit_trees", "judge_quality", "labelled_sample", "statistics"]
