"""Benchmark decontamination with suffix arrays of the training shards."""

from __future__ import annotations

import hashlib
import math
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import WORDS, map_docs

WINDOW = 8
#: Test texts of one block. What is made of a block takes about 40 times as much memory; tasks hold one at a time.
BLOCK_BYTES = 8 << 20
#: Words of documents in one suffix array, besides those of the last text, whatever its length.
SHARD_WORDS = 1 << 20

FIELDS = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean"), ("longest_words", "int"), ("longest_item", "string"), ("longest_at", "int"), ("items", "array<string>"), ("hit_spans", "array<int>")]
NONE = np.zeros(0, np.int64)


class TestSuffixes:
    """A block of test items as word numbers: their distinct windows for searches in suffix arrays, the items of each, and
    a suffix array of the distinct texts themselves, which tells how far a match goes on."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]]):
        owners: dict[bytes, set[str]] = {}  # by distinct text
        for name, text in items:
            if words := text.translate(WORDS).split():
                owners.setdefault(b" ".join(words), set()).add(name)
        texts = [t.split() for t in owners]
        self.names = sorted({n for own in owners.values() for n in own})
        number = {n: k for k, n in enumerate(self.names)}
        self.owner = [np.array(sorted(number[n] for n in own), np.int64) for own in owners.values()]
        self.vocab: dict[bytes, int] = {}
        for words in texts:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        size = np.array([len(w) for w in texts], np.int64)
        self.least = int(min(WINDOW, size.min())) if len(size) else 0
        flat = np.array([self.vocab[w] for words in texts for w in (*words, None) if w is not None], np.int64)
        first = np.cumsum(size + 1) - size - 1
        line = np.zeros(int(size.sum()) + len(size) + WINDOW, np.int64)  # a gap after each text
        line[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
        n = np.maximum(size - WINDOW + 1, 1)
        text = np.repeat(np.arange(len(size)), n)
        wide = line[(first[text] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[:, None] + np.arange(WINDOW)]
        wide[np.cumsum(wide == 0, axis=1) > 0] = 0
        self.low, at, which = np.unique(keys(wide), return_index=True, return_inverse=True)
        wide = wide[at]
        self.length = (wide > 0).sum(1)
        self.high = keys(np.where(wide == 0, (1 << 31) - 1, wide))
        pairs = np.unique(which.ravel() * max(len(size), 1) + text)  # (window, text)
        self.text, self.edge = pairs % max(len(size), 1), np.searchsorted(pairs, np.arange(len(self.low) + 1) * max(len(size), 1))
        self.order = whole_suffix_array(line, int(size.max()) if len(size) else 0)
        self.line = line.astype(">u4").tobytes()
        self.text_at = np.repeat(np.arange(len(size) + 1), [*(size + 1), WINDOW])

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """Numbers of the items that have any of the windows, ascending."""
        texts = np.unique(np.concatenate([NONE, *(self.text[self.edge[w] : self.edge[w + 1]] for w in windows.tolist())]))
        return np.unique(np.concatenate([NONE, *(self.owner[t] for t in texts.tolist())]))

    def place(self, part: bytes, lo: int = 0) -> int:
        """First place in the suffix array whose suffix isn't below the words (as bytes)."""
        hi, n = len(self.order), len(part)
        while lo < hi:
            mid = (lo + hi) // 2
            a = 4 * int(self.order[mid])
            if self.line[a : a + n] < part:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def occurs(self, part: bytes) -> bool:
        k = self.place(part)
        a = 4 * int(self.order[k]) if k < len(self.order) else len(self.line)
        return self.line[a : a + len(part)] == part

    def first_item(self, part: bytes) -> int:
        """The smallest of the items whose texts hold the words."""
        k, n, best = self.place(part), len(part), len(self.names)
        while k < len(self.order) and self.line[(a := 4 * int(self.order[k])) : a + n] == part:
            best, k = min(best, int(self.owner[self.text_at[a // 4]][0])), k + 1
        return best

    def longest(self, ids: np.ndarray, starts: np.ndarray) -> tuple[int, int]:
        """(words, start) of the longest match of WINDOW words or more, the first of like ones. starts: where whole windows
        match, ascending. In a run of them both ends of the match only ever move on, so this is linear in its length."""
        best, raw = (0, 0), ids.astype(">u4").tobytes()
        edge = np.flatnonzero(np.diff(starts, prepend=-2) > 1).tolist()
        for a, b in zip(edge, [*edge[1:], len(starts)]):
            p, last = int(starts[a]), int(starts[b - 1])
            e = p + WINDOW
            while p <= last:
                while e < last + WINDOW and self.occurs(raw[4 * p : 4 * (e + 1)]):
                    e += 1
                if e - p > best[0]:
                    best = (e - p, p)
                if e == last + WINDOW:
                    break
                p += 1
                e = max(e, p + WINDOW)
        return best


def whole_suffix_array(line: np.ndarray, longest: int) -> np.ndarray:
    """All suffixes of a line of word numbers in order, by prefix doubling up to the longest text."""
    rank, k = line, 1
    while k <= longest:
        after = np.concatenate([rank[k:], np.zeros(min(k, len(rank)), np.int64)])
        rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1].ravel() + 1
        k *= 2
    return np.argsort(rank, kind="stable")


def keys(ids: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings of the same order."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").ravel()


def suffix_array(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes that begin with ``least`` known words, in suffix order (by their first eight words), and their keys."""
    gap = np.flatnonzero(ids == 0)
    start = np.flatnonzero(ids)
    if not len(start):
        return start, keys(np.zeros((0, WINDOW), np.int64))
    start = start[gap[np.searchsorted(gap, start)] - start >= least]
    wide = ids[start[:, None] + np.arange(WINDOW)]
    wide[np.cumsum(wide == 0, axis=1) > 0] = 0  # beyond an unknown word nothing can match
    order = np.lexsort(wide.T[::-1])
    return start[order], keys(wide[order])


def search(tests: TestSuffixes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of every distinct test window: pairs (window, start in ids) of all occurrences. A place begins one
    window of each length at most."""
    start, key = suffix_array(ids, tests.least)
    lo, hi = np.searchsorted(key, tests.low, "left"), np.searchsorted(key, tests.high, "right")
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return window, start[np.repeat(lo, n) + inside]


def scan(tests: TestSuffixes, texts: list[bytes]) -> list[tuple]:
    """For each text: words, spans of hit words (starts and ends), item names, longest match (words, place, item)."""
    out: list[tuple] = []
    known, shard, first = tests.vocab.get, [], []

    def flush() -> None:
        nonlocal shard, first
        ids, at = np.array(shard + [0] * WINDOW, np.int64), np.array(first, np.int64)
        bounds = np.append(at, len(shard))
        window, start = search(tests, ids) if tests.least else (NONE, NONE)
        order = np.lexsort((window, start))
        window, start = window[order], start[order]
        edge = np.searchsorted(start, bounds)
        for d in range(len(at)):
            n, a, b = int(bounds[d + 1] - at[d] - 1), edge[d], edge[d + 1]
            if a == b:
                out.append((n, NONE, NONE, [], (0, None, None)))
                continue
            w, s = window[a:b], start[a:b] - at[d]
            size = tests.length[w]
            begin, end = joined(s, s + size)
            own = ids[at[d] : bounds[d + 1]]
            most, place = tests.longest(own, s[size == WINDOW])
            k = int(np.lexsort((s, -size))[0])
            if not most:
                most, place = int(size[k]), int(s[k])
            item = tests.first_item(own[place : place + most].astype(">u4").tobytes()) if most >= WINDOW else int(tests.items_of(w[k : k + 1])[0])
            out.append((n, begin, end, [tests.names[i] for i in tests.items_of(np.unique(w))], (most, place, tests.names[item])))
        shard, first = [], []

    for text in texts:
        words = text.translate(WORDS).split()
        first.append(len(shard))
        shard += map(known, words, repeat(0))
        shard.append(0)
        if len(shard) >= SHARD_WORDS:
            flush()
    flush()
    return out


def joined(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of overlapping or touching ones, sorted by their begin."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], begin[1:] > reach[:-1])) if len(begin) else np.zeros(0, bool)
    return begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(begin) else end


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, *, carry: bool = False, min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark documents that hold windows of eight words of test items.

    Every task builds suffix arrays of its documents and binary-searches each distinct test window in them, so no document
    is shuffled and the corpus is read once. The test texts are cut into blocks of about ``block_bytes``, each broadcast by
    itself; a task holds one at a time. Columns: n_words, n_hit (words inside an occurring window), n_items, items_sha256,
    contaminated (``min_items`` items or more), the longest verbatim match (words, the smallest of its items, its first
    place in words; a match is as long as both texts go on alike, at least a window), the items, and hit_spans (flat starts
    and ends in words).

    Null or empty texts have no words and no hits. Null items or item texts are left out; rows that repeat an item_id
    count as one item. A row that repeats is judged by itself. An empty benchmark marks nothing. A document or an item of
    any length is searched whole, in the memory of one task.
    """
    spark = docs.sparkSession
    tests = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    total = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    tests = tests.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    held = [spark.sparkContext.broadcast(TestSuffixes([(i, t.encode()) for i, t in tests.where(F.col("b") == b).select("i", "t").collect()])) for b in range(blocks)]

    def make():
        def fn(ids: list, texts: list[bytes]) -> dict:
            rows: list[tuple] = []
            for k, block in enumerate(held):
                found = scan(block.value, texts)
                rows = [both(x, y) for x, y in zip(rows, found)] if k else found
                if len(held) > 1:
                    block.__dict__.pop("_value", None)  # the next block takes its place in memory
            names = [sorted(r[3]) for r in rows]
            return {
                "n_words": [r[0] for r in rows], "n_hit": [int((r[2] - r[1]).sum()) for r in rows], "n_items": [len(n) for n in names],
                "items_sha256": [hashlib.sha256(",".join(n).encode()).hexdigest() for n in names],
                "contaminated": [len(n) >= min_items for n in names],
                "longest_words": [r[4][0] for r in rows], "longest_item": [r[4][2] for r in rows], "longest_at": [r[4][1] for r in rows],
                "items": names, "hit_spans": [np.stack([r[1], r[2]], axis=1).ravel() for r in rows],
            }

        return fn

    return map_docs(docs, make, FIELDS, carry=carry, rows=512 if blocks == 1 else 10_000)


def both(x: tuple, y: tuple) -> tuple:
    """What two blocks have found in one text."""
    begin, end = np.concatenate([x[1], y[1]]), np.concatenate([x[2], y[2]])
    order = np.argsort(begin, kind="stable")
    best = min((z[4] for z in (x, y) if z[4][0]), key=lambda m: (-m[0], m[1], m[2]), default=x[4])
    return (x[0], *joined(begin[order], end[order]), x[3] + y[3], best)


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tests = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return mark_contaminated(docs, tests).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_words", "longest_item", "longest_at")


UP, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_LIST = rf"regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{DOWN}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""WITH items AS (SELECT item_id::VARCHAR AS item, row_number() OVER () AS source, {WORD_LIST} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
grams AS (SELECT item, source, j, w[j:j + {WINDOW - 1}] AS g FROM (SELECT item, source, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS j FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM grams), d AS (SELECT doc_id, {WORD_LIST} AS w FROM documents),
parts AS (SELECT doc_id, n, p, w[p:p + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
found AS (SELECT doc_id, n, p, item, source, j FROM parts JOIN grams USING (g)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1),
runs AS (SELECT doc_id, item, n, p, source, p - j AS lag, p - row_number() OVER (PARTITION BY doc_id, source, p - j ORDER BY p) AS run FROM found),
matches AS (SELECT doc_id, item, max(n) + count(*) - 1 AS size, min(p) - 1 AS place FROM runs GROUP BY doc_id, item, source, lag, run),
best AS (SELECT doc_id, size, place, item FROM matches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, place, item) = 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated,
coalesce(size, 0)::INTEGER AS longest_words, item AS longest_item, place::INTEGER AS longest_at
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)"""
