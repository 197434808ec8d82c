"""Bigram scores of a whole corpus under the model of all of it (base) and of a part of its documents (alt), as
``likelihood.score_corpus`` gives them, without a row for each token on the way.

Documents are dealt into blocks. A block sends each of its pairs of words once, with counts, to the bucket of the first
word; a bucket sums them up, and answers each block in the order of its question; the block then scores its tokens where
they are. Words are named by 64-bit hashes (blake2b), a pair by both words' hashes.

Texts that aren't the corpus's own are scored under models that ``train`` has counted: their blocks ask in the same way,
without adding to the counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from inkwell.operators import textpass
from inkwell.runtime import ship, written

#: Characters of text in a block, and of all text for a bucket.
BLOCK, BUCKET = 12_000_000, 12_000_000


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """The pairs of words in the sentences of a block's documents. ``pairs`` are distinct, by bucket and hashes."""

    def __init__(self, texts: list[str | None], in_alt: np.ndarray, buckets: int):
        ids, flat, doc, sent, size = _Ids(), [], [], [], []
        get = ids.__getitem__
        for k, t in enumerate(texts):
            for j, s in enumerate(textpass.SENTENCE.findall(t or "")):
                words = textpass.alpha_words(s.lower())
                if len(words) > 1:
                    flat.append(np.fromiter(map(get, words), np.int64, len(words)))
                    doc.append(k)
                    sent.append(j)
                    size.append(len(words) - 1)
        self.doc, self.sent, self.size = np.array(doc, np.int64), np.array(sent, np.int32), np.array(size, np.int64)
        if not flat:
            self.inverse = self.n = self.m = self.first = self.second = self.bucket = np.zeros(0, np.int64)
            return
        hashes = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8).digest() for w in ids), np.uint64)
        tokens = np.concatenate(flat)
        del flat, ids
        inside = np.ones(len(tokens) - 1, bool)
        inside[np.cumsum(self.size + 1)[:-1] - 1] = False  # a sentence's last word begins no pair
        code = tokens[:-1][inside] * len(hashes) + tokens[1:][inside]
        pair, inverse, n = np.unique(code, return_inverse=True, return_counts=True)
        m = np.bincount(inverse, weights=np.repeat(in_alt[self.doc], self.size), minlength=len(pair)).astype(np.int64)
        first, second = hashes[pair // len(hashes)], hashes[pair % len(hashes)]
        bucket = (first % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((second, first, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.inverse, self.n, self.m, self.first, self.second, self.bucket = place[inverse], n[order], m[order], first[order], second[order], bucket[order]

    def parts(self) -> list[tuple[int, slice]]:
        """Buckets and their pairs."""
        found, start = np.unique(self.bucket, return_index=True)
        return [(int(b), slice(int(a), int(e))) for b, a, e in zip(found, start, [*start[1:], len(self.bucket)])]


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _small(x: np.ndarray) -> bytes:
    return x.astype(np.uint32).tobytes() if not len(x) or x.max() < 1 << 32 else b"L" + x.astype(np.uint64).tobytes()


def _whole(b: bytes) -> np.ndarray:
    return (np.frombuffer(b[1:], np.uint64) if len(b) % 4 else np.frombuffer(b, np.uint32)).astype(np.int64)


ASKED = "block int, bucket int, kind int, contexts binary, runs binary, words binary, n binary, m binary"
#: Sums of a bucket over all blocks, and of the vocabularies the words that are at home there.
TRAINED = f"{ASKED}, v bigint, w bigint"
ANSWERS = "block int, bucket int, n binary, m binary, likelier binary, runs binary, sums binary, v bigint, w bigint"


def _asked(block: int, b: Block, buckets: int, counts: bool = True) -> list[tuple]:
    """Without ``counts`` a block asks only."""
    rows = []
    for k, s in b.parts():
        starts = _runs(b.first[s])
        n, m = (b.n[s], b.m[s]) if counts else (np.zeros(s.stop - s.start, np.int64),) * 2
        rows.append((block, k, 0, b.first[s][starts].tobytes(), _small(np.diff([*starts, s.stop - s.start])), b.second[s].tobytes(), _small(n), _small(m)))
    if not counts:
        return rows
    # the vocabulary: second words, and those of them that alt has
    order = np.argsort(b.second, kind="stable")
    words = b.second[order]
    starts = _runs(words)
    seen = np.add.reduceat(b.m[order], starts) > 0 if len(starts) else np.zeros(0, bool)
    words = words[starts]
    home = (words % np.uint64(buckets)).astype(np.int64)
    for k in np.unique(home):
        rows.append((block, int(k), 1, None, None, words[home == k].tobytes(), None, _small(seen[home == k].astype(np.int64))))
    return rows


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(fields), fields)], schema=pa.schema(fields))


def _vocabulary(rows: list[dict]) -> tuple[int, int]:
    """Words that are at home in a bucket, and those of them that alt has."""
    voc = [r for r in rows if r["kind"] == 1]
    if not voc:
        return 0, 0
    words, at = np.unique(np.concatenate([np.frombuffer(r["words"], np.uint64) for r in voc]), return_inverse=True)
    return len(words), int((np.bincount(at, weights=np.concatenate([_whole(r["m"]) for r in voc])) > 0).sum())


def _merged(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """Distinct pairs of a bucket, sorted: first and second word, counts; and of each asked pair its place among them."""
    first = np.concatenate([np.repeat(np.frombuffer(r["contexts"], np.uint64), _whole(r["runs"])) for r in rows])
    second = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])])
    starts = np.flatnonzero(new)
    n = np.add.reduceat(np.concatenate([_whole(r["n"]) for r in rows])[order], starts)
    m = np.add.reduceat(np.concatenate([_whole(r["m"]) for r in rows])[order], starts)
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    return f[starts], s[starts], n, m, pair


def _summed(table: pa.Table) -> pa.Table:
    """Sums over all blocks of a bucket, as one row that no block has asked."""
    rows = table.to_pylist()
    v, w = _vocabulary(rows)
    bucket, rows = rows[0]["bucket"], [r for r in rows if r["kind"] == 0]
    if not rows:
        return _table([(None, bucket, 1, None, None, None, None, None, v, w)], TRAINED)
    first, second, n, m, _ = _merged(rows)
    heads = _runs(first)
    return _table([(None, bucket, 0, first[heads].tobytes(), _small(np.diff([*heads, len(first)])), second.tobytes(), _small(n), _small(m), v, w)], TRAINED)


def _answer(table: pa.Table) -> pa.Table:
    """Sums over all blocks of a bucket: counts of each pair, rank inside its first word, sums over the first word. Pairs that
    were only asked count nothing."""
    rows = table.to_pylist()
    v, w = _vocabulary(rows)
    bucket, out = rows[0]["bucket"], [(None, rows[0]["bucket"], None, None, None, None, None, v, w)]
    rows = [r for r in rows if r["kind"] == 0]
    if any(r["block"] is not None for r in rows):
        f, _, n, m, pair = _merged(rows)
        heads = _runs(f)
        context = np.cumsum(np.concatenate([[True], f[1:] != f[:-1]])) - 1
        # pairs of a context by falling count: the likelier ones are those before the first with the same count
        down = np.lexsort((-n, context))
        level = np.concatenate([[True], (context[down][1:] != context[down][:-1]) | (n[down][1:] != n[down][:-1])])
        likelier = np.empty(len(n), np.int64)
        likelier[down] = np.maximum.accumulate(np.where(level, np.arange(len(n)), 0)) - heads[context[down]]
        more = np.where(n > 0, n + 1.0, 0.0)
        sums = np.stack([np.add.reduceat(x.astype(float), heads) for x in (n, m, n > 0, more * np.log(n + 1.0), more)], axis=1)
        at = 0
        for r in rows:
            runs = _whole(r["runs"])
            mine = pair[at : at + int(runs.sum())]
            at += len(mine)
            if r["block"] is None:
                continue
            ends = np.cumsum(runs) - 1
            out.append((r["block"], bucket, _small(n[mine]), _small(m[mine]), _small(likelier[mine]), r["runs"], sums[context[mine[ends]]].tobytes(), 0, 0))
    return _table(out, ANSWERS)


def _scores(b: Block, answers: list[dict], v: int, w: int) -> tuple[np.ndarray, ...]:
    """lp_base, rank_base, ent_base, lp_alt of the block's tokens."""
    answers = sorted(answers, key=lambda r: r["bucket"])
    n, m, likelier, runs = (np.concatenate([_whole(r[c]) for r in answers]) for c in ("n", "m", "likelier", "runs"))
    total, alt, seen, x, mass = np.concatenate([np.frombuffer(r["sums"], float).reshape(-1, 5) for r in answers]).T
    all_ = total + v
    # minus the sum of p ln p, p = (n + 1) / all, with the unseen words' one in all
    entropy = (mass * np.log(all_) - x) / all_ + (v - seen) / all_ * np.log(all_)
    spread = lambda c: np.repeat(c, runs)
    i = b.inverse
    return np.log((n + 1) / spread(all_))[i], (likelier + 1)[i], spread(entropy)[i], np.log((m + 1) / spread(alt + w))[i]


def token_rows(b: Block, lp, rank, ent, alt) -> list[np.ndarray]:
    starts = np.cumsum(b.size) - b.size
    tok = np.arange(len(lp)) - np.repeat(starts, b.size) + 1
    return [np.repeat(b.doc, b.size), np.repeat(b.sent, b.size), tok.astype(np.int32), lp, rank, ent, alt]


def sentence_rows(b: Block, lp, rank, ent, alt) -> list[np.ndarray]:
    """As ``likelihood.sentence_features``."""
    starts = np.cumsum(b.size) - b.size
    mean = lambda x: np.add.reduceat(x, starts) / b.size
    a, r, e = mean(lp), mean(np.log(rank.astype(float))), mean(ent)
    variance = mean((lp - np.repeat(a, b.size)) ** 2)
    cross = np.exp(mean(alt) - a)
    lrr = np.divide(a, r, out=np.zeros_like(a), where=r != 0)
    return [b.doc, b.sent, b.size, a, r, lrr, e, mean(lp + ent), variance, np.where(cross == 0, 1.0, cross)]


TOKENS = "sent int, tok int, lp_base double, rank_base bigint, ent_base double, lp_alt double"
SENTENCES = "sent int, n_tokens bigint, mean_logprob double, mean_logrank double, lrr double, mean_entropy double, mean_curvature double, logprob_variance double, cross_ppl_ratio double"


def score(docs: DataFrame, in_alt: DataFrame, key: str, text: str, fields: str = TOKENS, rows: Callable[..., list[np.ndarray]] = token_rows) -> DataFrame:
    """(key, fields...) of a corpus; in_alt: the keys of the documents that the second model has learned from. Scored tokens,
    or with SENTENCES and sentence_rows their features by sentence."""
    dealt, buckets = _dealt(docs, in_alt, key, text)
    answers = written(_questions(dealt, key, buckets).groupBy("bucket").applyInArrow(_answer, ANSWERS))
    known = answers.agg(F.sum("v").alias("v"), F.sum("w").alias("w")).first()
    return _told(dealt, answers, key, docs.schema[key].dataType, buckets, known.v or 0, known.w or 0, fields, rows)


@dataclass
class Trained:
    """Counts of both models (TRAINED), the sizes of their vocabularies, and the number of buckets."""

    table: DataFrame
    v: int
    w: int
    buckets: int


def train(docs: DataFrame, in_alt: DataFrame, key: str, text: str) -> Trained:
    """Both models of a corpus, counted once and written."""
    dealt, buckets = _dealt(docs, in_alt, key, text)
    table = written(_questions(dealt, key, buckets).groupBy("bucket").applyInArrow(_summed, TRAINED))
    known = table.agg(F.sum("v").alias("v"), F.sum("w").alias("w")).first()
    return Trained(table, known.v or 0, known.w or 0, buckets)


def score_under(model: Trained, docs: DataFrame, key: str, text: str, fields: str = TOKENS, rows: Callable[..., list[np.ndarray]] = token_rows) -> DataFrame:
    """As ``score``, of texts that the models needn't have seen: a pair they haven't seen gets the add-one probability of its
    context, as ``likelihood.score_tokens`` gives it."""
    dealt, _ = _dealt(docs, None, key, text)
    asked = model.table.where("kind = 0").drop("v", "w").unionAll(_questions(dealt, key, model.buckets, counts=False))
    answers = written(asked.groupBy("bucket").applyInArrow(_answer, ANSWERS))
    return _told(dealt, answers, key, docs.schema[key].dataType, model.buckets, model.v, model.w, fields, rows)


def _dealt(docs: DataFrame, in_alt: DataFrame | None, key: str, text: str) -> tuple[DataFrame, int]:
    """(block, key, _t, _alt): texts by block, and keys of the second model's documents; number of buckets."""
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.length(text)).alias("n")).first().n or 0
    blocks, buckets = size // BLOCK + 1, size // BUCKET + 1
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")
    dealt = docs.select(block, F.col(key), F.col(text).alias("_t"), F.lit(False).alias("_alt"))
    if in_alt is not None:
        dealt = dealt.unionAll(in_alt.select(block, F.col(key).cast(docs.schema[key].dataType), F.lit(None).cast("string"), F.lit(True)))
    return dealt, buckets


def _read(table: pa.Table, key: str, buckets: int) -> tuple[Block, pa.Array]:
    mask = np.asarray(table.column("_alt").to_numpy())
    own = table.filter(pa.array(~mask))
    mine = own.column(key).combine_chunks()
    inside = np.zeros(len(mine))
    if mask.any():
        good = set(table.column(key).combine_chunks().filter(pa.array(mask)).to_pylist())
        inside = np.array([k in good for k in mine.to_pylist()], float)
    return Block(own.column("_t").to_pylist(), inside, buckets), mine


def _questions(dealt: DataFrame, key: str, buckets: int, counts: bool = True) -> DataFrame:
    def ask(table: pa.Table) -> pa.Table:
        return _table(_asked(table.column("block")[0].as_py(), _read(table, key, buckets)[0], buckets, counts), ASKED)

    return dealt.groupBy("block").applyInArrow(ask, ASKED)


def _told(dealt: DataFrame, answers: DataFrame, key: str, kind: DataType, buckets: int, v: int, w: int, fields: str, rows: Callable[..., list[np.ndarray]]) -> DataFrame:
    schema = StructType([StructField(key, kind), *StructType.fromDDL(fields).fields])
    names = schema.names

    def tell(table: pa.Table, said: pa.Table) -> pa.Table:
        kinds = [pa.int32() if x.endswith(" int") else pa.int64() if x.endswith(" bigint") else pa.float64() for x in fields.split(", ")]
        b, keys = _read(table, key, buckets)
        if not len(b.size):
            return pa.Table.from_arrays([keys.slice(0, 0), *(pa.array([], k) for k in kinds)], names)
        first, *rest = rows(b, *_scores(b, said.to_pylist(), v, w))
        return pa.Table.from_arrays([keys.take(pa.array(first)), *(pa.array(c, k) for c, k in zip(rest, kinds))], names)

    return dealt.groupBy("block").cogroup(answers.where("block is not null").groupBy("block")).applyInArrow(tell, schema)
