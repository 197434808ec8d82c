"""LM scoring: log-probability of whole texts under a gated recurrent model, with word counts of the whole corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from copy import copy
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import LOWER, crc_mod, cut, documents, ship
from inkwell.llm.gru import Gru

#: Most frequent tokens with a softmax of their own; ranks up to which words are broadcast, in groups of the model.
WORDS, GROUP_RANKS = 1024, (4096, 16_384, 65_536)
#: The model learns from all training texts, in rounds: so many sixteenths of them, by hash, in each.
ROUNDS = (2, 14)
#: Fewer training tokens than LEAST_TOKENS are gone over again, up to MOST_EPOCHS times.
LEAST_TOKENS, MOST_EPOCHS = 1_000_000, 8
#: Words in a task's counter, tokens of texts scored or learned from side by side, and models added up by one task.
COUNTER, SIDE_BY_SIDE, FOLD = 400_000, 3_000_000, 16
#: Stands for the end of a text; no word holds white space.
END = b"\n"
SEED = 42


def held_out(doc_id: object) -> bool:
    return crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences of every token in training texts. Each task sums up before anything is shuffled, in a counter
    of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for b in batches:
            for start in range(0, b.num_rows, 256):
                for t in b.column(0).slice(start, 256).cast(pa.binary()).to_pylist():
                    counts.update((t or b"").translate(LOWER).split())
                    counts[END] += 1
                if len(counts) >= COUNTER:
                    yield flush()
        yield flush()

    return training(docs).select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def training(docs: DataFrame) -> DataFrame:
    """(text, slice): the training texts, null ones empty, and a sixteenth of them that each belongs to."""
    slice_ = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("slice")), F.lit(16))
    return docs.where(crc_mod("doc_id", 7) != 2).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), slice_.alias("slice"))


class CharModel:
    """Probability of a word as a string of bytes, its end included: third order over hashed contexts, shrunk to second
    and first order. Over all strings without white space it sums to one."""

    SYMBOLS, STOP, CONTEXTS, SHRINK = 257, 256, 1024, 5.0

    def __init__(self, places: list[int], counts: list[int]):
        n, size = self.SYMBOLS, self.SYMBOLS * self.SYMBOLS
        every = np.zeros(size + self.CONTEXTS * n)
        every[np.array(places, np.int64)] = counts
        two, self.three = every[:size].reshape(n, n), every[size:].reshape(self.CONTEXTS, n)
        one = two.sum(0) + 0.5
        one[[9, 10, 11, 12, 13, 32]] = 0
        one /= one.sum()
        self.two = (two + self.SHRINK * one) / (two.sum(1, keepdims=True) + self.SHRINK)
        self.total = self.three.sum(1)
        # no word is empty
        self.start = float(1 - self._next(self.context(np.array([self.STOP]), np.array([self.STOP])), np.array([self.STOP]), np.array([self.STOP]))[0])

    @classmethod
    def context(cls, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (before * 31 + last * 7919 + (before * last) % 1009) % cls.CONTEXTS

    @classmethod
    def symbols(cls, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words and their ends, the two before each, and where words begin."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        x = np.full(int(size.sum()) + len(words), cls.STOP, np.int64)
        inside = np.ones(len(x), bool)
        inside[begin + size] = False
        x[inside] = np.frombuffer(b"".join(words), np.uint8)
        last = np.concatenate(([cls.STOP], x[:-1]))
        before = np.where(last == cls.STOP, cls.STOP, np.concatenate(([cls.STOP], last[:-1])))
        return x, last, before, begin

    @classmethod
    def places(cls, words: list[bytes]) -> np.ndarray:
        """Where the words' symbols count."""
        x, last, before, _ = cls.symbols(words)
        return np.concatenate([last * cls.SYMBOLS + x, cls.SYMBOLS**2 + cls.context(before, last) * cls.SYMBOLS + x])

    def _next(self, context: np.ndarray, last: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (self.three[context, x] + self.SHRINK * self.two[last, x]) / (self.total[context] + self.SHRINK)

    def log10(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        x, last, before, begin = self.symbols(words)
        return np.add.reduceat(np.log10(self._next(self.context(before, last), last, x)), begin) - np.log10(self.start)


class WordModel:
    """The recurrent model over the short list and groups of rarer words, and what the broadcast words need."""

    def __init__(self, head: list[tuple[bytes, int]], total: dict[str, int], chars: CharModel):
        """head: (word, c) of words by falling frequency, the end first. total: sums over all words of c: n, words (c > 0),
        once (c = 1)."""
        own = head[:WORDS]
        counts = np.array([c for _, c in head], np.int64)
        ranks = [len(own), *(max(len(own), min(r, len(head))) for r in GROUP_RANKS)]
        groups = len(GROUP_RANKS) + 1  # the last group is of all other words, the unknown among them
        self.number = {w: k for k, (w, _) in enumerate(head)}
        self.token = np.arange(len(head))
        # log10 of a word's probability inside its group; 0 for words of their own
        self.inside = np.zeros(len(head))
        mass = np.zeros(groups)
        for g, (a, b) in enumerate(zip(ranks, ranks[1:])):
            self.token[a:b] = len(own) + g
            mass[g] = counts[a:b].sum()
            if b > a:
                self.inside[a:b] = np.log10(counts[a:b] / mass[g])
        self.rest = len(own) + groups - 1
        self.token_of = dict(zip(self.number, self.token.tolist()))
        rest = total["n"] - int(counts.sum())
        mass[-1] = rest + 1
        # Good and Turing: of the tokens beyond the head as many are unknown as belong to words seen once
        self.unknown = (total["once"] + 1) / (rest + 1)
        self.known_share = (1 - self.unknown) / max(rest, 1)
        self.chars = chars
        # a last entry stands for words beyond the head, whose number is -1
        self.token, self.inside = np.append(self.token, self.rest).astype(np.int16), np.append(self.inside, 0.0)
        self.base, self.known = np.append(np.log10(counts + 1.0), 0.0), np.append(counts > 0, False)
        self.norm = float(np.log10(total["n"] + total["words"] + 1))
        self.gru = Gru(counts[: len(own)].astype(float), mass)

    def tokens(self, text: bytes) -> np.ndarray:
        """Tokens of the model alone."""
        words = text.translate(LOWER).split()
        return np.fromiter(map(self.token_of.get, words, repeat(self.rest)), np.int16, len(words))

    def ids(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Head numbers (-1: not in the head), tokens of the model, and the words that are not in the head."""
        words = text.translate(LOWER).split()
        k = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        return k, self.token[k], [words[j] for j in np.flatnonzero(k < 0).tolist()]


def fit_chars(counts: DataFrame) -> CharModel:
    """The character model of all words seen once. What comes to the driver is bounded by its two tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CharModel.SYMBOLS**2 + CharModel.CONTEXTS * CharModel.SYMBOLS, np.int64)
        for b in batches:
            sums += np.bincount(CharModel.places(b.column(0).to_pylist()), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["at", "n"])

    rows = counts.where("c = 1").select("word").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    return CharModel([r["at"] for r in rows], [r.n for r in rows])


def learn(docs: DataFrame, model: WordModel, tokens: int) -> None:
    """Fit the recurrent model on all training texts, whole ones of any length.

    In each round every task starts from the same parameters, goes over its own texts of the round's slices by truncated
    backpropagation, and the tasks' parameters are averaged by tokens, in folds of FOLD, so that few come to the driver.
    """
    spark, texts = docs.sparkSession, training(docs)
    epochs, first = max(1, min(MOST_EPOCHS, LEAST_TOKENS // max(tokens, 1))), 0
    shapes = {k: v.shape for k, v in model.gru.p.items()}
    for turn, many in enumerate(ROUNDS):
        held = spark.sparkContext.broadcast(model)
        rate, to = 0.01 * (1 - turn / (2 * len(ROUNDS))), 0.3 if turn < len(ROUNDS) - 1 else 0.0

        def run(batches: Iterator[pa.RecordBatch], held=held, rate=rate, to=to) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            m, waiting, size, weight = held.value, [], 0, 0
            gru = copy(m.gru)  # other tasks of this worker start from the same parameters
            gru.p = {k: v.copy() for k, v in gru.p.items()}
            for b in batches:
                for t in b.column(0).cast(pa.binary()).to_pylist():
                    waiting.append(m.tokens(t))
                    size += len(waiting[-1]) + 1
                    if size >= SIDE_BY_SIDE:
                        gru.fit(waiting, epochs=epochs, rate=rate, to=to)
                        waiting, size, weight = [], 0, weight + size
            gru.fit(waiting, epochs=epochs, rate=rate, to=to)
            weight += size
            if weight:
                flat = np.concatenate([v.ravel() for v in gru.p.values()]).astype(np.float64) * weight
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([flat.tobytes()], pa.binary()), pa.array([weight], pa.int64())], names=["part", "sums", "weight"])

        def fold(table: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
            return pa.table({"part": pa.array([table.column("part")[0].as_py() // FOLD], pa.int64()), "sums": pa.array([sums.tobytes()], pa.binary()), "weight": pa.array([sum(table.column("weight").to_pylist())], pa.int64())})

        kind = "part long, sums binary, weight long"
        own = texts.where((F.col("slice") >= first) & (F.col("slice") < first + many)).select("text")
        found, first = own.mapInArrow(run, kind), first + many
        parts = own.rdd.getNumPartitions()
        while parts > FOLD:
            found, parts = found.groupBy(F.floor(F.col("part") / FOLD).alias("g")).applyInArrow(fold, kind), -(-parts // FOLD)
        rows = found.collect()
        if weight := sum(r.weight for r in rows):
            flat, at = sum(np.frombuffer(r.sums, np.float64) for r in rows) / weight, 0
            for k, shape in shapes.items():
                n = int(np.prod(shape))
                model.gru.p[k] = flat[at : at + n].reshape(shape).astype(np.float32)
                at += n


def fit_words(docs: DataFrame) -> tuple[WordModel, DataFrame, dict[str, int]]:
    """Counts of all training texts, the character model of rare words, and the recurrent model fitted on all of them."""
    ship(docs.sparkSession)
    counts = cut(count_words(docs))
    r = counts.agg(F.sum("c").alias("n"), F.count("*").alias("words"), F.count_if(F.col("c") == 1).alias("once")).first()
    total = {k: int(r[k] or 0) for k in ("n", "words", "once")}
    # The head are the words above a count that so many have at most; a histogram of sixteenths of powers of two finds it,
    # so no more than the head comes to the driver. Words seen once stay out: they are what unknown words are like.
    bins, least = counts.where("c > 1").groupBy(F.floor(F.log2("c") * 16).alias("bin")).count().orderBy(F.desc("bin")).collect(), 1 << 62
    room = GROUP_RANKS[-1] - 1
    for r in bins:
        room -= r["count"]
        if room < 0:
            break
        least = r.bin
    top = counts.where(((F.col("c") > 1) & (F.floor(F.log2("c") * 16) >= least)) | (F.col("word") == END)).collect()
    top.sort(key=lambda x: (x.word != END, -x.c, x.word))
    head = [(bytes(x.word), x.c) for x in top] or [(END, 0)]
    total["once"] -= head[0][1] == 1  # the end is no word
    model = WordModel(head, total, fit_chars(counts.where(F.col("word") != END)))
    learn(docs, model, total["n"])
    return model, counts, total


def score_texts(docs: DataFrame, model: WordModel, counts: DataFrame, total: dict[str, int]) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    score is the log10 probability of the text: over all texts the probabilities sum to one. A word of the head has its
    probability in the recurrent model, a word beyond it a share of the mass of rare words: known ones by their count,
    unknown ones by the character model, in the proportion that words seen once foretell. Tasks score all that the
    broadcast words settle (their number is fixed) and send rarer words, summed by text, to be joined with their counts;
    every text's own row goes along with a key of its own, so one pass over the texts does. Keys follow from the rows, so
    a task that runs again sends the same.

    Null and empty texts are the end alone. Repeated rows are each scored. A null id counts as an empty text when its
    remainder is taken. Without training texts all words are unknown and the model is as it was started.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("key long, more int, h long, check int, n int, chars double, held_out boolean, n_known long, base double, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        m, out, ln10 = held.value, to_arrow_schema(schema), np.log(10)
        waiting: list[tuple] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, tokens
            if not waiting:
                return
            scores = m.gru.score([w[-1] for w in waiting]) / ln10
            cols = [
                [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting],
                [xxhash.xxh64_intdigest(w[1].to_bytes(8, "little", signed=True), 5) - (1 << 63) for w in waiting], [-1] * len(waiting),
                [w[3] for w in waiting], None, [held_out(w[0]) for w in waiting],
                [w[4] for w in waiting], [w[5] for w in waiting], scores + [w[6] for w in waiting],
            ]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(waiting), f.type) if c is None else pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)
            waiting, tokens = [], 0

        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                keys, mores, rare, ns = [], [], [], []
                for i, t, key, more in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    k, token, beyond = m.ids(t or b"")
                    end = m.number[END]
                    waiting.append((i, key, more, len(k) + 1, int(m.known[k].sum()) + int(m.known[end]), float(m.base[k].sum() + m.base[end]), float(m.inside[k].sum()), token))
                    tokens += len(k) + 1
                    found = Counter(beyond)
                    keys += [key] * len(found)
                    mores += [more] * len(found)
                    rare += found
                    ns += found.values()
                if rare:
                    n = len(rare)
                    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in rare), np.uint64, n).view(np.int64)
                    check = np.fromiter((crc32(w) for w in rare), np.int64, n) & 0x7FFFFFFF
                    cols = [None, keys, mores, hashes, check, ns, m.chars.log10(rare), None, None, None, None]
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)
                if tokens >= SIDE_BY_SIDE:
                    yield from flush()
        yield from flush()

    text = F.col("text").cast("string")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce(text, F.lit("")))
    parts = docs.select("doc_id", text.alias("text"), key.alias("key"), F.hash(F.col("doc_id"), text).alias("more")).mapInArrow(run, schema)
    known = counts.select(F.xxhash64("word").alias("h"), F.crc32("word").bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int").alias("check"), "c")
    parts = parts.join(known.hint("shuffle_hash"), ["h", "check"], "left")  # distinct words, dealt evenly; no sort of the texts' words
    own, c = F.col("held_out").isNotNull(), F.coalesce("c", F.lit(0))
    rare_base = F.when(own, F.col("base")).otherwise(F.col("n") * F.log10(c + 1.0))
    unknown = F.col("chars") + F.lit(float(np.log10(model.unknown)))
    rare = F.when(c > 0, F.log10(c * F.lit(float(model.known_share)) + F.pow(F.lit(10.0), F.greatest(unknown, F.lit(-300.0))))).otherwise(unknown)
    found = parts.groupBy("key", "more").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max(F.when(own, F.col("n"))).cast("long").alias("n_tokens"), F.count_if(own).alias("copies"),
        F.sum(F.when(own, F.col("n_known")).when(c > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(rare_base).alias("base"), F.sum(F.when(own, F.col("score")).otherwise(F.col("n") * rare)).alias("score"),
    )
    copies = F.col("copies")  # rows that repeat share a key, and each has its share of the sums
    rows = found.select("doc_id", "held_out", "n_tokens", (F.col("n_known") / copies).cast("long").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"), (F.col("base") / copies - F.col("n_tokens") * F.lit(model.norm)).alias("base_score"), (F.col("score") / copies).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    return rows.drop("copy")


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_texts(docs, *fit_words(docs))
