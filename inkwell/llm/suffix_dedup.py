"""Suffix-array dedup: repeated 50-byte strings across documents, found with logarithmic families of suffix indexes.

A 50-byte window is keyed by the least hash of the 24-byte grams inside it, so equal windows have equal keys wherever
they stand, and neighbouring windows mostly share theirs. Texts are dealt into blocks. (1) Blocks tell each key bucket
their keys; (2) buckets answer which keys other blocks have too; (3) blocks send the stretches of text under shared keys;
(4) a bucket feeds them, in batches by ascending doc_id, to a family of suffix arrays and gets the repeated windows;
(5) blocks cut these from their texts. Only repeated text is sent by key, and a key never meets more than one copy of
equal stretches from each block. Suffixes are sorted and compared by their bytes; hashes only say where they meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import documents, ship

LENGTH, GRAM = 50, 24
BLOCK_BYTES, PIECE, BUCKET_KEYS = 8 << 20, 1 << 20, 1 << 18
#: Keys for each byte of text, about 2 / (windows that a gram can be the least of, and one).
KEYS_PER_BYTE = 2 / (LENGTH - GRAM + 2)
BATCH = 1 << 20
#: Blocks that share a key from which on its windows are sent one by one, each to the bucket of its own hash, so that a very
#: common gram doesn't bring all its surroundings into one bucket.
HOT = 1024
#: Rows without an id come after all others.
NO_ID = (1 << 63) - 1
_rng = np.random.default_rng(50)
TABLE = _rng.integers(1, 1 << 63, 256, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
FACTOR = 0xD6E8FEB86659FD93


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte grams, by doubling."""
    part, span, out, have = TABLE[x], 1, None, 0
    while True:
        if k & 1:
            if out is None:
                out, have = part, span
            else:
                n = len(x) - have - span + 1
                out = out[:n] * np.uint64(pow(FACTOR, span, 1 << 64)) + part[have : have + n]
                have += span
        k >>= 1
        if not k:
            break
        n = len(part) - span
        part = part[:n] * np.uint64(pow(FACTOR, span, 1 << 64)) + part[span : span + n]
        span *= 2
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if width > span else v


class Stretches:
    """Maximal runs of windows of one key, of many texts: text number, start in it, bytes, key, and where its bytes are."""

    def __init__(self, texts: list[bytes]):
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        self.buffers: list[bytes] = []
        pieces, size = [], 0
        for d, t in enumerate(texts):
            for a in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
                pieces.append((d, a, t[a : a + PIECE + LENGTH - 1]))
                size += len(pieces[-1][2])
                if size >= PIECE:
                    self._add(pieces, cols)
                    pieces, size = [], 0
        if pieces:
            self._add(pieces, cols)
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.int64)
        self.doc, self.start, self.size, self.key, self.at = (np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(cols, kinds))

    def _add(self, pieces: list[tuple[int, int, bytes]], cols: list[list[np.ndarray]]) -> None:
        buffer = b"".join(p[2] for p in pieces)
        least = sliding_least(gram_hashes(np.frombuffer(buffer, np.uint8), GRAM), LENGTH - GRAM + 1)
        sizes = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(sizes)
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[(ends - sizes)] = True
        outside = ends[:-1, None] - np.arange(1, LENGTH) if len(ends) > 1 else np.zeros((0, 1), np.int64)
        valid = np.ones(len(least), bool)
        valid[outside.ravel()] = False
        new[np.minimum(outside.min(1), len(least) - 1) if len(outside) else []] = True
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(least))) + LENGTH - 1
        keep = valid[begin]
        begin, size = begin[keep], size[keep]
        piece = np.searchsorted(ends, begin, "right")
        cols[0].append(np.array([p[0] for p in pieces])[piece])
        cols[1].append(begin - (ends - sizes)[piece] + np.array([p[1] for p in pieces])[piece])
        cols[2].append(size)
        cols[3].append(mixed(least[begin] + np.uint64(1)))  # least values crowd near zero
        cols[4].append(begin + (len(self.buffers) << 32))
        self.buffers.append(buffer)

    def text(self, k: int) -> bytes:
        a = int(self.at[k] & 0xFFFFFFFF)
        return self.buffers[int(self.at[k] >> 32)][a : a + int(self.size[k])]


#: A suffix, cut at LENGTH bytes. Sorts and compares byte by byte, zero bytes included, as all are of one width.
SUFFIX = np.dtype(f"S{LENGTH}")


class SuffixLevel:
    """A suffix array: distinct suffixes in byte order."""

    def __init__(self, suffix: np.ndarray):
        self.suffix = suffix

    def has(self, suffix: np.ndarray) -> np.ndarray:
        """Merge scan of sorted suffixes: which of them agree with one here in all LENGTH bytes."""
        at = np.searchsorted(self.suffix, suffix)
        inside = at < len(self.suffix)
        inside[inside] = self.suffix[at[inside]] == suffix[inside]
        return inside

    def merged(self, other: SuffixLevel) -> SuffixLevel:
        """Both in order; they have no suffix in common."""
        out = np.empty(len(self.suffix) + len(other.suffix), SUFFIX)
        at = np.searchsorted(self.suffix, other.suffix) + np.arange(len(other.suffix))
        own = np.ones(len(out), bool)
        own[at] = False
        out[at], out[own] = other.suffix, self.suffix
        return SuffixLevel(out)


class SuffixFamily:
    """Logarithmic index family: a new batch gets a suffix array, is scanned against every level, and joins the family as
    a level; levels of like size are merged, so there are about log2(batches) of them."""

    def __init__(self) -> None:
        self.levels: list[SuffixLevel] = []

    def add(self, suffix: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Add a batch of suffixes whose owners ascend and are beyond all before. Returns which of them agree in LENGTH
        bytes with a suffix of a smaller owner, in this batch or any before."""
        array = np.argsort(suffix, kind="stable")  # owners ascend inside equal suffixes
        inside, who = suffix[array], owner[array]
        new = np.ones(len(inside), bool)
        new[1:] = inside[1:] != inside[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        distinct = inside[first]
        old = np.zeros(len(first), bool)
        for level in self.levels:
            old |= level.has(distinct)
        repeated = np.empty(len(inside), bool)
        repeated[array] = old[group] | (who > who[first][group])
        self.levels.append(SuffixLevel(distinct[~old]))
        while len(self.levels) > 1 and len(self.levels[-2].suffix) <= 2 * len(self.levels[-1].suffix):
            a, b = self.levels.pop(), self.levels.pop()
            self.levels.append(b.merged(a))
        return repeated


def suffixes(data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches laid end to end: place of every window in data, and its bytes."""
    x = np.frombuffer(data, np.uint8)
    begin = np.cumsum(size) - size
    n = size - LENGTH + 1
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return at, np.lib.stride_tricks.sliding_window_view(x, LENGTH)[at].view(SUFFIX).ravel() if len(at) else np.zeros(0, SUFFIX)


def repeats(owner: np.ndarray, start: np.ndarray, size: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of text in, spans (index of the stretch, begin, end in its document) out that smaller owners have too.

    Equal stretches are indexed once, for their smallest owner: all larger ones repeat them whole."""
    order = np.argsort(owner, kind="stable")
    place = np.cumsum(size) - size
    family, k = SuffixFamily(), 0
    known: dict[bytes, int] = {}
    out = [(np.zeros(0, np.int64),) * 3]
    # batches end between owners and hold BATCH bytes or one owner
    total, ordered = np.cumsum(size[order]), owner[order]
    while k < len(order):
        end = int(np.searchsorted(total, (total[k - 1] if k else 0) + BATCH, "right"))
        end = int(np.searchsorted(ordered, ordered[min(max(end, k + 1), len(order)) - 1], "right"))
        pick, parts, whole, same = [], [], [], []
        for j in order[k:end].tolist():
            text = data[place[j] : place[j] + size[j]]
            first = known.setdefault(text, j)
            if first == j:
                pick.append(j)
                parts.append(text)
            elif owner[first] < owner[j]:
                whole.append(j)
            else:
                same.append((j, first))
        k = end
        out.append((np.array(whole, np.int64), start[whole], start[whole] + size[whole]))
        pick = np.array(pick, np.int64)
        at, inside = suffixes(b"".join(parts), size[pick])
        which = np.repeat(np.arange(len(pick)), size[pick] - LENGTH + 1)
        hit = family.add(inside, owner[pick][which])
        # a span ends where its stretch does
        new, old = np.ones(len(hit), bool), np.ones(len(hit), bool)
        new[1:] = ~hit[:-1] | (which[1:] != which[:-1])
        old[:-1] = ~hit[1:] | (which[1:] != which[:-1])
        begin, last = np.flatnonzero(hit & new), np.flatnonzero(hit & old)
        w = which[begin]
        offset = start[pick][w] - (np.cumsum(size[pick]) - size[pick])[w]
        found = (pick[w], at[begin] + offset, at[last] + offset + LENGTH)
        out.append(found)
        for j, first in same:  # a document's own copies of a stretch share its spans
            a, b = np.searchsorted(found[0], [first, first + 1]) if np.all(np.diff(found[0]) >= 0) else (0, 0)
            mine = np.flatnonzero(found[0] == first) if a == b else np.arange(a, b)
            out.append((np.full(len(mine), j), found[1][mine] + start[j] - start[first], found[2][mine] + start[j] - start[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Removed bytes, maximal removed runs, and the digest of what is left, of a text and its sorted disjoint spans."""
    left, removed, runs, last = hashlib.sha256(), 0, 0, 0
    for a, b in spans:
        left.update(text[last:a])
        removed, runs, last = removed + b - a, runs + 1, b
    left.update(text[last:])
    return removed, runs, left.hexdigest()


def pack(raw: bytes) -> bytes:
    """Numbers and text for the way between tasks; better than what the shuffle's own codec makes of them."""
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def read_block(table: pa.Table) -> tuple[list[tuple[int, bytes]], list[int], list[int]]:
    """Distinct (id, text) of a block in order; the places there of texts no smaller id has, and of copies of them."""
    rows = sorted({(i, t) for i, t in zip(table.column("id").to_pylist(), table.column("text").to_pylist()) if len(t) >= LENGTH})
    seen: dict[bytes, int] = {}
    own, copies = [], []
    for k, (i, t) in enumerate(rows):
        (copies if seen.setdefault(t, i) < i else own).append(k)
    return rows, own, copies


KEYS = "bucket int, block int, keys binary"
REPLY = "bucket int, block int, keys binary, hot binary"
PARTS = "bucket int, block int, id binary, row binary, start binary, size binary, data binary, done binary"
SPANS = "block int, spans binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of whole texts as UTF-8 bytes.

    Every byte goes that is covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id.
    spans has the removed runs' begins and ends, flat. One row for each input row.

    doc_id is an integer; a row without one counts as larger than all others (as 2^63 - 1). Rows that share a doc_id don't
    cover each other, nor do rows without one. Null texts are empty; texts under LENGTH bytes lose nothing. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = -(-total // BLOCK_BYTES) + 1, 1 << max(2, int(total * KEYS_PER_BYTE / BUCKET_KEYS).bit_length())
    shift = np.uint64(64 - buckets.bit_length() + 1)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64(id_)), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id"), id_.alias("id"), text.alias("text"))

    def short(key: np.ndarray) -> np.ndarray:
        """32 bits of a key below those that name its bucket."""
        return ((key << np.uint64(64 - int(shift))) >> np.uint64(32)).astype(np.uint32)

    def tell(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": [], "block": [], "keys": []}, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary())]))
        block = table.column("block")[0].as_py()
        rows_, own, _ = read_block(table)
        key = np.unique(Stretches([rows_[k][1] for k in own]).key)
        edge = np.searchsorted(key >> shift, np.arange(buckets + 1, dtype=np.uint64))
        at = [b for b in range(buckets) if edge[b] < edge[b + 1]]
        return pa.table({"bucket": pa.array(at, pa.int32()), "block": pa.array([block] * len(at), pa.int32()), "keys": pa.array([np.unique(short(key[edge[b] : edge[b + 1]])).tobytes() for b in at], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        whose = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        both = np.sort(np.concatenate(raw).astype(np.uint64) << np.uint64(32) | whose.astype(np.uint64))
        key, who = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        run = np.cumsum(new) - 1
        blocks_of = np.bincount(run, minlength=1)[run] if len(run) else run
        shared = blocks_of > 1
        key, who, hot = key[shared].astype(np.uint32), who[shared], blocks_of[shared] > HOT
        order = np.argsort(who, kind="stable")
        key, hot = key[order], hot[order]
        edge = np.searchsorted(who[order], np.arange(len(raw) + 1))
        out: dict[str, list] = {"bucket": [], "block": [], "keys": [], "hot": []}
        for k, (bucket, block) in enumerate(zip(table.column("bucket").to_pylist(), table.column("block").to_pylist())):
            if edge[k] < edge[k + 1]:
                own = slice(edge[k], edge[k + 1])
                for name, value in zip(out, (bucket, block, key[own].tobytes(), key[own][hot[own]].tobytes())):
                    out[name].append(value)
        kinds = {"bucket": pa.int32(), "block": pa.int32()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.binary())) for n, v in out.items()})

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.split()[0]: [] for f in PARTS.split(", ")}
        if table.num_rows:
            block = table.column("block")[0].as_py()
            texts, own, copies = read_block(table)
            s = Stretches([texts[k][1] for k in own])
            row = np.array(own, np.int64)[s.doc]
            owner = np.array([i for i, _ in texts], np.int64)[row]
            bucket, low = s.key >> shift, short(s.key)
            mine = np.zeros(len(s.key), bool)  # keys that two documents of this block have
            order = np.lexsort((owner, s.key))
            k, o = s.key[order], owner[order]
            run = np.cumsum(np.concatenate(([True], k[1:] != k[:-1]))) - 1 if len(k) else np.zeros(0, np.int64)
            if len(k):
                first, last = np.flatnonzero(np.diff(run, prepend=-1)), np.flatnonzero(np.diff(run, append=run[-1] + 1))
                mine[order] = (o[first] != o[last])[run]
            want = bucket << np.uint64(32) | low

            def said(name: str) -> np.ndarray:
                keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, r in zip(replies.column("bucket").to_pylist(), replies.column(name).to_pylist()))]))
                at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
                return keys[at] == want if len(keys) else np.zeros(len(want), bool)

            shared, hot = mine | said("keys"), said("hot")
            parts: dict[int, list] = {}
            known: dict[bytes, int] = {}
            done: list[tuple[int, int, int]] = [(k, 0, len(texts[k][1])) for k in copies]
            for j in np.flatnonzero(shared).tolist():
                text, i, begin, to = s.text(j), int(owner[j]), int(s.start[j]), int(bucket[j])
                for a in range(len(text) - LENGTH + 1) if hot[j] else (0,):
                    t = text[a : a + LENGTH] if hot[j] else text
                    if known.setdefault(t, i) < i:  # a smaller document here has the same stretch
                        done.append((int(row[j]), begin + a, begin + a + len(t)))
                    else:
                        parts.setdefault(xxhash.xxh64_intdigest(t) >> int(shift) if hot[j] else to, []).append((i, int(row[j]), begin + a, t))
            if done:
                parts[-1 - block] = []  # needs no bucket: a row of the block's own
            for b, rows_ in parts.items():
                for name, value in (("bucket", b), ("block", block), ("id", np.array([r[0] for r in rows_], np.int64).tobytes()), ("row", np.array([r[1] for r in rows_], np.int64).tobytes()), ("start", np.array([r[2] for r in rows_], np.int64).tobytes()), ("size", np.array([len(r[3]) for r in rows_], np.int64).tobytes()), ("data", b"".join(r[3] for r in rows_)), ("done", np.array(done if b < 0 else [], np.int64).tobytes())):
                    out[name].append(pack(value) if isinstance(value, bytes) else value)
        kinds = {"bucket": pa.int32(), "block": pa.int32()}
        return pa.table({n: pa.array(v, kinds.get(n, pa.binary())) for n, v in out.items()})

    def match(table: pa.Table) -> pa.Table:
        cols = {n: table.column(n).to_pylist() for n in table.column_names}
        cols |= {n: [unpack(x) for x in cols[n]] for n in ("id", "row", "start", "size", "data", "done")}
        blob = lambda n: [np.frombuffer(x, np.int64) for x in cols[n]]
        id_of, rows_, start, size = blob("id"), blob("row"), blob("start"), blob("size")
        whose = np.repeat(np.arange(len(id_of)), [len(x) for x in id_of])
        owner, start, size = np.concatenate(id_of), np.concatenate(start), np.concatenate(size)
        which, begin, end = repeats(owner, start, size, b"".join(cols["data"]))
        spans = np.stack([np.concatenate(rows_)[which], begin, end], axis=1)
        row = whose[which]
        by_row = np.argsort(row, kind="stable")
        edge = np.searchsorted(row[by_row], np.arange(len(id_of) + 1))
        out = [pack(spans[by_row[edge[k] : edge[k + 1]]].tobytes() + done) for k, done in enumerate(cols["done"])]
        return pa.table({"block": pa.array(cols["block"], pa.int32()), "spans": pa.array(out, pa.binary())})

    id_type = docs.schema["doc_id"].dataType
    result = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>").fields])

    def strike(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts = read_block(table)[0]
        by_row: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for blob in replies.column("spans").to_pylist():
            for k, a, b in np.frombuffer(unpack(blob), np.int64).reshape(-1, 3).tolist():
                by_row.setdefault(texts[k], []).append((a, b))
        out = []
        for i, t in zip(table.column("id").to_pylist(), table.column("text").to_pylist()):
            spans = [(a, min(b, len(t))) for a, b in joined(by_row.get((i, t), []))]
            out.append((len(t), *kept_bytes(t, spans), [x for ab in spans for x in ab]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        first = table.column("doc_id")
        return pa.table([first, *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=[f.name for f in result])

    told = rows.groupBy("block").applyInArrow(tell, KEYS)
    replies = told.groupBy("bucket").applyInArrow(answer, REPLY)
    parts = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(send, PARTS)
    spans = parts.groupBy("bucket").applyInArrow(match, SPANS)
    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(strike, result)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("spans")
