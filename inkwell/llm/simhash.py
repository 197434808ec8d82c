"""SimHash near-duplicates: deletion-variant signatures, equality join, verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import LOWER, cut, documents, map_docs, ship, tasks_for, written

SEED = 42
#: Ids up to which rows are picked by a broadcast of ids.
FEW = 1 << 20
#: Members of a component that are compared in one block, members that all of a larger one are compared with first, and
#: shingle hashes that a block has about.
SMALL, PIVOTS, BLOCK_HASHES = 64, 16, 1 << 22
#: Rows of a block that others are compared with, that are compared with others, and that are both.
HELD, ASKS, BOTH = 0, 1, 2


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Space-joined shingles, repeats included; of fewer words the whole sequence, of none nothing."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    return [joined[a:b] for a, b in zip(begins.tolist(), ends[width - 1 :].tolist())]


def hashes(parts: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(p, SEED) for p in parts), np.uint64, len(parts))


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 of no hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        part = h[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def signatures(docs: DataFrame, *, width: int = 3, distinct: bool = False, words: bool = False) -> DataFrame:
    """(doc_id, fp, same) of whole texts, A-Z in lower case. fp: the fingerprint as a signed long.

    distinct: each shingle counts once. words: ``same`` is a hash of the words, else 0 (texts of one fingerprint are alike).
    """

    def make():
        def fn(ids: list, texts: list[bytes]) -> dict:
            fps, same = [], []
            for t in texts:
                parts = t.translate(LOWER).split()
                h = hashes(list(set(parts)) if distinct and width == 1 else shingles(parts, width))
                fps.append(fingerprint(np.unique(h) if distinct else h))
                same.append(xxhash.xxh64_intdigest(b" ".join(parts), SEED + 1) if words else 0)
            return {"fp": np.array(fps, np.uint64).view(np.int64), "same": np.array(same, np.uint64).view(np.int64)}

        return fn

    return map_docs(docs, make, [("fp", "long"), ("same", "long")])


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of each row whose id (node) is given."""

    def make():
        def fn(_: list, texts: list[bytes]) -> dict:
            parts = [t.translate(LOWER).split() for t in texts]
            return {"shingles": [np.unique(hashes(shingles(w, width))).view(np.int64) for w in parts]}

        return fn

    ids = cut(ids.distinct())
    picked = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= FEW else ids, F.col("doc_id").cast("long") == F.col("node"), "left_semi")
    return map_docs(picked, make, [("shingles", "array<long>")]).select(F.col("doc_id").cast("long").alias("node"), "shingles")


def segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the fewest segments of which one differs by at most one bit, where all 64 differ by ``bits`` at most."""
    n = bits // 2 + 1
    edge = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def variants(fp: Column, bits: int) -> Column:
    """Keys of a fingerprint: each segment as it is (wildcard 0), and with each one of its bits deleted (wildcard 1 + bit)."""
    keys = []
    for s, (low, width) in enumerate(segments(bits)):
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for wild in range(width + 1):
            kept = part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << wild >> 1)).cast("long")) if wild else part
            keys.append(kept.bitwiseOR(F.lit((s << 6 | wild) << 33).cast("long")))
    return F.array(*keys)


def run_links(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links inside a run of one key, as pairs of its members: breadth-first trees, in which each member looks at those
    not reached yet. They connect what all pairs at most ``bits`` bits apart would, and grow with the members only."""
    out: list[tuple[int, int]] = []
    rest = np.arange(len(fp))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= bits
            if near.any():
                found = rest[near].tolist()
                out += [(x, y) for y in found]
                front += found
                rest = rest[~near]
    return out


def meeting(a: np.ndarray, b: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """Segment and wildcard (as in a key) under which two fingerprints meet first, of all under which they do."""
    x, out = a ^ b, np.full(len(a), -1, np.int64)
    for s, (low, width) in reversed(list(enumerate(cuts))):
        part = (x >> np.uint64(low)) & np.uint64((1 << width) - 1)
        wild = np.where(part == 0, 0, 1 + np.bitwise_count(part - np.uint64(1)).astype(np.int64))  # of a power of two: 1 + its bit
        out = np.where(np.bitwise_count(part) <= 1, s << 6 | wild, out)
    return out


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first, many at a time, without cutting a run of equal values in it."""
    held: list[list[np.ndarray]] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([c.to_numpy() for c in b.columns])
        count += b.num_rows
        if count >= 1 << 18:
            rows = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last run may go on in the next batch
            if last:
                yield [x[:last] for x in rows]
            held, count = [[x[last:] for x in rows]], len(rows[0]) - last
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def links(nodes: DataFrame, bits: int) -> DataFrame:
    """Links (u, v), u > v, between nodes (fp, node): they connect all whose fingerprints differ in at most ``bits`` bits.

    Each node goes to the keys of its variants; equal keys meet by one shuffle, and a run of equal keys is verified at
    once. Runs with a deleted bit only matter where that bit differs inside, for the others have met without it. A link
    is given by the first key its ends meet under and left out by later ones: their ends are connected by then.
    """
    spark = nodes.sparkSession
    ship(spark)
    cuts = segments(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, node in whole_runs(batches):
            fp = fp.view(np.uint64)
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(begin, len(key)))
            wild = (key >> np.int64(33)) & np.int64(63)
            low = np.array([a for a, _ in cuts])[key >> np.int64(39)]
            bit = (fp >> np.maximum(low + wild - 1, 0).astype(np.uint64)) & np.uint64(1)
            mixed = np.minimum.reduceat(bit, begin) != np.maximum.reduceat(bit, begin)
            want = (size > 1) & ((wild[begin] == 0) | mixed)
            two = begin[want & (size == 2)]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
            xs, ys = [near], [near + 1]
            for b, n in zip(begin[want & (size > 2)].tolist(), size[want & (size > 2)].tolist()):
                if pairs := run_links(fp[b : b + n], bits):
                    x = np.array(pairs) + b
                    xs.append(x[:, 0])
                    ys.append(x[:, 1])
            x, y = np.concatenate(xs), np.concatenate(ys)
            first = meeting(fp[x], fp[y], cuts) == key[x] >> np.int64(33)
            u, v = node[x[first]], node[y[first]]
            e = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)])[:, u != v], axis=1) if len(u) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[0], pa.int64()), pa.array(e[1], pa.int64())], names=["u", "v"])

    rows = nodes.select(F.explode(variants(F.col("fp"), bits)).alias("key"), "fp", "node")
    rows = rows.repartition(tasks_for(spark, 4), "key").sortWithinPartitions("key", "fp", "node")
    return rows.mapInArrow(run, "u long, v long").distinct()


def alike(pivots: list[np.ndarray], sets: list[np.ndarray], least: float) -> list[np.ndarray]:
    """For each pivot the places of all sets whose similarity (shared of all hashes) with it is ``least`` or more, exactly.
    Only sets that share a hash with a pivot are looked at; sets without any hash are alike."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([np.zeros(0, np.int64), *sets])
    order = np.argsort(flat, kind="stable")
    flat, owner, out = flat[order], np.repeat(np.arange(len(sets)), size)[order], []
    for p in pivots:
        lo, hi = np.searchsorted(flat, p, "left"), np.searchsorted(flat, p, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        out.append(np.flatnonzero(shared >= least * (len(p) + size - shared) - 1e-9))
    return out


def compare(rows: DataFrame, least: float) -> DataFrame:
    """Verified links (u, v), u > v, of rows (comp, blk, kind, node, root, shingles). In each block of a component the rows
    of kind ASKS and BOTH are compared with those of kind HELD and BOTH. Of the members of one group (root) that a row is
    like, one link is given, so links don't grow with the square of a block."""
    spark = rows.sparkSession
    ship(spark)

    def edges(kind: list[int], node: list[int], root: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        asking = [k for k, x in enumerate(kind) if x != HELD]
        held = np.array([k for k, x in enumerate(kind) if x != ASKS], np.int64)
        groups, uv = np.array(root, np.int64), set()
        found = alike([sets[k] for k in asking], [sets[k] for k in held], least) if asking and len(held) else []
        for k, near in zip(asking, found):
            near = held[near]
            near = near[groups[near] != groups[k]]
            for y in near[np.unique(groups[near], return_index=True)[1]].tolist():
                uv.add((max(node[k], node[y]), min(node[k], node[y])))
        e = np.array(sorted(p for p in uv if p[0] != p[1]), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0], pa.int64()), pa.array(e[:, 1], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple[list, list, list, list] = ([], [], [], [])
        now = None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:5]]
            sets = b.column(5)
            flat, edge = sets.values.to_numpy(), sets.offsets.to_numpy()
            for k, key in enumerate(zip(cols[0], cols[1])):
                if now != key:
                    if len(block[0]) > 1:
                        yield edges(*block)
                    block, now = ([], [], [], []), key
                for held, value in zip(block, (cols[2][k], cols[3][k], cols[4][k], flat[edge[k] : edge[k + 1]].copy())):
                    held.append(value)
        if len(block[0]) > 1:
            yield edges(*block)

    rows = rows.select("comp", "blk", "kind", "node", "root", "shingles").repartition(tasks_for(spark, 4), "comp", "blk")
    return rows.sortWithinPartitions("comp", "blk").mapInArrow(run, "u long, v long").distinct()


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has FEW rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


def verified_components(nodes: DataFrame, docs: DataFrame, bits: int, width: int, least: float) -> DataFrame:
    """components() of all pairs of nodes (fp, node: a doc_id) within one component of fingerprint links whose sets of
    shingles are alike to ``least``: single linkage, exactly.

    Components of more than SMALL members, or of long texts, are cut into blocks of a size that grows with the root of the
    component's. First every member is compared with its own block, and some PIVOTS members with all blocks; what is alike
    is joined. After that a pair that isn't joined has an end outside its component's largest group, so it is enough to
    compare those members with every block: all at once where this sends few rows for each member, else four times as many
    in each turn. Members that have been compared with all are done, so the turns end with nothing left; inside a group
    that is joined no more pairs are made.
    """
    cand = components(links(nodes, bits))
    members = cand.select(F.col("root").alias("comp"), "node").unionAll(cand.select(F.col("root").alias("comp"), F.col("root").alias("node")).distinct())
    sets = cut(cut(members).join(shingle_sets(docs, members.select("node"), width), "node"))
    sizes = sets.groupBy("comp").agg(F.count("*").alias("size"), F.sum(F.size("shingles")).alias("bytes"))
    blocks = F.greatest(F.when(F.col("size") > SMALL, F.ceil(F.sqrt(F.col("size").cast("double")) / 2)).otherwise(1), F.ceil(F.col("bytes") / BLOCK_HASHES)).cast("int")
    large = cut(sizes.withColumn("blocks", blocks).where("blocks > 1").select("comp", "size", "blocks"))
    sets = sets.join(small(large), "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    luck = lambda turn: F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    blk = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    to_all = lambda df: df.withColumn("kind", F.lit(ASKS)).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = luck(0) * F.col("size") < PIVOTS
    own = sets.withColumn("blk", blk).withColumn("kind", F.lit(BOTH)).withColumn("root", F.col("node"))
    roots = components(compare(own.unionByName(to_all(own.where((F.col("blocks") > 1) & first))), least))
    many = cut(sets.where("blocks > 1").withColumn("blk", blk).withColumn("kind", F.lit(HELD)))
    state = many.select("comp", "size", "blocks", "node", first.alias("done")).distinct()
    turn = PIVOTS
    while True:
        state = cut(state.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        groups = state.groupBy("comp", "root").agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("open"))
        tops = groups.groupBy("comp").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("top"), F.max_by("open", F.struct("n", -F.col("root"))).alias("there"), F.sum("open").alias("all"))
        tops = cut(tops.where("all > there").select("comp", "top", (F.col("all") - F.col("there")).alias("left")))
        if tops.isEmpty():
            return roots
        turn *= 4
        state = state.join(small(tops), "comp", "left")
        asked = F.coalesce(~F.col("done") & (F.col("root") != F.col("top")) & ((F.col("left") * F.col("blocks") <= 16 * F.col("size")) | (luck(turn) * F.col("left") < turn)), F.lit(False))
        state = cut(state.withColumn("asked", asked).drop("left"))
        pool = many.join(state.where("top is not null").select("node", "root", "asked"), "node")
        found = compare(pool.unionByName(to_all(pool.where("asked"))), least)
        roots = components(roots.toDF("u", "v").unionAll(found))
        state = state.select("comp", "size", "blocks", "node", (F.col("done") | F.col("asked")).alias("done"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge, root: the smallest node reachable. Large-star and small-star in turn.

    Each half is a grouped minimum and a join on the node; every step is a written table in the shared folder, and only a
    count and a sum of hashes come to the driver. As the minima are written too, both sides of a join come from a shuffle of
    their own, and a node that most edges share can be split as it runs.
    """
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = None
    while (now := sign(edges)) != before and now[0]:
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), instead_of=(least, edges))
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        edges = written(small.where("u <> v").distinct(), instead_of=(least, large))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def group_near_duplicates(docs: DataFrame, *, width: int = 3, bits: int = 2, distinct: bool = False, verify: tuple[int, float] | None = None) -> DataFrame:
    """(doc_id, fp, component_id): documents linked where fingerprints differ in at most ``bits`` bits.

    With ``verify`` = (words, similarity), a link is instead a pair of documents that such links connect and whose
    shingles of so many words have that similarity (of the whole sets, exactly). Copies are folded into one node before
    anything is shuffled by key, so a group of copies is one row of the join. component_id is the smallest doc_id
    reachable.

    doc_id is an integer. Null texts are empty; empty texts share fingerprint zero and are linked like any other. Rows
    that repeat give one row each. Rows that share a doc_id count as one document in links. A null id can't name a
    component, but its row gets the component of its fingerprint's other rows, null if there is none.
    """
    sig = cut(signatures(docs, width=width, distinct=distinct, words=verify is not None))
    nodes = cut(sig.groupBy("fp", "same").agg(F.min("doc_id").cast("long").alias("node")))  # so that the last join can be split
    known = nodes.where(F.col("node").isNotNull()).select("fp", "node")
    roots = verified_components(known, docs, bits, *verify) if verify else components(links(known, bits))
    of_node = nodes.join(roots, "node", "left").select("fp", "same", F.coalesce("root", "node").alias("component_id"))
    return sig.select("doc_id", "fp", "same").join(of_node, ["fp", "same"]).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, width: int, bits: int, distinct: bool, verify: tuple[int, float]) -> DataFrame:
    """The documents that stay when of each group (as in group_near_duplicates) one does: that of the smallest doc_id.

    A document is a row's id and text. So rows that share an id but not the text are judged apart, null ids come last
    and stay like others, and of rows equal in both one stays (which one isn't fixed, if their other columns differ).
    Null texts are empty, and empty texts are copies of each other. All columns stay, whatever their names.
    """
    key = F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"].cast("string"), F.lit("")))
    named = docs.select(F.struct(key.alias("key"), docs["doc_id"].alias("id")).alias("doc_id"), docs["text"].alias("text"))
    sig = cut(signatures(named, width=width, distinct=distinct, words=True).select("doc_id.key", "doc_id.id", "fp", "same"))
    nodes = cut(sig.groupBy("fp", "same").agg(F.min("key").alias("node"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")))
    roots = verified_components(nodes.select("fp", "node"), docs.select(key.alias("doc_id"), docs["text"].alias("text")), bits, *verify)
    member = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    first = member.join(nodes.select("node", "best"), "node").groupBy("root").agg(F.min("best").alias("first"))
    kept = nodes.join(member.join(first, "root").drop("root"), "node", "left").select("fp", "same", F.coalesce("first", "best")["key"].alias("kept"))
    judged = sig.join(kept, ["fp", "same"]).select("key", (F.col("key") == F.col("kept")).alias("stays"))
    fate = cut(judged.groupBy("key").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    fate = small(fate)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), key.alias("key")).join(fate, "key", "left")
    once, more = rows.where("n is null").select("row.*"), rows.where("stays and n > 1")
    if fate.where("stays").isEmpty():
        return once
    return once.unionByName(more.groupBy("key", "row.doc_id", "row.text").agg(F.first("row").alias("row")).select("row.*"))


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group_near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
