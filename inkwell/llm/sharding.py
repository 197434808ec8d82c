"""Sharding: balanced label propagation over groups of equal texts, and an exact law of balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwell.llm.common import cut, documents, tasks_for, written

SHARDS = 40
#: Rounds of label propagation at most; it ends where a round cuts no fewer links.
ROUNDS = 50
#: Parts of a shard in which rows are numbered side by side; so many for each shuffle partition.
PARTS = 4


def numbers(values: dict[int, int], n: int, default: int = 0):
    """Array literal over the shards; its length is the number of shards, whatever the rows."""
    return F.array(*(F.lit(int(values.get(s, default))) for s in range(n))).cast("array<long>")


def propagate(cells: DataFrame, total: int, shards: int, rounds: int) -> DataFrame:
    """Balanced label propagation. cells: (text_key, first, n), the rows of a group of equal texts by their first shard.

    In each round a group's neighbours vote by rows for one shard with room left, and cells move there; where more ask
    than a shard has room for, cells are let in by hash up to its quota. A group larger than a shard fills one shard
    after another. It ends when no cell asks to move, or a round has left as many rows outside their group's main shard as
    there were. Returns (text_key, first, shard).
    """
    room_of = total // shards
    cells, outside = written(cells.withColumn("shard", F.col("first"))), None
    for turn in range(rounds):
        held = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = numbers({s: max(0, room_of - held.get(s, 0)) for s in range(shards)}, shards)
        placed = cells.groupBy("text_key", "shard").agg(F.sum("n").alias("rows"))
        before, outside = outside, placed.groupBy("text_key").agg((F.sum("rows") - F.max("rows")).alias("out")).agg(F.sum("out")).first()[0]
        if not outside or before is not None and outside >= before:
            break
        free = placed.where(F.element_at(room, F.col("shard") + 1) > 0)
        votes = free.groupBy("text_key").agg(F.max_by("shard", F.struct("rows", -F.col("shard"))).alias("to"))
        asking = cells.join(votes, "text_key", "left").withColumn("to", F.coalesce("to", "shard"))
        asked = {r.to: r.n for r in asking.where("to <> shard").groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            break
        share = F.array(*(F.lit(min(1.0, max(0, room_of - held.get(s, 0)) / asked[s]) if s in asked else 1.0) for s in range(shards)))
        luck = F.pmod(F.xxhash64("text_key", "first", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        goes = (F.col("to") != F.col("shard")) & (luck < F.element_at(share, F.col("to") + 1))
        cells = written(asking.select("text_key", "first", "n", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")), instead_of=(cells,))
    return cells.select("text_key", "first", "shard")


def numbered(rows: DataFrame, parts: int) -> DataFrame:
    """Add ``at``, the place of a row in its shard, gapless from 0, linked rows first. Equal rows are one row with a count
    until the end, and no window holds more than a part of a shard: places are summed up inside (shard, part), and the
    parts' sums, a small table, come before them."""
    part = F.when(F.col("linked"), 0).otherwise(parts) + F.pmod(F.xxhash64("doc_id", "text_key", "size"), F.lit(parts)).cast("int")
    rows = cut(rows.withColumn("part", part).groupBy("doc_id", "size", "text_crc32", "text_key", "shard", "part").agg(F.count("*").alias("copies")))
    sizes = rows.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(offsets, ["shard", "part"])
    first = F.col("offset") + F.col("ahead")
    return rows.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("at"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, *, rounds: int = ROUNDS) -> DataFrame:
    """Put every row into a shard: (doc_id, size, text_crc32, law, shard, slot, grown_shard), by the law ``rows``.

    Rows start in a shard by hash, so shards begin nearly even. Documents are linked by equal texts; label propagation
    works on cells (group of equal texts, first shard), a table that is grouped before it is shuffled, so a text that a
    third of all rows share is one cell for each shard. Last, shards over their quota hand surplus rows, unlinked ones
    first, to those below it, which makes counts differ by one at most. Only sums by shard come to the driver.

    Null texts have no bytes and size 16, and link with each other and with empty ones. A null id is a row like others;
    rows that repeat are placed one by one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"), F.pmod(F.xxhash64(row_key, F.lit(1)), F.lit(shards)).cast("int").alias("first"))
    rows = cut(rows.withColumn("text_key", F.xxhash64("text_key", "text_crc32", "size")))
    cells = rows.groupBy("text_key", "first").agg(F.count("*").alias("n"))
    many = cells.groupBy("text_key").agg(F.sum("n").alias("all")).where("all > 1").select("text_key")
    total = rows.count()
    moved = propagate(cells.join(many, "text_key", "left_semi"), total, shards, rounds)
    rows = rows.join(moved, ["text_key", "first"], "left").withColumn("linked", F.col("shard").isNotNull()).withColumn("shard", F.coalesce("shard", "first"))
    rows = numbered(rows, PARTS * tasks_for(spark) // 4 + 1)
    rows = cut(rows.select("doc_id", "size", "text_crc32", "shard", "at"))
    held = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # one row more goes to the fullest shards, so that least has to move
    order = sorted(range(shards), key=lambda s: (-held.get(s, 0), s))
    quota = {s: total // shards + (k < total % shards) for k, s in enumerate(order)}
    over, need, surplus, gaps = 0, 0, {}, []
    for s in range(shards):
        surplus[s] = over
        over += max(0, held.get(s, 0) - quota[s])
        if (gap := quota[s] - held.get(s, 0)) > 0:
            gaps.append((need, s, held.get(s, 0)))
            need += gap
    extra = F.element_at(numbers(surplus, shards), F.col("shard") + 1) + F.col("at") - F.element_at(numbers(quota, shards), F.col("shard") + 1)
    to, slot = F.col("shard"), F.col("at")
    moves = F.col("at") >= F.element_at(numbers(quota, shards), F.col("shard") + 1)
    for k, (first, s, has) in enumerate(gaps):
        inside = moves & (extra >= first) & (extra < (gaps[k + 1][0] if k + 1 < len(gaps) else need))
        to, slot = F.when(inside, s).otherwise(to), F.when(inside, extra - first + has).otherwise(slot)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
