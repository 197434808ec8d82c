"""Documents to paragraphs and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx

SENTENCE = re.compile(tx.SENTENCE)
#: Sentences whose ends are summed up in one array.
RUN = 256


def paragraphs(docs: DataFrame, key: str, text: str, delimiter: str = "\n\n") -> DataFrame:
    return docs.select(key, F.posexplode(tx.paragraphs(F.col(text), delimiter)).alias("paragraph_index", "paragraph"))


def sentences(docs: DataFrame, key: str, text: str, delimiter: str = "\n\n") -> DataFrame:
    """(key, paragraph_index, sentence_index, text, word_count). The sentence index counts empty sentences, which are dropped
    after it is given, so it may have gaps."""
    rows = paragraphs(docs, key, text, delimiter).select(key, "paragraph_index", F.posexplode(tx.sentences(F.col("paragraph"))).alias("sentence_index", "text"))
    return rows.where("text <> ''").withColumn("word_count", tx.word_count(F.col("text")))


def sentence_offsets(docs: DataFrame, key: str, text: str, delimiter: str = "\n\n") -> DataFrame:
    """Sentences with the places where they begin and end in their paragraph (code points, end exclusive), empty ones kept.
    Places are summed up inside a paragraph's array, so no row is shuffled."""
    parts = F.regexp_extract_all("paragraph", F.lit(tx.SENTENCE), F.lit(0))
    rows = paragraphs(docs, key, text, delimiter).withColumn("_parts", parts)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("ends"))
    # in runs of RUN sentences, so that an array that grows one by one stays short
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_parts") - 1, F.lit(0)), F.lit(RUN)), lambda k: F.slice("_parts", k + 1, RUN))

    def within(at: Column, run: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("ends")), lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.concat(a["ends"], F.array(a["at"] + F.length(x))).alias("ends")))

    def add(a: Column, run: Column) -> Column:
        inner = within(a["at"], run)
        return F.struct(inner["at"].alias("at"), F.concat(a["ends"], inner["ends"]).alias("ends"))

    rows = rows.withColumn("_ends", F.aggregate(runs, start, add, lambda a: a["ends"]))
    pairs = F.zip_with("_parts", "_ends", lambda p, e: F.struct(p.alias("raw"), e.alias("end")))
    rows = rows.select(key, "paragraph_index", "paragraph", F.posexplode(pairs).alias("sentence_index", "_p"))
    rows = rows.select(key, "paragraph_index", "paragraph", "sentence_index", F.col("_p.raw").alias("_raw"), F.col("_p.end").alias("char_end"))
    lead = F.length("_raw") - F.length(F.regexp_replace("_raw", rf"\A{tx.WS}+", ""))
    return rows.select(key, "paragraph_index", "sentence_index", tx.strip(F.col("_raw")).alias("text"), (F.col("char_end") - F.length("_raw") + lead).alias("char_start"), "char_end", "paragraph")


def offsets(paragraph: str) -> Iterator[tuple[int, int]]:
    """(char_start, char_end) of each sentence of a paragraph, in plain Python, as ``sentence_offsets`` gives them."""
    end = 0
    for m in SENTENCE.finditer(paragraph):
        raw = m.group()
        end += len(raw)
        yield end - len(raw.lstrip()), end
