"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.runtime import cut, ship, written

#: A-Z to a-z and nothing else, on UTF-8 bytes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The same, and every ASCII byte but letters and digits becomes a space.
WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    """Partitions to ask for where a count must be given."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_docs(
    docs: DataFrame,
    make: Callable[[], Callable[[list, list[bytes]], dict]],
    fields: list[tuple[str, str]],
    *,
    carry: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = 512,
) -> DataFrame:
    """Apply an Arrow-batched function to every row's id and UTF-8 text (null: empty).

    ``make`` is called once in each task; what it returns gets ids and texts of up to ``rows`` rows and gives the
    ``fields``. The result has one row for each input row: the id and the fields, or with ``carry`` the input row as
    the struct ``_row`` (so no input column can clash with a field) and the fields.
    """
    ship(docs.sparkSession)
    new = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields))
    if carry:
        src = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
        head = T.StructField("_row", src.schema["_row"].dataType)
    else:
        src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        head = T.StructField("doc_id", src.schema["doc_id"].dataType)
    names = [f.name for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fn, out = make(), to_arrow_schema(new)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                part = whole.slice(start, rows)
                if carry:
                    first = part.column(0)
                    ids, text = pc.struct_field(first, [id_col]), pc.struct_field(first, [text_col])
                else:
                    first = ids = part.column(0)
                    text = part.column(1)
                got = fn(ids.to_pylist(), [t or b"" for t in text.cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([first, *(pa.array(got[n], out.field(n).type) for n in names)], names=[head.name, *names])

    return src.mapInArrow(run, T.StructType([head, *new.fields]))
