"""What Python code on executors needs."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once in an application, so their Python finds it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        name = f"{tempfile.mkdtemp()}/{root.name}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(name)
        _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir. A temporary one stands in only where the master is local
    and none is set; on a cluster its files would go with their machine, so there it is an error."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir", ""):
        return folder
    if not re.match(r"local($|\[)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(sc.applicationId, tempfile.mkdtemp())


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut that survives a lost executor: a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, *, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """A table in the shared folder that stands for df, for loops: unlike a checkpoint, which goes on estimating its size by
    the plan it came from, each round starts from what the files hold. Tables of ``instead_of`` are deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4()}"
    df.write.parquet(path)
    for old in instead_of:
        for name in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
            if "/tables/" in name:
                p = spark._jvm.org.apache.hadoop.fs.Path(name)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return spark.read.schema(df.schema).parquet(path)
