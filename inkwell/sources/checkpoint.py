"""Resumable jobs: an append-only Parquet table whose keys are the done set, JSON metrics, and the configuration."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


logger = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of that schema if there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    """One atomic append of a batch; cost follows the batch, not the table."""
    df.write.mode("append").parquet(path)


def resume(targets: DataFrame, path: str, key: str, schema: str) -> DataFrame:
    """Targets that the table doesn't have yet."""
    return targets.join(load(targets.sparkSession, path, schema).select(key), key, "left_anti")


def run_batch(targets: DataFrame, path: str, key: str, schema: str, job: Callable[[DataFrame], DataFrame], error: str | None = None) -> None:
    """Run a job over the targets that aren't done and append its rows in one commit. Rows with an ``error`` stay out, so
    that the next run takes them up again. schema: that of the table."""
    done = job(resume(targets, path, key, schema))
    if error is not None:
        done = done.where(F.col(error).isNull())
    append(done.select(*(c.split()[0] for c in schema.split(", "))), path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A small metrics table as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_threshold(spark: SparkSession, path: str, default: float = 0.5) -> float:
    """The threshold of a metrics table, or the default."""
    if not exists(spark, path):
        return default
    row = spark.read.schema("threshold double").json(path).select(F.coalesce("threshold", F.lit(default)).alias("t")).first()
    return row.t if row else default


# Pools, their sizes and the defaults of the configuration.
@dataclass
class Pool:
    name: str
    count: int
    purpose: str = ""


@dataclass
class Sampling:
    seed: int = 42
    pools: list[Pool] = field(default_factory=lambda: [Pool("human_baseline", 4000), Pool("human_training", 600), Pool("machine_training", 700), Pool("machine_heldout_family", 150), Pool("machine_modern", 150), Pool("polished_mixed", 350), Pool("adversarial", 100)])
    ell_target_ratio: float = 0.5


@dataclass
class Paths:
    raw: str = "dataset/raw"
    interim: str = "dataset/interim"
    generated: str = "dataset/generated"
    features: str = "dataset/features"


@dataclass
class Generation:
    host: str = "http://localhost:11434"
    models: list[str] = field(default_factory=lambda: ["llama3.2:3b", "gemma2:2b", "phi3.5:3.8b"])
    num_parallel: int = 1
    max_loaded_models: int = 1
    num_ctx: int = 2048
    keep_alive: str = "30m"


@dataclass
class Scorer:
    base_model: str = "Qwen/Qwen2.5-0.5B"
    instruct_model: str = "Qwen/Qwen2.5-0.5B-Instruct"


@dataclass
class Decision:
    operating_point: str = "tpr_at_1pct_fpr"
    min_words_for_verdict: int = 150


@dataclass
class Config:
    paths: Paths = field(default_factory=Paths)
    sampling: Sampling = field(default_factory=Sampling)
    ollama: Generation = field(default_factory=Generation)
    scorer: Scorer = field(default_factory=Scorer)
    decision: Decision = field(default_factory=Decision)


CHOICES = {"operating_point": ("tpr_at_1pct_fpr",)}


def _made(kind: type, values: dict) -> object:
    known = {f.name: f for f in fields(kind)}
    out = kind()
    for name, value in (values or {}).items():
        if name not in known:
            logger.warning("the configuration has no %s in %s; it is left out", name, kind.__name__)
            continue
        now = getattr(out, name)
        if is_dataclass(now):
            value = _made(type(now), value)
        elif name == "pools":
            value = [Pool(**p) for p in value]
        elif isinstance(now, float) and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        elif not isinstance(value, type(now)) or isinstance(value, bool) != isinstance(now, bool):
            raise ValueError(f"{name}: {value!r} isn't a {type(now).__name__}")
        elif name in CHOICES and value not in CHOICES[name]:
            raise ValueError(f"{name}: {value!r} isn't one of {CHOICES[name]}")
        setattr(out, name, value)
    return out


def load_config(path: str) -> Config:
    """YAML over the defaults; without a file the defaults; values of a wrong type fail."""
    import yaml

    p = Path(path)
    return _made(Config, yaml.safe_load(p.read_text()) or {}) if p.exists() else Config()


