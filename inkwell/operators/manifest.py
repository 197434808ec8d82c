"""Manifests: one row of provenance for each document of a pool, in one schema for all pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators.joins import keep_first

COLUMNS = ["doc_id", "pool", "source", "author_type", "generator", "prompt_condition", "ell_flag", "topic", "word_count", "license"]
PARAGRAPHS = "array<struct<paragraph_index:int,original_text:string,revised_text:string,was_revised:boolean>>"

# Sources, author types and conditions of pools, display names of generator families, licence lines.
HUMAN_SOURCE = "persuade_corpus"
POLISHED_SOURCE, POLISHED_MODEL = "persuade_corpus+llama3.2:3b", "llama3.2:3b"
MODERN_SOURCE = "ollama_modern_generated"
UNKNOWN_PROMPT = "unknown (DAIGT-provided)"
HUMAN, MACHINE, MIXED, NONE, UNKNOWN = "human", "machine", "mixed", "n/a", "unknown"
GENERATORS = {
    "mistral7binstruct_v2": "Mistral-7B-Instruct v2",
    "mistral7binstruct_v1": "Mistral-7B-Instruct v1",
    "mistralai/Mistral-7B-Instruct-v0.1": "Mistral-7B-Instruct v0.1",
    "chat_gpt_moth": "GPT-3.5 (chat_gpt_moth)",
    "llama2_chat": "LLaMA-2-Chat",
    "llama_70b_v1": "LLaMA-70B",
    "NousResearch/Llama-2-7b-chat-hf": "LLaMA-2-7B-Chat (NousResearch)",
    "kingki19_palm": "PaLM (kingki19_palm)",
    "palm-text-bison1": "PaLM Text-Bison-1",
    "falcon_180b_v1": "Falcon-180B",
    "darragh_claude_v6": "Claude v6 (darragh)",
    "darragh_claude_v7": "Claude v7 (darragh)",
    "radek_500": "GPT-3.5 (radek_500)",
    "radekgpt4": "GPT-4 (radek)",
    "cohere-command": "Cohere Command",
}
HUMAN_LICENSE = "PERSUADE 2.0: CC BY-NC-SA 4.0"
MACHINE_LICENSE = "DAIGT-V2 (Kaggle): confirmed usable -- see DATA_CARD.md"
LOCAL_LICENSE = "N/A -- generated locally via Ollama, not sourced from a licensed dataset"
#: Names of pools where scores are made, and in manifests.
POOL_ALIASES = {"baseline": "human_baseline", "machine_heldout": "machine_heldout_family", "polished": "polished_mixed", "modern_gen": "machine_modern"}
#: Labels of pools: 0 human, 1 machine, -1 mixed.
POOL_LABELS = {"human_baseline": 0, "human_training": 0, "machine_training": 1, "machine_heldout_family": 1, "machine_modern": 1, "polished_mixed": -1}


def generator_name(source: Column) -> Column:
    """Display name of a family, or the family as it is."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in GENERATORS.items() for x in kv))[source], source)


def pool_label(pool: Column) -> Column:
    """Null for a pool without a label."""
    return F.create_map(*(F.lit(x) for kv in POOL_LABELS.items() for x in kv))[pool]


def flag(ell: Column) -> Column:
    """Missing and blank flags are unknown."""
    return F.coalesce(F.nullif(tx.strip(ell), F.lit("")), F.lit(UNKNOWN))


def _rows(df: DataFrame, *values: Column) -> DataFrame:
    return df.select(*(v.alias(n) for n, v in zip(COLUMNS, values, strict=True)))


def human_rows(df: DataFrame, pool: str, *, key: str = "text_hash", ell: str = "ell_status", topic: str = "prompt_name", words: str = "word_count") -> DataFrame:
    c = F.col
    return _rows(df, c(key), F.lit(pool), F.lit(HUMAN_SOURCE), F.lit(HUMAN), F.lit(NONE), F.lit(NONE), flag(c(ell)), c(topic), c(words).cast("long"), F.lit(HUMAN_LICENSE))


def machine_rows(df: DataFrame, pool: str, *, order: str = "row_ord", text: str = "text", topic: str = "prompt_name") -> DataFrame:
    c, key = F.col, F.concat_ws("::", F.col("source"), F.col(order).cast("string"))
    return _rows(df, key, F.lit(pool), c("source"), F.lit(MACHINE), generator_name(c("source")), F.lit(UNKNOWN_PROMPT), F.lit(NONE), c(topic), tx.word_count(c(text)), F.lit(MACHINE_LICENSE))


def build(pools: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of the four sampled pools. doc_id is unique if the pools are disjoint; ``joins.assert_unique`` checks it."""
    out = None
    for name, df in pools.items():
        rows = human_rows(df, name) if name.startswith("human") else machine_rows(df, name)
        out = rows if out is None else out.unionAll(rows)
    return out


def revised_words(paragraphs_json: Column) -> Column:
    """Words of all revised paragraphs in the JSON text."""
    return F.aggregate(F.from_json(paragraphs_json, PARAGRAPHS), F.lit(0).cast("long"), lambda a, p: a + F.coalesce(tx.word_count(p["revised_text"]), F.lit(0)))


def revised_count(paragraphs_json: Column) -> Column:
    return F.size(F.filter(F.from_json(paragraphs_json, PARAGRAPHS), lambda p: p["was_revised"])).cast("long")


def revised_text(paragraphs_json: Column) -> Column:
    return F.array_join(F.transform(F.from_json(paragraphs_json, PARAGRAPHS), lambda p: p["revised_text"]), "\n\n")


def polished(checkpoint: DataFrame, joined: DataFrame, order: str) -> DataFrame:
    """Rows of polished documents in the checkpoint's order of keys; of joined rows with one hash the first counts."""
    meta = keep_first(joined.select("text_hash", "prompt_name", "ell_status", order), ["text_hash"], [order])
    rows = checkpoint.join(meta.select(F.col("text_hash").alias("essay_id"), "prompt_name", "ell_status"), "essay_id", "left")
    c = F.col
    return _rows(rows, c("essay_id"), F.lit("polished_mixed"), F.lit(POLISHED_SOURCE), F.lit(MIXED), F.lit(POLISHED_MODEL), c("intensity"), flag(c("ell_status")), c("prompt_name"), revised_words(c("paragraphs_json")), F.lit(HUMAN_LICENSE))


def modern(checkpoint: DataFrame) -> DataFrame:
    c = F.col
    return _rows(checkpoint, c("essay_id"), F.lit("machine_modern"), F.lit(MODERN_SOURCE), F.lit(MACHINE), c("model"), c("condition"), F.lit(NONE), c("topic"), c("word_count").cast("long"), F.lit(LOCAL_LICENSE))


def adversarial(checkpoint: DataFrame) -> DataFrame:
    c = F.col
    name = F.concat_ws(" + ", generator_name(c("source_family")), c("attack_type"))
    return _rows(checkpoint, c("essay_id"), F.lit("adversarial"), c("source_family"), F.lit(MACHINE), name, c("attack_type"), F.lit(NONE), c("topic"), c("word_count").cast("long"), F.lit(MACHINE_LICENSE))


def build_generated(spark: SparkSession, root: str, joined: DataFrame, order: str) -> dict[str, DataFrame]:
    """Manifests of the generated sets whose checkpoints are there, by pool; absent sets are left out."""
    from inkwell.sources.checkpoint import exists

    makers = {"polish": ("polished_mixed", lambda df: polished(df, joined, order)), "modern": ("machine_modern", modern), "adversarial": ("adversarial", adversarial)}
    found = {name: f"{root}/{name}/checkpoint.parquet" for name in makers}
    return {makers[name][0]: makers[name][1](spark.read.parquet(path)) for name, path in found.items() if exists(spark, path)}
