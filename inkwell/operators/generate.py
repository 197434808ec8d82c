"""Generation jobs: targets, prompts and runners over an injected client, with resume and failures kept apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import stats as st
from inkwell.functions import text as tx
from inkwell.operators import sampling
from inkwell.runtime import ship

MIN_WORDS, MIN_PARAGRAPHS, PER_MODEL = 200, 2, 50

# Models, conditions, topics and prompts.
MODELS = ["llama3.2:3b", "gemma2:2b", "phi3.5:3.8b"]
CONDITIONS = ["bare", "persona", "style_exemplar", "evasion"]
INTENSITIES = ["grammar", "flow", "rewrite"]
TOPICS = ["Phones and driving", "Summer projects", "Mandatory extracurricular activities", "Community service", "Grades for extracurricular activities", "Cell phones at school", "Distance learning", "Seeking multiple opinions"]
LENGTH_LINE = "Write a persuasive essay of about 350-450 words. Return only the essay text, nothing else -- no title, no preamble, no notes."
PERSONA_LINE = "You are a 17-year-old high school student applying to college, writing a persuasive essay for a class assignment."
EXEMPLAR_LINE = "Here is an example of a well-written student essay:"
STYLE_LINE = "Now, in a similar style, respond to the following:"
EVASION_LINE = "Write naturally, vary your sentence length, and avoid sounding AI-generated."
POLISH = {
    "grammar": "Fix only grammar, spelling, and punctuation errors in the following paragraph. Do not change wording, tone, or sentence structure otherwise. Return only the corrected paragraph, nothing else.",
    "flow": "Improve the flow and sentence transitions of the following paragraph while keeping the same content, meaning, and approximate length. Return only the revised paragraph, nothing else.",
    "rewrite": "Rewrite the following paragraph, preserving its content and meaning but freely changing wording and sentence structure. Return only the rewritten paragraph, nothing else.",
}


class Client(Protocol):
    def generate(self, model: str, prompt: str) -> str: ...


class HttpClient:
    """A local generation server; imported and reached on the executors only. A call that hangs fails after ``timeout``
    seconds, and one that fails is made ``tries`` times in all, with growing pauses."""

    def __init__(self, host: str = "http://localhost:11434", num_ctx: int = 2048, keep_alive: str = "30m", timeout: float = 600.0, tries: int = 3):
        self.host, self.num_ctx, self.keep_alive, self.timeout, self.tries = host, num_ctx, keep_alive, timeout, tries

    def generate(self, model: str, prompt: str) -> str:
        import json
        import time
        from urllib.error import URLError
        from urllib.request import Request, urlopen

        body = {"model": model, "prompt": prompt, "stream": False, "keep_alive": self.keep_alive, "options": {"num_ctx": self.num_ctx}}
        for turn in range(self.tries):
            try:
                with urlopen(Request(f"{self.host}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=self.timeout) as r:  # noqa: S310
                    return json.load(r)["response"].strip()
            except (URLError, TimeoutError):
                if turn + 1 == self.tries:
                    raise
                time.sleep(2.0**turn)
        raise ValueError("tries must be one or more")


def targets(spark: SparkSession, per_model: int = PER_MODEL, seed: int = 42) -> DataFrame:
    """(essay_id, model, condition, topic): every model, conditions and topics in turn, in a shuffled order."""
    rows = spark.range(len(MODELS) * per_model).select((F.col("id") / per_model).cast("int").alias("m"), F.pmod("id", F.lit(per_model)).cast("int").alias("i"))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k + 1)
    model = pick(MODELS, F.col("m"))
    out = rows.select(
        F.format_string("%s_%03d", tx.slug(model), F.col("i")).alias("essay_id"), model.alias("model"),
        pick(CONDITIONS, F.pmod("i", F.lit(len(CONDITIONS)))).alias("condition"), pick(TOPICS, F.pmod("i", F.lit(len(TOPICS)))).alias("topic"),
    )
    return out.orderBy(st.hash_order(seed, F.col("essay_id")))


def prompt(assignment: Column, condition: Column, exemplar: Column) -> Column:
    """The prompt of a condition; an unknown one, or a style without an exemplar, fails."""
    lines = lambda *parts: F.concat_ws("\n\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    fail = lambda why: F.raise_error(F.concat(F.lit(why), condition)).cast("string")
    styled = F.when(exemplar.isNull(), fail("no exemplar for ")).otherwise(lines(EXEMPLAR_LINE, exemplar, F.concat(F.lit(STYLE_LINE + "\n\n"), assignment), LENGTH_LINE))
    return (
        F.when(condition == "bare", lines(assignment, LENGTH_LINE)).when(condition == "persona", lines(PERSONA_LINE, assignment, LENGTH_LINE))
        .when(condition == "style_exemplar", styled).when(condition == "evasion", lines(assignment, EVASION_LINE, LENGTH_LINE)).otherwise(fail("unknown condition: "))
    )


def select_essays(joined: DataFrame, key: str, n: int, seed: int = 42, text: str = "text", words: str = "word_count") -> DataFrame:
    """n essays with enough words and paragraphs."""
    return sampling.uniform(joined.where((F.col(words) >= MIN_WORDS) & (F.size(tx.paragraphs(F.col(text))) >= MIN_PARAGRAPHS)), key, n, seed)


def revision_plan(essays: DataFrame, key: str, text: str = "text", seed: int = 42) -> DataFrame:
    """(key, paragraph_index, original_text, revise): round-half-even of 40 to 100 % of the paragraphs, one at least, by hash."""
    rows = essays.select(key, tx.paragraphs(F.col(text)).alias("_p"))
    quota = F.greatest(F.lit(1), F.rint(F.size("_p") * (0.4 + 0.6 * st.hash_unit(seed, F.col(key))))).cast("int")
    order = lambda i: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")), 256)
    picked = F.transform(F.slice(F.array_sort(F.transform("_p", lambda _, i: F.struct(order(i).alias("h"), i.alias("i")))), F.lit(1), quota), lambda s: s["i"])
    rows = rows.withColumn("_pick", picked)
    return rows.select(key, "_pick", F.posexplode("_p").alias("paragraph_index", "original_text")).select(key, "paragraph_index", "original_text", F.array_contains("_pick", F.col("paragraph_index")).alias("revise"))


def generate(rows: DataFrame, key: str, model: str, prompt: str, client: Callable[[], Client]) -> DataFrame:
    """(key, response, error): one call for each row. The client is made once in a task; a row that fails keeps its error."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = client()
        for b in batches:
            out = []
            for k, m, p in zip(b[key], b["_model"], b["_prompt"]):
                try:
                    out.append((k, used.generate(m, p), None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "response", "error"])

    kind = rows.schema[key].dataType.simpleString()
    done = rows.select(key, F.col(model).alias("_model"), F.col(prompt).alias("_prompt")).mapInPandas(run, f"{key} {kind}, response string, error string")
    return done.withColumn("response", tx.strip_preamble(F.col("response")))


def polish(essays: DataFrame, key: str, intensity: str, model: str, client: Callable[[], Client], text: str = "text", seed: int = 42) -> DataFrame:
    """(key, intensity, n_paragraphs, n_revised, paragraphs_json) of essays with all calls done; those with a failed call are
    left out, so that a later run takes them up again."""
    plan = revision_plan(essays, key, text, seed).join(essays.select(key, intensity), key)
    ask = F.coalesce(*(F.when(F.col(intensity) == k, F.lit(v)) for k, v in POLISH.items()))
    plan = plan.withColumn("_id", F.concat_ws("#", F.col(key).cast("string"), F.col("paragraph_index").cast("string"))).withColumn("_ask", F.concat(ask, F.lit("\n\nParagraph:\n"), F.col("original_text"))).withColumn("_m", F.lit(model))
    answers = generate(plan.where("revise"), "_id", "_m", "_ask", client)
    rows = plan.join(answers, "_id", "left").withColumn("revised_text", F.when(F.col("revise"), F.col("response")).otherwise(F.col("original_text")))
    part = F.struct("paragraph_index", "original_text", "revised_text", F.col("revise").alias("was_revised"))
    out = rows.groupBy(key, intensity).agg(F.count("*").alias("n_paragraphs"), F.count_if("revise").alias("n_revised"), F.count_if(F.col("revised_text").isNull()).alias("_failed"), F.array_sort(F.collect_list(part)).alias("_parts"))
    return out.where("_failed = 0").select(key, intensity, "n_paragraphs", "n_revised", F.to_json("_parts").alias("paragraphs_json"))
