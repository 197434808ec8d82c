"""Part-of-speech, clause and entity features: by rules over token codes (``textpass.tags``), or through the annotator seam.

The rules know closed classes and endings. Their values aren't those of a trained parser; whatever has
``tag(sentence) -> list[Token]`` can take their place, and is then called through Arrow.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.runtime import ship

# Classes of function words, and relations of clauses and of subordinate ones.
FUNCTION_POS = {"DET", "ADP", "PRON", "CCONJ", "SCONJ", "AUX", "PART"}
CLAUSE_DEPS = {"ROOT", "conj", "ccomp", "advcl", "relcl", "acl", "xcomp", "csubj", "parataxis"}
SUBORDINATE_DEPS = {"advcl", "ccomp", "relcl", "acl", "xcomp", "csubj", "mark"}
#: Code of a class, and its words. Besides, U is a number, a comma itself, . another mark, P a capitalised word that doesn't begin
#: its sentence, N any other word.
CLOSED = {
    "D": "the a an this that these those each every some any no all both",
    "A": "of in on at by with from to for about into over under between through during before after against",
    "R": "i you he she it we they me him her us them my your his its our their who which what",
    "C": "and or but nor yet so",
    "S": "because although though while if unless since when whereas whether",
    "X": "is are was were be been being am do does did have has had will would can could shall should may might must",
    "T": "not",
    "B": "very too also never always often here there now then",
}
#: Codes of open classes by ending, for words longer than the ending by three: participles, other verbs, adverbs, adjectives.
ENDINGS = (("ing", "G"), ("ed", "G"), ("ize", "V"), ("ly", "B"), ("ous", "J"), ("ful", "J"), ("ble", "J"), ("ive", "J"))
#: Words, numbers, and single characters of other kinds.
TOKEN = r"\p{L}+|\p{Nd}+(?:[.,/]\p{Nd}+)*|[^\p{L}\p{Nd}\x09-\x0D\x20]"
COLUMNS = ["function_word_rate", "pos_trigram_entropy", "clause_count_mean", "subordination_ratio_mean", "n_participial", "proper_noun_rate", "named_entity_rate"]


def annotate(docs: DataFrame, key: str, text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(key, COLUMNS...) of every document, in one pass without a shuffle, or with a tagger batch by batch."""
    if tagger is not None:
        return annotate_with(docs, key, text, tagger)
    from inkwell.operators import textpass

    return textpass.each(docs, key, F.col(text), textpass.TAG_FIELDS, lambda t: textpass.tags(t, False, frozenset()))


class Token(NamedTuple):
    text: str
    pos: str
    tag: str
    dep: str


class Tagger(Protocol):
    def tag(self, sentence: str) -> list[Token]: ...


def features(text: str, tagger: Tagger) -> list[float]:
    """In the order of COLUMNS; zeros of a text without words."""
    pos: list[str] = []
    clauses, subordinate, participial, proper, entities = [], [], 0, 0, 0
    for sentence in re.findall(tx.SENTENCE, text):
        tokens = tagger.tag(sentence)
        if not tokens:
            continue
        n = max(1, sum(t.pos in ("VERB", "AUX") and t.dep in CLAUSE_DEPS for t in tokens))
        clauses.append(n)
        subordinate.append(sum(t.dep in SUBORDINATE_DEPS for t in tokens) / n)
        participial += tokens[0].tag in ("VBG", "VBN") and any(t.text == "," for t in tokens[1:8])
        proper += sum(t.pos == "PROPN" for t in tokens)
        entities += sum(t.pos == "PROPN" and (k == 0 or tokens[k - 1].pos != "PROPN") for k, t in enumerate(tokens))
        pos += [t.pos for t in tokens if t.text.isalpha()]
    n = len(pos)
    grams = Counter(zip(pos, pos[1:], pos[2:]))
    total = sum(grams.values())
    entropy = sum(-c / total * math.log2(c / total) for c in grams.values()) if total else 0.0
    per100 = 100 / n if n else 0.0
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    return [sum(p in FUNCTION_POS for p in pos) / n if n else 0.0, entropy, mean(clauses), mean(subordinate), float(participial), proper * per100, entities * per100]


def annotate_with(docs: DataFrame, key: str, text: str, tagger: Tagger) -> DataFrame:
    """(key, COLUMNS...) of every document by an injected tagger, Arrow batch by Arrow batch."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [features(t or "", tagger) for t in b["_t"]]
            yield pd.concat([b[[key]].reset_index(drop=True), pd.DataFrame(rows, columns=COLUMNS, dtype=float)], axis=1)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{c} double" for c in COLUMNS))
