"""Perturbations: keyboard typos and synonym swaps, as expressions whose dice are hash digits of row and place."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterator
from hashlib import sha256
from string import punctuation
from unicodedata import category

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.functions import text as tx
from inkwell.runtime import cut, ship

RATES = {"typo": 0.12, "paraphrase": 0.3}
#: Words of a thesaurus that go to all tasks.
MOST_KNOWN = 200_000

# Neighbours of each key.
NEIGHBOURS = {
    "q": "wa", "w": "qesa", "e": "wrsd", "r": "etdf", "t": "ryfg", "y": "tugh", "u": "yihj", "i": "uojk", "o": "ipkl", "p": "ol",
    "a": "qwsz", "s": "awedxz", "d": "serfcx", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "j": "huikmn", "k": "jiolm", "l": "kop",
    "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}
#: A small thesaurus of content words; a larger one is given as a table.
SYNONYMS = {
    "big": "large", "small": "little", "good": "fine", "bad": "poor", "important": "significant", "help": "aid", "show": "demonstrate",
    "use": "employ", "think": "believe", "many": "numerous", "begin": "start", "end": "finish", "people": "persons", "idea": "notion",
    "problem": "issue", "reason": "cause", "quick": "rapid", "happy": "glad", "easy": "simple", "hard": "difficult",
}


def digits(seed: Column, place: Column, which: int) -> Column:
    """A whole number below 65536 for the row's seed and a place; another for each ``which``."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), place.cast("string")), 256), 1 + 4 * which, 4), 16, 10).cast("int")


def typo(word: Column, seed: Column, place: Column) -> Column:
    """Swap, delete, insert or substitute one character. Words under three characters stay; a swap needs four."""
    n, op = F.length(word), F.pmod(digits(seed, place, 1), F.lit(4))
    i = F.pmod(digits(seed, place, 2), F.greatest(n, F.lit(1)))
    at = lambda k: F.substr(word, k + 1, F.lit(1))
    head, tail = F.substr(word, F.lit(1), i), F.substr(word, i + 2)
    near = F.coalesce(F.create_map(*(F.lit(x) for kv in NEIGHBOURS.items() for x in kv))[F.lower(at(i))], F.lit("abcdefghijklmnopqrstuvwxyz"))
    key = F.substr(near, F.pmod(digits(seed, place, 3), F.length(near)) + 1, F.lit(1))
    swapped = F.when((n >= 4) & (i < n - 1), F.concat(head, at(i + 1), at(i), F.substr(word, i + 3))).otherwise(word)
    return F.when(n < 3, word).when(op == 0, swapped).when(op == 1, F.concat(head, tail)).when(op == 2, F.concat(head, key, at(i), tail)).otherwise(F.concat(head, key, tail))


def inject_typos(text: Column, seed: Column, rate: float = RATES["typo"]) -> Column:
    """A typo in about ``rate`` of the space-separated words whose core is letters alone; spacing and punctuation stay, and so
    does the number of words."""

    def changed(token: Column, place: Column) -> Column:
        core = tx.strip_punct(token)
        hit = core.rlike(r"\A\p{L}+\z") & (digits(seed, place, 0) < F.lit(int(rate * 65536)))
        return F.when(hit, tx.replace_first(token, core, typo(core, seed, place))).otherwise(token)

    return F.array_join(F.transform(F.split(text, " "), changed), " ")


def swap_synonyms(text: Column, seed: Column, rate: float = RATES["paraphrase"], thesaurus: dict[str, str] | None = None) -> Column:
    """A synonym for about ``rate`` of the words that have one; capitals are kept."""
    table = F.create_map(*(F.lit(x) for kv in (thesaurus or SYNONYMS).items() for x in kv))

    def changed(token: Column, place: Column) -> Column:
        core = tx.strip_punct(token)
        other = table[F.lower(core)]
        hit = other.isNotNull() & (digits(seed, place, 0) < F.lit(int(rate * 65536)))
        cased = F.when(F.substr(core, F.lit(1), F.lit(1)).rlike(r"\p{Lu}"), tx.capitalize(other)).otherwise(other)
        return F.when(hit, tx.replace_first(token, core, cased)).otherwise(token)

    return F.array_join(F.transform(F.split(text, " "), changed), " ")


def _swap(text: str, name: str, bar: int, known: dict[str, str], wanted: set[str] | None = None) -> str:
    """Synonyms for the words that the dice hit; with ``wanted`` the hit words that aren't known are added there."""
    tokens, dice = text.split(" "), sha256(f"{name}:".encode())
    for k, t in enumerate(tokens):
        core = t.strip(punctuation)
        low = core.lower()
        other = known.get(low)
        if not core or (other is None and wanted is None):
            continue
        own = dice.copy()
        own.update(str(k).encode())
        if int.from_bytes(own.digest()[:2]) >= bar:
            continue
        if other is None:
            wanted.add(low)
        else:
            tokens[k] = t.replace(core, other[:1].upper() + other[1:].lower() if category(core[0]) == "Lu" else other, 1)
    return " ".join(tokens)


def swap_from_table(docs: DataFrame, key: str, text: str, thesaurus: DataFrame, rate: float = RATES["paraphrase"], seed: int = 42) -> DataFrame:
    """The same with a thesaurus of any size, (word, synonym), in one Arrow pass over the texts. Of a thesaurus over MOST_KNOWN
    words those of the highest ``df`` (any, if it has none) go to all tasks; of the others, those that the dice hit in a
    text are looked up before, once for each text. No row for a token is shuffled."""
    ship(docs.sparkSession)
    df = F.max("df") if "df" in thesaurus.columns else F.lit(0)
    table = cut(thesaurus.groupBy("word").agg(F.min("synonym").alias("synonym"), df.alias("df")).where("synonym is not null"))
    few = table.orderBy(F.desc("df"), "word").limit(MOST_KNOWN).select("word", "synonym").collect()
    known, bar = {r.word: r.synonym for r in few}, int(rate * 65536)
    name = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).alias("_name")
    rows = docs.where(F.col(text).isNotNull()).select(key, name, F.col(text).alias("_t"))
    kind = rows.schema[key]
    if table.count() > len(known):

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = []
                for n, t in zip(b.column(1).to_pylist(), b.column(2)):
                    _swap(t.as_py(), n, bar, known, own := set())
                    words.append(list(own))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], [key, "word"])

        asked = rows.mapInArrow(ask, StructType([kind, *StructType.fromDDL("word array<string>").fields])).select(key, F.explode("word").alias("word"))
        found = asked.join(table, "word").groupBy(key).agg(F.collect_list("word").alias("_words"), F.collect_list("synonym").alias("_synonyms"))
        rows = rows.join(found, key, "left")

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = zip(b.column(3), b.column(4)) if b.num_columns > 3 else [(None, None)] * b.num_rows
            own = (ChainMap(dict(zip(w.as_py(), s.as_py())), known) if w is not None and w.is_valid else known for w, s in more)
            out = [_swap(t.as_py(), n, bar, o) for n, t, o in zip(b.column(1).to_pylist(), b.column(2), own)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "attacked"])

    return rows.mapInArrow(swap, StructType([kind, *StructType.fromDDL("attacked string").fields]))


def apply_attack(text: Column, kind: str, seed: Column) -> Column:
    if kind == "typo":
        return inject_typos(text, seed)
    if kind == "paraphrase":
        return swap_synonyms(text, seed)
    raise ValueError(f"unknown attack: {kind}")


def attacked_versions(df: DataFrame, key: str, original: str, attacked: str) -> DataFrame:
    """Each row as two, (essay_id, doc_id, version, text): the original under key::orig, the attacked one under key::attk."""
    name = F.col(key).cast("string")
    row = lambda tail, version, c: F.struct(F.concat(name, F.lit(f"::{tail}")).alias("doc_id"), F.lit(version).alias("version"), F.col(c).alias("text"))
    return df.select(F.col(key).alias("essay_id"), F.inline(F.array(row("orig", "original", original), row("attk", "attacked", attacked))))
