"""One Arrow pass over texts for all features that a text's own words, marks and rule tags give, in plain Python.

Expressions over arrays, evaluated lambda by lambda, take many times as long. Classes of characters are Unicode's categories, as Java's \\p has them.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from math import log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.functions import text as tx
from inkwell.operators import annotate
from inkwell.runtime import ship

#: Distinct words that a task counts, or whose codes it keeps, before it hands them on.
MOST_WORDS = 200_000
WINDOW = 50

NATIVE_FIELDS = [
    "n_sentences bigint", "n_words bigint", "sent_len_mean double", "sent_len_std double", "sent_len_burstiness double", "mattr double", "hapax_rate double",
    "em_dash_rate double", "semicolon_rate double", "oxford_comma_rate double", "n_lists_detected bigint", "template_rate double", "discourse_marker_rate double",
    "homophone_error_rate double", "numeral_rate double",
]
TAG_FIELDS = [f"{c} double" for c in annotate.COLUMNS]
#: ``checked``: distinct words that a spelling can be wrong in, without those known beforehand.
SPELLING_FIELDS = ["n_checkable bigint", "checked array<string>"]
WORD_FIELDS = ["n_words bigint", "mattr double", "mean_word double"]


@cache
def _ranges() -> dict[str, list[tuple[int, int]]]:
    """Code points of each category, as ranges; L has all letters."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(k))
        spans = out.setdefault("L" if c[0] == "L" else c, [])
        if spans and spans[-1][1] == k - 1:
            spans[-1] = (spans[-1][0], k)
        else:
            spans.append((k, k))
    return out


@cache
def patterns(top: int) -> dict[str, re.Pattern]:
    """Patterns for texts without a code point above ``top``: a class of few ranges is looked up faster."""

    def chars(*kinds: str) -> str:
        if top < 128:
            return "".join({"L": "a-zA-Z", "Nd": "0-9"}.get(k, "") for k in kinds)
        return "".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for k in kinds for a, b in _ranges()[k] if a <= top)

    letter, digit, number, mark = f"[{chars('L')}]", f"[{chars('Nd')}]", f"[{chars('Nd', 'Nl', 'No')}]", chars("Mn") or "\x00"
    # Java's \b before and after a letter: a mark counts as its base does. The first letter comes first, which is found fast
    begin = lambda c: f"{c}(?<!{letter}{c})(?<!{digit}{c})(?<!_{c})(?<!{letter}[{mark}]{c})(?<!{digit}[{mark}]{c})"
    end = rf"(?!{letter})(?!{digit})(?![_{mark}])"
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    word = lambda w: begin(either(w[0])) + either(w[1:]) + end
    return {
        "word": re.compile(f"{letter}+"),
        "token": re.compile(rf"{letter}+|{digit}+(?:[.,/]{digit}+)*|[^\x09-\x0D\x20]"),
        "alnum": re.compile(rf"[^\W_]+(?:[.,/]{number}+)*"),
        "not_just": re.compile(rf"{begin('[nN]')}{either('ot')}\s+(?:{either('just')}|{either('only')}){end}[^\n]{{0,60}}?{word('but')}(?:\s+{either('also')})?"),
        "homophone": re.compile("|".join(map(word, tx.HOMOPHONE_ERRORS))),
    }


def patterns_of(text: str) -> dict[str, re.Pattern]:
    return patterns(127 if text.isascii() else 0xFFFF if not ASTRAL.search(text) else sys.maxunicode)


ASTRAL = re.compile("[\U00010000-\U0010ffff]")
SENTENCE = re.compile(tx.SENTENCE)
NUMBER = re.compile(r"[0-9]+(?:[.,/][0-9]+)*")
#: A list of three from its first comma on, and what is before that comma.
TAIL = re.compile(r",\s*+[A-Za-z][\w\s]{0,30}?(,)?\s+(?:[aA][nN][dD]|[oO][rR])\s+[A-Za-z][\w\s]{0,30}")
ITEM = re.compile(r"[\w\s]*\Z")
LATIN = re.compile("[A-Za-z]")
NAMES, ANCHORS, SUBORDINATE = re.compile("P+"), re.compile("[^SGVX]"), re.compile("S[GVX]")


def alpha_words(low: str) -> list[str]:
    """Runs of letters of a lower-case text."""
    return patterns_of(low)["word"].findall(low)


def lists(text: str) -> list[str]:
    """For each list of three the comma before its and/or, or nothing. A list is found by its first comma: its rest has no
    other beginning, and its first item is the longest one before it that no list before has taken."""
    out, at, used = [], 0, 0
    while m := TAIL.search(text, at):
        comma = m.start()
        run = ITEM.search(text[max(used, comma - 31) : comma]).group()
        if LATIN.search(run):
            out.append(m.group(1) or "")
            at = used = m.end()
        else:
            at = comma + 1
    return out


def moving_ratio(words: list[str]) -> float:
    """Mean type-token ratio over all windows of WINDOW words: a word counts in those where it is the first of its kind."""
    n, total, last = len(words), 0, {}
    before, top = last.get, n - WINDOW
    for i, w in enumerate(words):
        low = max(before(w, -1) + 1, i - (WINDOW - 1), 0)
        held = (i if i < top else top) - low + 1
        if held > 0:
            total += held
        last[w] = i
    return total / (float(WINDOW) * (n - WINDOW + 1))


def mattr(words: list[str], types: int) -> float:
    n = len(words)
    return 0.0 if n < 2 else types / n if n <= WINDOW else moving_ratio(words)


def mean(xs: list[float]) -> float:
    return sum(xs) / len(xs) if xs else 0.0


def native(text: str) -> tuple:
    """In the order of NATIVE_FIELDS."""
    low = text.lower()
    p = patterns_of(low)
    find = p["word"].findall
    words, lengths = [], []
    for s in SENTENCE.findall(low):
        ws = find(s)
        words += ws
        if ws or s.strip():
            lengths.append(float(len(ws)))
    n, counts = len(words), Counter(words)
    middle = mean(lengths)
    std = sqrt(mean([(x - middle) * (x - middle) for x in lengths]))
    per100 = 100.0 / n if n else 0.0
    commas = lists(text)
    templates = len(commas)
    if "not" in low and "but" in low and ("just" in low or "only" in low):
        templates += sum(1 for _ in p["not_just"].finditer(text))
    homophones = sum(1 for _ in p["homophone"].finditer(text)) if any(h in low for h in tx.HOMOPHONE_ERRORS) else 0
    number = NUMBER.fullmatch
    numerals = sum(1 for t in p["alnum"].findall(low) if t in _NUMBERS or ("0" <= t[0] <= "9" and number(t)))
    return (
        len(lengths), n, middle, std, std / middle if middle else 0.0, mattr(words, len(counts)), sum(c == 1 for c in counts.values()) / n if n else 0.0,
        (text.count("—") + text.count("--")) * per100, text.count(";") * per100, sum(1 for c in commas if c) / len(commas) if commas else -1.0, len(commas), templates * per100,
        sum(counts[m] for m in tx.DISCOURSE_MARKERS) * per100, homophones * per100, numerals * per100,
    )


_NUMBERS = frozenset(tx.NUMBER_WORDS)
_CLOSED = {w: c for c, words in reversed(annotate.CLOSED.items()) for w in words.split()}


_ENDS = tuple(e for e, _ in annotate.ENDINGS)


def first_code(token: str) -> str:
    """Code of a token that begins its sentence."""
    if token == ",":
        return ","
    kind = unicodedata.category(token[0])
    if kind[0] != "L":
        return "U" if kind == "Nd" else "."
    low = token.lower()
    if code := _CLOSED.get(low):
        return code
    return next((c for end, c in annotate.ENDINGS if low.endswith(end) and len(low) > len(end) + 2), "N") if low.endswith(_ENDS) else "N"


class Codes(dict):
    """Codes of tokens inside a sentence."""

    def __missing__(self, token: str) -> str:
        if len(self) >= MOST_WORDS:
            self.clear()
        code = first_code(token)
        if code not in ".,U" and token.lower() not in _CLOSED and unicodedata.category(token[0]) == "Lu":
            code = "P"
        self[token] = code
        return code


_codes = Codes()
_PLAIN = str.maketrans("G", "V", "U.,")
#: A number below 16 for each code of a word.
_PLACES = np.zeros(128, np.int64)
_PLACES[[ord(c) for c in "DARCSXTBVJPN"]] = range(12)


def tags(text: str, spelling: bool, known: frozenset[str]) -> tuple:
    """In the order of TAG_FIELDS, and with ``spelling`` of SPELLING_FIELDS."""
    codes, code, token = [], _codes.__getitem__, patterns_of(text)["token"].findall
    clauses, subordination, participial, proper, entities, checkable, checked = [], [], 0, 0, 0, 0, set()
    for s in SENTENCE.findall(text):
        tokens = token(s)
        if not tokens:
            continue
        c = "".join(map(code, tokens))
        if c[0] == "P":
            c = first_code(tokens[0]) + c[1:]
        codes.append(c)
        n = max(1, c.count("G") + c.count("V") + c.count("X"))
        clauses.append(float(n))
        subordination.append((c.count("S") + len(SUBORDINATE.findall(ANCHORS.sub("", c)))) / n if "S" in c else 0.0)
        participial += c[0] == "G" and c.find(",", 1, 8) > 0
        if "P" in c:
            proper += c.count("P")
            entities += len(NAMES.findall(c))
        if spelling:
            words = [t for t, k in zip(tokens, c) if k not in "PU.," and len(t) > 1]
            checkable += len(words)
            checked.update(words)
    words = "".join(codes).translate(_PLAIN)
    n = len(words)
    places = _PLACES[np.frombuffer(words.encode("ascii"), np.uint8)]
    grams = np.bincount(places[:-2] * 256 + places[1:-1] * 16 + places[2:])
    grams = grams[grams > 0]
    total = float(max(n - 2, 1))
    entropy = log2(total) - float((grams * np.log2(grams)).sum()) / total
    per100 = 100.0 / n if n else 0.0
    out = (sum(map(words.count, "DARCSXT")) / n if n else 0.0, entropy, mean(clauses), mean(subordination), float(participial), proper * per100, entities * per100)
    return (*out, checkable, list({w.lower() for w in checked} - known)) if spelling else out


def of_words(text: str) -> tuple:
    """In the order of WORD_FIELDS."""
    words = alpha_words(text.lower())
    n = len(words)
    return n, mattr(words, len(set(words)) if n <= WINDOW else 0), sum(map(len, words)) / n if n else 0.0


def each(docs: DataFrame, key: str, text: Column, fields: list[str], f: Callable[[str], tuple]) -> DataFrame:
    """(key, fields...): what f gives for the text of each row (null: empty), in one Arrow pass without a shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("_t"))
    schema = StructType([rows.schema[0], *StructType.fromDDL(", ".join(fields)).fields])
    kinds = [{"bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}[x.split()[1]] for x in fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = zip(*(f(t.as_py()) for t in b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return rows.mapInArrow(run, schema)


def document_counts(docs: DataFrame, text: Column) -> DataFrame:
    """(word, df): of each word (letters, lower case) in how many rows it is. Tasks count up to MOST_WORDS words before
    they hand on what they have."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(have.keys(), pa.string()), pa.array(have.values(), pa.int64())], ["word", "df"])
            have.clear()
            return b

        for b in batches:
            for t in b.column(0):
                have.update(set(alpha_words(t.as_py().lower())))
                if len(have) >= MOST_WORDS:
                    yield out()
        if have:
            yield out()

    found = docs.select(F.coalesce(text, F.lit("")).alias("_t")).mapInArrow(run, "word string, df bigint")
    return found.groupBy("word").agg(F.sum("df").alias("df"))
