"""Text functions as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, since Java's \s is ASCII only.
SPACES = r"\s\x1c-\x1f\x85\p{Z}"
WS = f"[{SPACES}]"
#: White space, letters, digits and underscore of any script.
GAP = rf"[a-zA-Z \p{{L}}\p{{N}}_{SPACES}]"

# Fixed values of the feature definitions.
DISCOURSE_MARKERS = [
    "moreover", "furthermore", "additionally", "consequently", "nevertheless", "nonetheless", "therefore", "thus", "hence", "accordingly",
    "ultimately", "crucially", "importantly", "significantly", "notably", "specifically", "essentially", "fundamentally", "undoubtedly",
    "clearly", "indeed", "however", "meanwhile", "subsequently",
]
HOMOPHONE_ERRORS = ["could of", "should of", "would of", "must of", "might of"]
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen",
    "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
    "hundred", "thousand", "million", "billion", "trillion", "quadrillion", "gajillion", "bazillion",
]

#: A list of three: first item, second item, an optional comma, and/or, third item. Few commas begin one, and each place
#: before a comma would try the same rest again, so commas that can't are marked (by a private character) beforehand.
MARK = "\ue000"
NO_LIST_COMMA = rf",(?!{WS}*+[A-Za-z]{GAP}{{0,30}}?,?{WS}+(?i:and|or){WS}+[A-Za-z])"
LIST_OF_THREE = rf"(?=[A-Za-z][^,]{{0,30}},)([A-Za-z]{GAP}{{0,30}}+),{WS}*+([A-Za-z]{GAP}{{0,30}}?)([,\x{{e000}}])?{WS}+(?i:(and|or)){WS}+([A-Za-z]{GAP}{{0,30}})"
NOT_JUST_BUT = rf"(?i)\bnot{WS}+(?:just|only)\b[^\n]{{0,60}}?\bbut\b(?:{WS}+also)?"
# Fixed value: what a model's reply may begin with before its text.
PREAMBLE = (
    r"(?is)^(?:"
    r"here.{0,15}(?:is|s|are).{0,30}(?:revised|rewritten|corrected|paragraph|version)"
    r"|sure[,!]"
    r"|i.ve (?:revised|rewritten|corrected)"
    r"|certainly"
    r"|\*\*revised"
    r").*?\n\n"
)
SENTENCE = r"[^.!?]+[.!?]*"


def lit_re(pattern: str) -> Column:
    return F.lit(pattern)


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def normalize(text: Column) -> Column:
    """White space runs become one space, ends are dropped, letters lower."""
    return F.lower(F.regexp_replace(strip(text), f"{WS}+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def paragraphs(text: Column, delimiter: str = "\n\n") -> Column:
    """Trimmed paragraphs that aren't empty; the delimiter is literal."""
    quoted = "".join("\\" + c if not c.isalnum() and c != "\n" else c for c in delimiter)
    return F.filter(F.transform(F.split(text, quoted), strip), lambda p: p != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def alpha_words(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), lit_re(r"[\p{L}]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentence texts with their closing marks, trimmed; the place in the array is the place before empty ones are dropped."""
    return F.transform(F.regexp_extract_all(text, lit_re(SENTENCE), F.lit(0)), strip)


def count_literal(text: Column, literal: str) -> Column:
    """Occurrences that don't overlap."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in literal) if literal.isascii() else literal
    return F.regexp_count(text, lit_re(quoted)).cast("long")


def count_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, lit_re(pattern)).cast("long")


def lists(text: Column) -> Column:
    """For each list of three in the text the comma before its and/or; empty where there is none."""
    return F.regexp_extract_all(F.regexp_replace(text, NO_LIST_COMMA, MARK), lit_re(LIST_OF_THREE), F.lit(3))


def count_homophones(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [count_pattern(text, rf"(?i)\b{p}\b") for p in HOMOPHONE_ERRORS])


def strip_preamble(text: Column) -> Column:
    """Cut a conversational preamble up to the first blank line; a text without one is untouched, ends included."""
    return F.when(text.rlike(PREAMBLE), strip(F.regexp_replace(text, PREAMBLE, ""))).otherwise(text)


def strip_punct(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, r"\A\p{Punct}+", ""), r"\p{Punct}+\z", "")


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.instr(text, old)
    return F.when((at == 0) | (old == ""), text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old))))


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def slug(text: Column) -> Column:
    return F.translate(text, ":.", "--")
