"""Secret scan: fixed patterns, and strings in sensitive context that zstandard can't foresee."""

from __future__ import annotations

import hashlib
import re

import zstandard
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import LOWER, documents, map_docs

KINDS = ("assign", "access", "hex", "novel")
# Letters of the keys match in either case, ASCII only.
PATTERNS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
SENSITIVE = re.compile(r"(?i:passw|passphrase|secret|credential|bearer|authori[sz]ation|api.?key|access.?key|private.?key|auth.?token|token|client.?id|signature)", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}")
LETTER = re.compile(r"[A-Za-z]")
#: Length of a candidate, and code points on either side of it that it is measured in.
LEAST, AROUND = 12, 2048
#: Marginal compressed bytes for each byte of a candidate from which on it counts as incompressible. Set on planted strings:
#: in texts of the test tables it is reached by 99 % or more of random strings of 12 to 40 letters and digits and of
#: letters in both cases, by nine in ten random lower-case ones, and by 2 % of the texts' own words.
NOVELTY = 0.85
#: What a text must hold (in lower case) for the slower patterns to have a match.
NEEDED = (b"passw", b"secret", b"token", b"key", b"passphrase", b"credential", b"bearer", b"authori", b"client", b"signature")
IDENTIFIERS = b" ".join(
    x + y
    for x in (b"get", b"set", b"is", b"has", b"make", b"load", b"save", b"read", b"write", b"open", b"close", b"parse", b"user", b"client", b"server", b"request", b"response", b"access", b"session", b"account", b"private", b"public", b"default", b"config")
    for y in (b"_name", b"_value", b"_token", b"_secret", b"_password", b"_key", b"_id", b"_url", b"_path", b"_file", b"Name", b"Value", b"Token", b"Secret", b"Password", b"Key", b"Id", b"Url", b"Path", b"File")
) + b" abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 example changeme placeholder http://www. https:// .com .org .net function return import const public static void string Authorization: Bearer "


def base_spans(text: str, assigned: bool = True) -> list[tuple[int, int, str]]:
    """Matches that are long enough, (start, end, kind), by start and then kind. assigned: False where no key word occurs."""
    out = [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(PATTERNS) if k or assigned for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


def packer() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(candidate: str, before: str, after: str, pack: zstandard.ZstdCompressor) -> float:
    """Marginal zstandard bytes of the candidate inside the text around it, given the identifiers, for each of its bytes.

    By itself a string this short never compresses, whatever it holds; inside its text its characters cost what the text's
    own cost, or what repeats of the text and the identifiers leave. Copies of the candidate in that text are struck out,
    or each would make the others foreseeable.
    """
    raw = candidate.encode("utf-8", "replace")
    a, b = before.replace(candidate, "").encode("utf-8", "replace"), after.replace(candidate, "").encode("utf-8", "replace")
    return (len(pack.compress(a + raw + b)) - len(pack.compress(a + b))) / len(raw)


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings of LEAST characters or more, a letter among them, in lines with a sensitive word, on either side of it, and
    in the lines right below that are one such string each (as in a key block)."""
    out: list[tuple[int, int]] = []
    end = 0
    for hot in SENSITIVE.finditer(text):
        if hot.start() < end:
            continue
        begin, end = text.rfind("\n", 0, hot.start()) + 1, text.find("\n", hot.end())
        end = len(text) if end < 0 else end
        while end < len(text):
            below = text.find("\n", end + 1)
            below = len(text) if below < 0 else below
            m = CANDIDATE.fullmatch(text, end + 1, below)
            if m is None or below - end - 1 < LEAST:
                break
            end = below
        out += [m.span() for m in CANDIDATE.finditer(text, begin, end) if m.end() - m.start() >= LEAST and LETTER.search(m[0])]
    return out


def novel_spans(text: str, taken: list[tuple[int, int, str]], pack: zstandard.ZstdCompressor) -> list[tuple[int, int, str]]:
    """Candidates that compression can't foresee and no base match covers; each distinct string is measured once, in the
    text that is left without any candidate, so that secrets side by side don't make each other look usual."""
    out, seen, k, reach = [], {}, 0, 0
    taken, found = sorted(taken), candidates(text)
    rest, at, last = [], [], 0
    for a, b in found:
        rest.append(text[last:a])
        at.append((at[-1] if at else 0) + a - last)
        last = b
    left = "".join(rest) + text[last:]
    for (a, b), here in zip(found, at):
        while k < len(taken) and taken[k][0] < b:
            reach, k = max(reach, taken[k][1]), k + 1
        if a < reach:
            continue
        if (c := text[a:b]) not in seen:
            seen[c] = novelty(c, left[max(0, here - AROUND) : here], left[here : here + AROUND], pack) >= NOVELTY
        if seen[c]:
            out.append((a, b, "novel"))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FIELDS = [("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"), ("n_novel", "long")]


def find_secrets(docs: DataFrame, *, carry: bool = False) -> DataFrame:
    """Find secrets in every whole text; one row for each input row, nothing is shuffled.

    Base spans come from fixed patterns. Beyond them, a string in the line of a sensitive word or in the key block below
    is reported as ``novel`` where zstandard, primed with code identifiers and the text around the string, still needs
    ``NOVELTY`` bytes for each of its bytes. Null texts are empty and have no spans; repeated rows are each judged; ties
    can't arise within a kind.
    """

    def make():
        pack = packer()

        def fn(ids: list, texts: list[bytes]) -> dict:
            rows = []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                low = raw.translate(LOWER)
                hot = any(w in low for w in NEEDED)
                base = base_spans(text, hot)
                more = novel_spans(text, base, pack) if hot else []
                n = [sum(k == x for *_, k in base) for x in KINDS[:3]]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))), len(more)))
            return {name: [r[k] for r in rows] for k, (name, _) in enumerate(FIELDS)}

        return fn

    return map_docs(docs, make, FIELDS, carry=carry)


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
