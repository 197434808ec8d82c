import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, key string, fp long, kept string, _row string"
LABEL = "doc_id long, quality int, toxic int"
INSULTS = ["idiot", "scum", "moron"]


def prose(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents of every awkward kind: null ids and texts, empty and long ones, copies, near copies, repeated rows."""
    r = random.Random(3)
    en = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    fr = ["".join(r.choice("éèaçoumpv") for _ in range(r.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(240):
        text = prose(r, r.choice([5, 40, 80, 150]), fr if i % 3 == 0 else en)
        if i % 6 == 1:
            text += f" you {r.choice(INSULTS)}! {r.choice(INSULTS)}"
        if i % 10 == 3:
            text = "#".join(text.split()) + " $$$ ### $$$ " * 40
        out.append((i, text, "fr" if i % 3 == 0 else "en"))
    base = prose(r, 200, en)
    for i in range(240, 260):
        words = base.split()
        words[r.randrange(200)] = r.choice(en)
        out.append((i, " ".join(words) if i > 243 else base, "en"))
    out += [(300, None, "en"), (301, "", None), (302, "   \n\t ", "en"), (None, "no id here", "en"), (None, None, None), (303, prose(r, 30000, en), "en"), (304, "ÄÖ \u2003 ß\x00 \U0001f600", "en"), (10, out[10][1], "en"), (10, out[10][1], "en"), (305, "word", "en"), (306, "word", "en")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, g, f"src{k % 5}", len(t or ""), 0.5, "x", "y", 1, "z", "w") for k, (i, t, g) in enumerate(rows)], DOC).repartition(3)


@pytest.fixture(scope="session")
def labels(spark, rows):
    good = [(i, 0 if t and "$$$" in t else 1, int(any(w in t for w in INSULTS))) for i, t, _ in rows if i is not None and t and i < 260 and i % 5]
    return spark.createDataFrame([*good, (None, 1, 1), (7, None, None), good[0], (9999, 1, 0)], LABEL)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)
