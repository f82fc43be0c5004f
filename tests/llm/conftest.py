import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = {"row": "1", "host": "'h'", "id": "2", "key": "3", "runs": "'r'", "a": "4", "b": "5", "n": "6", "okey": "7", "ids": "8", "keys": "9", "found": "'f'", "gone_id": "10", "TEXT2": "'t'"}


def make_rows(seed=0, n=60):
    """Texts with copies, near copies, shared passages and repeated lines, besides null, empty, blank and long ones."""
    g = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("Na", "so", "ké", "lo", "ü") for b in ("ri", "ta", "mo") for c in ("", "n", "s.")]
    text = lambda k: " ".join(g.choice(words) for _ in range(k))
    passage, texts = text(27), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            t = g.choice(texts)
        elif kind == 2 and texts:
            w = g.choice(texts).split(" ")
            w[g.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = text(g.randrange(3, 40)) + " " + passage + "\n" + text(g.randrange(3, 30))
        elif kind == 4:
            t = "Home | About\n" + text(g.randrange(1, 12)) + "\n\nAll rights reserved"
        else:
            t = text(g.randrange(1, 90))
        texts.append(t)
    texts += [None, "", " \n\t ", "x", text(6000), text(6000)[:-3] + " " + passage, "\U0001f600 ▁ ñ 中文 \x00 end"]
    return [(i * 3 + 1, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[g.randrange(3)], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"{v} AS `{k}`" for k, v in CLASHING.items()]).repartition(5)
    return df.persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and repeated ids, and repeated rows."""
    same = " ".join(f"w{i}" for i in range(30))
    data = [(None, same, "en", "s1", 1), (None, None, None, None, None), (5, same, "en", "s1", 1), (5, same, "en", "s1", 1), (5, "other words of row five", "en", None, 1), (9, same, "de", "s1", 1)]
    return spark.createDataFrame(data, SCHEMA)
