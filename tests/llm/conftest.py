import random

import pytest

#: doc_id, text, lang, source, n_chars and columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, n long, name string, score double, node long, component long, start int, size long, bucket string, label string, `end` int, kind int"


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join("zz" + w if r.random() < share else w for w in text.split(" "))


TOXIC = ["you idiot clown", "what a moron and loser", "pathetic scum"]


def build():
    """(doc_id, text, lang, source): nulls, empties, blanks, repeats, copies, near copies, a long text."""
    base = [passage(i, 120) for i in range(6)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(10 + i, edited(base[0], i, 0.01), "en", "s0") for i in range(8)]
    rows += [(30 + i, edited(base[1], 100 + i, 0.25), "en", "s1") for i in range(4)]
    rows += [(40, base[2], "en", "s2"), (41, base[2].replace(" ", "\n\t "), "en", None), (42, base[2] + " ", "en", "s2"), (43, base[2].upper(), "en", "s2")]
    rows += [(50, None, None, None), (51, "", "en", "s0"), (52, " \n\t", "en", "s0"), (53, "one two", "en", "s1"), (54, "one two", "de", "s1"), (55, "ONE  two", "de", "s1")]
    rows += [(60, base[3], "en", "s0"), (60, base[3], "en", "s0"), (60, base[4], "en", "s0"), (None, base[5], "en", "s1"), (None, None, "en", "s1")]
    rows += [(70, passage(70, 30_000), "en", "s2"), (71, edited(passage(70, 30_000), 1, 0.005), "en", "s2"), (72, "x" * 50_000, "en", "s0"), (73, "é😀 ß " * 3000, "fr", "s0")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return build()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, lang, s, len(t or ""), 7, 7, "x", 0.5, 1, 1, 0, 3, "b", "l", 1, 2) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return repr(tuple(r))


@pytest.fixture
def equal():
    def check(got, want):
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)

    return check
