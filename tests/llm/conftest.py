from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, class string"


def prose(r: random.Random, n: int) -> str:
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "Lambda", "mu,", "nu.", "xi", "größe", "été"]
    return " ".join(r.choice(words) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with null and empty texts, repeats, ties, a very long text, null ids and columns of clashing names."""
    r = random.Random(1)
    texts: list = [None, "", " \n\t ", "one", "one two three", "One TWO three four", "\x1c\x00 odd <|endoftext|> é e\u0301 日本"]
    texts += [prose(r, r.randint(5, 60)) for _ in range(40)]
    base = prose(r, 200).split()
    for _ in range(12):
        own = list(base)
        own[r.randrange(200)] = "changed" + str(r.randint(0, 9))
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 3 + [prose(r, 9000), "spam ! spam ! " * 30, "line one here\n" * 6 + "end"]
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "c", None)[min(i % 7, 3)], None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    return [*out, out[10], (None, "no id at all here", "en", "a", 5, "x", "y"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark, rows):
    own = [(r[0], 1 if i % 4 else 0, 1 if i % 5 == 0 else 0) for i, r in enumerate(rows)]
    return spark.createDataFrame([*own, (3, None, None), (None, 1, 1), (5, 1, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
