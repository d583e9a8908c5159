import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, d long, dn boolean, shard int, h long, part int, copies int, size long, n_words long, kept string, group long, fp long"
EXTRA = ("x", 1, True, 2, 3, 4, 5, 6, 7, "k", 8, 9)


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, len(text or ""), *EXTRA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randrange(60)) + "." * (k % 9 == 8) for k in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, copies, non-ASCII white space, columns whose names operators use."""
    shared = prose(99, 45)
    rows = [row(1, prose(1, 80)), row(2, prose(1, 80)), row(3, None), row(4, ""), row(5, " \n\t "), row(6, prose(2, 30) + "\n" + shared + " " + prose(3, 30)), row(7, shared), row(7, shared), row(7, "other " + shared), row(8, "one"), row(9, "A b  c É é" + " x" * 60), row(None, prose(1, 80), None), row(None, None, None), row(10, prose(5, 6000), "b"), row(11, prose(1, 80).upper(), "b"), row(12, prose(6, 25) * 3, "c"), row(13, prose(1, 79) + " changed", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
