import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of texts (or (id, text) pairs), in as many partitions as asked for."""

    def make(texts, parts=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENT).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, blank, repeated, very long and strange texts."""
    rng = random.Random(5)
    words = ["alpha", "béta", "gamma,", "delta\tx", "eps\nilon", "Zeta!", "eta", "theta", "iota", "kappa"]
    some = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(25)]
    return [None, "", " \t\n", "one", "one two", "one two three", "a b a b a b a b", some[0], some[0], *some, " ".join(rng.choices(words, k=30_000)), "日本語 テキスト", "\x00 \x1c \x85", "x" * 5000]
