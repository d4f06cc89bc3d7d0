import random

import pytest

from rollstore.llm import common


@pytest.fixture(scope="session", autouse=True)
def ready(spark):
    common.prepare(spark)


def words(rng, n, vocabulary=40):
    return " ".join(rng.choice([f"w{i}", f"W{i}", f"ä{i}"]) for i in (rng.randrange(vocabulary) for _ in range(n)))


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, nulls, empties, blanks and one long text."""
    rng = random.Random(1)
    passage = words(rng, 70)
    base = words(rng, 200, 400)
    out = [words(rng, rng.randrange(1, 120), 300) for _ in range(25)]
    out += [base] * 6 + [base.replace("w7 ", f"x{i} ", 1) + f" tail{i}" for i in range(8)]
    out += [words(rng, 20, 300) + "\n" + passage + "\t" + words(rng, 15, 300) for _ in range(6)] + [passage] * 2
    out += [None, None, "", "", " \t\n", "one", "One", "one two three four", "a b c d e", "A b c d e", "a b\x00c  d\x1ce", words(rng, 6000, 3000)]
    out += ["x" * 300, "y" + "x" * 120, "x" * 49, "All rights reserved. cc by CC-BY! GNU General Public License, version 3."]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i, out[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents with other columns, whose names are those that operators might use inside."""
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, -1, i, b"x") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int, _id long, digest binary").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
