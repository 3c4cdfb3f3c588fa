import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, score double, `kept` string, `node` int"


def texts(seed=1, n=120):
    """Prose of a few words, near and exact copies, junk, nulls, empty texts, ties and repeated rows."""
    draw = random.Random(seed)
    words = ["the", "and", "of", "Stone", "river", "walk", "été", "größe", "niño", "blue", "ten", "<|endoftext|>", "don't", "x1", "#tag", "a\tb", "end.\n", "😀"]
    rows = []
    for i in range(n):
        t = " ".join(draw.choice(words) + str(draw.randint(0, 40)) * draw.randint(0, 1) for _ in range(draw.randint(0, 90)))
        rows.append((i, t, draw.choice(["en", "de", "fr", "es", None]), draw.choice(["a", "b", "c", None]), 0.5, "x", 7))
    base = " ".join(f"w{k}" for k in range(60))
    rows += [(1000 + k, base.replace(f"w{k} ", f"v{k} "), "en", "a", None, None, None) for k in range(30)]
    rows += [(2000 + k, base, "en", "a", None, None, None) for k in range(20)]
    rows += [(3000, None, None, None, None, None, None), (3001, "", "en", "b", None, None, None), (3002, " \n\t ", "en", "b", None, None, None), (3003, "one", "en", "b", None, None, None)]
    rows += [(3004, "long " * 30_000, "en", "b", None, None, None), (None, "no id here", "en", "c", None, None, None), (3005, "same", "en", "c", None, None, None), (3005, "same", "en", "c", None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
