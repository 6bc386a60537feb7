import random

import pytest
from llm_data import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep int, row string, token string, `a.b` int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with internal ones."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base[:60] + ["Zz"] + base[61:]
    passage = words(rng, 70)
    texts = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "One"), (9, "one two"),
        (10, " ".join(words(rng, 40) + passage + words(rng, 40))), (11, " ".join(words(rng, 30) + passage + words(rng, 20))), (12, " ".join(words(rng, 9000))), (12, " ".join(words(rng, 50))),
        (13, " ".join(base[:90])), (None, " ".join(base)), (None, None), (14, "é ü 你好  x 😀 it's <|startoftext|> A1B2 don't"), (15, "x" * 5000), (3, " ".join(base)),
    ]
    rows = [(i, t, None if i == 2 else "en", [None, "s1", "s2", "s3"][k % 4], None if t is None else len(t), 1, "r", "t", 2) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
