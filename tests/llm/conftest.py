import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, own int"


@pytest.fixture
def frame(spark):
    """Documents with an extra column from texts, or (id, text) pairs."""

    def make(rows, schema=DOC):
        if schema == DOC:
            rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
            rows = [(i, t, "en", "h", None if t is None else len(t), 1) for i, t in rows]
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture
def words():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n, seed: [random.Random(seed * 1000 + i).choice(vocabulary) for i in range(n)]
