from __future__ import annotations

import random

import pytest

from odonymy.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(40)] + ["der", "The", "the", "straße", "été", "x#y", "a|b", "don't"]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def frame(spark):
    def build(rows, partitions=3):
        """rows: (doc_id, text); extra columns have clashing names."""
        full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
        out = spark.createDataFrame(full, SCHEMA)
        return out.selectExpr("*", "'q' AS block", "1 AS bucket", "'z' AS score", "2 AS n", "'r' AS rep", "array(1) AS w").repartition(partitions)

    return build


def story(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with exact and near copies, shared passages, short, empty, null and long texts."""
    rng = random.Random(11)
    rows = [(10 + i, story(rng, rng.randint(1, 120))) for i in range(60)]
    base, passage = story(rng, 150), story(rng, 55)
    rows += [(200 + i, base) for i in range(8)]
    for i in range(25):
        w = base.split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 99)}"
        rows.append((300 + i, " ".join(w)))
    rows += [(400 + i, f"{story(rng, 20)} {passage}\n{story(rng, 15)}") for i in range(10)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (504, "one"), (505, "one two"), (506, "One  TWO"), (507, "  　x"), (508, story(rng, 6000)), (1, base), (2, passage), (0, "w1 " * 400), (-5, "w1 " * 50)]
    rng.shuffle(rows)
    return rows
