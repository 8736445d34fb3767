import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, key long"
_WORDS = "the of and to in that is was for on with as be at by this from are or an were which their has one all been two more".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(_WORDS) + str(rng.randrange(400)) for _ in range(n))


ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "no id at all here"), (None, None), (6, prose(1, 120)), (7, prose(1, 120)), (8, prose(1, 118) + " other end"),
    (9, "ab " * 6000), (10, "x" * 30_000), (11, "line one is here\nline one is here\n" + prose(2, 60)), (12, "é𠮷ü " + prose(3, 80)), (13, prose(4, 9000)), (14, prose(5, 200)), (15, prose(5, 100) + " " + prose(6, 100)),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns that an operator might use itself."""
    rows = [(i, t, None if i == 4 else "en", None if i in (2, 6) else f"src{(i or 0) % 3}", len(t or ""), 1, 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
