import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string, spans string, n long, `order` int"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 400)) for _ in range(n)]


def sample_texts():
    rng = random.Random(7)
    base = words(rng, 120)
    near = base[:60] + ["changed"] + base[61:]
    far = base[:60] + words(rng, 60)
    long = " ".join(words(rng, 30_000))
    return [" ".join(base), " ".join(near), " ".join(base), " ".join(far), long, " ".join(words(rng, 50)), None, "", " \n\t ", "one two three", "One TWO three", "solo", "l1\nl2\nl3\nl4", "x\nl1\nl2\nl3\ny", "é漢字 don't 's  \n\n end ", "😀" * 50]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None if t is None else len(t), "k", None, i, 1) for i, t in enumerate(sample_texts())]
    rows += [rows[0], rows[0], (None, "null id text one two three four five", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
