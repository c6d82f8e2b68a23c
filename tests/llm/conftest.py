import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cls string, label int"


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    r = random.Random(5)
    words = ["alpha", "Beta", "gämma", "delta", "ж", "eps", "zeta", "eta", "x1", "--", "y"]
    say = lambda n: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))
    base, long_text = say(120), say(9000)
    near = base.split()
    near[60] = "other"
    far = list(near)
    for i in (10, 30, 50, 70, 90, 110):
        far[i] = f"edit{i}"
    texts = [base, base, " ".join(near), " ".join(far), None, "", "  \n\t ", "One", "one two three", "ONE two  three", long_text, long_text + " tail", base.upper(), say(60) + "\n" + say(12) + "\n" + say(60)]
    texts += [say(r.randrange(1, 200)) for _ in range(30)]
    texts += [texts[13].split("\n")[1] + "\n" + say(70) for _ in range(4)]
    rows = [(i, t, "en", r.choice(["a", "b", None, "ü"]), None, 1, "c", 7) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[0], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (None, say(40), None, "a", 3, 4, "d", 5)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.fixture(scope="session")
def same():
    def compare(got, expected, places=6):
        got, expected = ([tuple(round(x, places) if isinstance(x, float) else x for x in row) for row in rows] for rows in (got, expected))
        assert sorted(got, key=key) == sorted(expected, key=key)

    return compare
