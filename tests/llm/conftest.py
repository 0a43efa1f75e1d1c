import random

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls watch from tall trees in deep green woods near old mill".split()
#: Columns beside those of documents, with names that operators might use themselves.
EXTRA = "words string, t string, row_ long, kept string, n long, token string, digest string, `dotted.name` long"


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls in all columns, empty, blank, repeated and long texts, and extra columns."""
    rnd = random.Random(7)
    rows = []
    for k in range(120):
        w = (WORDS * 4)[: rnd.randint(1, 90)]
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice([*WORDS, f"x{k}", "Ünïcode"])
        text = (" ", "  ", "\n", " \t")[k % 4].join(w)
        rows.append((k, text.upper() if k % 5 == 0 else text, ("en", "fr", None)[k % 3], ("a", "a", "b", None)[k % 4], len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t ", "en", "a", 4), (None, "one two three", "en", "b", 13), (203, "One two THREE", None, None, 13), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (204, "\x00\x01\x02 odd \x03 marks \U0001f600 end", "en", "a", 20), (205, "word " * 30_000, "en", "a", 150_000), (206, "a" * 100_000, "en", "a", 100_000)]
    extra = ("w", "t", 1, "k", 2, "z", "d", 3)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)


@pytest.fixture(scope="session")
def texts(hard):
    return [(r.doc_id, r.text) for r in hard.collect()]


