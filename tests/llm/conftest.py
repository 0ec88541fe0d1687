import random

import pytest

WORDS = ("the of and to in that is was for on as with by it at from or an be this which not are but have had his they "
         "she you all her been one their has would what will there if can about up out who more said").split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd case: nulls, empty and very long texts, copies, repeated rows, clashing columns."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) + rng.choice(WORDS) for _ in range(n))
    shared, long = prose(60), prose(6000)
    texts = [prose(rng.randrange(5, 200)) for _ in range(30)]
    texts += [None, "", " \t\n", "a", "one two", long, long, shared, "x " + shared + "\ny " + prose(20), shared + " " + shared,
              "line of words here\n" * 12, "é" * 400, "ü" + "é" * 399 + " tail", "A B c a b C", "0" * 1000]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s3"][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], "en", "s1"), (None, None, None, None)]
    rows = [(i, t, lang, src, len(t or ""), 9, 9, 9, 9, 9) for i, t, lang, src in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, score int, "
                                       "kept int, fp int, length int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
