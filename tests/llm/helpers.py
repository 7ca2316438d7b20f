"""Small tables and texts for the tests."""

from nextbasket.llm.common import LOWER, UPPER

EDGE = [(1, None), (None, "a b"), (2, ""), (3, "x"), (3, "x"), (4, "word " * 20000), (5, "é ß\n\n€ \x00 z"), (6, " \n ")]
DOC = "doc_id long, text string, lang string, score double, n_chars long"


def docs(spark, rows):
    """With columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, None, 1.5, len(t or "")) for i, t in rows], DOC)


def lower(t):
    return (t or "").translate(str.maketrans(UPPER, LOWER))


def sentence(r, n):
    return " ".join(r.choice(("the", "of", "and")) if r.random() < 0.2 else "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
