import random

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, shared passages, odd characters."""
    r = random.Random(7)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(300)]
    passage = " ".join(r.choices(vocab, k=90))
    body = lambda n: " ".join(r.choices(vocab, k=n))
    rows = [
        (1, body(200), "en", "a", 5),
        (2, body(30) + " " + passage + "\n" + body(20), "en", "a", None),
        (3, passage, "en", None, 1),
        (4, body(10) + "\t" + passage + "  " + body(70), None, "b", 1),
        (4, body(10) + " " + passage, "en", "b", 1),
        (5, None, "en", "a", None),
        (6, "", "de", "b", 0),
        (7, " \n\t ", "de", "b", 4),
        (None, passage + " " + body(5), "de", "b", 4),
        (8, "one", "fr", "c", 3),
        (9, "ÄÖ Ü x   é́ İ ß ﬁ 日本語 😀", "fr", "c", 3),
        (10, "same same " * 400, None, None, 3),
        (11, "same same " * 300, None, None, 3),
        (12, "<|endoftext|> it's 12'34 a.b,c!! #*$%&|<>", "en", "c", 3),
        (13, "x" * 200_000, "en", "c", 3),
        (14, body(8000) + " " + passage, "en", "a", 3),
        (15, "A. B! C? ".upper() * 3, "en", "a", 3),
        (16, "123 456 ... --- 789", "en", "a", 3),
    ]
    return rows + rows[1:3] + [(100 + i, passage, "en", "hot", 1) for i in range(40)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """The table with extra columns of the given names."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("extra") for n in names})


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
