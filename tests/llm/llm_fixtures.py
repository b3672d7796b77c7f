import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def make(spark, rows, schema=DOCS):
    """A table of the given rows; missing trailing columns are null."""
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


EDGE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (6, "12 .. --"),
    (7, "Alpha beta gamma delta epsilon zeta eta theta. " * 3), (7, "Alpha beta gamma delta epsilon zeta eta theta. " * 3),
    (None, "a row without an id keeps its text. and has some words"), (8, "x" * 200_000), (9, "word " * 60_000),
    (10, "alpha BETA gamma delta epsilon zeta eta theta."), (11, "é à ü ß 日本 語   z"),
]
