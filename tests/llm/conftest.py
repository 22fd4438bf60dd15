import pytest

from seqloom.llm.queries import tokenizer

CLASH = "rank score cell block node component keep removed label _doc n host path"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls, blanks, ties, repeated rows, and columns named like the operators' own."""

    def make(rows):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        for name in CLASH.split():
            frame = frame.selectExpr("*", f"'x' as {name}")
        return frame

    return make


@pytest.fixture(scope="session")
def byte_vocabulary():
    return tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_vocabulary():
    return tokenizer("word_bpe_49k.json")
