import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

# Texts that every operator must take: null, empty, blanks, ties, very long, odd signs.
ODD = [None, "", " \n\t ", "one", "same text here", "same text here", "word " * 40_000, "x" * 200_000,
       "é漢字 ¡ \x1c odd\x85signs　 <|endoftext|> 'S\r\nline", "@ + ( 1.2.3 \x00 |<>"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with null ids, repeated rows and clashing column names."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD)]
    rows += [(None, "no id at all, but text.", None, None, None), (3, "one", "en", "s", 3), (3, "other text of three", None, "s", 1)]
    rows += [(None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    for name in ("key", "id", "node", "n", "kept", "spans", "n_words", "payload", "row", "a", "h"):
        df = df.selectExpr("*", f"'{name}' as `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    """A few hundred rows of the smallest documents table, whole texts."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
