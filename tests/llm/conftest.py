import pytest

#: (doc_id, text): null and empty texts, a null id, ties, repeated rows, odd
#: white space, control characters, special strings, a very long word.
DOCS = [
    (1, "The cat sat on the mat.  The cat's here, isn't it?\nNew line\tand tab"),
    (2, ""), (3, None), (None, "a text without an id"), (None, None),
    (5, "same text for two ids"), (6, "same text for two ids"),
    (7, "row"), (7, "row"), (7, "another text of id 7"),
    (8, "a\x1cb \x1f c\u00a0d\u2003e  f \n g   "), (9, "<|endoftext|> and <|startoftext|>x"),
    (10, "ÄÖÜ ß ﬁ İ Σς 漢字 🙂🙂 e\u0301"), (11, "x" * 5000), (12, "word " * 3000), (13, "   "), (14, "\n\n \n"),
    (-4, "negative id"), (2**62, "large id 12345 67 8"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "clash", 1.5, t, None) for i, t in DOCS]
    # extra columns, named like those that operators make or use
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, score double, ids string, mark int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def key(row):
    return tuple((v is None, str(v)) for v in row)


def sorted_rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)
