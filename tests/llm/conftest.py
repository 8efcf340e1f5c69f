import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, source="a", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls in every column, empty, blank and very long texts, repeated rows, unusual characters, and clashing extra columns."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(300)]
    rows = [doc(i, " ".join(r.choices(words, k=r.randint(1, 60))), f"s{i % 3}") for i in range(40)]
    rows += [doc(100, None), doc(101, ""), doc(102, " \n\t "), (None, "no id here", None, None, None), (103, "no source", None, None, None)]
    rows += [doc(104, " ".join(r.choices(words, k=60_000)), "s0"), doc(105, "x" * 200_000, "s1"), doc(106, "é ñ 漢字 🙂 á <|endoftext|> \x00"), doc(1, rows[1][1], "s1"), doc(1, rows[1][1], "s1")]
    d = docs_of(rows)
    for c in ("ids", "n_tokens", "grade", "toxic", "expected_grade", "p_keep", "selected", "p_toxic", "node", "component", "n", "sig", "block", "shard", "slot", "g", "fine", "key", "words"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="session")
def no_docs(docs_of):
    return docs_of([])


def same_rows(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))
