"""Small documents with nulls, empty and long texts, repeated rows and clashing column names."""

import os
import sys

import pytest

sys.path.append(os.path.dirname(os.path.abspath(__file__)))

from llm_samples import prose

@pytest.fixture(scope="session")
def odd_docs(spark):
    """(doc_id, text, source, lang, n_chars, and columns whose names the operators use inside)."""
    long = prose(5, 30_000)
    rows = [
        (1, prose(1, 60), "a", "en"), (2, prose(1, 60), "a", "en"), (3, prose(1, 60), "b", None), (3, prose(1, 60), "b", None), (4, None, None, None), (5, "", "a", "en"), (6, " \n\t ", "a", "en"),
        (7, "?!", None, "en"), (8, "one two", "b", "en"), (9, long, "b", "en"), (10, prose(2, 200), "c", "en"), (11, prose(2, 199) + " changed", "c", "en"), (None, "no id", "c", "en"), (None, None, "c", "en"),
        (12, "naïve ÀÉÎ 漢字 😀 don't we'll it's  \n\n x", "c", "fr"), (13, "mail ann@example.org or +1 (980) 555-6268, 555-6268 again", "c", "en"),
    ]
    rows = [(i, t, s, g, None if t is None else len(t), "h", "k", "b", 1) for i, t, s, g in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, _h string, key string, bucket string, rid int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
