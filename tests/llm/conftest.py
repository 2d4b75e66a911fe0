import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = "the same words again and again " * 40_000
    rows = [(1, "a b c d", "en", "x", 7, 0.5, "k"), (1, "a b c d", "en", "x", 7, 0.5, "k"), (2, "a b c d", None, None, None, None, None),
            (3, None, "en", "x", None, None, None), (4, "", "fr", "y", 0, 1.0, "k"), (5, "", None, "y", 0, None, "k"),
            (None, "a b c d", "en", "x", 7, None, "k"), (6, "A B\tC\nD", "en", None, 7, None, None), (7, long, "en", "x", len(long), None, None),
            (8, long + "end", "en", "x", len(long) + 3, None, None), (9, "été über ☃ 日本 \x00 <|endoftext|>", "fr", "z", 9, None, None),
            (9, "another text of one id", "en", "z", 9, None, None), (-20, "12 34 --- !!", "de", "z", 9, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
