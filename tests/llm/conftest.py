import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, score string, band string, node string, shard string, _text string, ids string, lang_pred string"
LONG = "the river and the long house of words " * 4000 + "einzig " * 3000


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from the farm", "en"), (2, "", "en"), (3, None, None), (None, "Das ist ein kurzer Satz ohne Nummer", "de"),
        (5, LONG, "en"), (6, "Das ist ein kurzer Satz", "de"), (6, "Das ist ein kurzer Satz", "de"), (7, "Le chat est sur la table et il dort", "fr"),
        (8, "Das ist ein kurzer Satz", None), (9, "  \n\t ", "en"), (10, "12345 !!", None), (11, "<|endoftext|> a special \U0001f600 text é", "en"),
        (None, None, None), (12, "x" * 70000, "en"), (13, "Le chat est sur la table et il dort", "fr"), (14, "one two", "en"), (15, "one two", "en"),
    ]
    return spark.createDataFrame([(i, t, g, None, None, 1, "s", "b", "n", "h", "t", "i", "l") for i, t, g in texts], SCHEMA)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
