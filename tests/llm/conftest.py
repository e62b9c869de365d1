"""Small awkward tables for the corpus operators."""

import pytest

LONG = "word " * 40_000
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 70),
    (2, "THE quick brown fox\tjumps over the lazy dog near the old river bank today", "en", "a", 70),
    (3, "Le chat est sur la table et le chien est dans la maison avec les enfants", "fr", "b", 70),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \t\n ", "fr", None, 4),
    (7, LONG, "en", "b", 200_000),
    (8, "one", "en", "c", 3),
    (9, "one", "en", "c", 3),
    (9, "one", "en", "c", 3),
    (10, "12345 !!! 678", None, "c", 13),
    (None, "a text without an id of its own", "en", None, 31),
    (11, "é" * 300, "fr", "b", 300),
]


@pytest.fixture
def docs(spark):
    """Documents with nulls, repeats, long and empty texts, and columns whose names operators use themselves."""
    rows = [(*r, 7, "x", True) for r in DOCS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, key string, kept boolean"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def no_docs(docs):
    return docs.where("false")
