"""Small inputs that the tests of the text operators share."""

from __future__ import annotations

import duckdb

SMALL = "/root/testdata/sf0.001"
#: The columns of documents, and names that the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, value string, key string, _gone string, spans string, host string, part string, q string, digest string"


def docs(spark, *texts, first=1, **other):
    """Documents with ids from ``first``, all other columns filled with clashing names."""
    rows = [(i, t, other.get("lang", "en"), other.get("source", "s"), None if t is None else len(t), *["x"] * 10) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    rows = [
        (None, None, None, None, None),
        (1, None, "en", None, None),
        (2, "", None, "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (4, "one", "en", "s", 3),
        (5, "word " * 30_000, "en", "s", 150_000),
        (5, "word " * 30_000, "en", "s", 150_000),
        (6, "x" * 100_000, "xx", "s", 100_000),
        (7, "é <b>&amp;   \U0001f600 '", "fr", "t", 20),
    ]
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def read(table, columns, where="true", folder=SMALL):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{folder}/{table}.parquet' WHERE {where}").fetchall()
