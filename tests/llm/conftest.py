import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those that the operators make.
CLASHES = "key string, shard int, rank int, score double, row long, gone long, done string, set_id long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, lang]) rows, with columns of clashing names beside them."""

    def make(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else None, None, None, "k", 1, 2, 0.5, 3, r[0], "d", 7) for r in rows
        ]
        return spark.createDataFrame(full, f"{DOCS}, {CLASHES}")

    return make


@pytest.fixture(scope="session")
def rows():
    def collect(df, *columns):
        return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)

    return collect
