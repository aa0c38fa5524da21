"""The ``make_docs`` fixture; test modules import it."""

from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text) pairs, with clashing extra columns."""
    def make(rows, schema="doc_id long, text string, class string, a int, score string"):
        return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)
    return make
