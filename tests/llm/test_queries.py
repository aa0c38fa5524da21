from __future__ import annotations

import pytest
from conftest import SMALL_SF
from harness import duckdb_connection, normalise

from shelfwise.llm.queries import ORACLE_SQL, QUERIES


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", list(ORACLE_SQL))
def test_matches_sql(spark, key):
    df = QUERIES[key](spark, SMALL_SF)
    found = duckdb_connection(SMALL_SF).execute(ORACLE_SQL[key])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(normalise(df.columns, [tuple(r) for r in df.collect()])) == sorted(normalise(columns, found.fetchall()))


@pytest.mark.parametrize("key,table", [("op3_toxicity", "documents"), ("op8_language_id", "documents"), ("op4_html_extraction", "pages"),
                                       ("op6_document_fingerprints", "documents"), ("op2_sentencepiece", "documents"),
                                       ("op1_quality_classifier", "documents")])
def test_a_row_for_every_row(spark, key, table):
    assert QUERIES[key](spark, SMALL_SF).count() == spark.read.parquet(f"{SMALL_SF}/{table}.parquet").count()
