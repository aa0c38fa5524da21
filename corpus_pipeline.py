"""Corpus preparation: toxic documents go, documents of no recognisable language go, one document of
each group of near duplicates stays, the rest is packed into sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's
result as Parquet to the shared checkpoint folder and reads it back for the next. All stages but
the last return the columns of documents, whatever other columns there are.

Defined cases: a NULL or empty text is not toxic, has no language and so goes with the second stage.
Rows of NULL id pass the stages by their text alone; the near-duplicate stage never removes them.
Rows that share an id are removed as near duplicates only together; of those that share id and text one stays
there, whatever their other columns hold. Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import jaccard_join, langid, packing, toxicity as tox
from shelfwise.llm.common import materialize, read_table, ship

#: A language is recognised from this score on; texts that mix two languages stay.
LEAST_LANGUAGE_SCORE = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = tox.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(tox.score_column(model)(F.col("text").cast("string")) < tox.DECISION)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    ship(spark)
    found = langid.predict_column(langid.fit(docs))(F.col("text").cast("string"))
    recognised = (found.getField("lang_pred") != langid.UNDETERMINED) & (found.getField("score") >= LEAST_LANGUAGE_SCORE)
    return docs.where(recognised)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates."""
    ship(spark)
    groups = materialize(jaccard_join.shingle_components(docs), "pipeline-groups")
    by_id = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("rows"))
    by_id = materialize(by_id, "pipeline-ids")
    again = by_id.where("rows > 1").select(F.col("doc_id").alias("again"))
    if not again.isEmpty():  # repetitions of a document, decided id by id; rows without id stay as they are
        repeated = docs.join(again, docs["doc_id"] == again["again"], "left_semi")
        docs = docs.join(again, docs["doc_id"] == again["again"], "left_anti").unionByName(repeated.dropDuplicates(["doc_id", "text"]))
    gone = by_id.where("stays = 0").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: one row per piece with its place in a sequence."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifiers nor the tokenizer; the tests hold the rows
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
