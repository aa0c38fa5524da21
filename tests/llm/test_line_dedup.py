from __future__ import annotations

import random

import pytest
from conftest import SMALL_SF
from pyspark.sql import functions as F

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import line_dedup
from shelfwise.plans.inspect import plan_text, python_operators

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOWER)


def brute(rows, min_chars=20, min_docs=3):
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            holders = held[key(line)]
            ids = [x for x in holders if x is not None]
            repeated = len(key(line)) >= min_chars and len(holders) >= min_docs
            if not repeated or i == (max(ids) if ids else None):
                keep.append(line)
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


L = [f"common line number {k} with enough letters É" for k in range(12)]


def odd_rows():
    rnd = random.Random(3)
    rows = [(k, "\n".join([rnd.choice(L) for _ in range(rnd.randint(0, 6))] + [f"own line of document {k} only, long"])) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort"), (104, "short"), (105, "short"),
             (106, "x" * 19), (107, "x" * 19), (108, "x" * 19), (109, "y" * 20), (110, " Y" + "y" * 19 + "\t"), (111, "\x0b" + "y" * 20 + "\r"),
             (112, " " + "y" * 20), (113, "É" * 20), (114, "é" * 20), (115, "É" * 20), (116, "É" * 20 + "\n\nend")]
    rows += [(None, L[0] + "\nlast"), (None, "é" * 20), (7, L[1]), (7, L[1]), (59, rows[59][1])]
    rows += [(200, "\n".join(["the same line again and again"] * 3000)), (201, "the same line again and again\nmore"), (202, "The Same line again and again ")]
    return rows


@pytest.mark.parametrize("batches,fanout", [(5, 2), (3, 4)])
def test_equals_brute_force(spark, make_docs, batches, fanout):
    rows = odd_rows()
    df = line_dedup.dedup(make_docs(rows), batches=batches, fanout=fanout, bucket_keys=500)
    assert got(df) == brute(rows)


def test_empty_table_and_other_thresholds(spark, make_docs):
    assert line_dedup.dedup(make_docs([]), batches=2).count() == 0
    rows = [(1, "ab\ncd"), (2, "AB"), (3, "cd")]
    assert got(line_dedup.dedup(make_docs(rows), min_chars=2, min_docs=2, batches=2)) == brute(rows, 2, 2)


def test_only_null_ids(spark, make_docs):
    rows = [(None, L[0]), (None, L[0]), (None, L[0] + "\n" + L[1])]
    assert got(line_dedup.dedup(make_docs(rows), batches=2)) == brute(rows)


def test_runs_are_levelled_and_settled_keys_are_not_written_again(spark, make_docs):
    runs = line_dedup.LineRuns(spark, 2, fanout=3)

    def batch(ids):
        return line_dedup.line_keys(make_docs([(i, L[0] + f"\na line of document {i} alone") for i in ids]))

    runs.add(batch([90, 91, 92]))
    assert [len(x) for x in runs.levels] == [1]
    runs.add(batch([10, 11]))  # L[0] is settled: only the two own lines are new
    assert spark.table(runs.levels[0][1]).count() == 2
    runs.add(batch([95]))  # a larger id changes the keeper
    assert [len(x) for x in runs.levels] == [0, 1]
    assert [r["last"] for r in runs.repeated().collect()] == [95]
    assert spark.table(runs.levels[1][0]).count() == 7
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_no_python_and_runs_are_not_moved(spark):
    docs = spark.read.parquet(f"{SMALL_SF}/documents.parquet")
    assert python_operators(line_dedup.dedup(docs, batches=2)) == []
    runs = line_dedup.LineRuns(spark, 3)
    keys = line_dedup.line_keys(docs)
    assert python_operators(keys) == []
    runs.add(keys)
    run = spark.table(runs.levels[0][0])
    own = keys.groupBy("h", "g").agg(F.max("doc_id").alias("m")).repartition(3, "h", "g")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(own.join(run, ["h", "g"], "left"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text
    side = text[text.rindex("Scan parquet"):] if "Scan parquet" in text else text[text.rindex("FileScan"):]
    assert "Exchange" not in side
    runs.close()
