"""Filters, guards and small helpers (no Spark job needed for most)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import expressions as X
from shelfwise.functions.expressions import escape_like
from shelfwise.functions.filters import Filters
from shelfwise.operators import kpis, series
from shelfwise.operators import free_sql
from shelfwise.operators.free_sql import check_read_only, to_spark
from shelfwise.operators.lookups import adhoc_sql, ping
from shelfwise.operators.rules import order_for
from shelfwise.operators.series import pick_auto_columns
from shelfwise.session import checkpoint_dir
from shelfwise.sources.catalog import normal_json


def test_filters_reject_reversed_range():
    with pytest.raises(ValueError):
        Filters(start_date="2024-02-01", end_date="2024-01-01")


def test_filters_parse_dates():
    f = Filters(start_date="2024-01-01", end_date=dt.datetime(2024, 1, 31, 12))
    assert f.start_date == dt.date(2024, 1, 1) and f.end_date == dt.date(2024, 1, 31)
    assert not f.by_region and not f.by_category and not f.open_dates


def test_date_range_is_inclusive_of_last_day(spark):
    rows = [(dt.datetime(2024, 1, 31, 23, 59, 59),), (dt.datetime(2024, 2, 1),), (None,)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    f = Filters(start_date="2024-01-01", end_date="2024-01-31")
    assert df.where(f.date_in_range(df.ts)).count() == 1
    assert df.where(f.date_null_or_in_range(df.ts)).count() == 2
    assert df.where(Filters().date_in_range(df.ts)).count() == 2   # open range drops NULL only


def test_escape_like():
    assert escape_like("50%_off\\") == "50\\%\\_off\\\\"


def test_search_takes_text_literally(golden):
    from shelfwise.operators.rules import search_products, search_warehouses
    assert [r.name for r in search_warehouses(golden, "ALP").collect()] == ["Alpha"]
    assert search_products(golden, "%").count() == 0


@pytest.mark.parametrize("sql", ["DROP TABLE x", "select 1; select 2", "insert into t values (1)", "SET x = 1", "not sql",
                                 "WITH t AS (SELECT 1 a) INSERT INTO x SELECT * FROM t", "CREATE TABLE y AS SELECT 1",
                                 "FROM x INSERT INTO y SELECT *", "CACHE TABLE z AS SELECT 1"])
def test_free_sql_guard_rejects(spark, sql):
    with pytest.raises(ValueError):
        check_read_only(spark, sql)


@pytest.mark.parametrize("sql", ["  with a as (select 1) select * from a ;", "SELECT ';' AS x", "-- comment\nSELECT 1",
                                 "(SELECT 1) UNION (SELECT 2)", "SELECT 'drop table x'"])
def test_free_sql_guard_accepts(spark, sql):
    assert check_read_only(spark, sql) == sql


def test_ping(spark):
    assert ping(spark).first().ok == 1


def test_order_words():
    assert order_for("Which warehouses are underperforming?") == "worst"
    assert order_for("Which categories generate the most revenue?") == "best"
    assert order_for("What is below reorder level?") == "best" and order_for("best yellow items") == "best"
    assert order_for("LOW sellers?") == "worst"


def test_money_is_exact_until_the_edge(spark):
    df = spark.createDataFrame([(9007199254740993,)], "c long")
    assert str(df.select(X.money(F.col("c"), exact=True)).first()[0]) == "90071992547409.93"
    assert df.select(X.money(F.col("c"))).first()[0] == 90071992547409.93


def test_figures_of_any_number(spark):
    df = spark.createDataFrame([("a", 0.004), ("a", 0.004), ("b", 0.016)], "name string, y double")
    assert {r.name: r.y for r in series.auto_series(df).collect()} == {"a": 0.008, "b": 0.016}
    assert kpis.show_metrics(df, "y").first().total == pytest.approx(0.024, abs=1e-12)
    odd = spark.createDataFrame([("a", float("nan")), ("b", 1e300)], "name string, y double")
    assert kpis.show_metrics(odd, "y").first().row_count == 2
    dec = spark.createDataFrame([("a", Decimal("0.125")), ("b", Decimal("90071992547409.930"))], "name string, y decimal(30,3)")
    assert pick_auto_columns(dec) == ("name", "y")
    assert kpis.show_metrics(dec, "y").first().total == 90071992547410.055


def test_share_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", Decimal("0.00"))], "category_name string, total_revenue decimal(23,2)")
    assert series.revenue_share(df).first().share is None


def test_json_is_one_key_whatever_its_spelling(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "x"}',), ('{"a":"x","b":1}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in df.select(normal_json(F.col("j"))).collect()] == ['{"a":"x","b":1}', '{"a":"x","b":1}', "no json", None]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_auto_columns(spark):
    df = spark.createDataFrame([("a", 1.5, 2)], "name string, revenue double, n long")
    assert pick_auto_columns(df) == ("name", "revenue")
    assert pick_auto_columns(df.select("n")) is None


@pytest.mark.parametrize("sql", [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')", "SELECT java_method('java.lang.System', 'exit', 1)",
    "SELECT system.builtin.reflect('java.lang.System', 'exit')", "SELECT `reflect`('a', 'b')", "SELECT * FROM parquet.`/any/path`",
    "SELECT (SELECT count(*) FROM text.`/etc/hosts`)", "SELECT * FROM range(10)", "SELECT * FROM IDENTIFIER('secret')",
    "SELECT TRANSFORM(name) USING 'cat' AS (x) FROM product", "SELECT * FROM secret_view", "SELECT * FROM other.product",
    "SELECT r'\\', reflect('a', 'b'), '' FROM product", "SELECT /* x */ reflect /* y */ ('a', 'b')", "WITH a AS (SELECT * FROM secret_view) SELECT * FROM a",
    "SELECT input_file_name()", "DROP TABLE product", "SELECT 1; SELECT 2"])
def test_free_sql_refuses(golden, sql):
    golden.spark.range(1).createOrReplaceTempView("secret_view")
    with pytest.raises(ValueError):
        adhoc_sql(golden, sql)


def test_free_sql_keeps_the_callers_views(golden):
    spark = golden.spark
    spark.range(3).createOrReplaceTempView("product")
    try:
        assert adhoc_sql(golden, "SELECT count(*) FROM product").first()[0] == 3
        assert adhoc_sql(golden, "SELECT max(price) FROM retail.Product").first()[0] == Decimal("120.00")
        assert spark.table("product").columns == ["id"]
    finally:
        spark.catalog.dropTempView("product")
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("product_")]


def test_free_sql_in_postgresql_spelling(golden):
    rows = adhoc_sql(golden, """
        WITH sold (pid, cents) AS (SELECT i.productid, SUM(i.subtotal)::numeric FROM retail.salestransactionitem i GROUP BY i.productid)
        SELECT p.name::text || ' (' || p.productid::int8 || ')' AS text, ROUND(s.cents::numeric / 3, 2) AS third, CAST(s.cents AS numeric) AS same,
               CAST(s.cents AS NUMERIC(12, 1)) AS tenth, 'retail.product ::text (x)' AS told, CAST(s.cents AS double precision) AS d -- retail.x reflect(
        FROM retail.product p JOIN sold AS s ON s.pid = p.productid WHERE p.name ILIKE '%MILK%' AND (s.cents) IN (50.00) ORDER BY 1 NULLS LAST""").collect()
    assert [(r.text, r.third, r.same, r.tenth, r.told, r.d) for r in rows] == [
        ("Milk (1000)", Decimal("16.67"), Decimal("50.00"), Decimal("50.0"), "retail.product ::text (x)", 50.0)]


def test_rewriting_leaves_aliases_and_precisions():
    assert to_spark("SELECT (SELECT x AS text), y::numeric(9,2), CAST(z AS varchar(3))") == "SELECT (SELECT x AS text), y::numeric(9,2), CAST(z AS varchar(3))"
    assert to_spark("SELECT a :: numeric, CAST(b AS text)") == "SELECT a :: decimal(38,10), CAST(b AS string)"
    assert "product" in free_sql.to_spark("select retail . product.name from retail.product")


def test_json_documents_are_equal_by_value(spark):
    pairs = [('{"a": 1, "b": 2.50}', '{"b":2.5,"a":1.0}'), ('{"a": 9, "a": 1}', '{"a":1}'), ('{"a": 1e2}', '{"a":100}'),
             ('{"a": "1.0", "b": "x\\"2.50"}', '{ "b" : "x\\"2.50", "a":"1.0"}'), ('[1.00, {"z": 0.10}]', '[1,{"z":0.1}]')]
    df = spark.createDataFrame(pairs, "x string, y string")
    assert all(r[0] == r[1] for r in df.select(normal_json(F.col("x")), normal_json(F.col("y"))).collect())
    apart = [('{"a": "1.0"}', '{"a":"1"}'), ('{"a": 1}', '{"a":"1"}'), ('{"a": 10}', '{"a":1}'), ('[1,2]', '[2,1]')]
    df = spark.createDataFrame(apart, "x string, y string")
    assert all(r[0] != r[1] for r in df.select(normal_json(F.col("x")), normal_json(F.col("y"))).collect())
