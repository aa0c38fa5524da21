"""The nine retail tables derived from the TPC-H-style test tables.

The reference reads nine stored tables; the test data is a TPC-H-style star.  Each
function below maps driver tables onto one retail table (see ``FIXTURES.md`` §2 for
the same mapping as SQL, which the oracle uses).  All of them are narrow
projections and filters, so Parquet pushdown and column pruning reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.schema import MONEY

# Fixed values of the test-data mapping (FIXTURES.md §2).
NULL_WAREHOUSE_NATION = 24          # customers of this nation buy without a warehouse
NO_DETAILS_SIZE_RESIDUE = 7         # p_size % 10 == 7 has no product details
SEASONS = ("Winter", "Spring", "Summer", "Autumn")   # by p_size % 4
NO_LEADTIME_SUPPLIER_MODULUS = 11   # suppkey % 11 == 0 has no lead time
CATEGORY_ID_DIGITS = 15             # hexadecimal digits of the type name's MD5 that make its id
JOIN_BASE_DATE = "1995-01-01"


class DriverTables:
    """Lazy readers of the driver's Parquet files in one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def warehouse(d: DriverTables) -> DataFrame:
    nation = d.read("nation").select("n_nationkey", "n_name", "n_regionkey")
    region = d.read("region").select("r_regionkey", "r_name")
    key = F.col("n_nationkey").cast("string")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("warehouseid"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("Site "), key).alias("location"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("Manager "), key).alias("managername"),
    )


def category_id(type_name):
    """The id of a type: a number from its name's digest, so no task ranks all names."""
    return F.conv(F.substring(F.md5(type_name.cast("binary")), 1, CATEGORY_ID_DIGITS), 16, 10).cast("long")


def category(d: DriverTables) -> DataFrame:
    types = d.read("part").select("p_type").distinct()
    return types.select(
        category_id(F.col("p_type")).alias("categoryid"),
        F.col("p_type").alias("name"),
        F.concat(F.lit("D-"), F.substring("p_type", 1, 3)).alias("deptcode"),
    )


def supplier(d: DriverTables) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    return d.read("supplier").select(
        F.col("s_suppkey").cast("long").alias("supplierid"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Contact "), key).alias("contactperson"),
        F.concat(F.lit("s"), key, F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
    )


def member(d: DriverTables) -> DataFrame:
    key = F.col("c_custkey")
    return d.read("customer").select(
        key.cast("long").alias("memberid"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("m"), key.cast("string"), F.lit("@example.com")).alias("email"),
        F.col("c_mktsegment").alias("membershiptype"),
        F.date_add(F.lit(JOIN_BASE_DATE).cast("date"), (key % 365).cast("int")).alias("joindate"),
    )


def _season(size):
    expr = F.when(size % 4 == 0, F.lit(SEASONS[0]))
    for residue, name in enumerate(SEASONS[1:], start=1):
        expr = expr.when(size % 4 == residue, F.lit(name))
    return expr


def product(d: DriverTables) -> DataFrame:
    part = d.read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    details = F.concat(
        F.lit('{"brand": "'), F.col("p_brand"),
        F.lit('", "season": "'), _season(F.col("p_size")), F.lit('"}'),
    )
    return part.select(
        F.col("p_partkey").cast("long").alias("productid"),
        category_id(F.col("p_type")).alias("categoryid"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        F.when(F.col("p_size") % 10 == NO_DETAILS_SIZE_RESIDUE, F.lit(None).cast("string"))
         .otherwise(details).alias("product_details"),
    )


def supply_pairs(d: DriverTables) -> DataFrame:
    """Every (part, supplier) pair that was ever delivered."""
    return d.read("lineitem").select("l_partkey", "l_suppkey").distinct()


def productsupplier(d: DriverTables) -> DataFrame:
    part_key, supp_key = F.col("l_partkey"), F.col("l_suppkey")
    return supply_pairs(d).select(
        part_key.cast("long").alias("productid"),
        supp_key.cast("long").alias("supplierid"),
        (600 + (part_key * 7 + supp_key * 3) % 400).cast(MONEY).alias("supplycost"),
        F.when(supp_key % NO_LEADTIME_SUPPLIER_MODULUS == 0, F.lit(None).cast("int"))
         .otherwise((1 + (part_key * 3 + supp_key * 5) % 30).cast("int")).alias("leadtimedays"),
    )


def inventory(d: DriverTables) -> DataFrame:
    """A product is stocked in the warehouse of each nation that one of its suppliers is in."""
    nations = d.read("supplier").select("s_suppkey", "s_nationkey")
    pairs = supply_pairs(d)
    stocked = pairs.join(nations, pairs.l_suppkey == nations.s_suppkey).select("l_partkey", "s_nationkey").distinct()
    pk, nk = F.col("l_partkey"), F.col("s_nationkey")
    return stocked.select(
        nk.cast("long").alias("warehouseid"),
        pk.cast("long").alias("productid"),
        ((pk * 7 + nk * 13) % 101).cast("int").alias("stockquantity"),
        (5 + (pk * 3 + nk * 11) % 40).cast("int").alias("reorderlevel"),
    )


def salestransaction(d: DriverTables) -> DataFrame:
    orders = d.read("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customer = d.read("customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").cast("long").alias("transactionid"),
        F.col("o_custkey").cast("long").alias("memberid"),
        F.when(F.col("c_nationkey") == NULL_WAREHOUSE_NATION, F.lit(None).cast("long"))
         .otherwise(F.col("c_nationkey").cast("long")).alias("warehouseid"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("transactiondate"),
        F.col("o_totalprice").cast(MONEY).alias("totalamount"),
    )


def salestransactionitem(d: DriverTables) -> DataFrame:
    li = d.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    cents = F.round(F.col("l_extendedprice") * 100)
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("lineitemid"),
        F.col("l_orderkey").cast("long").alias("transactionid"),
        F.col("l_partkey").cast("long").alias("productid"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.floor(cents / F.col("l_quantity")) / 100).cast(MONEY).alias("unitpriceatsale"),
        F.col("l_extendedprice").cast(MONEY).alias("subtotal"),
    )
