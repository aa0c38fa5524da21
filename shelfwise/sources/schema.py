"""Fixed schemas of the nine retail tables.

Keys are ``long``, counts of units and days ``int``, money ``decimal(12,2)``.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


def _fields(*spec):
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in spec])


SCHEMAS: dict[str, T.StructType] = {
    "warehouse": _fields(
        ("warehouseid", T.LongType(), False),
        ("name", T.StringType(), True),
        ("location", T.StringType(), True),
        ("region", T.StringType(), True),
        ("managername", T.StringType(), True),
    ),
    "category": _fields(
        ("categoryid", T.LongType(), False),
        ("name", T.StringType(), True),
        ("deptcode", T.StringType(), True),
    ),
    "supplier": _fields(
        ("supplierid", T.LongType(), False),
        ("name", T.StringType(), True),
        ("contactperson", T.StringType(), True),
        ("email", T.StringType(), True),
        ("phone", T.StringType(), True),
    ),
    "member": _fields(
        ("memberid", T.LongType(), False),
        ("name", T.StringType(), True),
        ("email", T.StringType(), True),
        ("membershiptype", T.StringType(), True),
        ("joindate", T.DateType(), True),
    ),
    "product": _fields(
        ("productid", T.LongType(), False),
        ("categoryid", T.LongType(), True),
        ("name", T.StringType(), True),
        ("price", MONEY, True),
        ("product_details", T.StringType(), True),  # JSON document as text
    ),
    "productsupplier": _fields(
        ("productid", T.LongType(), False),
        ("supplierid", T.LongType(), False),
        ("supplycost", MONEY, True),
        ("leadtimedays", T.IntegerType(), True),
    ),
    "inventory": _fields(
        ("warehouseid", T.LongType(), False),
        ("productid", T.LongType(), False),
        ("stockquantity", T.IntegerType(), True),
        ("reorderlevel", T.IntegerType(), True),
    ),
    "salestransaction": _fields(
        ("transactionid", T.LongType(), False),
        ("memberid", T.LongType(), True),
        ("warehouseid", T.LongType(), True),
        ("transactiondate", T.TimestampNTZType(), True),
        ("totalamount", MONEY, True),
    ),
    "salestransactionitem": _fields(
        ("lineitemid", T.LongType(), False),
        ("transactionid", T.LongType(), True),
        ("productid", T.LongType(), True),
        ("quantity", T.IntegerType(), True),
        ("unitpriceatsale", MONEY, True),
        ("subtotal", MONEY, True),
    ),
}

# Key columns of each table, used for deterministic ordering (raw viewer) and for
# bucketing when the tables are stored.
KEYS: dict[str, tuple[str, ...]] = {
    "warehouse": ("warehouseid",),
    "category": ("categoryid",),
    "supplier": ("supplierid",),
    "member": ("memberid",),
    "product": ("productid",),
    "productsupplier": ("productid", "supplierid"),
    "inventory": ("warehouseid", "productid"),
    "salestransaction": ("transactionid",),
    "salestransactionitem": ("lineitemid",),
}

TABLE_NAMES: tuple[str, ...] = tuple(SCHEMAS)
