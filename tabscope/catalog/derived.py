"""Derived tables, as expressions that both engines read the same way.

The benchmark tables hold no gaps, sentinels or decorated text, so these put them in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscope.catalog import table

GAPPY_LINEITEM = [
    "l_quantity", "l_extendedprice", "nullif(l_discount, 0.0) as l_discount", "nullif(l_tax, 0.0) as l_tax",
    "case when l_quantity <= 45 then l_returnflag end as l_returnflag",
    "case when l_quantity <= 20 then l_linestatus end as l_linestatus",
    "case when l_quantity <= 6 then l_linenumber end as l_linenumber",
]
GAPPY_TYPES = ["double", "double", "double", "double", "string", "string", "int"]

DIRTY_ORDERS = [
    "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "'x' as extract_source",
    "case when o_totalprice > 499000 then 'huge' else 'usual' end as size_class",
    "cast(null as varchar(10)) as nothing",
    "case when o_totalprice < 100000 then o_totalprice end as small_price",
]

CODED_EVENTS = [
    "event_id", "user_id", "event_type",
    "case when value < 1.0 then -999.0 when value > 200.0 then 9999.0 else value end as reading",
    "case when value < 30.0 then 0.0 else value end as spend", "value",
]

WIDE_LINEITEM = [
    "l_quantity", "l_extendedprice", "nullif(l_discount, 0.0) as discount", "l_tax",
    "l_quantity * 2 + 1 as quantity_twice", "l_extendedprice * -0.5 + l_quantity as price_down",
    "l_quantity + l_linenumber * 3 as quantity_near",
]

LABELLED_ORDERS = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate",
    "case when o_totalprice > 250000 then 1 else 0 end as is_big",
    "case when o_totalprice > 250000 then 1 else 0 end as final_flag_copy",
    "case when o_totalprice > 250000 then 'closed' else 'open' end as final_status",
    "o_totalprice * 1.0 as price_again",
    "case when o_custkey > 100 then o_totalprice end as price_gaps",
    "concat('ORD-', cast(o_orderkey as varchar(20))) as order_ref",
]


def derived(spark: SparkSession, folder: str, name: str, expressions: list[str]) -> DataFrame:
    return table(spark, folder, name).selectExpr(*expressions)


def sql(name: str, expressions: list[str]) -> str:
    return f"SELECT {', '.join(expressions)} FROM {name}"


def names(expressions: list[str]) -> list[str]:
    return [e.rsplit(" as ", 1)[-1].strip() for e in expressions]
