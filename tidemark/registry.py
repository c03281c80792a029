"""Where queries register themselves with their SQL, and the panel of orders that many of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def orders_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer's nation, the date as a day, and years since the first one."""
    orders, customers = T.table(spark, folder, "orders"), T.table(spark, folder, "customer")
    joined = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    day = F.to_date("o_orderdate")
    return joined.withColumn("day", day).withColumn("x", S.years_since(day, "1995-01-01")).withColumn("y", F.log("o_totalprice"))


ORDERS = """orders_by_nation AS (
  SELECT o.*, c.c_nationkey AS nation, CAST(o_orderdate AS DATE) AS day,
         date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 365.25 AS x, ln(o_totalprice) AS y
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)"""
