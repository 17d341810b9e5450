"""Edge fixtures derived inside queries from the driver tables (identical text in the oracles).

The driver tables hold no NULLs, constants or duplicates, so the profile and
cleaning queries derive them: l_quantity is NULL on line number 4, a constant
column, a 99.6 % constant column, an all-unique string, numeric text with 5 %
junk, date text and padded mixed-case categories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import problems

LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "const_col", "near_const"]
LINE_STRINGS = ["l_returnflag", "l_linestatus", "flag_padded"]


def line_fx(spark: SparkSession, sf: str) -> DataFrame:
    li = problems.line(spark, sf)
    c = F.col
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(c("l_linenumber") == 4, F.lit(None)).otherwise(c("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "target",
        F.lit(1.0).alias("const_col"),
        F.when(c("l_orderkey") % 250 == 0, F.lit(2.0)).otherwise(F.lit(1.0)).alias("near_const"),
        F.concat(F.lit(" "), F.upper(c("l_returnflag")), F.lit(" ")).alias("flag_padded"),
        F.when(c("l_orderkey") % 20 == 0, F.lit("x")).otherwise(c("l_extendedprice").cast("string"))
        .alias("price_text"),
        F.when(c("l_orderkey") % 5 == 0, F.lit("x")).otherwise(c("l_tax").cast("string")).alias("tax_text"),
        F.date_format(c("l_shipdate"), "yyyy-MM-dd").alias("ship_text"),
        F.when(c("l_linenumber") == 3, F.lit(None)).otherwise(c("l_linestatus")).alias("status_nulls"),
        F.concat(F.lit("k"), c("l_orderkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string"),
                 F.lit("-"), c("l_partkey").cast("string")).alias("row_code"),
    )


LINE_FX_SQL = """
line_fx AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity END AS l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, target,
         1.0::DOUBLE AS const_col,
         CASE WHEN l_orderkey % 250 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS near_const,
         ' ' || upper(l_returnflag) || ' ' AS flag_padded,
         CASE WHEN l_orderkey % 20 = 0 THEN 'x' ELSE CAST(l_extendedprice AS VARCHAR) END AS price_text,
         CASE WHEN l_orderkey % 5 = 0 THEN 'x' ELSE CAST(l_tax AS VARCHAR) END AS tax_text,
         strftime(l_shipdate, '%Y-%m-%d') AS ship_text,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linestatus END AS status_nulls,
         'k' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)
           AS row_code
  FROM line)"""


def line_fx_sql() -> str:
    return problems.with_sql("line") + "," + LINE_FX_SQL


def unpivot_sql(name: str, select_sql: str, cols: list[str]) -> str:
    """DuckDB CTE stacking ``cols`` of a sub-select into ("column", value), NULLs kept."""
    return (f'{name} AS (SELECT * FROM ({select_sql}) UNPIVOT INCLUDE NULLS '
            f'(value FOR "column" IN ({", ".join(cols)})))')
