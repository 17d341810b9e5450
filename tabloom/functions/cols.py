"""Column-expression helpers shared by every operator (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def col(name: str) -> Column:
    """Backtick-quoted column reference; names may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns (booleans excluded, as in a pandas ``select_dtypes('number')``)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def datetime_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType) and f.name not in exclude]


def finite(c: Column) -> Column:
    """NaN and +-inf become NULL, so that "missing" is NULL everywhere."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(INF)), d)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode would raise on plain '/')."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rnd(c: Column, digits: int) -> Column:
    """Round the binary double half away from zero at ``digits`` dp: round(x * 10^d) / 10^d.

    Spark's ``round`` works on the shortest decimal text of the double, which
    differs from rounding the binary value at exact .5 boundaries (9/60000 =
    1.5E-4 is really 1.4999..e-4).  Scaling first makes both agree; + 0.0
    folds -0.0 so hashes compare across engines.
    """
    scale = float(10 ** digits)
    return F.round(c.cast("double") * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)


def r6(c: Column) -> Column:
    return rnd(c, 6)


def r4(c: Column) -> Column:
    return rnd(c, 4)


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN in float columns into NULL (pandas has one notion of missing)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def md5_order_key(c: Column) -> Column:
    """Numeric sort key with the same order as ``md5(cast(c as string))``.

    First 15 hex digits (60 bits) as a bigint; ties on those are broken by the
    full digest string, which callers add as a secondary order key.
    """
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("long")
