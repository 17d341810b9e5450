"""Cleaning: P01-P18, P23.  Decisions come from one aggregation over the
training side (a handful of scalars per column), then are applied as column
expressions to any frame, train or test.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import col, finite, numeric_columns
from .kernels import quantile_wide, numeric_value_counts, value_counts
from .ordering import first_per_key

# What counts as a number (pandas to_numeric accepts these forms; Spark's
# try_cast would also take '1d' / '1f', so the regex guards it) and the datetime formats tried.
NUMERIC_TEXT = r"^\s*[+-]?((([0-9]+(\.[0-9]*)?)|(\.[0-9]+))([eE][+-]?[0-9]+)?|(?i:inf(inity)?))\s*$"
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy"]
# shape of each format: a parse is only attempted on matching text (failed parses are slow)
DATETIME_SHAPES = {
    "yyyy-MM-dd HH:mm:ss": r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?\s*$",
    "yyyy-MM-dd": r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*$",
    "yyyy/MM/dd": r"^\s*[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\s*$",
    "dd.MM.yyyy": r"^\s*[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\s*$",
    "MM/dd/yyyy": r"^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s*$",
}

# what is parsed for each format: one- and two-digit parts, a fraction of a second
DATETIME_PATTERNS = {
    "yyyy-MM-dd HH:mm:ss": "yyyy-M-d H:mm:ss[.SSSSSSSSS]",
    "yyyy-MM-dd": "yyyy-M-d",
    "yyyy/MM/dd": "yyyy/M/d",
    "dd.MM.yyyy": "d.M.yyyy",
    "MM/dd/yyyy": "M/d/yyyy",
}


def _string_cols(df: DataFrame, columns=None) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]


# any of the shapes above (one regex gates the five per-format checks)
DATE_LIKE = (r"^\s*([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?)?"
             r"|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})\s*$")


def parse_number(c: Column) -> Column:
    """Number in a text, else NULL; infinities are numbers."""
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


def parse_datetime(c: Column, fmt: str) -> Column:
    text = F.translate(F.trim(c), "T", " ")
    return F.when(c.rlike(DATETIME_SHAPES[fmt]), F.try_to_timestamp(text, F.lit(DATETIME_PATTERNS[fmt])))


# P01 / P02 ------------------------------------------------------------------------------------
def type_repair_plan(df: DataFrame, columns=None, num_share: float = 0.9, dt_share: float = 0.9) -> dict:
    """Decide per string column: 'numeric' (parseable share of all rows >= 0.9), else
    ('datetime', format) (share of non-null >= 0.9, best format), else None.  One aggregation."""
    cols = _string_cols(df, columns)
    if not cols:
        return {}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    probe = df.select(*[col(c).alias(f"_c{i}") for i, c in enumerate(cols)],
                      *[col(c).rlike(DATE_LIKE).alias(f"_d{i}") for i, c in enumerate(cols)])
    for i, c in enumerate(cols):
        x = F.col(f"_c{i}")
        aggs.append(F.count(parse_number(x)).alias(f"n{i}"))
        aggs.append(F.count(x).alias(f"nn{i}"))
        for j, fmt in enumerate(DATETIME_FORMATS):
            aggs.append(F.count_if(F.col(f"_d{i}") & x.rlike(DATETIME_SHAPES[fmt])).alias(f"s{i}_{j}"))
    r = probe.agg(*aggs).first()
    plan, probe = {}, []
    for i, c in enumerate(cols):
        rows, nn = r["_rows"], r[f"nn{i}"]
        if rows and r[f"n{i}"] / rows >= num_share:
            plan[c] = ("numeric", None)
        elif nn:
            # parse only formats whose shape alone could reach the share
            probe += [(c, fmt) for j, fmt in enumerate(DATETIME_FORMATS) if r[f"s{i}_{j}"] / nn >= dt_share]
    if probe:
        r2 = df.agg(*[F.count(parse_datetime(col(c), fmt)).alias(f"d{k}") for k, (c, fmt) in enumerate(probe)],
                    *[F.count(col(c)).alias(f"nn{k}") for k, (c, fmt) in enumerate(probe)]).first()
        best = {}
        for k, (c, fmt) in enumerate(probe):
            share = r2[f"d{k}"] / r2[f"nn{k}"] if r2[f"nn{k}"] else 0.0
            if share >= dt_share and (c not in best or share > best[c][0]):
                best[c] = (share, fmt)
        for c, (_, fmt) in best.items():
            plan[c] = ("datetime", fmt)
    return plan


def apply_type_repair(df: DataFrame, plan: dict) -> DataFrame:
    out = []
    for c in df.columns:
        kind = plan.get(c)
        if kind is None:
            out.append(col(c))
        elif kind[0] == "numeric":
            out.append(parse_number(col(c)).alias(c))
        else:
            out.append(parse_datetime(col(c), kind[1]).alias(c))
    return df.select(*out)


def fix_dtypes(df: DataFrame, columns=None) -> DataFrame:
    return apply_type_repair(df, type_repair_plan(df, columns))


# P03 ------------------------------------------------------------------------------------------
def normalize_categories(df: DataFrame, columns=None) -> DataFrame:
    cols = set(_string_cols(df, columns))
    return df.select(*[F.lower(F.trim(col(c))).alias(c) if c in cols else col(c) for c in df.columns])


# P04 ------------------------------------------------------------------------------------------
def drop_duplicates(df: DataFrame, key: str | None = None, order_by: list | None = None, keep: str = "first"
                    ) -> tuple[DataFrame, DataFrame]:
    """Keep first/last per key by ``order_by`` (default: the other columns); whole row when key is None.
    Returns (deduplicated frame, one-row frame with the dropped count).  Unknown key -> KeyError."""
    if key is None:
        out = df.dropDuplicates()
    else:
        if key not in df.columns:
            raise KeyError(key)
        out = first_per_key(df, [key], order_by or [c for c in df.columns if c != key], keep)
    from .joins import one_row_join
    a = df.agg(F.count(F.lit(1)).alias("_a"))
    b = out.agg(F.count(F.lit(1)).alias("_b"))
    dropped = one_row_join(a, b).select((F.col("_a") - F.col("_b")).alias("dropped"))
    return out, dropped


# P05 / P06 ------------------------------------------------------------------------------------
def constant_columns(df: DataFrame, threshold: float = 0.995, exclude=()) -> DataFrame:
    """(column, top_share, drop): share of the most frequent value, NULL counted as a value."""
    cols = [c for c in df.columns if c not in exclude]
    vc = value_counts(df, cols)
    s = vc.groupBy("column").agg((F.max("n") / F.sum("n")).alias("top_share"))
    return s.withColumn("drop", F.col("top_share") >= F.lit(threshold))


def high_cardinality_columns(df: DataFrame, threshold: float = 0.95, exclude=()) -> DataFrame:
    """(column, unique_ratio, drop) for string columns: nunique / non-null; all-null columns skipped."""
    cols = [c for c in _string_cols(df) if c not in exclude]
    vc = value_counts(df, cols).where(F.col("value").isNotNull())
    s = vc.groupBy("column").agg((F.count(F.lit(1)) / F.sum("n")).alias("unique_ratio"))
    return s.withColumn("drop", F.col("unique_ratio") >= F.lit(threshold))


def drop_flagged(df: DataFrame, flags: DataFrame) -> DataFrame:
    drop = {r["column"] for r in flags.where("drop").select("column").collect()}  # one row per column
    return df.select(*[col(c) for c in df.columns if c not in drop])


# P07 / P08 ------------------------------------------------------------------------------------
def winsor_bounds(train: DataFrame, columns: list[str], lo: float = 0.01, hi: float = 0.99) -> dict:
    q = quantile_wide(train, columns, {"lo": lo, "hi": hi}).collect()
    return {r["column"]: (r["lo"], r["hi"]) for r in q}


def winsorize(df: DataFrame, bounds: dict) -> DataFrame:
    def clip(c):
        lo, hi = bounds[c]
        x = col(c).cast("double")
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))).alias(c)
    return df.select(*[clip(c) if c in bounds else col(c) for c in df.columns])


def impute_plan(train: DataFrame, numeric: list[str], categorical: list[str]) -> dict:
    """numeric -> train median; categorical -> smallest most frequent value, else 'unknown'."""
    plan = {}
    if numeric:
        for r in quantile_wide(train, numeric, {"median": 0.5}).collect():
            plan[r["column"]] = r["median"]
    if categorical:
        vc = value_counts(train, categorical).where(F.col("value").isNotNull())
        # most frequent, ties to the smaller value; combined map-side
        mode = vc.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("value"))
        for r in mode.collect():
            plan[r["column"]] = r["value"]
        for c in categorical:
            plan.setdefault(c, "unknown")
    return plan


def impute(df: DataFrame, plan: dict) -> DataFrame:
    return df.select(*[F.coalesce(col(c), F.lit(plan[c])).alias(c) if c in plan else col(c) for c in df.columns])


# P09 / P10 / P11 ------------------------------------------------------------------------------
def sanitize(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN / +-inf / NULL -> 0.0 as double."""
    return df.select(*[F.coalesce(finite(col(c)), F.lit(0.0)).alias(c) if c in columns else col(c)
                       for c in df.columns])


def fit_fill(train: DataFrame, columns: list[str]) -> dict:
    """P10: train median of the finite values (else 0.0), used on both sides."""
    fin = train.select(*[finite(col(c)).alias(c) for c in columns])
    med = {r["column"]: r["median"] for r in quantile_wide(fin, columns, {"median": 0.5}).collect()}
    return {c: (med.get(c) if med.get(c) is not None else 0.0) for c in columns}


def apply_fill(df: DataFrame, fills: dict) -> DataFrame:
    return df.select(*[F.coalesce(finite(col(c)), F.lit(fills[c])).alias(c) if c in fills else col(c)
                       for c in df.columns])


def sentinel_fill(df: DataFrame, columns: list[str], value: float = -999.0) -> DataFrame:
    return df.select(*[F.coalesce(col(c).cast("double"), F.lit(value)).alias(c) if c in columns else col(c)
                       for c in df.columns])


# P12 / P13 ------------------------------------------------------------------------------------
def label_dictionary(train: DataFrame, column: str) -> DataFrame:
    """Sorted distinct train values -> 0..k-1 (the dictionary has one row per distinct value)."""
    from .ordering import dense_codes
    return dense_codes(train.select(col(column).cast("string").alias("_lv")), "_lv")


def label_encode(df: DataFrame, column: str, dictionary: DataFrame, out: str | None = None) -> DataFrame:
    """Codes from the train dictionary; unseen and NULL -> -1."""
    j = df.join(dictionary, col(column).cast("string") == F.col("_lv"), "left")
    return j.withColumn(out or column, F.coalesce(F.col("_code"), F.lit(-1).cast("long"))).drop("_lv", "_code")


def datetime_to_number(c: Column) -> Column:
    """Epoch microseconds; missing -> 0."""
    return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(0).cast("long"))


# P14 ------------------------------------------------------------------------------------------
def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    from ..functions.cols import categorical_columns, datetime_columns
    return {"numeric": numeric_columns(df), "datetime": datetime_columns(df),
            "other": categorical_columns(df)}


# P15 / P16 ------------------------------------------------------------------------------------
def ascii_name(name: str, letter_prefix: bool = False) -> str:
    """The runs of ASCII letters and digits of the decomposed name, joined by '_'; 'feat' without any.
    ``letter_prefix`` puts 'f_' before a name that starts with a digit."""
    runs = re.findall("[0-9A-Za-z]+", unicodedata.normalize("NFKD", str(name)))
    joined = "_".join(runs) or "feat"
    return f"f_{joined}" if letter_prefix and joined[0].isdigit() else joined


def ascii_mapping(names: list[str], letter_prefix: bool = False) -> dict[str, str]:
    """Old name -> ASCII name over a union of names.  The n-th further name with one ASCII form gets the
    suffix _n; a number that some other name already bears is passed over."""
    forms = {n: ascii_name(n, letter_prefix) for n in dict.fromkeys(names)}
    mapping: dict[str, str] = {}
    taken: set[str] = set()
    repeats: Counter[str] = Counter()
    for old, form in forms.items():
        new = form
        while new in taken:
            repeats[form] += 1
            new = f"{form}_{repeats[form]}"
        taken.add(new)
        mapping[old] = new
    return mapping


def rename_pair(train: DataFrame, test: DataFrame, letter_prefix: bool = False):
    m = ascii_mapping(list(dict.fromkeys(train.columns + test.columns)), letter_prefix)
    return (train.select(*[col(c).alias(m[c]) for c in train.columns]),
            test.select(*[col(c).alias(m[c]) for c in test.columns]), m)


# P17 ------------------------------------------------------------------------------------------
def align(train: DataFrame, test: DataFrame, features: list[str], fill_missing: bool = True, keep=()):
    """Features in train order; a feature missing from test becomes 0.0 there (or is dropped)."""
    if fill_missing:
        feats = [f for f in features if f in train.columns]
        tcols = [col(f) if f in test.columns else F.lit(0.0).alias(f) for f in feats]
    else:
        feats = [f for f in features if f in train.columns and f in test.columns]
        tcols = [col(f) for f in feats]
    return (train.select(*[col(k) for k in keep if k in train.columns], *[col(f) for f in feats]),
            test.select(*[col(k) for k in keep if k in test.columns], *tcols))


# P18 ------------------------------------------------------------------------------------------
def _json_safe(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return finite(c)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _json_safe(x, dt.elementType))
    if isinstance(dt, T.StructType):
        inner = F.struct(*[_json_safe(c[f.name], f.dataType).alias(f.name) for f in dt.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda k, v: _json_safe(v, dt.valueType))
    return c


def to_json_safe(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON object per row; NaN / +-inf -> null at any depth, nulls kept as keys."""
    fields = [_json_safe(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(out))


# P23 ------------------------------------------------------------------------------------------
def dropna(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)
