"""Delimited-file scans and sinks: S01-S06, S08-S11.

Delimiter detection reads only the first lines of a file (a sniff, not a
scan); everything else is a normal distributed read or write.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import col, normalize_missing

# Separators tried, in order, and the sniff budget in characters.
SEPARATORS = [",", ";", "\t", "|"]
SNIFF_CHARS = 4096
QUOTED = re.compile(r'"(?:[^"]|"")*"')
INDEX_ARTEFACT = re.compile(r"^(Unnamed:.*|_c\d+)$")


#: column of records that do not fit the header
CORRUPT = "_corrupt_record"


def _reader(spark: SparkSession, sep: str):
    # quotes inside a quoted field are doubled; a record is judged whole, whatever columns a query reads
    return spark.read.option("header", True).option("sep", sep).option("escape", '"').option("columnPruning", False)


def _unquoted(line):
    """A record without its quoted fields."""
    return F.regexp_replace(line, '"(?:[^"]|"")*"', "")


def spans_lines(spark: SparkSession, path) -> bool:
    """Whether a quoted field holds a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None,
             infer: bool = True, bad_records: str = "error") -> DataFrame:
    """Header row, comma by default, inferred types unless a schema is given; NaN is read as NULL.

    Quoted fields may hold separators, doubled quotes and line breaks (files with such breaks are read whole by one
    task each, others are split).  A record with fewer fields than the header is filled with NULL.  One with more:
    ``error`` fails with their number, ``skip`` leaves them out, ``keep`` adds the record's text as
    ``_corrupt_record``."""
    if bad_records not in ("error", "skip", "keep"):
        raise ValueError(f"unknown treatment of bad records: {bad_records}")
    r = _reader(spark, sep).option("multiLine", spans_lines(spark, path))
    if schema is None:
        schema = r.option("inferSchema", infer).csv(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    df = r.option("columnNameOfCorruptRecord", CORRUPT).schema(wide).csv(path)
    bare = _unquoted(F.col(CORRUPT))
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    # a query may not ask for the record's text alone: the first column is always read with it
    read = F.coalesce(F.length(col(schema[0].name).cast("string")), F.lit(0)) >= 0
    long = F.when(read & (fields > len(schema)), F.col(CORRUPT))
    if bad_records == "keep":
        return normalize_missing(df.withColumn(CORRUPT, long))
    if bad_records == "skip":
        return normalize_missing(df.where(long.isNull()).drop(CORRUPT))
    n, first = df.agg(F.count(long), F.min(long)).first()
    if n:
        raise ValueError(f"{n} records with more than {len(schema)} fields, such as {first[:80]!r}")
    return normalize_missing(r.schema(schema).csv(path))


def _head_lines(spark: SparkSession, path: str, max_lines: int = 50) -> list[str]:
    # the sniff: a bounded prefix of the file, by design
    lines = spark.read.text(path).limit(max_lines).collect()
    out, used = [], 0
    for r in lines:
        if used >= SNIFF_CHARS:
            break
        out.append(r[0])
        used += len(r[0]) + 1
    return out


def detect_separator_try(spark: SparkSession, path: str) -> str:
    """The first separator whose header splits into more than one column; else comma."""
    head = _head_lines(spark, path, 1)
    if not head:
        return ","
    for s in SEPARATORS:
        if head[0].count(s) > 0:
            return s
    return ","


def detect_separator_sniff(spark: SparkSession, path: str) -> str:
    """The separator whose per-line count is constant and > 0 over the sniffed lines
    (most columns wins), quoted fields left out; a single-column file -> comma."""
    lines = [QUOTED.sub("", ln) for ln in _head_lines(spark, path) if ln.strip()]
    best, best_n = ",", 0
    for s in SEPARATORS:
        counts = {ln.count(s) for ln in lines}
        if len(counts) == 1:
            n = counts.pop()
            if n > best_n:
                best, best_n = s, n
    return best


def header_columns(spark: SparkSession, path: str, sep: str | None = None) -> list[str]:
    """Column names from the header only (no type inference)."""
    sep = sep or detect_separator_sniff(spark, path)
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns


def drop_index_artefacts(df: DataFrame) -> DataFrame:
    """Drop pandas 'Unnamed: n' and Spark '_cN' index columns."""
    return df.select(*[col(c) for c in df.columns if not INDEX_ARTEFACT.match(c)])


def table_catalog(tables: dict[str, DataFrame], with_size: bool = False) -> DataFrame:
    """One row per table: table, rows, cols, columns (comma-joined) [, size_kb]."""
    out = None
    for name, df in tables.items():
        aggs = [F.count(F.lit(1)).alias("rows")]
        row = df.agg(*aggs).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("cols"),
                                   F.lit(",".join(df.columns)).alias("columns"))
        if with_size:
            size = (df.select("_metadata.file_path", "_metadata.file_size").distinct()
                    .agg(F.round(F.sum("file_size") / 1024.0, 1).alias("size_kb")))
            from ..operators.joins import one_row_join
            row = one_row_join(row, size)
        out = row if out is None else out.unionByName(row)
    return out


def folder_catalog(spark: SparkSession, folder: str, merged: dict[str, DataFrame] | None = None) -> DataFrame:
    """S04 of a folder: one row per table with its separator, size, rows and columns.  A delimited file is a table;
    a sub-folder is a table whose delimited files each have the header.  A table that cannot be read, or that has
    records with more fields than its header, has an ``error`` as well.  ``merged`` adds entries of tables joined
    in memory.

    One job lists the files and one reads all of them; only files whose quoted fields hold line breaks are read
    again.  What reaches the driver is a row per file."""
    import csv

    def listing(kind, path):
        return spark.read.format(kind).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path)
    files = {p: 0 for p in listing("binaryFile", folder).inputFiles()}  # empty files have a name only
    for r in listing("binaryFile", folder).select("path", "length").collect():
        files[_same(r["path"], files)] = r["length"]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    bare = _unquoted(F.col("value"))
    full = F.trim("value") != ""
    counts = [F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) for s in SEPARATORS]
    lines = listing("text", folder).select("value", F.col("_metadata.file_path").alias("path"),
                                           F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    per = lines.groupBy("path").agg(
        # the first line: the ids of a task's rows ascend, and a file's first block is read by one task
        F.min_by("value", F.when((F.col("block") == 0) & full, F.col("id"))).alias("header"),
        F.count_if(full).alias("lines"), F.max((quotes % 2).cast("int")).alias("broken"),
        *[F.max(F.when(full, c)).alias(f"s{i}") for i, c in enumerate(counts)])
    found = {}
    for r in per.collect():
        header = r["header"] or ""
        head = [len(next(csv.reader([header], delimiter=s), [])) for s in SEPARATORS]
        at = max(range(len(SEPARATORS)), key=lambda i: (head[i], -i))
        sep = SEPARATORS[at] if head[at] > 1 else ","
        columns = next(csv.reader([header], delimiter=sep), [])
        found[r["path"]] = [sep, r["lines"] - 1, columns, (r[f"s{SEPARATORS.index(sep)}"] or 0) + 1 > len(columns) and not r["broken"], r["broken"]]
    tables: dict[str, list] = {}
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    for path in sorted(files):
        parent, name = unquote(path).rsplit("/", 2)[1:]
        name = name if parent == base else parent
        tables.setdefault(name, []).append(path)
    rows = []
    for name, paths in sorted(tables.items()):
        size, error = round(sum(files[p] for p in paths) / 1024.0, 1), None
        got = [found.get(_same(p, found)) for p in paths]
        known = [g for g in got if g]
        if not known:
            rows.append((name, "file", None, size, None, None, None, "empty file"))
            continue
        sep, columns = known[0][0], known[0][2]
        for p, g in zip(paths, got):
            if g and g[4]:  # records over several lines
                df = read_csv(spark, unquote(p), g[0], infer=False, bad_records="keep")
                g[1], bad = df.agg(F.count(F.lit(1)), F.count(CORRUPT), F.count(col(df.columns[0]))).first()[:2]
                g[3] = bad > 0
        if any(g[3] for g in known):
            error = "records with more fields than the header"
        elif any(g[2] != columns for g in known):
            error = "files with different headers"
        rows.append((name, "file", sep, size, sum(g[1] for g in known), len(columns), ",".join(columns), error))
    for name, df in (merged or {}).items():
        rows.append((name, "merged", None, None, df.count(), len(df.columns), ",".join(df.columns), None))
    return spark.createDataFrame(rows, "table string, kind string, separator string, size_kb double, rows long, "
                                       "cols int, columns string, error string")


def _same(path: str, found: dict) -> str | None:
    """The key of a listed file among the read ones: escapes and the scheme's slashes may differ."""
    plain = {unquote(k).split(":", 1)[-1].lstrip("/"): k for k in found}
    return plain.get(unquote(path).split(":", 1)[-1].lstrip("/"))


def peek(df: DataFrame, order_col: str, n: int = 5, mode: str = "head") -> DataFrame:
    """Head / tail by an explicit order column, or a deterministic sample (bottom-n of md5(id)).
    The limit is the operator: n rows, whatever n is; a negative n is an error."""
    if n < 0:
        raise ValueError(f"cannot show {n} rows")
    if mode == "head":
        return df.orderBy(col(order_col).asc()).limit(n)
    if mode == "tail":
        return df.orderBy(col(order_col).desc()).limit(n)
    if mode == "sample":
        return df.orderBy(F.md5(col(order_col).cast("string")), col(order_col)).limit(n)
    raise ValueError(f"unknown peek mode {mode}")


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Header, no index, UTF-8 (csv) or parquet; overwrite."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        w.parquet(path)
    return path


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """E.g. remove the target from a test file."""
    return df.drop(column)


def random_baseline(df: DataFrame, id_col: str, k: int = 5, seed: int = 42, prefix: str = "fb_rand_") -> DataFrame:
    """K standard-normal columns, a pure function of (id, seed, i).

    Box-Muller over two 52-bit uniforms from xxhash64 of the id, so values do
    not depend on partitioning and survive any recomputation unchanged.
    """
    cols = []
    mask = F.lit((1 << 52) - 1)
    for i in range(1, k + 1):
        h1 = F.xxhash64(col(id_col), F.lit(seed), F.lit(i), F.lit(1)).bitwiseAND(mask)
        h2 = F.xxhash64(col(id_col), F.lit(seed), F.lit(i), F.lit(2)).bitwiseAND(mask)
        u1 = (h1.cast("double") + 1.0) / float(1 << 52)
        u2 = h2.cast("double") / float(1 << 52)
        cols.append((F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * 3.141592653589793 * u2)).alias(f"{prefix}{i}"))
    return df.select("*", *cols)
