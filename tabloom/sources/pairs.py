"""Train and test tables that are published together or not at all.

Both sides are written under a new version; a manifest (rows, columns and an order-free checksum of each side, taken
from the files) is written last and is the commit.  A reader takes the newest version that has a manifest and checks
both sides against it, so half a pair is never read and a failed write leaves the earlier version in place.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import col

SIDES = ("train", "test")


def checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, sum of the row hashes): the same for any order and partitioning of the rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.sum(F.xxhash64(*[col(c) for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return row["n"], row["h"]


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    r = spark.read.schema(schema)
    if fmt == "csv":
        return (r.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\\N")
                .option("emptyValue", "").option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False)
                .option("ignoreTrailingWhiteSpace", False).csv(path))
    return r.parquet(path)


def write_pair(train: DataFrame, test: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write both tables as a new version of the pair at ``path``; returns the version."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt}")
    spark = train.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    manifest = {"version": version, "format": fmt}
    for side, df in zip(SIDES, (train, test)):
        at = f"{path}/data/{version}/{side}"
        if fmt == "csv":
            (df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "\\N")
             .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at))
        else:
            df.write.parquet(at)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        rows, total = checksum(_read(spark, at, fmt, schema))
        manifest |= {f"{side}_rows": rows, f"{side}_checksum": total, f"{side}_schema": schema.json()}
    text = spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1)
    text.write.text(f"{path}/commits/{version}")  # the commit
    return version


def committed(spark: SparkSession, path: str) -> list[dict]:
    """Manifests of the committed versions, oldest first."""
    try:
        lines = spark.read.text(f"{path}/commits/*").collect()  # one short line per version
    except Exception as e:  # noqa: BLE001 - no version was committed yet
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return sorted((json.loads(r["value"]) for r in lines), key=lambda m: m["version"])


def read_pair(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables of the newest committed version (or the named one), checked against its manifest."""
    found = [m for m in committed(spark, path) if version in (None, m["version"])]
    if not found:
        raise FileNotFoundError(f"no committed pair at {path}")
    m = found[-1]
    out = []
    for side in SIDES:
        df = _read(spark, f"{path}/data/{m['version']}/{side}", m["format"], T.StructType.fromJson(json.loads(m[f"{side}_schema"])))
        if checksum(df) != (m[f"{side}_rows"], m[f"{side}_checksum"]):
            raise ValueError(f"the {side} table of version {m['version']} is not what was committed")
        out.append(df)
    return out[0], out[1]
