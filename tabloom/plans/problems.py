"""Binary-classification problems derived from the driver tables.

Each problem is (train with target, test without target, roles, auxiliary
tables).  The split is a stratified 5-fold assignment: rows of each class are
ordered by ``md5(id)``; fold = (position - 1) % 5 and fold 0 is the test side.
The position comes from the sliced running total, so a class holding half of
all rows is never sorted by a single task.

``SQL`` holds the same definitions as DuckDB common table expressions for the
oracle queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cols import col, md5_order_key
from ..operators.ordering import row_number_in
from ..session import materialize
from ..sources.tables import load

N_FOLDS = 5
USERS_CUTOFF = "2024-01-29 00:00:00"


@dataclass
class Roles:
    id: str | None
    target: str


@dataclass
class Problem:
    name: str
    train: DataFrame
    test: DataFrame
    roles: Roles
    aux: dict[str, DataFrame] = field(default_factory=dict)
    folds: DataFrame | None = None  # every labelled row with its fold number


# The labelled table of a problem (ids, target, folds) is an input every query of the problem
# reads: it is written once under spark.checkpoint.dir, which also cuts the lineage (short
# plans; recovery reads the files instead of recomputing the split).


def stratified_folds(df: DataFrame, id_col: str, target: str, k: int = N_FOLDS,
                     out: str = "fold") -> DataFrame:
    """fold = (row number within class by md5(id) - 1) % k."""
    keyed = df.withColumn("_h", md5_order_key(col(id_col))).withColumn("_hs", F.md5(col(id_col).cast("string")))
    ranked = row_number_in(keyed, [target], ["_h", "_hs"], out="_rn")
    return ranked.withColumn(out, (F.col("_rn") - 1) % k).drop("_h", "_hs", "_rn")


def _folds_table(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The labelled table with folds, written and re-read; built anew for every query, so a changed
    source is seen and every timing holds the whole work."""
    return materialize(build(), f"problem-{name}")


def _split(name, folds: DataFrame, roles: Roles, aux) -> Problem:
    train = folds.where(F.col("fold") != 0).drop("fold")
    test = folds.where(F.col("fold") == 0).drop("fold", roles.target)
    return Problem(name, train, test, roles, aux, folds)


def docs(spark: SparkSession, sf_dir: str) -> Problem:
    """labels (doc_id, quality, toxic) + documents 1:1; target quality."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    folds = _folds_table(spark, sf_dir, "docs", lambda: stratified_folds(labels, "doc_id", "quality"))
    return _split("docs", folds, Roles("doc_id", "quality"), {"documents": documents})


def orders(spark: SparkSession, sf_dir: str) -> Problem:
    """orders; target o_orderpriority = '1-URGENT'; customer N:1, lineitem 1:N, nation N:1."""
    o = load(spark, sf_dir, "orders")
    base = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                    (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("target"))
    folds = _folds_table(spark, sf_dir, "orders", lambda: stratified_folds(base, "o_orderkey", "target"))
    aux = {
        "customer": load(spark, sf_dir, "customer"),
        "lineitem": load(spark, sf_dir, "lineitem"),
        "nation": load(spark, sf_dir, "nation"),
    }
    return _split("orders", folds, Roles("o_orderkey", "target"), aux)


def users(spark: SparkSession, sf_dir: str) -> Problem:
    """distinct events.user_id; target = a purchase at or after the cutoff; history before it."""
    ev = load(spark, sf_dir, "events")
    cutoff = F.lit(USERS_CUTOFF).cast("timestamp")
    base = ev.groupBy("user_id").agg(
        F.max(F.when((F.col("event_type") == "purchase") & (F.col("ts") >= cutoff), 1).otherwise(0))
        .cast("int").alias("target"))
    folds = _folds_table(spark, sf_dir, "users", lambda: stratified_folds(base, "user_id", "target"))
    history = ev.where(F.col("ts") < cutoff)
    return _split("users", folds, Roles("user_id", "target"), {"events": history})


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with target = (l_returnflag = 'R'); a profile problem without an id."""
    li = load(spark, sf_dir, "lineitem")
    return li.withColumn("target", (F.col("l_returnflag") == "R").cast("int"))


# DuckDB text of the same definitions (used by oracle_sql in __spark_entry__).
SQL = {
    "docs": """
docs_folds AS (
  SELECT doc_id, quality, toxic,
         (row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1) % 5 AS fold
  FROM labels),
docs_train AS (SELECT doc_id, quality, toxic FROM docs_folds WHERE fold <> 0),
docs_test AS (SELECT doc_id, toxic FROM docs_folds WHERE fold = 0),
docs_aux AS (SELECT doc_id, lang, source, n_chars FROM documents)""",
    "orders": """
orders_base AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
         CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS target FROM orders),
orders_folds AS (
  SELECT *, (row_number() OVER (PARTITION BY target ORDER BY md5(CAST(o_orderkey AS VARCHAR))) - 1) % 5 AS fold
  FROM orders_base),
orders_train AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, target
                 FROM orders_folds WHERE fold <> 0),
orders_test AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate
                FROM orders_folds WHERE fold = 0)""",
    "users": """
users_base AS (
  SELECT user_id,
         CAST(max(CASE WHEN event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-29 00:00:00' THEN 1 ELSE 0 END)
              AS INTEGER) AS target
  FROM events GROUP BY user_id),
users_folds AS (
  SELECT *, (row_number() OVER (PARTITION BY target ORDER BY md5(CAST(user_id AS VARCHAR))) - 1) % 5 AS fold
  FROM users_base),
users_train AS (SELECT user_id, target FROM users_folds WHERE fold <> 0),
users_test AS (SELECT user_id FROM users_folds WHERE fold = 0),
events_hist AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-29 00:00:00')""",
    "line": """
line AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS target FROM lineitem)""",
}


def with_sql(*names: str) -> str:
    """``WITH`` clause holding the named problem definitions."""
    return "WITH " + ",".join(SQL[n] for n in names)
