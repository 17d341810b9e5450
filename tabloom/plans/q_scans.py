"""Queries: sources and sinks S01-S11 (CSV round trips go through the shared checkpoint folder)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as JN
from ..session import scratch_path
from ..sources import files as FS
from ..sources.tables import TABLES, Catalog, load
from . import problems
from ..sources.pairs import read_pair, write_pair
from .q_clean import both_sides
from .registry import query


def _roundtrip(spark, sf, sep: str) -> str:
    """Write the customer table as delimited text into the shared scratch folder."""
    return _write_sep(load(spark, sf, "customer"), scratch_path(spark, "csv"), sep)


def _write_sep(df, path, sep):
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


@query("s01_csv_scan", "SELECT * FROM customer")
def s01(spark, sf):
    schema = load(spark, sf, "customer").schema
    path = _roundtrip(spark, sf, ",")
    return FS.read_csv(spark, path, ",", schema=schema)


@query("s02_delimiter_try_list", "SELECT * FROM customer")
def s02(spark, sf):
    schema = load(spark, sf, "customer").schema
    path = _roundtrip(spark, sf, ";")
    return FS.read_csv(spark, path, FS.detect_separator_try(spark, path), schema=schema)


@query("s03_delimiter_sniff", "SELECT * FROM customer")
def s03(spark, sf):
    schema = load(spark, sf, "customer").schema
    path = _roundtrip(spark, sf, "|")
    return FS.read_csv(spark, path, FS.detect_separator_sniff(spark, path), schema=schema)


CATALOG_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, {{n_{t}}} AS cols, '{{c_{t}}}' AS columns FROM {t}" for t in TABLES)


def _catalog_sql():
    # column lists are schema facts of the given tables
    spec = {
        "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
        "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
        "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
        "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
        "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
        "documents": ["doc_id", "text", "lang", "source", "n_chars"],
        "embeddings": ["vec_id", "embedding", "label"], "pages": ["page_id", "url", "html"],
        "benchmark": ["item_id", "text"], "labels": ["doc_id", "quality", "toxic"],
        "conversations": ["conv_id", "turn", "role", "text"],
    }
    kw = {}
    for t, cs in spec.items():
        kw[f"n_{t}"] = len(cs)
        kw[f"c_{t}"] = ",".join(cs)
    return CATALOG_SQL.format(**kw)


@query("s04_table_catalog", _catalog_sql())
def s04(spark, sf):
    return FS.table_catalog({t: load(spark, sf, t) for t in TABLES})


@query("s05_header_probe")
def s05(spark, sf):
    path = _roundtrip(spark, sf, "|")
    cols = FS.header_columns(spark, path)
    return spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "position int, column string")


@query("s06_drop_index_artefacts", "SELECT * FROM customer")
def s06(spark, sf):
    cust = load(spark, sf, "customer")
    path = _write_sep(cust.select((F.col("c_custkey") - 1).alias("Unnamed: 0"), "*"), scratch_path(spark, "csv"), ",")
    raw = FS.read_csv(spark, path, ",", infer=True)
    clean = FS.drop_index_artefacts(raw)
    return clean.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in cust.schema.fields])


@query("s07_named_registry", """
SELECT c.c_mktsegment, count(*) AS n FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment""")
def s07(spark, sf):
    cat = Catalog.from_dir(spark, sf, ["orders", "customer"])
    cat.register("orders_customer", JN.join(cat.table("orders"), cat.table("customer"), "o_custkey", "c_custkey"))
    return spark.table("orders_customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("s08_peek_rows", """
(SELECT 'head' AS mode, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5)
UNION ALL (SELECT 'tail', o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5)
UNION ALL (SELECT 'sample', o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey
           LIMIT 5)""")
def s08(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    parts = [FS.peek(o, "o_orderkey", 5, m).select(F.lit(m).alias("mode"), "*") for m in ("head", "tail", "sample")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s09_sink_train_test", problems.with_sql("docs") + """
SELECT v.format, t.side, t.doc_id, t.quality, t.toxic
FROM (SELECT 'train' AS side, doc_id, quality, toxic FROM docs_train
      UNION ALL SELECT 'test', doc_id, NULL, toxic FROM docs_test) t, (VALUES ('csv'), ('parquet')) v(format)""")
def s09(spark, sf):
    """Both sides written as one version of a pair, and read back through its manifest."""
    p = problems.docs(spark, sf)
    out = None
    for fmt in ("csv", "parquet"):
        path = scratch_path(spark, f"pair_{fmt}")
        write_pair(p.train, p.test, path, fmt)
        both = both_sides(*read_pair(spark, path)).select(F.lit(fmt).alias("format"), "side", "doc_id", "quality", "toxic")
        out = both if out is None else out.unionByName(both)
    return out


@query("s01_quoted_records", """
SELECT doc_id, md5(text) AS text_md5, 'say ""' || source || '"", ok' AS quoted FROM documents""")
def s01_quoted(spark, sf):
    """Texts with line breaks, separators and quotes, through a delimited file."""
    path = scratch_path(spark, "quoted")
    docs = load(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit('say ""'), "source", F.lit('"", ok')).alias("quoted"))
    (docs.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    back = FS.read_csv(spark, path, schema="doc_id long, text string, quoted string")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "quoted")


@query("s04_folder_catalog", """
SELECT 'customer' AS "table", ';' AS separator, count(*) AS "rows", 5 AS cols, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns,
       CAST(NULL AS VARCHAR) AS error FROM customer
UNION ALL SELECT 'orders', chr(9), count(*), 4, 'o_orderkey,o_custkey,o_orderstatus,o_orderdate', NULL FROM orders
UNION ALL SELECT 'ragged', ',', count(*), 2, 'o_orderkey,o_custkey', 'records with more fields than the header' FROM orders
UNION ALL SELECT 'joined', NULL, count(*), 2, 'o_orderkey,c_name', NULL FROM orders JOIN customer ON o_custkey = c_custkey""")
def s04_folder(spark, sf):
    """A folder of tables in several files each, one of which has records with too many fields."""
    folder = scratch_path(spark, "folder")
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    c.write.option("header", True).option("sep", ";").csv(f"{folder}/customer")
    o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").write.option("header", True).option("sep", "\t").csv(f"{folder}/orders")
    extra = F.when(F.col("o_orderkey") % 7 == 0, F.lit(",1")).otherwise(F.lit(""))
    lines = o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_custkey").cast("string"), extra).alias("value"))
    lines.withColumnRenamed("value", "o_orderkey,o_custkey").write.option("header", True).option("quote", "").option(
        "sep", "|").csv(f"{folder}/ragged")
    joined = JN.join(o, c, "o_custkey", "c_custkey", "inner").select("o_orderkey", "c_name")
    got = FS.folder_catalog(spark, folder, {"joined": joined})
    return got.select("table", "separator", "rows", "cols", "columns", "error")


@query("s10_drop_target", problems.with_sql("docs") + " SELECT doc_id, toxic FROM docs_folds WHERE fold = 0")
def s10(spark, sf):
    f = problems.docs(spark, sf).folds
    return FS.drop_column(f.where(F.col("fold") == 0), "quality").drop("fold")


@query("s11_random_baseline")
def s11(spark, sf):
    return FS.random_baseline(problems.docs(spark, sf).train.select("doc_id"), "doc_id", 5, 42)
