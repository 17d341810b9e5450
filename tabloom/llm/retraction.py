"""What a chain of filters removes under every order of the filters, counted by an incremental stream.

Five filters judge whole texts (null: empty; words: maximal ``[^\\x20\\x09-\\x0D]+``, case-sensitive); a text fails

* A with fewer than 100 words,
* B when 100 * distinct words < 80 * words,
* C when 100 * ``[A-Z]`` characters > 10 * code points,
* D when it holds one of ``#$%&*|``,
* E when a document with a smaller id has the identical text, removed or not.

The files of the documents are a stream of available-now micro-batches.  A to D are known when a row is read;
E may change with every later file, since a smaller id of the same text can still come.  The state of a text
(keyed by its SHA-256) is its smallest id so far and the masks counted for it.  When a smaller id arrives, the
state retracts the earlier masks from the part counters and counts them again with E set.  The states of some
``BUCKET`` texts lie together; the number of buckets follows the rows of the table.  Each micro-batch
writes its net change of the counters under its batch number, so a repeated batch replaces itself; the sum over
the batches is the answer, and all 120 orders are read off the 32 masks of a part.

Rows whose text came up with a smaller id in the same task fail E for good; they go on without the text's key,
dealt by id, so that of a hot text a task sends only rows with ever smaller ids to its state.

Rows without an id never fail E and set it for nobody.  Rows that repeat an id with one text do not set E for each
other.  An id that is labelled twice has quality or toxic if one of its labels says so.  No rows: no parts.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path
from .common import prepare

LETTERS = "ABCDE"
E_BIT = 16
MICRO_BATCHES = 4
BUCKET = 500  # texts whose states are kept together; a state of its own takes Python some milliseconds
_ODD = re.compile(r"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_DELTA = "part string, mask int, quality int, toxic int, n long"


def mask_of(text: str) -> int:
    """Bits of A to D that a text fails."""
    b = text.encode("utf-8", "replace")
    words = b.split()
    capitals = len(b) - len(b.translate(None, _CAPITALS))
    return ((len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words))
            + 4 * (100 * capitals > 10 * len(text)) + 8 * bool(_ODD.search(text)))


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, part, mask) of rows (doc_id, text, lang).  Key: the text's SHA-256; null when the row's E is
    settled: there is no id, or the task has seen a smaller one of the text."""
    low: dict[bytes, int] = {}
    for b in batches:
        ids, texts, parts = (c.to_pylist() for c in b.columns)
        rows = []
        for i, text, part in zip(ids, texts, parts):
            text = text or ""
            key = hashlib.sha256(text.encode("utf-8", "replace")).digest()
            rows.append([key, i, part or "", mask_of(text)])
            if i is not None and i <= low.get(key, i):
                low[key] = i
        for row in rows:
            if row[1] is None:
                row[0] = None
            elif row[1] > low[row[0]]:
                row[0], row[3] = None, row[3] | E_BIT
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            cols, (pa.binary(), pa.int64(), pa.string(), pa.int32()))], names=["key", "doc_id", "part", "mask"])


def retract(bucket, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by the rows of one bucket of texts.  State, per text: the smallest id, and the number of
    rows by (part, mask, quality, toxic) that are counted as not failing E."""
    changes: dict[tuple, int] = {}
    texts: dict[bytes, tuple[int, dict]] = pickle.loads(state.get[0]) if state.exists else {}
    new = False

    def count(k, n):
        changes[k] = changes.get(k, 0) + n
    for frame in frames:
        for key, i, part, mask, quality, toxic in zip(*(frame[c].tolist() for c in ("key", "doc_id", "part", "mask", "quality", "toxic"))):
            k = (part, mask, quality, toxic)
            if key is None:
                count(k, 1)
                continue
            low, held = texts.get(key, (None, {}))
            if low is not None and i > low:
                count((part, mask | E_BIT, quality, toxic), 1)
                continue
            if low is None or i < low:
                for (p, m, q, t), n in held.items():
                    count((p, m, q, t), -n)
                    count((p, m | E_BIT, q, t), n)
                held = {}
            held[k] = held.get(k, 0) + 1
            texts[key] = (i, held)
            count(k, 1)
            new = True
    if new:
        state.update((pickle.dumps(texts),))
    rows = [(*k, n) for k, n in changes.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "mask", "quality", "toxic", "n"])


def counted_masks(spark: SparkSession, path: str, labels: DataFrame, micro_batches: int = MICRO_BATCHES,
                  files_per_batch: int | None = None) -> DataFrame:
    """(part, mask, quality, toxic, n) of all documents under ``path`` (Parquet files with doc_id, text, lang).

    ``micro_batches``: number of micro-batches that the files are dealt to, unless ``files_per_batch`` is given."""
    path = path.rstrip("/")
    files = len(spark.read.parquet(path).inputFiles())
    per = files_per_batch or max(1, -(-files // micro_batches))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("quality"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    # as a pattern: a file stream takes a plain path for a folder, and the table may be one file
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = (spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per).parquet(pattern)
              .select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
              .mapInArrow(judge, "key binary, doc_id long, part string, mask int"))
    zero = F.lit(0)
    buckets = max(1, -(-spark.read.parquet(path).count() // BUCKET))  # counted from the files' footers
    keyed = (stream.join(marks, "doc_id", "left")
             .select(F.pmod(F.coalesce(F.xxhash64("key"), F.xxhash64("doc_id")), F.lit(buckets)).alias("bucket"), "key",
                     F.coalesce("doc_id", zero).alias("doc_id"), "part", "mask", F.coalesce("quality", zero).alias("quality"),
                     F.coalesce("toxic", zero).alias("toxic")))
    deltas = keyed.groupBy("bucket").applyInPandasWithState(retract, _DELTA, "texts binary", "update", GroupStateTimeout.NoTimeout)
    out = scratch_path(spark, "llm-masks")

    def add(batch: DataFrame, number: int):
        (batch.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"))
         .write.mode("overwrite").parquet(f"{out}/batch={number}"))
    query = (deltas.writeStream.foreachBatch(add).outputMode("update").trigger(availableNow=True)
             .option("checkpointLocation", scratch_path(spark, "llm-stream")).start())
    query.awaitTermination()
    return (spark.read.schema(_DELTA + ", batch long").parquet(f"{out}/*" if files else out)
            .groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")).where("n <> 0"))


def interactions(masks: DataFrame) -> DataFrame:
    """The report over all orders of the filters from (part, mask, quality, toxic, n)."""
    counts = masks.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("bad"))
    steps = [(order, k, 1 << LETTERS.index(letter), sum(1 << LETTERS.index(x) for x in order[: k - 1]))
             for order in map("".join, itertools.permutations(LETTERS)) for k, letter in enumerate(order, 1)]
    plan = masks.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, earlier int")  # 600 rows
    bits = F.explode(F.array(*[F.lit(1 << i) for i in range(len(LETTERS))])).alias("bit")
    rows = counts.select("*", bits).join(F.broadcast(plan), "bit")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    removed = fails & ~gone
    zero = F.lit(0).cast("long")

    def total(flag, value="n"):
        return F.sum(F.when(flag, F.col(value)).otherwise(zero))
    share = F.lit(120) / F.bit_count("mask")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(removed).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(removed, "good").alias("good_lost"),
        total(removed, "bad").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(zero)).alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, micro_batches: int = MICRO_BATCHES,
          files_per_batch: int | None = None) -> DataFrame:
    """One row per part, order of the filters and step."""
    return interactions(counted_masks(prepare(spark), path, labels, micro_batches, files_per_batch))
