"""Helpers shared by the operators of this subpackage: session settings, batch maps, word hashing,
lineage cuts in the shared checkpoint folder and connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, materialize, prepare_session

BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: small Arrow batches (texts may be long), shared folder."""
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # noqa: BLE001 - a Spark version without this setting keeps the row bound
        pass
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write once under the shared checkpoint folder and read back (cuts lineage, survives lost
    executors)."""
    return materialize(df, f"llm-{name}")


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote, once every table made from it is written too."""
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    files = df.inputFiles()
    if not files:
        return
    path = files[0].rsplit("/", 1)[0]
    if "/llm-" not in path or folder.split(":", 1)[-1].lstrip("/") not in path:
        raise ValueError(f"not a written intermediate: {path}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished, no longer referenced plans now rather than
    at the driver's next garbage collection; they count against executor disks."""
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # noqa: BLE001 - sessions without a local driver JVM clean up on their own
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (compared without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(fn, schema)


def likely(rows: DataFrame, wanted: DataFrame, key: str, bits: int = 26) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a long) is not in ``wanted``, so that a join with it shuffles few.

    A bitmap of 2 ** ``bits`` hashed keys (8 MB whatever the input's size, in parts of 2 ** 15) is broadcast; no row with
    a wanted key is lost, and rows that only share a bit stay for the join to drop."""
    columns, (part, bitmap) = rows.columns, fresh(rows, "part", "bitmap")
    spot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    marks = wanted.groupBy(F.shiftright(spot, 15).alias(part)).agg(F.bitmap_construct_agg(spot.bitwiseAND(F.lit((1 << 15) - 1))).alias(bitmap))
    byte = F.substring(bitmap, (F.shiftright(spot, 3).bitwiseAND(F.lit(4095)) + 1).cast("int"), F.lit(1))
    out = rows.withColumn(part, F.shiftright(spot, 15)).join(F.broadcast(marks), part)
    return (out.where(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), spot.bitwiseAND(F.lit(7)).cast("int")) == 1)
            .select(*[F.col(f"`{c}`") for c in columns]))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased (both rules are exactly those
    of bytes.lower and bytes.split)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


class WordHash(dict):
    """64-bit hash of a word, kept for words seen before; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (in place on a copy)."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed: the high ones of small numbers take no room."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, m: int, kind=np.uint64) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    raw = pa.decompress(blob, decompressed_size=m * wide, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(wide, m).T.copy().view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes, m: int) -> np.ndarray:
    return np.cumsum(unpack(blob, m), dtype=np.uint64)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of word hashes ``h``; with fewer words
    the whole sequence is the one shingle; without words there is none."""
    n = len(h)
    if n == 0:
        return h
    k = min(width, n)
    with np.errstate(over="ignore"):
        s = mix(h[: n - k + 1] + np.uint64(k))
        for i in range(1, k):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i: n - k + 1 + i])
    return np.unique(s)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b longs).

    Alternates large-star and small-star steps (each a map-side combined minimum per node and a
    join on the node, which AQE splits when a node is hot) until the edges are stars.
    Every round is written to the shared folder.  Nulls and self links are ignored."""
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "cc")
    for _ in range(max_rounds):
        # settled when every node has one parent and no parent has one: stars
        seen = (e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
                .union(e.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")))
        if seen.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.where("a <> b").distinct()
        # small star: every neighbour not above the node, and the node itself, link to the least one
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = cut(small.select("x.a", "x.b").where("a <> b").distinct(), "cc")
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def per_process(key: str, make):
    """An object kept for the life of the Python worker, across tasks (word caches and the like)."""
    import sys
    store = sys.modules.setdefault("_tabloom_process_store", {})
    if key not in store:
        store[key] = make()
    return store[key]


def share(spark: SparkSession, value):
    """Broadcast of an object whose classes the executors may not be able to import."""
    from pyspark import cloudpickle
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(b):
    import pickle
    return pickle.loads(b.value)
