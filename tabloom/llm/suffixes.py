"""Removal of long byte strings that an earlier document already holds (suffix ranks by doubling).

A byte goes when a ``length``-byte string (50) that covers it also starts in a document with a smaller id.
Strings are judged on the input; they never cross documents.

Ranks are found in two rounds of growing offsets, as in prefix doubling with names instead of dense
numbers (only equality matters):

1. Rank by ``FIRST`` bytes.  Of the positions of every 50-byte window one is looked at: the one whose
   FIRST-byte string has the least hash (equal windows choose alike, so no match is lost).  Spark
   aggregates (rank, document); ranks found in one document only are unique and leave.
2. Windows whose position kept its rank are ranked by all 50 bytes, past the threshold.  Windows that
   follow each other with one rank travel as one row (rank, document, place, bytes); Spark sorts them by
   (rank, document), and in that order a window is repeated when its 50 bytes came up in a document
   with a smaller id.

Ranks that very many documents share (above the rows / ``HOT_SHARE``, so at most HOT_SHARE of them) skip the
sorted runs: their windows are aggregated to the smallest document (combined map-side) and joined back.
Surviving ranks are kept in a filter of at most ``FILTER_MB`` megabytes for the second scan; its false
positives only add rows.

Null text counts as empty.  Rows without an id neither remove nor lose bytes.  Rows that share an id do not
match each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .bloom import LogFrequencyBloom
from .common import cut, fresh, map_batches, mix, release

LENGTH = 50
FIRST = 18
HOT_SHARE, HOT_FLOOR = 50_000, 5000
FILTER_MB = 64
RUN = 60  # windows in one row at most (their answers are bits of a long)
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def rolling(buf: np.ndarray, length: int) -> np.ndarray:
    """64-bit polynomial hash of every ``length``-byte string of ``buf`` (len(buf) - length + 1 values)."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    parts, h, size = [], _BYTE[buf], 1
    want = length
    while True:
        if want & size:
            parts.append((size, h))
        if size * 2 > want:
            break
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    out, at = None, 0
    for size, h in reversed(parts):
        piece = h[at: at + n]
        out = piece if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + piece
        at += size
    return mix(out)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def window_ranks(texts: list[bytes], length: int, first: int):
    """Of all windows of the texts: (text number, start, rank), in order; texts laid end to end."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    if len(buf) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    m = _least(rolling(buf, first), length - first + 1)
    begin = np.cumsum(lens) - lens
    count = np.maximum(lens - length + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return doc, place, m[begin[doc] + place]


def _pieces(texts: list[bytes]):
    """Consecutive texts of about PIECE bytes."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _bytes_of(col) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in col.to_pylist()]


def _run_starts(doc, rank):
    return np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rank[1:] != rank[:-1])]) if len(doc) else np.zeros(0, np.int64)


def shared_ranks(docs: DataFrame, length: int, first: int) -> DataFrame:
    """(rank, n) of ranks that two documents have."""
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), _bytes_of(b.column(1))
            for lo, hi in _pieces(texts):
                doc, _, rank = window_ranks(texts[lo:hi], length, first)
                s = _run_starts(doc, rank)
                pair = np.unique(np.stack([doc[s].astype(np.uint64), rank[s]]), axis=1) if len(s) > 4096 and \
                    len(s) > len(doc) // 4 else np.stack([doc[s].astype(np.uint64), rank[s]])
                yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64)),
                                                  pa.array(ids[lo + pair[0].astype(np.int64)].astype(np.int64))],
                                                 names=["rank", "doc"])
    got = map_batches(docs.select("doc_id", "text"), run, "rank long, doc long")
    return got.groupBy("rank").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")) \
        .where("lo < hi").select("rank", "n")


def _masked(hashes: np.ndarray, docs: np.ndarray, carry):
    """Repeated flags of windows (hash, document), and the least document by hash; carry: earlier ones."""
    h = np.concatenate([carry[0], hashes])
    d = np.concatenate([carry[1], docs])
    if not len(h):
        return np.zeros(0, bool), h, d
    u, inv = np.unique(h, return_inverse=True)
    low = np.full(len(u), np.iinfo(np.int64).max)
    np.minimum.at(low, inv, d)
    return (d > low[inv])[len(carry[0]):], u, low


def _settle(length: int):
    def run(batches):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        last, carry = None, none
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column(0).to_numpy()
            doc, size = b.column(1).to_numpy(), b.column(4).to_numpy().astype(np.int64)
            ctx = b.column(5).to_pylist()
            buf = np.frombuffer(b"".join(ctx), np.uint8)
            h = rolling(buf, length)
            lens = size + length - 1
            begin = np.cumsum(lens) - lens
            row = np.repeat(np.arange(len(size)), size)
            bit = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wh, wd = h[begin[row] + bit], doc[row]
            if rank[0] != last:
                carry = none
            again, u, low = _masked(wh, wd, carry)
            mask = np.bitwise_or.reduceat(np.where(again, np.int64(1) << bit, 0), np.cumsum(size) - size)
            # what the next batch needs: windows of the last rank
            tail = rank[row] == rank[-1]
            keep = np.unique(wh[tail])
            if rank[0] == rank[-1] == last:
                keep = np.unique(np.concatenate([keep, carry[0]]))
            at = np.searchsorted(u, keep)
            last, carry = rank[-1], (u[at], low[at])
            hit = np.flatnonzero(mask)
            if len(hit):
                idx = pa.array(hit)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).take(idx), b.column(2).take(idx), b.column(3).take(idx), pa.array(mask[hit])],
                    names=["doc", "tag", "place", "mask"])
    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """(doc, tag, place, mask): bit i of mask says that the window at place + i of document ``doc`` (whose
    text has the 32-bit hash ``tag``) also starts in a document with a smaller id."""
    spark = docs.sparkSession
    ranks = cut(shared_ranks(docs, length, first), "ranks")
    release(spark)
    total, count = ranks.agg(F.sum("n"), F.count("*")).first()
    filt = bloom.build(ranks.select("rank", F.lit(1).alias("q")), bloom.shards_for(count or 0, 10, FILTER_MB),
                       lambda k: mix(k.view(np.uint64)))
    hot_at = max(HOT_FLOOR, (total or 0) // HOT_SHARE)
    hot = np.sort(np.array([r["rank"] for r in ranks.where(F.col("n") > hot_at).select("rank").collect()], np.int64))
    release(spark)
    shared = spark.sparkContext.broadcast((filt.bits, filt.shards, hot))

    def run(batches):
        import xxhash
        bits, shards, hot = shared.value
        filt = LogFrequencyBloom(bits, shards)
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), _bytes_of(b.column(1))
            for lo, hi in _pieces(texts):
                doc, place, rank = window_ranks(texts[lo:hi], length, first)
                s = _run_starts(doc, rank)
                if not len(s):
                    continue
                size = np.diff(np.r_[s, len(doc)])
                ok = filt.hit(mix(rank[s]), 1)
                s, size = s[ok], size[ok]
                if not len(s):
                    continue
                # split long runs, and hot ones into single windows
                common = np.isin(rank[s].view(np.int64), hot) if len(hot) else np.zeros(len(s), bool)
                step = np.where(common, 1, RUN)
                parts = -(-size // step)
                off = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * np.repeat(step, parts)
                s2, left = np.repeat(s, parts) + off, np.repeat(size, parts) - off
                n2, c2 = np.minimum(left, np.repeat(step, parts)), np.repeat(common, parts)
                d2, p2, r2 = doc[s2], place[s2], rank[s2].view(np.int64)
                tags = np.array([xxhash.xxh32_intdigest(t) for t in texts[lo:hi]], np.uint32).view(np.int32)
                ctx = [None] * len(s2)
                key = r2.copy()
                for i, (d, p, n, c) in enumerate(zip(d2.tolist(), p2.tolist(), n2.tolist(), c2.tolist())):
                    x = texts[lo + d][p: p + n + length - 1]
                    if c:
                        key[i] = np.uint64(xxhash.xxh64_intdigest(x)).view(np.int64)
                    else:
                        ctx[i] = x
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ids[lo + d2].astype(np.int64)), pa.array(tags[d2]),
                     pa.array(p2.astype(np.int32)), pa.array(n2.astype(np.int32)), pa.array(ctx, pa.binary())],
                    names=["rank", "doc", "tag", "place", "size", "ctx"])
    rows = map_batches(docs.select("doc_id", "text"), run,
                       "rank long, doc long, tag int, place int, size int, ctx binary")
    out = (rows.where("ctx is not null").repartition("rank").sortWithinPartitions("rank", "doc")
           .mapInArrow(_settle(length), "doc long, tag int, place int, mask long"))
    if len(hot):
        single = rows.where("ctx is null").select("rank", "doc", "tag", "place")
        low = single.groupBy("rank").agg(F.min("doc").alias("low"))
        out = out.union(single.join(low, "rank").where("doc > low").select("doc", "tag", "place",
                                                                           F.lit(1).cast("long").alias("mask")))
    return cut(out, "repeats")


def covered(n: int, places, masks, length: int) -> np.ndarray:
    """Byte flags of a text of n bytes from its repeated windows."""
    edge = np.zeros(n + 1, np.int64)
    p = np.asarray(places, np.int64)[:, None] + np.arange(RUN)
    on = ((np.asarray(masks, np.int64)[:, None] >> np.arange(RUN)) & 1).astype(bool)
    starts = np.unique(p[on])
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"):
    """(rows, names): ``docs`` with five more columns (names given): bytes, removed bytes, removed runs,
    SHA-256 of what is left, and what is left as text (a character cut in two is left out)."""
    spark = docs.sparkSession
    names = fresh(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "dd_id", "dd_places", "dd_masks",
                  "dd_tag")
    did, places, masks, tag = names[5:]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = base.where("doc_id is not null").where(F.octet_length("text") >= length)
    found = repeated_windows(named, length)
    release(spark)
    by_doc = found.groupBy("doc", "tag").agg(F.collect_list("place").alias("p"), F.collect_list("mask").alias("m"))
    by_doc = by_doc.groupBy("doc").agg(F.collect_list("tag").alias(tag), F.collect_list("p").alias(places),
                                       F.collect_list("m").alias(masks))
    full = docs.withColumn(did, F.col(id_col).cast("long")).join(by_doc.withColumnRenamed("doc", did), did, "left")
    full = full.select(*[F.col(f"`{c}`") for c in docs.columns], tag, places, masks)
    t_at = docs.columns.index(text_col)
    k = len(docs.columns)

    def run(batches):
        import xxhash
        for b in batches:
            cols = [[], [], [], [], []]
            for text, tags, ps, ms in zip(_bytes_of(b.column(t_at)), *(b.column(k + i).to_pylist() for i in range(3))):
                gone = np.zeros(len(text), bool)
                if tags:
                    mine = int(np.uint32(xxhash.xxh32_intdigest(text)).view(np.int32))
                    if mine in tags:
                        i = tags.index(mine)
                        gone = covered(len(text), ps[i], ms[i], length)
                left = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
                cols[0].append(len(text))
                cols[1].append(int(gone.sum()))
                cols[2].append(int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()))
                cols[3].append(hashlib.sha256(left).hexdigest())
                cols[4].append(left.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:k], *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                names=[*b.schema.names[:k], *names[:5]])
    from pyspark.sql import types as T
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, kinds))])
    return map_batches(full, run, schema), names[:5]


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows, names = cut_repeats(docs.select("doc_id", "text"), length)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *names[:4])


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings cut out of their text (and n_chars counted anew, where there is
    such a column); documents of which nothing is left go."""
    rows, (nb, nr, _, _, kept) = cut_repeats(docs, length)
    rows = rows.where(~((F.col(nr) > 0) & (F.col(kept) == "")))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.when(F.col(nr) > 0, F.col(kept)).otherwise(F.col("text")).alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col(nr) > 0, F.length(kept).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return rows.select(*out)
