"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct ``width``-word shingles (fewer words: the whole sequence; no words:
the empty set, linked with nothing).  Under every permutation both the least and the greatest value
are kept, so ``perms`` hash evaluations give 2 * perms signature values; each agrees between two sets
with probability equal to their Jaccard similarity.  Bands of ``rows`` values are keys.  With 80
permutations and bands of 5 a pair at similarity 0.8 is missed with probability 3e-6.

Documents with equal sets are one class (the 64-bit digest of the set); only classes meet.  Inside a
key the classes are compared with a pivot, the class that shares keys with the most others (one row per
class, never all pairs); links are confirmed on full sets (100 * intersection >= ``percent`` * union), and
components are formed.  Keys whose classes still lie in several components go through their members in
blocks of at most ``BLOCK``: pairs across components whose signatures agree in at least the threshold
less SLACK standard deviations (a true link fails that with probability 2e-5) are compared on full sets
in the task, and only links that join components are emitted.  Full sets are fetched only for members of such a pair:
unrelated classes that share a key by chance, whose number grows faster than the input, go no further than signatures.  A pair is looked at under the first key it
shares.  No member is left out of a block.

Null text counts as empty.  Rows with a repeated id are classified each by its own text.  Rows without
an id take part through their set; their component is null when no document of it has an id, and such
rows are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, connected_components, cut, likely, map_batches, mix, release, shingle_hashes, words_of

PERMS, ROWS = 80, 5
WIDTH, PERCENT = 5, 80
BLOCK = 1024
SLACK = 4.1


def minmax_signature(s: np.ndarray, mult: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """Least and greatest value of every permutation over the set: (2 * perms,), interleaved."""
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(mult), np.uint64)
    for at in range(0, len(s), 2048):
        x = (s[None, at: at + 2048] ^ flip[:, None]) * mult[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def _family(perms: int):
    rng = np.random.default_rng(20240817)
    return (rng.integers(0, 1 << 63, perms, np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, perms, np.uint64) * np.uint64(2))


def _digest(s: np.ndarray) -> int:
    import xxhash
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def signatures(docs: DataFrame, width: int, perms: int = PERMS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, digest, bands, sig, text_hash): set size, set digest, band keys and one byte of every signature
    value (these three null for empty sets) and a hash of the text."""
    def run(batches):
        mult, flip = _family(perms)
        hashes = WordHash()
        salt = np.arange(2 * perms // rows, dtype=np.uint64)
        for b in batches:
            n, dig, bands, sig = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_hashes(np.array([hashes[w] for w in words_of(t)], np.uint64), width)
                n.append(len(s))
                if not len(s):
                    dig.append(None)
                    bands.append(None)
                    sig.append(None)
                    continue
                v = minmax_signature(s, mult, flip)
                sig.append((v * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(56)).astype(np.uint8).tobytes())
                v = v[: len(salt) * rows].reshape(-1, rows)
                k = mix(salt + np.uint64(1))
                for j in range(rows):
                    k = mix(k * np.uint64(0x9E3779B97F4A7C15) + v[:, j])
                dig.append(_digest(s))
                bands.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(dig, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary()), b.column(2)],
                names=["doc_id", "n", "digest", "bands", "sig", "text_hash"])
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")), run,
                       "doc_id long, n long, digest long, bands array<long>, sig binary, text_hash long")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(digest, s): the full set of every document."""
    def run(batches):
        hashes = WordHash()
        for b in batches:
            dig, sets = [], []
            for t in b.column(0).to_pylist():
                s = shingle_hashes(np.array([hashes[w] for w in words_of(t)], np.uint64), width)
                if len(s):
                    dig.append(_digest(s))
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(dig, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "s"])
    return map_batches(docs.select("text"), run, "digest long, s array<long>")


def _size_ok(percent: int):
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose full sets reach the threshold."""
    j = (pairs.join(sets.select(F.col("digest").alias("a"), F.col("s").alias("sa")), "a")
         .join(sets.select(F.col("digest").alias("b"), F.col("s").alias("sb")), "b"))
    j = j.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return j.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _partners(t: pa.Table, percent: int):
    """Of the members of one cell (key, half, digest, root, n, bands, sig) each with a partner: its place and the
    places of those across components, likeliest first, whose size and signature allow a link.  A pair is looked at
    under the first key it shares."""
    share = percent / 100
    least = share - SLACK * (share * (1 - share) / (2 * PERMS)) ** 0.5
    key = t.column("key")[0].as_py()
    dig, root = t.column("digest").to_numpy(), t.column("root").to_numpy()
    n, half = t.column("n").to_numpy(), t.column("half").to_numpy()
    sig = np.stack([np.frombuffer(x, np.uint8) for x in t.column("sig").to_pylist()])
    bands = np.stack(t.column("bands").to_numpy(zero_copy_only=False))
    cross = half.min() != half.max()  # a cell of two blocks: pairs inside a block belong to another cell
    for i in range(len(dig)):
        y = np.flatnonzero((half[i] < half if cross else dig[i] < dig) & (root != root[i])
                           & (100 * np.minimum(n[i], n) >= percent * np.maximum(n[i], n)))
        if not len(y):
            continue
        agree = (sig[i] == sig[y]).mean(axis=1)
        y, agree = y[agree >= least], agree[agree >= least]
        if not len(y):
            continue
        y = y[np.argsort(-agree, kind="stable")]
        y = y[bands[i][(bands[i] == bands[y]).argmax(axis=1)] == key]
        if len(y):
            yield i, y


def with_partner(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Cells of ``members`` (key, m, digest, root, n, bands, sig; m rows per key): the rows that are in a pair whose full
    sets have to be compared, with their cell (key, c1, c2) and half of it."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    cells = members.withColumn("blocks", blocks).withColumn("blk", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    # a key of more than one block: every pair of blocks is one cell, and a row goes to the cells of its block
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("blk", "other").alias("c1"), F.greatest("blk", "other").alias("c2"),
                         (F.col("blk") > F.col("other")).cast("int").alias("half"), "digest", "root", "n", "bands", "sig")

    def run(t: pa.Table) -> pa.Table:
        found = np.zeros(t.num_rows, bool)
        for i, y in _partners(t, percent):
            found[i] = True
            found[y] = True
        return t.filter(pa.array(found))
    return cells.groupBy("key", "c1", "c2").applyInArrow(run, cells.schema)


def joining_links(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links of ``members`` (as for ``with_partner``) that join components; ``sets`` (digest, s) are the full ones."""
    def run(t: pa.Table) -> pa.Table:
        dig, root = t.column("digest").to_numpy(), t.column("root").to_numpy()
        sets = [np.sort(x) for x in t.column("s").to_numpy(zero_copy_only=False)]
        up = {}

        def top(x):
            while x in up:
                x = up[x]
            return x
        out = []
        for i, y in _partners(t, percent):
            for j in y.tolist():
                a, b = top(root[i]), top(root[j])
                if a == b:
                    continue  # joined by a link found before
                x, z = sets[i], sets[j]
                both = int((z[np.minimum(np.searchsorted(z, x), len(z) - 1)] == x).sum())
                if 100 * both >= percent * (len(x) + len(z) - both):
                    up[a] = b
                    out.append((min(dig[i], dig[j]), max(dig[i], dig[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    cells = cut(with_partner(members, percent, block), "cells")
    return cells.join(sets, "digest").groupBy("key", "c1", "c2").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK,
                    text_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text); with ``text_hash``
    also xxhash64 of its text, which tells rows of one id apart."""
    spark = docs.sparkSession
    sig = cut(signatures(docs, width), "sig")
    classes = sig.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("low"), F.max("n").cast("int").alias("n"), F.first("bands").alias("bands"),
        F.first("sig").alias("sig"))
    classes = cut(classes, "classes")
    keyed = classes.select("digest", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    keyed = cut(keyed.join(shared, "key"), "keyed")  # only keys that two classes share
    # rows are fetched by id, those without one by the digest of their set
    wanted = cut(keyed.select("digest").distinct().join(classes.select("digest", "low"), "digest"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    low = wanted.where("low is not null").select(F.col("low").alias("doc_id")).distinct()
    # an inner join with distinct ids: the optimizer would run a semi join first, which shuffles every text
    sets = full_sets(likely(texts, low, "doc_id").join(low, "doc_id"), width)
    no_id = full_sets(texts.where("doc_id is null"), width).join(wanted.where("low is null"), "digest", "left_semi")
    sets = cut(sets.union(no_id).dropDuplicates(["digest"]), "sets")
    release(spark)
    central = keyed.groupBy("digest").agg(F.sum("m").alias("near"))
    pivot = keyed.join(central, "digest").groupBy("key").agg(
        F.max_by(F.struct("digest", "n"), F.struct("near", "digest")).alias("p"))
    star = (keyed.join(pivot, "key").where("digest <> p.digest")
            .select(F.least("digest", "p.digest").alias("a"), F.greatest("digest", "p.digest").alias("b"),
                    F.col("n").alias("na"), F.col("p.n").alias("nb")).where(_size_ok(percent)).select("a", "b").distinct())
    links = cut(confirmed(star, sets, percent), "links")
    roots = cut(connected_components(links), "roots")
    now = (keyed.where("m > 2").select("key", "m", "digest")
           .join(roots, F.col("digest") == F.col("node"), "left")
           .select("key", "m", "digest", F.coalesce("root", "digest").alias("root")))
    several = now.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    members = now.join(several, "key").join(classes.select("digest", "n", "bands", "sig"), "digest")
    more = cut(joining_links(members, sets, percent, block), "more")
    if not more.isEmpty():
        roots = cut(connected_components(links.union(more)), "roots")
    release(spark)
    more = ["text_hash"] if text_hash else []
    rows = sig.select("doc_id", "n", "digest", *more).join(roots, F.col("digest") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "digest", F.coalesce("root", "digest").alias("root"), *more)
    ids = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(ids, "root", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *more)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
