"""Removal of word sequences that an earlier place already holds, by recompression.

A word goes when a window of ``length`` words (20) that covers it also starts earlier: in a document with a
smaller id, or in the same document before.  Windows are judged on the input.

Recompression names first every run of equal tokens and then, by a coin of their names, pairs of neighbours;
the named symbols are the tokens of the next round.  A name is a hash of what it stands for, so equal runs and
pairs get one name in every task and no dictionary has to be kept or joined.  Every symbol carries its context:
the words that must be seen to know that it is there.  Two equal windows hold the same symbols wherever the
context lies inside the window, so each window is represented by one such symbol, its anchor (the longest one,
then the one of the least hash), which all its copies choose alike.

The global rounds are aggregations by name:

1. Interior symbols: names found at one place only are unique, and the windows they stand for leave.
2. Long symbols: the consecutive windows of one anchor are one block, named by the anchor and the hashes of its
   windows.  The first place of every block name verifies all others whole, however many they are.
3. Windows: blocks that differ and share an anchor are compared window by window, one copy of each block.

Names, blocks and windows are combined before they are shuffled; a hot one is a row per task, and the joins
back are plain equi-joins, which Spark splits where they are skewed.  Nothing is broadcast or collected.

Null text counts as empty.  Rows without an id neither remove nor lose words.  Rows that share an id count as
one document: the place is (id, word number), and equal places do not remove each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, fresh, map_batches, mix, per_process, release

LENGTH = 20
ROUNDS = 3
PIECE = 1 << 16  # words handled at a time; a longer text is taken in overlapping parts
CHUNK = 1 << 20  # bytes of a text split into words at a time
_RUN, _PAIR, _ROLL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_TOP = np.iinfo(np.uint64).max


def name_runs(a, lo, hi, span, wall, seed):
    """Maximal runs of one name become a symbol; its context reaches over both neighbours."""
    s = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | wall[1:] | wall[:-1]])
    e = np.r_[s[1:], len(a)]
    times = (e - s).astype(np.uint64)
    names, many = a[s], times > 1
    names[many] = mix(names[many] * _RUN + times[many] + np.uint64(seed))
    return names, lo[np.maximum(s - 1, 0)], hi[np.minimum(e, len(a) - 1)], np.add.reduceat(span, s), wall[s]


def name_pairs(a, lo, hi, span, wall, seed):
    """A symbol whose coin says left and its neighbour whose coin says right become one; a left one needs its
    successor to be known, a right one that stays alone its predecessor."""
    left = (mix(a + np.uint64(seed)) & np.uint64(1)).astype(bool) & ~wall
    right = ~left & ~wall
    joined = np.r_[left[:-1] & right[1:], False]
    after = np.minimum(np.arange(len(a)) + 1, len(a) - 1)
    before = np.maximum(np.arange(len(a)) - 1, 0)
    names = a.copy()
    names[joined] = mix(a[joined] * _PAIR + a[after][joined] + np.uint64(seed))
    keep = ~np.r_[False, joined[:-1]]
    return (names[keep], np.where(right, lo[before], lo)[keep], np.where(left, hi[after], hi)[keep],
            np.where(joined, span + span[after], span)[keep], wall[keep])


def parse(words: np.ndarray, wall: np.ndarray, rounds: int = ROUNDS) -> list[tuple]:
    """Symbols of every level: (name, context from, context to, words, wall).  Runs of words are named in the
    first round; later ones name pairs only, so that contexts stay within a window."""
    at = np.arange(len(words))
    level = (words, at, at + 1, np.ones(len(words), np.int64), wall)
    out = [level]
    level = name_runs(*level, 1)
    for r in range(rounds):
        level = name_pairs(*level, r + 2)
        out.append(level)
    return out


def anchors(levels: list[tuple], p: np.ndarray, length: int):
    """(name, symbol number) of the anchor of the windows that start at p (ascending).  The name covers the words of
    the symbol's context, which all windows it stands for hold."""
    n, sums = len(levels[0][0]), _sums(levels[0][0])
    bits = max(20, n.bit_length())
    low, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    best, name, place = np.full(len(p), _TOP), np.zeros(len(p), np.uint64), np.zeros(len(p), np.int64)
    for number, (a, lo, hi, span, _) in reversed(list(enumerate(levels))):
        i = np.r_[0, np.cumsum(np.bincount(lo, minlength=n))][p]  # symbols whose context begins before the window
        j = np.cumsum(np.bincount(hi, minlength=n + 1))[p + length]  # whose context ends in it or before
        some = np.flatnonzero(i < j)
        if not len(some):
            continue
        key = (mix(a) >> np.uint64(8 + bits)) << shift
        key |= (np.uint64(63) - np.minimum(span, 63).astype(np.uint64)) << np.uint64(56)
        key = np.r_[key | np.arange(len(a), dtype=np.uint64), _TOP]
        least = np.minimum.reduceat(key, np.stack([i[some], j[some]], 1).ravel())[::2]
        take = (least >> shift) < (best[some] >> shift)
        at, least = some[take], least[take]
        index = (least & low).astype(np.int64)
        best[at], place[at] = least, index * len(levels) + number
        name[at] = mix(a[index] + _spans(sums, lo[index], hi[index]))
    return name, place


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of every ``length`` words in a row."""
    out = np.zeros(len(words) - length + 1, np.uint64)
    for i in range(length):
        out = out * _ROLL + words[i: len(words) - length + 1 + i]
    return mix(out)


def _powers(n: int):
    """Powers of an odd base and of its inverse, modulo 2**64."""
    store = per_process("recompress-powers", dict)
    if len(store.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", 0x9E3779B97F4A7C1B), ("down", pow(0x9E3779B97F4A7C1B, -1, 1 << 64))):
            store[key] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
    return store["up"], store["down"]


def _spans(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the values from lo to hi (exclusive) from the running sums of value * power, whatever lo is."""
    return mix((sums[hi] - sums[lo]) * _powers(len(sums))[1][lo] + (hi - lo).astype(np.uint64) * _RUN)


def _sums(values: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(values) + 1)
    return np.r_[np.uint64(0), np.cumsum(values * up[: len(values)])]


_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of every word."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    parts, lo = [], 0
    while lo < len(b):
        hi = lo + CHUNK
        while hi < len(b) and _IN_WORD[b[hi]]:
            hi += 1
        edge = np.flatnonzero(np.diff(np.r_[False, _IN_WORD[b[lo:hi]], False].view(np.int8)))
        parts.append(_spans(_sums(_BYTE[b[lo:hi]]), edge[::2], edge[1::2]))
        lo = hi
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _laid(texts, length: int):
    """Parts (row, word offset, hashes) of the texts, gathered to about PIECE words."""
    held, size = [], 0
    for row, text in enumerate(texts):
        h = word_hashes(text)
        for lo in range(0, max(1, len(h) - length + 1), PIECE):
            part = h[lo: lo + PIECE + length - 1]
            if len(part) < length:
                continue
            held.append((row, lo, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def named_windows(texts, length: int, rounds: int):
    """(row, start, anchor name, anchor place, window hash) of all windows, piece by piece."""
    for held in _laid(texts, length):
        gap = np.zeros(1, np.uint64)
        words = np.concatenate([x for _, _, h in held for x in (gap, h)] + [gap])
        sizes = np.array([len(h) for _, _, h in held])
        begin = np.cumsum(sizes + 1) - sizes
        wall = np.zeros(len(words), bool)
        wall[np.r_[begin - 1, len(words) - 1]] = True
        count = sizes - length + 1
        part = np.repeat(np.arange(len(held)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        p = begin[part] + inner
        name, place = anchors(parse(words, wall, rounds), p, length)
        yield (np.array([r for r, _, _ in held])[part], np.array([o for _, o, _ in held])[part] + inner, name, place,
               windows(words, length)[p])


def _runs(row, start, name, place):
    """Starts of the stretches of windows of one anchor."""
    return np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (name[1:] != name[:-1])
                                | (start[1:] != start[:-1] + 1)])


def interior_symbols(rows: DataFrame, length: int, rounds: int) -> DataFrame:
    """(name, row): the anchors of every row; a name that a row has at several places comes twice."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for row, start, name, place, _ in named_windows(b.column(1).to_pylist(), length, rounds):
                s = _runs(row, start, name, place)
                pair, times = np.unique(np.stack([row[s].astype(np.uint64), name[s]]), axis=1, return_counts=True)
                pair = np.repeat(pair, np.minimum(times, 2), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(ids[pair[0].astype(np.int64)])],
                                                 names=["name", "row"])
    return map_batches(rows, run, "name long, row long")


def shared_blocks(rows: DataFrame, length: int, rounds: int) -> DataFrame:
    """(name, content, doc, row, start, wins): stretches of windows whose anchor is in ``names`` of the row."""
    def run(batches):
        for b in batches:
            ids, docs = b.column(0).to_numpy(), b.column(1).to_numpy()
            names = [np.sort(np.array(x, np.int64)) for x in b.column(3).to_pylist()]
            for row, start, name, place, win in named_windows(b.column(2).to_pylist(), length, rounds):
                name = name.view(np.int64)
                edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
                live = np.concatenate([np.isin(name[lo:hi], names[row[lo]]) for lo, hi in zip(edge[:-1], edge[1:])])
                row, start, name, place, win = (x[live] for x in (row, start, name, place, win))
                if not len(row):
                    continue
                s = _runs(row, start, name, place)
                content = mix(np.add.reduceat(mix(win + _RUN), s) + np.diff(np.r_[s, len(win)]).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[s]), pa.array(content.view(np.int64)), pa.array(docs[row[s]]),
                     pa.array(ids[row[s]]), pa.array(start[s].astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.r_[s, len(win)].astype(np.int32)), pa.array(win.view(np.int64)))],
                    names=["name", "content", "doc", "row", "start", "wins"])
    return map_batches(rows, run, "name long, content long, doc long, row long, start int, wins array<long>")


def repeated_windows(docs: DataFrame, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """(doc, row, start, mask): bit i of mask says that the window at word start + i of the row (the hash of id and
    text) also starts earlier.  ``docs``: doc long, text string, no nulls."""
    if not 1 <= length <= 60:
        raise ValueError("windows of 1 to 60 words")
    spark = docs.sparkSession
    rows = docs.where(F.length("text") >= 2 * length - 1).withColumn("row", F.xxhash64("doc", "text"))
    symbols = cut(interior_symbols(rows.select("row", "text"), length, rounds), "symbols")
    shared = symbols.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    names = symbols.join(shared, "name").groupBy("row").agg(F.collect_set("name").alias("names"))
    blocks = cut(shared_blocks(rows.join(names, "row").select("row", "doc", "text", "names"), length, rounds), "blocks")
    discard(symbols)
    release(spark)

    first = cut(blocks.groupBy("name", "content").agg(F.min(F.struct("doc", "start", "wins")).alias("f"))
                .select("name", "content", "f.*"), "first")
    several = first.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    single = (first.join(several, "name")
              .select("name", "content", "doc", "start", F.posexplode("wins").alias("i", "win"))
              .withColumn("at", F.struct("doc", (F.col("start") + F.col("i")).alias("start"))))
    low = single.groupBy("name", "win").agg(F.min("at").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = (single.join(low, ["name", "win"]).where("at > low")
             .groupBy("name", "content").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("again")))
    known = cut(first.select("name", "content", F.struct("doc", "start").alias("first")).join(again, ["name", "content"], "left"),
                "known")
    discard(first)
    release(spark)
    whole = F.expr("shiftleft(1L, size(wins)) - 1")
    mask = F.when(F.struct("doc", "start") > F.col("first"), whole).otherwise(F.coalesce("again", F.lit(0).cast("long")))
    out = cut(blocks.join(known, ["name", "content"]).select("doc", "row", "start", mask.alias("mask")).where("mask <> 0"),
              "repeats")
    discard(blocks)
    discard(known)
    release(spark)
    return out


def covered(n: int, starts, masks, length: int) -> np.ndarray:
    """Flags of the words of a text of n words that its repeated windows cover."""
    bits = np.arange(60)
    on = ((np.asarray(masks, np.int64)[:, None] >> bits) & 1).astype(bool)
    p = np.unique((np.asarray(starts, np.int64)[:, None] + bits)[on])
    edge = np.zeros(n + 1, np.int64)
    edge[p] += 1
    np.subtract.at(edge, p + length, 1)
    return np.cumsum(edge[:-1]) > 0


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                rounds: int = ROUNDS):
    """(rows, names): ``docs`` with four more columns (names given): words, removed words, SHA-256 of the words
    that are left joined by a space, and these words as text."""
    names = fresh(docs, "n_words", "n_removed", "kept_sha256", "kept_text", "rp_id", "rp_row", "rp_starts", "rp_masks")
    rid, rrow, starts, masks = names[4:]
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = repeated_windows(base.where("doc is not null"), length, rounds)
    found = found.groupBy("doc", "row").agg(F.collect_list("start").alias(starts), F.collect_list("mask").alias(masks))
    found = found.withColumnsRenamed({"doc": rid, "row": rrow})
    k, at = len(docs.columns), docs.columns.index(text_col)
    full = docs.withColumn(rid, F.col(f"`{id_col}`").cast("long"))
    full = full.withColumn(rrow, F.xxhash64(rid, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    full = full.join(found, [rid, rrow], "left").select(*[F.col(f"`{c}`") for c in docs.columns], starts, masks)

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for text, ss, ms in zip(*(b.column(i).to_pylist() for i in (at, k, k + 1))):
                words = (text or "").encode("utf-8", "replace").split()
                left = words
                if ss:
                    gone = covered(len(words), ss, ms, length)
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(left)
                for column, x in zip(out, (len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:k], *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string())))],
                names=[*b.schema.names[:k], *names[:4]])
    kinds = (T.LongType(), T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, kinds))])
    return map_batches(full, run, schema), names[:4]


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows, names = cut_repeats(docs.select("doc_id", "text"), length)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *names[:3])


def drop_repeated_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without repeated words; a text that loses words has single spaces, others stay as they are."""
    rows, (_, removed, _, kept) = cut_repeats(docs, length)
    return rows.select(*[F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")).alias("text") if c == "text"
                         else F.col(f"`{c}`") for c in docs.columns])
