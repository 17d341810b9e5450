"""Collocations: phrases of two to four words that occur more often than their parts suggest.

Suffix pointers are sorted by multikey three-way quicksort.  A pointer stands for the words from its place to the
end of its piece, at most ``MAX_WORDS`` of them.  A set of pointers that agree on their first d words is parted by
the next word into less, equal and greater; the weight of an equal part is the count of the phrase of d + 1 words
it agrees on, and only equal parts go one word deeper.  A part with less weight than ``least`` cannot hold a
frequent phrase and is abandoned.

The sort is spread by the leading words.  The first two levels are global: every task sends the distinct words
and then the distinct pairs of frequent words of a block of text with their counts, Spark sums them, and
infrequent ones are abandoned.  What is left are the pointers that begin with a frequent pair whose second word
begins another one; equal ones of a block are combined, and they are routed by their two leading words to the
tasks that sort them from the third word on.  Leading pairs that hold more than a ``HOT_SHARE``-th of all words (at
most HOT_SHARE pairs) are dealt to ``SALTS`` tasks by the rest of the pointer; their parts, and those of a pair that
does not fit in one sort, are partial: none is abandoned, and the last sum by phrase completes them.

Which words and pairs are frequent is known to the tasks from bitmaps of a fixed size (8 and 16 MB); a chance hit
only keeps a pointer longer, counts are exact.  Words are told apart by 64-bit hashes inside a block of text, and
as text everywhere else.

Null text counts as empty, null language as ``und``; rows that are repeated count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, map_batches, mix, release
from .recompress import _BYTE, _spans, _sums

LEAST = 30
TOP = 2000
MAX_WORDS = 4
BLOCK = 4 << 20  # bytes of text counted at a time
SORT = 1 << 20  # pointers sorted at a time
HOT_SHARE, SALTS = 1000, 64
WORD_BITS, PAIR_BITS = 26, 27
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MAP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


class Block:
    """Words of a block of texts: hash (with the language), first word of a piece or not, and their distinct ones."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = b"\n".join([*texts, b""]).translate(_MAP)
        buf = np.frombuffer(raw, np.uint8)
        edge = np.flatnonzero(np.diff(np.r_[False, (buf != 32) & (buf != 10), False].view(np.int8)))
        self.raw, self.start, self.end = raw, edge[::2], edge[1::2]
        line = np.cumsum(buf == 10, dtype=np.int32)[self.start]
        self.first = np.r_[True, line[1:] != line[:-1]] if len(line) else np.zeros(0, bool)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(begin, self.start, "right") - 1
        self.langs = langs
        tongues = sorted(set(langs))
        tags = {t: _hash_all([t.encode("utf-8", "replace")])[0] for t in tongues}
        tag = np.array([tags[t] for t in langs], np.uint64)
        self.hash = mix(_spans(_sums(_BYTE[buf]), self.start, self.end) + tag[self.text] * _STEP)

    def word(self, i: int) -> str:
        return self.raw[self.start[i]: self.end[i]].decode()

    def lang(self, i: int) -> str:
        return self.langs[self.text[i]]

    def pairs(self, words: np.ndarray) -> np.ndarray:
        """Places whose word and successor, in one piece, are marked."""
        return np.flatnonzero(words[:-1] & words[1:] & ~self.first[1:])

    def pair_hash(self, at: np.ndarray) -> np.ndarray:
        return mix(self.hash[at] * _STEP + self.hash[at + 1])


def _hash_all(words: list[bytes]) -> np.ndarray:
    sizes = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(sizes)
    return _spans(_sums(_BYTE[np.frombuffer(b"".join(words), np.uint8)]), end - sizes, end)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    texts, langs, size = [], [], 0
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            texts.append(text.encode("utf-8", "replace"))
            langs.append(lang)
            size += len(texts[-1])
            if size >= BLOCK:
                yield Block(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Block(texts, langs)


def _rows(langs, phrases, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()),
                                       pa.array(np.asarray(counts, np.int64))], names=["lang", "phrase", "n"])


def words_of_blocks(batches):
    """(lang, word, n) of every block."""
    for k in _blocks(batches):
        _, at, n = np.unique(k.hash, return_index=True, return_counts=True)
        at = at.tolist()
        yield _rows([k.lang(i) for i in at], [k.word(i) for i in at], n)


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - int(len(bits) * 8).bit_length() + 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def pairs_of_blocks(words):
    """(lang, pair, n) of every block, of words in the bitmap."""
    def run(batches):
        bits = np.frombuffer(words.value, np.uint8)
        for k in _blocks(batches):
            at = k.pairs(_marked(bits, k.hash))
            _, some, n = np.unique(k.pair_hash(at), return_index=True, return_counts=True)
            at = at[some].tolist()
            yield _rows([k.lang(i) for i in at], [f"{k.word(i)} {k.word(i + 1)}" for i in at], n)
    return run


def pointers_of_blocks(words, pairs):
    """(lang, lead, rest, n): distinct pointers of a block: the leading pair, and the third and fourth word."""
    def run(batches):
        w_bits, p_bits = np.frombuffer(words.value, np.uint8), np.frombuffer(pairs.value, np.uint8)
        for k in _blocks(batches):
            at = k.pairs(_marked(w_bits, k.hash))
            h = k.pair_hash(at)
            good = np.zeros(len(k.hash) + 2, bool)
            known = np.zeros(len(k.hash) + 2, np.uint64)
            ok = _marked(p_bits, h)
            good[at[ok]], known[at[ok]] = True, h[ok]
            at = np.flatnonzero(good[:-2] & good[1:-1])
            four = good[at + 2]
            key = mix(known[at] * _STEP + np.where(four, known[at + 2], k.hash[at + 2]) + four.astype(np.uint64))
            _, some, n = np.unique(key, return_index=True, return_counts=True)
            at, four = at[some].tolist(), four[some].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k.lang(i) for i in at], pa.string()), pa.array([f"{k.word(i)} {k.word(i + 1)}" for i in at], pa.string()),
                 pa.array([f"{k.word(i + 2)} {k.word(i + 3)}" if f else k.word(i + 2) for i, f in zip(at, four)], pa.string()),
                 pa.array(n.astype(np.int64))], names=["lang", "lead", "rest", "n"])
    return run


def equal_parts(keys: np.ndarray, weight: np.ndarray, least: int):
    """Multikey three-way quicksort of the rows of ``keys`` (numbers of words; -1: the pointer has ended), as pointers.

    Yields (a row, depth, weight) of every equal part of at least ``least``."""
    todo = [(np.arange(len(keys)), 0)]
    while todo:
        rows, d = todo.pop()
        if not len(rows) or (least > 1 and weight[rows].sum() < least):
            continue
        if len(rows) <= 32 and least <= 1:  # small sets are counted without parting
            sums: dict[tuple, list] = {}
            for i, key, w in zip(rows.tolist(), keys[rows].tolist(), weight[rows].tolist()):
                for e in range(d, len(key)):
                    if key[e] < 0:
                        break
                    sums.setdefault((e, *key[d: e + 1]), [i, e + 1, 0])[2] += w
            yield from (tuple(x) for x in sums.values())
            continue
        at = keys[rows, d]
        pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
        equal = rows[at == pivot]
        todo.append((rows[at < pivot], d))
        todo.append((rows[at > pivot], d))
        total = int(weight[equal].sum())
        if pivot >= 0 and total >= least:
            yield int(equal[0]), d + 1, total
            if d + 1 < keys.shape[1]:
                todo.append((equal, d + 1))


def _sorted_counts(table: pa.Table, least: int):
    """(lang, phrase, n) of the phrases of three and four words of the pointers of a table."""
    lead = pc.binary_join_element_wise(table["lang"], table["lead"], "\n").combine_chunks().dictionary_encode()
    rest = pc.split_pattern(table["rest"].combine_chunks(), " ")
    size = pc.list_value_length(rest).to_numpy(zero_copy_only=False)
    word = rest.flatten().dictionary_encode()
    keys = np.full((table.num_rows, MAX_WORDS - 1), -1, np.int64)
    keys[:, 0] = lead.indices.to_numpy()
    begin = np.cumsum(size) - size
    number = word.indices.to_numpy()
    keys[:, 1] = number[begin]
    keys[size > 1, 2] = number[begin[size > 1] + 1]
    found = [x for x in equal_parts(keys, table["n"].to_numpy(), least) if x[1] > 1]
    if found:
        row, depth, n = (np.array(c) for c in zip(*found))
        langs, leads = table["lang"].take(row).to_pylist(), table["lead"].take(row).to_pylist()
        rests = table["rest"].take(row).to_pylist()
        yield _rows(langs, [f"{a} {b if d > 2 else b.split(' ')[0]}" for a, b, d in zip(leads, rests, depth.tolist())], n)


def sort_routed(least: int, size: int = SORT):
    """Sorts the pointers of a task, which come in the order of their leading words; a stretch of one lead that is
    longer than a sort, or that is dealt to several tasks (``hot``), is counted in parts."""
    def run(batches):
        held, many = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            many += b.num_rows
            if many < size:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            same = np.asarray(pc.and_(pc.equal(t["lead"], t["lead"][-1]), pc.equal(t["lang"], t["lang"][-1])))
            other = np.flatnonzero(~same)
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                yield from _both(t.slice(0, whole), least)
                held = t.slice(whole).to_batches()
            else:
                yield from _sorted_counts(t, 1)
                # what follows of this lead is partial too
                held = []
                t = t.slice(0, 1)
                last = (t["lang"][0].as_py(), t["lead"][0].as_py())
                broken.add(last)
            many = sum(x.num_rows for x in held)
        if held:
            yield from _both(pa.Table.from_batches(held).combine_chunks(), least)

    broken: set = set()

    def _both(t: pa.Table, least: int):
        part = t["hot"].to_numpy()
        for lang, lead in broken:
            part = part | np.asarray(pc.and_(pc.equal(t["lead"], lead), pc.equal(t["lang"], lang)))
        broken.clear()
        for flag, bound in ((False, least), (True, 1)):
            piece = t.filter(pa.array(part == flag))
            if piece.num_rows:
                yield from _sorted_counts(piece, bound)
    return run


def bitmap(phrases: DataFrame, bits: int) -> bytes:
    """Bitmap of 2**bits slots of the phrases (lang, phrase) of one or two words, as the blocks hash them."""
    def slots(batches):
        for b in batches:
            k = Block([p.encode() for p in b.column(1).to_pylist()], b.column(0).to_pylist())
            at = np.flatnonzero(k.first)
            h = k.hash[at] if len(at) == len(k.hash) else k.pair_hash(at)
            slot = (h >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> 15).astype(np.int32)), pa.array((slot & 32767).astype(np.int32))],
                                             names=["block", "slot"])

    def blocks(batches):
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                on = np.zeros(32768, bool)
                on[x] = True
                out.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["block", "bits"])
    found = map_batches(map_batches(phrases.select("lang", "phrase"), slots, "block int, slot int")
                        .groupBy("block").agg(F.collect_set("slot").alias("slots")), blocks, "block int, bits binary")
    out = bytearray(1 << (bits - 3))
    for row in found.collect():  # 4 KB each, 2**bits / 32768 of them at most
        out[row["block"] << 12: (row["block"] + 1) << 12] = row["bits"]
    return bytes(out)


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang"):
    """(counts, totals): (lang, phrase, words, n) of all phrases of one to four words with n >= least, and
    (lang, n) of all words."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.where(F.length(f"`{text_col}`") > 0).select(
        F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"))

    def summed(rows):
        return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    out = "lang string, phrase string, n long"
    words = cut(summed(map_batches(texts, words_of_blocks, out)), "words")
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    one = words.where(F.col("n") >= least)
    w_bits = sc.broadcast(bitmap(one, WORD_BITS))
    release(spark)
    two = cut(summed(map_batches(texts, pairs_of_blocks(w_bits), out)).where(F.col("n") >= least), "pairs")
    p_bits = sc.broadcast(bitmap(two, PAIR_BITS))
    release(spark)
    every = totals.agg(F.sum("n")).first()[0] or 0
    hot = two.where(F.col("n") > every // HOT_SHARE).select("lang", F.col("phrase").alias("lead"), F.lit(True).alias("hot"))
    pointers = map_batches(texts, pointers_of_blocks(w_bits, p_bits), "lang string, lead string, rest string, n long")
    pointers = pointers.join(F.broadcast(hot), ["lang", "lead"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("rest"), F.lit(SALTS))).otherwise(F.lit(0))
    routed = (pointers.withColumn("salt", salt).repartition("lang", "lead", "salt").sortWithinPartitions("lang", "lead")
              .select("lang", "lead", "rest", "n", "hot"))
    more = cut(summed(map_batches(routed, sort_routed(least), out)).where(F.col("n") >= least), "phrases")
    release(spark)
    counts = cut(one.union(two).union(more).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n"), "counts")
    for x in (words, two, more):
        discard(x)
    return counts, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of every language.

    Score: floor(2000000 * a / (l + r)) at the cut with the lowest one (the first of equals), where a, l and r count
    the phrase and its two parts; phrases that a longer one holds in at least 80 of 100 places are left out."""
    counts, totals = phrase_counts(docs, least, text_col, lang_col)
    word = F.split("phrase", " ")
    many = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), word.alias("w"))
    cuts = many.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w", "words").select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    cuts = (cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
            .join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]))
    score = F.expr("(cast(2000000 as decimal(38, 0)) * a) div (l + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    inner = many.where("words >= 3").select("lang", "a", "w", "words", F.explode(F.expr("sequence(2, words - 1)")).alias("k"))
    inner = inner.select("lang", "a", "w", "k", F.explode(F.expr("sequence(1, words - k + 1)")).alias("i")).select(
        "lang", F.array_join(F.expr("slice(w, i, k)"), " ").alias("phrase"), "a")
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    from pyspark.sql import Window
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (scored.join(held, ["lang", "phrase"], "left").where("held is null or 100 * held < 80 * a")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
