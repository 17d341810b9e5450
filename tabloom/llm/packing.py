"""Packing documents into fixed windows by lexical retrieval.

Every document is tokenised whole and closed with an end id.  Its full windows are sequences of their
own; the rest (shorter than a window) is packed.  Rests are dealt to shards of about ``shard_docs``
documents by a lexical key: three tokens of the rest, drawn by weighted min-hash (weight: idf over all
rests; a token of one rest alone has none), so that rests are alike in a key with the probability of
their weighted likeness and copies lie side by side; shards are equal ranges of the sorted keys, whose
last 16 bits are a salt that splits hot ones.  A shard holds a BM25 inverted index over the token ids of its rests.  A seed's
query (its ``query_terms`` most telling ids) returns its unused neighbours by score, which fill the seed's
window; the one that no longer fits is cut there, and its remainder is the next seed.  So all windows of
a shard are full but the last, which is cut into powers of two, which need no padding.

Null text counts as empty (the end id alone).  Repeated ids or rows are packed each on their own.  Word
chunks between ASCII white space are tokenised once and kept; the tokenizer's own splitting never crosses
white space, so the ids are those of the whole text.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, mix, per_process

WINDOW = 2048
SHARD_DOCS = 1024
QUERY_TERMS = 64
KEY_TOKENS = 3
K1, LENGTH_SHARE = 1.2, 0.75
END_ID = 1
PUNCTUATION = string.punctuation.replace("'", "")  # an apostrophe may begin a contraction


class ChunkIds(dict):
    """Token ids of a white-space chunk as little-endian 32-bit bytes; emptied at ``limit`` chunks (the
    letter runs and punctuation they are made of, at twice as many)."""

    def __init__(self, definition: str, limit: int = 600_000):
        super().__init__()
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok, self.limit, self.parts = Tokenizer.from_str(definition), limit, {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]  # found before the splitting
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")

    def add(self, chunks) -> None:
        """Tokenise chunks not seen before.  A chunk of letters between ASCII punctuation is the ids of its
        three parts (the tokenizer splits there); letter runs are tokenised many at a time, spaces between."""
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > self.limit:
            self.clear()  # the parts stay: chunks are put together again without the tokenizer
            new = list(chunks)
        if len(self.parts) > 2 * self.limit:
            self.parts.clear()
        split, whole = [], []
        for c in new:
            text = c.decode("utf-8", "replace")
            core = text.strip(PUNCTUATION)
            if core.isalpha() and not any(t in text for t in self.special):
                at = text.index(core)
                split.append((c, text[:at], core.lower() if core.isascii() else core, text[at + len(core):]))
            else:
                whole.append((c, text))
        parts = self.parts
        self._letters([w for w in dict.fromkeys(x[2] for x in split) if w not in parts])
        for p in {y for x in split for y in (x[1], x[3])}:
            if p not in parts:
                parts[p] = self._ids(p)
        for c, lead, core, tail in split:
            self[c] = parts[lead] + parts[core] + parts[tail]
        for c, text in whole:
            self[c] = self._ids(text)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> None:
        for at in range(0, len(words), 500):
            some = words[at: at + 500]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.last[ids]) + 1
            if len(stop) == len(some):
                raw, start = ids.tobytes(), 0
                for w, z in zip(some, (4 * stop).tolist()):
                    self.parts[w] = raw[start:z]
                    start = z
            else:  # some letter run is more than one word to the tokenizer
                self.parts.update((w, self._ids(w)) for w in some)


def tokenised(docs: DataFrame, definition: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_tokens, crcs, rest): CRC-32 of every full window and the ids of the rest."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        ids = per_process("packing-" + str(zlib.crc32(shared.value.encode())), lambda: ChunkIds(shared.value))
        for b in batches:
            n, crcs, rest = [], [], []
            for t in b.column(1).to_pylist():
                chunks = t.encode("utf-8", "replace").split() if t else []
                try:
                    buf = b"".join([ids[c] for c in chunks]) + end
                except KeyError:
                    ids.add(set(chunks))
                    buf = b"".join([ids[c] for c in chunks]) + end
                total = len(buf) // 4
                full = total // window
                view = memoryview(buf)
                n.append(total)
                crcs.append([zlib.crc32(view[i * window * 4: (i + 1) * window * 4]) for i in range(full)])
                rest.append(np.frombuffer(buf, "<u4")[full * window:].astype("<u2" if ids.tok.get_vocab_size() <= 1 << 16
                                                                             else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary())],
                names=["doc_id", "doc_tokens", "crcs", "rest"])
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run,
                       "doc_id long, doc_tokens long, crcs array<long>, rest binary")


class Bm25:
    """Inverted index over token ids of the rests of one shard."""

    def __init__(self, rests: list[np.ndarray]):
        self.n = len(rests)
        lens = np.array([len(r) for r in rests])
        doc = np.repeat(np.arange(self.n), lens)
        tok = np.concatenate(rests).astype(np.int64) if self.n else np.zeros(0, np.int64)
        pair, tf = np.unique(tok * max(self.n, 1) + doc, return_counts=True)
        self.tok, self.doc = pair // max(self.n, 1), pair % max(self.n, 1)
        self.terms, self.start = np.unique(self.tok, return_index=True)
        self.stop = np.r_[self.start[1:], len(self.tok)]
        df = self.stop - self.start
        self.idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * lens / max(lens.mean() if self.n else 1, 1e-9))
        self.weight = np.repeat(self.idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])

    def scores(self, ids: np.ndarray, query_terms: int) -> np.ndarray:
        t, tf = np.unique(ids, return_counts=True)
        at = np.searchsorted(self.terms, t)
        gain = self.idf[at] * (1 + np.log(tf))
        at = at[np.lexsort((t, -gain))[:query_terms]]
        s, e = self.start[at], self.stop[at]
        size = e - s
        where = np.repeat(s - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.doc[where], self.weight[where], minlength=self.n)


def pack_shard(rests: list[np.ndarray], window: int = WINDOW, query_terms: int = QUERY_TERMS):
    """Windows of one shard: lists of (document, start in its rest, length), all full but the last."""
    index, n = Bm25(rests), len(rests)
    used = np.array([len(r) == 0 for r in rests], bool)
    windows, carry, nxt = [], None, 0
    while True:
        if carry is not None:
            seed, at = carry
        else:
            while nxt < n and used[nxt]:
                nxt += 1
            if nxt == n:
                break
            seed, at = nxt, 0
            used[seed] = True
        carry = None
        take = min(window, len(rests[seed]) - at)
        pieces, room = [(seed, at, take)], window - take
        if room:
            score = index.scores(rests[seed], query_terms)
            score[used] = -1
            for d in np.lexsort((np.arange(n), -score)):
                if not room or used[d]:
                    break  # the used ones come last
                used[d] = True
                take = min(room, len(rests[d]))
                pieces.append((int(d), 0, take))
                room -= take
                if take < len(rests[d]):
                    carry = (int(d), take)
        windows.append(pieces)
    return windows


def powers_of_two(pieces, total: int):
    """Cut a short window into sequences whose lengths are powers of two."""
    out, pieces = [], [list(p) for p in pieces]
    while total:
        size = 1 << (total.bit_length() - 1)
        seq, need = [], size
        while need:
            d, at, n = pieces[0]
            take = min(n, need)
            seq.append((d, at, take))
            need -= take
            if take == n:
                pieces.pop(0)
            else:
                pieces[0] = [d, at + take, n - take]
        out.append(seq)
        total -= size
    return out


def _rest(r: bytes, total: int, window: int) -> np.ndarray:
    return np.frombuffer(r, "<u2" if len(r) == 2 * (total % window) else "<u4")


def dealt(tok: DataFrame, shards: int, window: int = WINDOW) -> DataFrame:
    """``tok`` with a shard from 0 to ``shards`` - 1 by lexical key."""
    if shards == 1:
        return tok.withColumn("shard", F.lit(0).cast("long"))
    spark = tok.sparkSession

    def frequency(batches):
        df = np.zeros(1 << 16, np.int64)
        for b in batches:
            for n, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u = np.unique(_rest(r, n, window))
                if len(u) and u[-1] >= len(df):
                    df = np.r_[df, np.zeros(int(u[-1]) + 1 - len(df), np.int64)]
                df[u] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["token", "df"])
    # one row per token of the vocabulary
    got = (map_batches(tok.select("doc_tokens", "rest"), frequency, "token long, df long")
           .groupBy("token").agg(F.sum("df").alias("df")).toArrow())
    token, df = got.column("token").to_numpy(), got.column("df").to_numpy()
    idf = np.where(df > 1, np.log((1 + tok.count()) / df), 0)
    # the token with the least of these is drawn with a probability in proportion to its idf
    rank = np.full((KEY_TOKENS, int(token.max(initial=0)) + 1), np.inf)
    for k in range(KEY_TOKENS):
        u = ((mix(token.view(np.uint64) + np.uint64((k + 1) << 40)) >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53
        with np.errstate(divide="ignore"):
            rank[k, token] = -np.log(u) / idf
    shared = spark.sparkContext.broadcast(rank)

    def key(batches):
        rank = shared.value
        for b in batches:
            out = []
            for n, r, salt in zip(b.column("doc_tokens").to_pylist(), b.column("rest").to_pylist(), b.column("salt").to_pylist()):
                x, z = _rest(r, n, window), salt & 0xFFFF
                for k in range(KEY_TOKENS):
                    at = rank[k][x]
                    best = at.argmin() if len(at) else -1
                    drawn = mix(x[best: best + 1].astype(np.uint64))[0] if best >= 0 and at[best] < np.inf else salt >> 16
                    z |= (int(drawn) & 0xFFFF) << (48 - 16 * k)
                out.append(z - (1 << 63))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "key"])
    salted = tok.withColumn("salt", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    from pyspark.sql import types as T
    keyed = map_batches(salted, key, T.StructType([*salted.schema.fields, T.StructField("key", T.LongType())]))
    edges = keyed.agg(F.percentile_approx("key", F.lit([i / shards for i in range(1, shards)]),
                                          F.lit(max(10_000, 20 * shards))).alias("x")).first()["x"]
    edges = spark.sparkContext.broadcast(np.array(edges, np.int64))

    def shard(batches):
        for b in batches:
            at = np.searchsorted(edges.value, b.column(b.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(at, pa.int64())], names=[*b.schema.names[:-2], "shard"])
    return map_batches(keyed, shard, T.StructType([*tok.schema.fields, T.StructField("shard", T.LongType())]))


def pack(docs: DataFrame, definition: str, window: int = WINDOW, shard_docs: int = SHARD_DOCS,
         query_terms: int = QUERY_TERMS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, seed_id."""
    tok = cut(tokenised(docs, definition, window), "rests")
    tok = dealt(tok, max(1, -(-tok.count() // shard_docs)), window)

    def run(t: pa.Table) -> pa.Table:
        base = t.column("shard")[0].as_py() << 32
        ids, total = t.column("doc_id").to_pylist(), t.column("doc_tokens").to_pylist()
        rests = []
        for n, r in zip(total, t.column("rest").to_pylist()):
            rests.append(_rest(r, n, window))
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, total[i]))
        rows, seq = [], 0
        for i, crcs in enumerate(t.column("crcs").to_pylist()):
            for j, c in enumerate(crcs):
                rows.append((ids[i], j * window, window, c, total[i], base + seq, 0, ids[i]))
                seq += 1
        ordered = [rests[i] for i in order]
        for pieces in pack_shard(ordered, window, query_terms):
            size = sum(p[2] for p in pieces)
            for group in [pieces] if size == window else powers_of_two(pieces, size):
                at = 0
                for d, start, n in group:
                    i = order[d]
                    crc = zlib.crc32(ordered[d][start: start + n].astype("<u4").tobytes())
                    rows.append((ids[i], total[i] // window * window + start, n, crc, total[i], base + seq, at,
                                 ids[order[group[0][0]]]))
                    at += n
                seq += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "seed_id"]
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(names, cols)})

    return tok.groupBy("shard").applyInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
             "seed_id long")


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
