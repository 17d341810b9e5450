"""Toxicity scores from the nearest labelled examples.

Terms are words without surrounding punctuation (A-Z lower-cased) and their prefixes of 3 to 7 code
points.  A bounded sample of labelled documents (``examples``, half of it at most toxic, taken in the
order of a hash of the id) gives the vocabulary (every term of the sample) and the example vectors: TF-IDF
with (1 + ln tf) * (1 + ln((1 + N) / (1 + df))), N and df counted over all documents, times a factor of the
term's chi-square against the label (1 where chance does not explain it, at least ``LEAST_FACTOR``), scaled
to length one.  No term of an example is left out.

Neighbours are exact.  The terms that most examples share are a dense matrix, whose products with a batch of
queries are taken at once.  For all other terms examples are laid out in blocks; the inverted index keeps, per
term and block, the postings and their largest weight.  A query's bound for a block is the sum of its weights times these
maxima and the largest dense product; blocks whose bound is below the k-th best dense product are left out.  These scores
are sums of four-byte numbers with a known bound of their error; the cosines of all examples that can be among the k best
within it are taken in full from their own terms (ties: smaller id).
The vote weighs every neighbour by its squared cosine and its class's sampling weight, shrunk to the
base rate; an isotonic fit on leave-one-out votes of the examples makes it a calibrated score.

Documents without a known term (also empty and null texts) get the calibrated base rate.  Labels of
documents whose crc32(id as text) mod 5 is 0 are never read.  Without a labelled document of either class every
score is 0, so that no document is rejected.  Terms are known by 64-bit hashes; the driver holds arrays only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, map_batches

EXAMPLES = 8000
LEAST_FACTOR = 0.1
NEIGHBOURS = 15
BLOCK = 512
STEP = 1 << 16  # postings laid out at a time
SOME = 64  # examples whose cosines are taken at a time
DENSE, DENSE_SHARE, DENSE_ROWS = 1024, 32, 128  # terms at most, in one example of so many, queries at once
SHRINK = 0.3
_EDGE = ".,!?;:%$*&#|()[]{}\"'`<>"
_SIGN = 1 << 63


def _stripped(word: bytes) -> bytes | str:
    """A word without surrounding punctuation: bytes where it is ASCII."""
    return word.strip(_EDGE.encode()) if word.isascii() else word.decode("utf-8", "replace").strip(_EDGE)


def term_hashes(words) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the terms of all words, the place of the word each is of).

    An ASCII prefix and its mark fit eight bytes, which are its hash; those of all words are taken at once."""
    from xxhash import xxh3_64_intdigest
    core = [_stripped(w) for w in words]
    plain = [i for i, w in enumerate(core) if len(w) > 1 and type(w) is bytes]
    odd = [i for i, w in enumerate(core) if len(w) > 1 and type(w) is str]
    whole = [xxh3_64_intdigest(core[i]) for i in plain] + [xxh3_64_intdigest(core[i].encode("utf-8", "replace")) for i in odd]
    out, of = [np.array(whole, np.uint64)], [np.array(plain + odd, np.int64)]
    if plain:
        at = np.array(plain, np.int64)
        size = np.array([len(core[i]) for i in plain], np.int64)
        head = np.array([core[i][:7] for i in plain], "S8").view("<u8")
        for k in range(3, 8):
            m = np.flatnonzero(size > k)
            low = np.uint64((1 << 8 * k) - 1)
            out.append((head[m] & low) | np.uint64(ord("*") << 8 * k))
            of.append(at[m])
    more = []
    for i in odd:
        for k in range(3, min(len(core[i]), 8)):
            t = core[i][:k]
            b = (t + "*").encode("utf-8", "replace")
            h = int.from_bytes(b, "little") if t.isascii() else xxh3_64_intdigest(b)
            more.append((h, i))
    if more:
        out.append(np.array([h for h, _ in more], np.uint64))
        of.append(np.array([i for _, i in more], np.int64))
    return np.concatenate(out).view(np.int64), np.concatenate(of)


def terms_of(word: bytes) -> list[int]:
    """64-bit hashes (signed) of a word's terms."""
    return term_hashes([word])[0].tolist()


class _Numbers(dict):
    """Words numbered as they come; ``new`` holds those whose terms are not looked up yet."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class TermIds:
    """Vocabulary ids (places in the sorted ``vocabulary``) of the terms of texts; those of words seen before are
    kept, as arrays, and emptied between batches when there are ``limit`` words."""

    def __init__(self, vocabulary: np.ndarray, limit: int = 100_000):
        self.vocabulary, self.limit = vocabulary, limit
        self._clear()

    def _clear(self) -> None:
        # the terms of word n are flat[begin[n]: begin[n + 1]]
        self.seen, self.flat, self.begin = _Numbers(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _look_up(self) -> None:
        n = len(self.seen.new)
        h, word = term_hashes(self.seen.new)
        o = np.argsort(h)  # neighbours in the vocabulary one after the other
        at = np.empty(len(h), np.int64)
        at[o] = np.minimum(np.searchsorted(self.vocabulary, h[o]), max(0, len(self.vocabulary) - 1))
        hit = np.flatnonzero(self.vocabulary[at] == h) if len(self.vocabulary) else np.zeros(0, np.int64)
        hit = hit[np.argsort(word[hit], kind="stable")]
        self.flat = np.concatenate([self.flat, at[hit].astype(np.int32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(np.bincount(word[hit], minlength=n))])
        self.seen.new.clear()

    def counts(self, texts) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, how often each occurs) of every text, the terms ascending."""
        if len(self.seen) >= self.limit:
            self._clear()
        number = self.seen.__getitem__
        words = [np.array([number(w) for w in x.encode("utf-8", "replace").lower().split()] if x else (), np.int64) for x in texts]
        if self.seen.new:
            self._look_up()
        out = []
        for w in words:
            begin = self.begin[w]
            term = np.sort(self.flat[_ranges(begin, self.begin[w + 1] - begin)])
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            out.append((term[first], np.diff(np.r_[first, len(term)])))
        return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in two bytes each where they fit."""
    return x.astype(np.uint16) if x.dtype.kind in "iu" and (not len(x) or x.max() < 1 << 16) else x


def _rounded_up(x: np.ndarray) -> np.ndarray:
    """In four bytes each and not below x: a bound stays one."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


_LAID_OUT = {"slot", "dense", "at", "weight", "posting", "seg_start", "seg_block", "seg_top", "term_start", "scratch", "asked"}


class Index:
    """Block-max inverted index over the example vectors."""

    def __init__(self, vectors, ids: np.ndarray, toxic: np.ndarray, n_terms: int, idf: np.ndarray | None = None):
        """``vectors``: a list of {term: weight}, or with ``idf`` the (terms, counts, terms of each example) end to end.

        Kept and sent to tasks are the counts by example; weights, postings, blocks and the dense matrix are laid out
        where the first query is answered."""
        if isinstance(vectors, list):
            sizes = np.array([len(v) for v in vectors], np.int64)
            term = np.array([t for v in vectors for t in v], np.int32)
            count = weight = np.array([w for v in vectors for w in v.values()], float)
        else:
            term, count, sizes = vectors
            weight = (1 + np.log(count)) * idf[term]
        self.idf, self.n, self.blocks, self.n_terms = idf, len(sizes), -(-max(1, len(sizes)) // BLOCK), n_terms
        full = np.flatnonzero(sizes)
        begin = np.cumsum(sizes) - sizes
        norm, key = np.ones(self.n), np.full(self.n, n_terms, np.int64)
        self.longest = 1.0
        if len(full):
            norm[full] = np.sqrt(np.add.reduceat(weight * weight, begin[full]))
            if idf is None:
                self.longest = float(norm.max())
            # like examples side by side: order by the heaviest term, so that block maxima are tight
            top = np.repeat(np.maximum.reduceat(weight, begin[full]), sizes[full])
            key[full] = np.minimum.reduceat(np.where(weight == top, term, n_terms), begin[full])
            del top
        del weight
        order = np.lexsort((ids, key))
        self.ids, self.toxic = ids[order], toxic[order]
        self.place = {i: at for at, i in enumerate(self.ids.tolist())}
        self.norm = norm[order] if idf is not None else None
        p = _ranges(begin[order], sizes[order])
        self.term, self.counts = term.astype(np.int32)[p], _narrow(count[p])
        del p
        self.begin = np.r_[0, np.cumsum(sizes[order])]
        # the first of the examples with the same vector
        self.first, seen = np.empty(self.n, np.int32), {}
        for i, (lo, hi) in enumerate(zip(self.begin[:-1].tolist(), self.begin[1:].tolist())):
            self.first[i] = seen.setdefault((self.term[lo:hi].tobytes(), self.counts[lo:hi].tobytes()), i)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in _LAID_OUT}

    def __getattr__(self, name):
        if name not in _LAID_OUT:
            raise AttributeError(name)
        self._lay_out()
        return self.__dict__[name]

    def _weights(self, place, term, example) -> np.ndarray:
        w = self.counts[place]
        return w if self.norm is None else (1 + np.log(w.astype(float))) * self.idf[term] / self.norm[example]

    def _lay_out(self) -> None:
        """Dense matrix of the common terms, postings and segments (the postings of one term in one block) of the
        others; some hundred thousand postings at a time, so that nothing of full length is made on the way.  Weights
        are in four bytes: products find candidates, whose cosines are then taken in full."""
        df = np.zeros(self.n_terms, np.int64)
        for lo in range(0, len(self.term), 4 * STEP):
            df += np.bincount(self.term[lo: lo + 4 * STEP], minlength=self.n_terms)
        often = np.argsort(-df, kind="stable")[:DENSE]
        often = often[df[often] * DENSE_SHARE > self.n]
        self.slot = np.full(self.n_terms, -1, np.int32)
        self.slot[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), np.float32)
        df[often] = 0
        self.posting, rare = np.r_[0, np.cumsum(df)].astype(np.int32), int(df.sum())
        self.at, self.weight = np.empty(rare, np.uint16 if self.n <= 1 << 16 else np.int32), np.empty(rare, np.float32)
        fill = self.posting[:-1].copy()
        for lo in range(0, len(self.term), STEP):
            term = self.term[lo: lo + STEP]
            place = np.arange(lo, lo + len(term))
            example = np.searchsorted(self.begin, place, "right") - 1
            w = self._weights(place, term, example)
            slot = self.slot[term]
            m = slot >= 0
            self.dense[slot[m], example[m]] = w[m]
            m = np.flatnonzero(~m)
            if not len(m):
                continue
            key = np.sort(term[m].astype(np.int64) << 32 | np.arange(len(m)))
            term, m = key >> 32, m[key & 0xFFFFFFFF]
            start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            size = np.diff(np.r_[start, len(term)])
            to = fill[term] + np.arange(len(term)) - np.repeat(start, size)
            self.at[to], self.weight[to] = example[m], w[m]
            fill[term[start]] += size.astype(np.int32)
        segs = []
        cuts = np.unique(np.r_[np.searchsorted(self.posting, np.arange(0, rare, STEP)), self.n_terms])
        for lo, hi in zip(np.r_[0, cuts[:-1]].tolist(), cuts.tolist()):
            part = slice(self.posting[lo], self.posting[hi])
            if part.start == part.stop:
                continue
            term = np.repeat(np.arange(lo, hi), df[lo:hi])
            cell = term * self.blocks + self.at[part] // BLOCK
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            segs.append(((start + part.start).astype(np.int32), _narrow(cell[start] % self.blocks),
                         _rounded_up(np.maximum.reduceat(self.weight[part], start)), term[start].astype(np.int32)))
        segs = [np.concatenate(x) for x in zip(*segs)] if segs else [np.zeros(0, np.int32)] * 2 + [np.zeros(0, np.float32), np.zeros(0, np.int32)]
        self.seg_start, self.seg_block, self.seg_top, of = segs
        self.seg_start = np.append(self.seg_start, np.int32(rare))  # a segment ends where the next one starts
        self.term_start = np.searchsorted(of, np.arange(self.n_terms + 1)).astype(np.int32)
        self.scratch, self.asked = np.zeros(self.n_terms), np.zeros(self.n_terms, bool)

    def _add(self, acc: np.ndarray, start: np.ndarray, stop: np.ndarray, weight: np.ndarray) -> None:
        """Add the products of the postings from ``start`` to ``stop``."""
        if not len(start):
            return
        size = (stop - start).astype(np.int64)
        p = _ranges(start, size)
        acc += np.bincount(self.at[p], np.repeat(weight, size) * self.weight[p], minlength=self.n)

    def products(self, queries) -> np.ndarray:
        """Products of the dense terms, a row per query (terms, weights), in four bytes."""
        m = np.zeros((len(queries), len(self.dense)), np.float32)
        for row, (t, w) in zip(m, queries):
            slot = self.slot[t]
            row[slot[slot >= 0]] = w[slot >= 0]
        return m @ self.dense

    def cosines(self, terms, weight, examples: np.ndarray) -> np.ndarray:
        """Products with the vectors of the examples, over all terms and in full."""
        one, which = np.unique(self.first[examples], return_inverse=True)
        out = np.zeros(len(one))
        self.asked[terms], self.scratch[terms] = True, weight
        for lo in range(0, len(one), SOME):  # near copies of a query may be thousands
            some = one[lo: lo + SOME]
            ends = list(zip(self.begin[some].tolist(), self.begin[some + 1].tolist()))
            term = np.concatenate([self.term[a:z] for a, z in ends])
            hit = np.flatnonzero(self.asked[term])
            term = term[hit]
            off = np.cumsum([0] + [z - a for a, z in ends])
            row = np.searchsorted(off, hit, "right") - 1
            w = self._weights(self.begin[some][row] + hit - off[row], term, some[row])
            out[lo: lo + SOME] = np.bincount(row, self.scratch[term] * w, minlength=len(some))
        self.asked[terms] = False
        # equal examples are equal whatever the order of the sums
        return np.round(out, 12)[which]

    def nearest(self, q, k: int, without: int | None = None, acc: np.ndarray | None = None):
        """(positions, cosines) of the k best examples with a positive cosine, best first.

        The k-th product of the dense terms is a first bound of the k-th cosine; only blocks whose bound reaches it are
        scored.  Scores are off by ``slack`` at most (they are sums of four-byte numbers), so that no example outside
        twice that below the k-th score can be one of the k best; the others' cosines are taken in full.  ``acc``: the
        query's ``products``."""
        terms, weight = (np.array(list(q), np.int64), np.array(list(q.values()))) if isinstance(q, dict) else q
        acc = (self.products([(terms, weight)])[0] if acc is None else acc).astype(float)
        slack = (len(self.dense) + 64) * 2.0 ** -24 * math.sqrt(float((weight * weight).sum())) * self.longest
        rare = np.flatnonzero(self.posting[terms + 1] > self.posting[terms])
        own, own_weight = terms[rare], weight[rare]
        live = np.ones(self.blocks, bool)
        if self.n > k and self.blocks > 1:
            if without is not None:
                acc[without] = 0
            least = np.partition(acc, -k)[-k]
            size = self.term_start[own + 1] - self.term_start[own]
            seg = _ranges(self.term_start[own], size)
            bound = np.bincount(self.seg_block[seg], np.repeat(own_weight, size) * self.seg_top[seg], minlength=self.blocks)
            live = bound + np.maximum.reduceat(acc, np.arange(0, self.n, BLOCK)) + 2 * slack >= least
        if live.all():
            self._add(acc, self.posting[own], self.posting[own + 1], own_weight)
        else:
            m = live[self.seg_block[seg]]
            seg = seg[m]
            self._add(acc, self.seg_start[seg], self.seg_start[seg + 1], np.repeat(own_weight, size)[m])
        if without is not None:
            acc[without] = 0
        kth = np.partition(acc, -k)[-k] if self.n > k else 0.0
        at = np.flatnonzero((acc > 0) & (acc >= kth - 2 * slack))
        sim = self.cosines(terms, weight, at)
        at, sim = at[sim > 0], sim[sim > 0]
        best = np.lexsort((self.ids[at], -sim))[:k]
        return at[best].tolist(), sim[best].tolist()


class Model:
    def __init__(self, vocabulary, idf, index, rate, weight, steps=None):
        self.vocabulary, self.idf, self.index, self.rate, self.weight = vocabulary, idf, index, rate, weight
        self.steps = steps  # isotonic fit: (votes, scores)
        self.sent = None

    def send(self, spark):
        """Broadcast of the model without its isotonic fit, made once.  Plain arrays, which tasks use as they come: neither
        executors nor the driver hold a pickled copy beside them."""
        if self.sent is None:
            index = self.index.__getstate__() if self.index else None
            self.sent = spark.sparkContext.broadcast((self.vocabulary, self.idf, index, self.rate, self.weight))
        return self.sent

    @staticmethod
    def received(value, steps=None) -> Model:
        vocabulary, idf, state, rate, weight = value
        index = None
        if state is not None:
            index = Index.__new__(Index)
            index.__dict__.update(state)
        return Model(vocabulary, idf, index, rate, weight, steps)

    def vector(self, terms, counts):
        """(terms, weights) of length one."""
        t = np.array(terms, np.int64)
        v = (1 + np.log(np.array(counts, float))) * self.idf[t]
        return t, v / math.sqrt((v * v).sum()) if len(t) else v

    def votes(self, queries, without=None):
        out = []
        for lo in range(0, len(queries), DENSE_ROWS):
            some = queries[lo: lo + DENSE_ROWS]
            acc = self.index.products(some) if self.index else some
            out += [self.vote(q, without[lo + i] if without else None, a) for i, (q, a) in enumerate(zip(some, acc))]
        return out

    def vote(self, q, without: int | None = None, acc=None):
        if self.index is None or not len(q[0]):
            return self.rate, [], []
        at, sim = self.index.nearest(q, NEIGHBOURS, without, acc)
        y = self.index.toxic[at]
        w = np.square(sim) * np.where(y > 0, self.weight[1], self.weight[0])
        return float(((w * y).sum() + SHRINK * self.rate) / (w.sum() + SHRINK)), at, sim

    def score(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps)) if self.steps else vote


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Weighted non-decreasing fit of y on x: (knots, values)."""
    order = np.argsort(x, kind="stable")
    ux, start = np.unique(x[order], return_index=True)
    sw = np.add.reduceat(w[order], start)
    sy = np.add.reduceat((w * y)[order], start) / sw
    stack = []
    for a, v, m in zip(ux, sy, sw):
        stack.append([v, m, a, a])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            v2, m2, _, hi = stack.pop()
            v1, m1, lo, _ = stack.pop()
            stack.append([(v1 * m1 + v2 * m2) / (m1 + m2), m1 + m2, lo, hi])
    return np.array([e for s in stack for e in s[2:]]), np.array([v for s in stack for v in (s[0], s[0])])


def no_model() -> Model:
    """Without an example of either class nothing can be told apart: every score is 0 and no document is rejected."""
    return Model(np.zeros(0, np.int64), np.zeros(0), None, 0.0, (1.0, 1.0))


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, mod: int = 5, held: int = 0) -> Model:
    """Model from ``labels`` (doc_id, toxic) of documents outside the held-out remainder."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where("doc_id is not null and toxic is not null")
           .where(F.crc32(F.col("doc_id").cast("string")) % mod != held)
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    size = dict(lab.groupBy("toxic").count().toPandas().itertuples(index=False, name=None))
    n1, n0 = int(size.get(1, 0)), int(size.get(0, 0))
    if not n1 or not n0:
        return no_model()
    take1 = min(n1, examples // 2)
    take0 = min(n0, examples - take1)
    picked = spark.createDataFrame(
        [(int(r["doc_id"]), int(r["toxic"])) for flag, take in ((1, take1), (0, take0)) for r in
         lab.where(F.col("toxic") == flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take).collect()],
        "doc_id long, toxic int")
    ex = cut(docs.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]), "examples")
    rows = {r["toxic"]: r["n"] for r in ex.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    m1, m0 = rows.get(1, 0), rows.get(0, 0)
    if not m1 or not m0:
        return no_model()

    def by_term(batches):
        for b in batches:
            got = {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = list(set((text or "").encode("utf-8", "replace").lower().split()))
                for t in np.unique(term_hashes(words)[0]).tolist():
                    got.setdefault(t, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(got), pa.int64()), *(pa.array([v[i] for v in got.values()], pa.int64()) for i in (0, 1))],
                names=["term", "c0", "c1"])
    t = (map_batches(ex.select("text", "toxic"), by_term, "term long, c0 long, c1 long").groupBy("term")
         .agg(F.sum("c0").cast("double").alias("b"), F.sum("c1").cast("double").alias("a")))
    total = float(m0 + m1)
    e = F.col("a") * (m0 - F.col("b")) - F.col("b") * (m1 - F.col("a"))
    chi = total * e * e / ((F.col("a") + F.col("b")) * (total - F.col("a") - F.col("b")) * m0 * m1)
    t = cut(t.withColumn("chi", F.when((F.col("a") + F.col("b") >= 4) & (F.col("a") + F.col("b") < total), chi)), "terms")
    # so high that hardly any of so many terms gets there by chance
    least = 2 * math.log(1 + t.where("chi is not null").count())
    t = t.orderBy("term").select("term", F.coalesce(F.greatest(F.lit(LEAST_FACTOR), F.least(F.lit(1.0), F.col("chi") / least)),
                                                    F.lit(LEAST_FACTOR)).alias("factor")).toArrow()
    voc, factor = t.column("term").to_numpy(), t.column("factor").to_numpy()
    shared = spark.sparkContext.broadcast(voc)

    def vectors(batches):
        ids = TermIds(shared.value)
        for b in batches:
            got = ids.counts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *(pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (0, 1))],
                names=["doc_id", "toxic", "t", "n"])

    def frequency(batches):
        ids = TermIds(shared.value)
        df, n = np.zeros(len(ids.vocabulary), np.int64), 0
        for b in batches:
            n += b.num_rows
            for t, _ in ids.counts(b.column(0).to_pylist()):
                df[t] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], names=["pos", "df"])
    got = map_batches(docs.select("text"), frequency, "pos long, df long").groupBy("pos").agg(F.sum("df").alias("df")).toArrow()
    pos, found = got.column("pos").to_numpy(), got.column("df").to_numpy()
    n_docs, df = int(found[pos < 0].sum()), np.zeros(len(voc))
    df[pos[pos >= 0]] = found[pos >= 0]
    idf = (1 + np.log((1 + n_docs) / (1 + df))) * factor
    sample = map_batches(ex.select("doc_id", "text", "toxic"), vectors,
                         "doc_id long, toxic int, t array<int>, n array<int>")
    got = sample.toArrow()
    rate = n1 / (n1 + n0)
    weight = ((n0 / m0), (n1 / m1))
    scale = sum(weight) / 2
    model = Model(voc, idf, None, rate, (weight[0] / scale, weight[1] / scale))
    ids, y = got.column("doc_id").to_numpy(), got.column("toxic").to_numpy()
    sizes = pc.list_value_length(got.column("t")).to_numpy().astype(np.int64)
    term, n = (np.concatenate([c.flatten().to_numpy() for c in got.column(x).chunks]) for x in ("t", "n"))
    del got, t
    model.index = Index((term, n, sizes), ids, y, len(voc), idf)
    del term, n
    sent = model.send(spark)

    def left_out(batches):
        m = Model.received(sent.value)
        for b in batches:
            queries = [m.vector(a, n) for a, n in zip(*(b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)))]
            votes = [v[0] for v in m.votes(queries, [m.index.place[i] for i in b.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(votes, pa.float64())], names=["toxic", "vote"])
    got = map_batches(sample, left_out, "toxic int, vote double").toArrow()
    votes, y = got.column("vote").to_numpy(), got.column("toxic").to_numpy()
    model.steps = isotonic(votes, y.astype(float), np.where(y > 0, weight[1], weight[0]))
    return model


def with_scores(docs: DataFrame, model: Model, names: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``docs`` with four more columns: score, predicted, neighbour ids and their cosines."""
    sent, steps = model.send(docs.sparkSession), model.steps
    at = docs.columns.index(text_col)

    def run(batches):
        import xxhash
        m = Model.received(sent.value, steps)
        ids, known = TermIds(m.vocabulary), {}
        for b in batches:
            texts = b.column(at).to_pylist()
            keys = [xxhash.xxh3_128_digest((x or "").encode("utf-8", "replace")) for x in texts]
            if len(known) > 16_384:
                known.clear()
            new = {k: x for k, x in zip(keys, texts) if k not in known}
            votes = m.votes([m.vector(t, n) for t, n in ids.counts(new.values())])
            for key, (vote, near, sim) in zip(new, votes):  # kept as bytes: lists of numbers take four times as much
                near = m.index.ids[near] if near else np.zeros(0, np.int64)
                known[key] = (m.score(vote), near.astype(np.int64).tobytes(), np.array([round(x, 6) for x in sim], float).tobytes())
            got = [known[k] for k in keys]
            off = pa.array(np.r_[0, np.cumsum([len(g[1]) // 8 for g in got])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(np.frombuffer(b"".join([g[i] for g in got]), kind)))
                     for i, kind in ((1, np.int64), (2, np.float64))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([g[0] for g in got], pa.float64()),
                 pa.array([int(g[0] >= 0.5) for g in got], pa.int32()), *lists],
                names=[*b.schema.names, *names])
    from pyspark.sql import types as T
    kinds = (T.DoubleType(), T.IntegerType(), T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType()))
    return map_batches(docs, run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))]))


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """Score, prediction and evidence of every document."""
    model = train(docs, labels, mod=mod, held=held)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == held, F.lit(False)).alias("held_out"), "text")
    return with_scores(base, model, ("score", "predicted", "neighbours", "cosines")).drop("text")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, columns unchanged."""
    names = fresh(docs, "tox_score", "tox_predicted", "tox_neighbours", "tox_cosines")
    scored = with_scores(docs, train(docs, labels), tuple(names))
    return scored.where(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
