"""Sampled segmentations of a text over a SentencePiece vocabulary, without replacement.

A text's lattice has an edge for every vocabulary piece (weight -alpha * ln(1 + rank)) and, where a
character has no piece, one byte-fallback edge.  A segmentation's probability is the product of its
edges' weights over the sum for all segmentations; backward sums make edges conditional probabilities, so
partial segmentations have exact bounds.  Pieces never cross the start of a word mark, so the lattice is
a chain of chunk lattices.

Gumbel top-k: the root gets a Gumbel value; the first sample is drawn along the lattice, and at every chunk
the set of all other choices there is one open node whose value is a Gumbel truncated at its parent's.
The open node with the greatest value is expanded next (A* with exact bounds): its best leaf is drawn
among the segmentations not yet emitted, and it splits into the nodes beside the new path.  The values of
the samples descend, and the k-th largest value still open is the threshold of the inclusion scores
1 - exp(-exp(log p - threshold)) (the threshold is minus infinity, the score 1, when nothing is left).

Random numbers come from a hash of (seed, row key, chunk, step), so a row's samples do not depend on
partitioning.  Null and empty texts have one segmentation, the empty one.  Rows with equal keys and texts
get equal samples.  Texts with fewer than k segmentations return all of them.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix, per_process

MARK = "▁"
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
ALPHA = 1.0
SAMPLES = 2
PART_BYTES = 3 << 19
_STEP, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HASH = 0xA0761D6478BD642F


class Vocabulary:
    """Pieces, their weights and a hash lookup of substrings."""

    def __init__(self, proto: bytes, alpha: float):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.sp.get_piece_size()
        self.byte = [0] * 256
        text, weight = {}, {}
        for i in range(n):
            if self.sp.is_byte(i):
                self.byte[int(self.sp.id_to_piece(i)[3:5], 16)] = i
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)):
                text[self.sp.id_to_piece(i)] = i
        first = min(text.values(), default=0)
        for p, i in text.items():
            weight[p] = -alpha * math.log(2 + i - first)
        self.fallback = -alpha * math.log(2 + n)
        self.most = max(map(len, text), default=1)
        self.tables = []
        for length in range(1, self.most + 1):
            own = [p for p in text if len(p) == length]
            code = np.array([[ord(c) for c in p] for p in own], np.uint64).reshape(len(own), length)
            h = np.zeros(len(own), np.uint64)
            for j in range(length):
                h = h * np.uint64(_HASH) + code[:, j] + np.uint64(1)
            h *= _STEP
            o = np.argsort(h)
            seen = np.zeros(1 << 20, bool)
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            # where the hashes with the same upper 16 bits begin, and how many there are at most
            begin = np.searchsorted(h[o] >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.int32)
            self.tables.append((h[o], np.array([text[own[i]] for i in o], np.int32),
                                np.array([weight[own[i]] for i in o]), seen, begin[:-1], int(np.diff(begin).max(initial=0))))
        size = n
        self.bytes_of = [b""] * size
        for p, i in text.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for v, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([v])

    def normal(self, text: str | None) -> str:
        return self.sp.normalize(text) if text else ""

    def decode(self, ids) -> str:
        """Text of a sequence of piece ids."""
        out = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


class Lattices:
    """Chunk lattices laid end to end; every chunk of L characters has L + 1 places."""

    def __init__(self, chunks: list[str], voc: Vocabulary):
        lens = np.array([len(c) for c in chunks], np.int64)
        self.begin = np.cumsum(lens + 1) - (lens + 1)
        self.end = self.begin + lens
        total = int((lens + 1).sum())
        code = np.zeros(total, np.uint64)
        at = np.arange(lens.sum()) + np.repeat(np.arange(len(chunks)), lens)
        code[at] = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")
        left = np.zeros(total, np.int64)
        left[at] = np.repeat(self.end, lens) - at
        # the cells of a place: one for every piece length that still fits its chunk.  Those of all places with as many
        # characters left are one matrix, a row per length: cell (place, length) is off + stride * (length - 1)
        k = max(1, min(voc.most, int(lens.max(initial=0))))
        room = np.minimum(left, k)
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(1, left.max(initial=0) + 2))
        many = np.diff(bounds)
        height = np.minimum(np.arange(1, len(bounds)), k)
        first = np.r_[0, np.cumsum(many * height)]
        cells = int(first[-1])
        self.off, self.stride = np.zeros(total, np.int64), np.zeros(total, np.int64)
        fitting = order[bounds[0]:]
        self.off[fitting] = np.arange(len(fitting)) + np.repeat(first[:-1] - (bounds[:-1] - bounds[0]), many)
        self.stride[fitting] = np.repeat(many, many)
        w, self.ids = np.full(cells, -np.inf), np.full(cells, -1, np.int32)
        self.last = np.zeros(total, np.int8)
        # places with most characters left first: those with more than j are the first ones
        ok = fitting[::-1]
        h, own, stride = np.zeros(len(ok), np.uint64), self.off[ok], self.stride[ok]
        for j in range(k):
            if j:
                ok = ok[: total - bounds[j]] if j < len(bounds) else ok[:0]
                h = h[: len(ok)]
            h *= np.uint64(_HASH)
            h += code[ok + j]
            h += np.uint64(1)
            table, ids, weight, seen, begin, run = voc.tables[j]
            if not len(table):
                continue
            x = h * _STEP
            f = np.flatnonzero(seen[(x >> np.uint64(44)).view(np.int64)])
            x = x[f]
            i = begin[(x >> np.uint64(48)).view(np.int64)]
            for _ in range(run - 1):  # to the first hash of the run that is not below
                i = np.where(table[i] < x, np.minimum(i + 1, len(table) - 1), i)
            hit = np.flatnonzero(table[np.minimum(i, len(table) - 1)] == x)
            f, i = f[hit], i[hit]
            cell = own[f] + j * stride[f]
            w[cell], self.ids[cell] = weight[i], ids[i]
            self.last[ok[f]] = j  # the longest piece of a place
        w[own[~np.isfinite(w[own])]] = voc.fallback
        beta = np.zeros(total)
        self.cum = np.empty(cells, np.float32)
        for r in range(1, len(bounds)):
            p = order[bounds[r - 1]: bounds[r]]
            if not len(p):
                continue
            m = min(k, r)
            x = w[first[r - 1]: first[r]].reshape(m, len(p))  # a view: turned into log conditional probabilities
            x += beta[p + 1 + np.arange(m)[:, None]]
            top = x.max(axis=0)
            mass = np.exp(x - top)
            total_mass = mass.sum(axis=0)
            beta[p] = all_of = top + np.log(total_mass)
            x -= all_of
            mass /= total_mass
            np.cumsum(mass.astype(np.float32), axis=0, out=self.cum[first[r - 1]: first[r]].reshape(m, len(p)))
        self.logp, self.code, self.room = w, code, room

    def cell(self, pos, length):
        return self.off[pos] + self.stride[pos] * (length - 1)

    def edges(self, pos: int) -> np.ndarray:
        """Log probabilities of the pieces of length 1, 2, ... from a place."""
        return self.logp[self.off[pos]: self.off[pos] + self.stride[pos] * self.room[pos]: max(1, self.stride[pos])]

    def draw(self, chunk: np.ndarray, key: np.ndarray, stream: int):
        """A segmentation of every chunk occurrence: its log probability and, in order of occurrence,
        (owner, place, length) of the pieces."""
        pos, logp = self.begin[chunk].copy(), np.zeros(len(chunk))
        stop = self.end[chunk]
        live = np.flatnonzero(pos < stop)
        own, where, size = [], [], []
        step = 0
        while len(live):
            u = uniform(key[live] + np.uint64((step * int(_STEP) + stream * int(_WORD)) & 0xFFFFFFFFFFFFFFFF))
            p = pos[live]
            j = np.zeros(len(live), np.int64)
            cell, last, stride = self.off[p], self.last[p], self.stride[p]
            more = np.flatnonzero((u > self.cum[cell]) & (last > 0))
            n = 1
            while len(more):
                j[more] = n
                more = more[(u[more] > self.cum[cell[more] + n * stride[more]]) & (last[more] > n)]
                n += 1
            own.append(live)
            where.append(p)
            size.append(j + 1)
            logp[live] += self.logp[cell + j * stride]
            p = p + j + 1
            pos[live] = p
            live = live[p < stop[live]]
            step += 1
        if not own:
            return logp, (np.zeros(0, np.int64),) * 3
        own, where, size = map(np.concatenate, (own, where, size))
        o = np.argsort(own, kind="stable")
        return logp, (own[o], where[o], size[o])

    def draw_other(self, chunk: int, taken: list[tuple[int, ...]], rng) -> tuple[list[int], float]:
        """One segmentation (piece lengths) other than those taken, and its log probability."""
        pos, end, path, logp = int(self.begin[chunk]), int(self.end[chunk]), [], 0.0
        while pos < end:
            probs = np.exp(self.edges(pos))
            mine = [t for t in taken if list(t[: len(path)]) == path]
            for t in mine:
                q, at = 0.0, pos
                for n in t[len(path):]:
                    q += float(self.logp[self.cell(at, n)])
                    at += n
                probs[t[len(path)] - 1] -= math.exp(q)
            probs = np.maximum(probs, 0)
            # an edge that only leads to taken segmentations has no mass left
            for n in {t[len(path)] for t in mine if probs[t[len(path)] - 1] < 1e-5}:
                if self._paths(pos + n, end, len(mine) + 1) <= sum(t[len(path)] == n for t in mine):
                    probs[n - 1] = 0
            c = np.cumsum(probs)
            j = int(min(np.searchsorted(c, rng() * c[-1], "right"), np.flatnonzero(probs)[-1]))
            logp += float(self.logp[self.cell(pos, j + 1)])
            path.append(j + 1)
            pos += j + 1
        return path, logp

    def _paths(self, pos: int, end: int, most: int) -> int:
        """Number of segmentations from a place on, counted up to ``most``."""
        n = {end: 1}
        for p in range(end - 1, pos - 1, -1):
            n[p] = min(most, sum(n.get(p + j + 1, 0) for j in np.flatnonzero(np.isfinite(self.edges(p)))))
        return n[pos]

    def piece_ids(self, where: np.ndarray, size: np.ndarray, voc: Vocabulary):
        """Ids of the pieces (bytes where a character has none) and how many ids each piece gives."""
        ids = self.ids[self.cell(where, size)]
        n = np.ones(len(ids), np.int64)
        miss = np.flatnonzero(ids < 0)
        if not len(miss):
            return ids, n
        raw = [[voc.byte[b] for b in chr(int(c)).encode("utf-8", "replace")] for c in self.code[where[miss]]]
        n[miss] = [len(r) for r in raw]
        out = np.repeat(ids, n)
        out[out < 0] = [x for r in raw for x in r]
        return out, n


def uniform(key: np.ndarray) -> np.ndarray:
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def truncated(phi, limit, key):
    """Gumbel with location phi, below limit."""
    e = -np.log(uniform(key))
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return phi - np.log(np.exp(np.minimum(phi - limit, 700.0)) + e)


def _others(logp: np.ndarray) -> np.ndarray:
    """Log of the mass beside a choice of log probability logp (minus infinity when there is none)."""
    rest = -np.expm1(np.minimum(logp, 0.0))
    return np.where(rest > 1e-12, np.log(np.maximum(rest, 1e-300)), -np.inf)


class _Numbers(dict):
    """Chunks numbered as they come."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


def sample_texts(texts: list[str], keys: np.ndarray, k: int, voc: Vocabulary):
    """For every text a list of (ids, log p, value, inclusion score), best value first."""
    chunks, types, bounds = _Numbers(), [], [0]
    for t in texts:
        types += map(chunks.__getitem__, CHUNKS.findall(voc.normal(t)))
        bounds.append(len(types))
    chunk, bounds = np.array(types, np.int64), np.array(bounds)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    if not len(chunk):
        return [[(np.zeros(0, np.int32), 0.0, 0.0, 1.0)] for _ in range(n)]
    lat = Lattices(list(chunks), voc)
    rank = np.arange(len(chunk)) - bounds[doc]
    root = mix(keys)
    key = mix(root[doc] + rank.astype(np.uint64) * _WORD)
    has = np.flatnonzero(np.diff(bounds) > 0)

    def prefix(lp):
        c = np.cumsum(lp)
        base = np.where(bounds[:-1] > 0, c[np.maximum(bounds[:-1] - 1, 0)], 0.0)
        return c - lp - base[doc]

    value = -np.log(-np.log(uniform(root)))  # the root's Gumbel: location 0
    lp, pieces = lat.draw(chunk, key, 1)
    paths = [(lp, pieces, np.zeros(n, bool), {})]
    opened = [truncated(prefix(lp) + _others(lp), value[doc], key + np.uint64(101))]
    out = [[] for _ in range(n)]
    alive = np.zeros(n, bool)
    alive[has] = True
    values, first = [value], True
    taken: list[dict] = [dict() for _ in range(n)]
    chosen_path = [0]

    def segment(path, occ):
        own, _, size = paths[path][1]
        special = paths[path][3].get(occ)
        if special is not None:
            return special
        a, z = np.searchsorted(own, [occ, occ + 1])
        return tuple(size[a:z].tolist())

    def best():
        """Greatest open value of every text: (value, path, occurrence)."""
        v, p, o = np.full(n, -np.inf), np.zeros(n, int), np.zeros(n, int)
        for i, g in enumerate(opened):
            top = np.maximum.reduceat(g, bounds[has])
            for t, d in zip(top, has):
                if t > v[d]:
                    s = g[bounds[d]: bounds[d + 1]]
                    v[d], p[d], o[d] = t, i, bounds[d] + int(s.argmax())
        return v, p, o

    emitted = [[(0, float(value[d]))] if alive[d] else [] for d in range(n)]
    for s in range(1, k):
        v, p, o = best()
        go = np.flatnonzero(np.isfinite(v))
        if not len(go):
            break
        new_lp = np.zeros(len(chunk))
        start = np.full(n, np.iinfo(np.int64).max)
        special = {}
        for d in go:
            path, occ = int(p[d]), int(o[d])
            node = taken[d].setdefault((path, occ), [segment(path, occ)])
            state = [int(root[d])]

            def rng(state=state, d=d, s=s):
                state[0] = (state[0] * 6364136223846793005 + 1442695040888963407 + s) & ((1 << 64) - 1)
                return float(uniform(np.array([state[0]], np.uint64))[0])
            seg, q = lat.draw_other(int(chunk[occ]), node, rng)
            node.append(tuple(seg))
            special[occ] = tuple(seg)
            a = bounds[d]
            new_lp[a:occ] = paths[path][0][a:occ]
            new_lp[occ] = q
            start[d] = occ
            # the node's remaining choices stay open beside the new path
            rest = 1.0 - sum(math.exp(_log_of(lat, int(chunk[occ]), x)) for x in node)
            if rest > 1e-5 or rest > 1e-12 and lat._paths(
                    int(lat.begin[chunk[occ]]), int(lat.end[chunk[occ]]), len(node) + 1) > len(node):
                pre = float(paths[path][0][a:occ].sum())
                opened[path][occ] = truncated(np.array([pre + math.log(rest)]), v[d],
                                              np.array([mix(key[occ: occ + 1])[0] + np.uint64(500 + s)]))[0]
            else:
                opened[path][occ] = -np.inf
            emitted[d].append((s, float(v[d])))
        after = np.flatnonzero(np.arange(len(chunk)) > np.where(start[doc] < np.iinfo(np.int64).max, start[doc], len(chunk)))
        tail_lp, (own, where, size) = lat.draw(chunk[after], key[after], s + 1)
        new_lp[after] = tail_lp
        # pieces of the new path: before the split those of the old one (kept by reference), then its own
        paths.append((new_lp, (after[own] if len(own) else own, where, size), start, special))
        g = np.full(len(chunk), -np.inf)
        pre = prefix(new_lp)
        g[after] = truncated(pre[after] + _others(new_lp[after]), v[doc[after]], key[after] + np.uint64(101 + s))
        opened.append(g)
        chosen_path.append(p)
    v, _, _ = best()

    for d in range(n):
        if not alive[d]:
            out[d] = [(np.zeros(0, np.int32), 0.0, float(value[d]), 1.0)]
            continue
        for s, g in emitted[d]:
            where, size = _pieces_of(d, s, lat, chunk, bounds, paths, chosen_path)
            ids, _ = lat.piece_ids(where, size, voc)
            lp = float(paths[s][0][bounds[d]: bounds[d + 1]].sum())
            inc = -math.expm1(-math.exp(min(lp - v[d], 700.0))) if np.isfinite(v[d]) else 1.0
            out[d].append((ids, lp, g, inc))
    return out


def _pieces_of(d: int, s: int, lat: Lattices, chunk: np.ndarray, bounds: np.ndarray, paths: list, chosen_path: list):
    """(places, lengths) of sample s of text d.  Not nested in ``sample_texts``: a nested function that calls itself is
    a reference cycle, which keeps all lattices of a part until Python's next full collection."""
    a, z = bounds[d], bounds[d + 1]
    own, where, size = paths[s][1]
    if s == 0:
        i, j = np.searchsorted(own, [a, z])
        return where[i:j], size[i:j]
    occ = int(paths[s][2][d])
    w0, s0 = _pieces_of(d, int(chosen_path[s][d]), lat, chunk, bounds, paths, chosen_path)
    begin = lat.begin[chunk[a:occ]]
    head = int((lat.end[chunk[a:occ]] - begin).sum())
    cut = int(np.searchsorted(np.cumsum(s0), head, "right")) if head else 0
    seg = np.array(paths[s][3][occ], np.int64)
    at = lat.begin[chunk[occ]] + np.cumsum(seg) - seg
    i, j = np.searchsorted(own, [occ + 1, z])
    return np.concatenate([w0[:cut], at, where[i:j]]), np.concatenate([s0[:cut], seg, size[i:j]])


def _log_of(lat: Lattices, chunk: int, seg) -> float:
    at, q = int(lat.begin[chunk]), 0.0
    for n in seg:
        q += float(lat.logp[lat.cell(at, n)])
        at += n
    return q


def parted(batches, text_at: int, size: int = PART_BYTES):
    """The rows in parts of about ``size`` bytes of text (a longer text is a part of its own): the lattices of
    a part are held at once."""
    import pyarrow.compute as pc
    for b in batches:
        if b.num_rows:
            n = pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(n) - n) // size
            start = np.flatnonzero(np.r_[True, np.diff(part) > 0])
            for lo, hi in zip(start, np.r_[start[1:], b.num_rows]):
                yield b.slice(int(lo), int(hi - lo))


def sample_encode(rows: DataFrame, proto: bytes, key_cols: tuple[str, ...], text_col: str = "text", k: int = SAMPLES,
                  alpha: float = ALPHA, seed: int = 0, digest: bool = False) -> DataFrame:
    """Up to k rows for every row: its key columns, sample (from 1), ids (or with ``digest`` n_pieces,
    ids_crc32 and whether they decode to the text), log_prob, value and inclusion."""
    shared = rows.sparkSession.sparkContext.broadcast(proto)
    src = rows.select(*key_cols, F.xxhash64(F.lit(seed), *key_cols).alias("row_key"), F.col(text_col).alias("row_text"))
    m = len(key_cols)

    def run(batches):
        import zlib
        voc = per_process(f"pieces-{alpha}-{zlib.crc32(shared.value)}", lambda: Vocabulary(shared.value, alpha))
        for b in parted(batches, m + 1):
            texts = [t or "" for t in b.column(m + 1).to_pylist()]
            got = sample_texts(texts, b.column(m).to_numpy().view(np.uint64), k, voc)
            row = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
            flat = [x for g in got for x in g]
            base = [*(b.column(i).take(row) for i in range(m)),
                    pa.array([i + 1 for g in got for i in range(len(g))], pa.int32())]
            tail = [pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3)]
            if digest:
                own = [t for t, g in zip(texts, got) for _ in g]
                mid = [pa.array([len(x[0]) for x in flat], pa.int64()),
                       pa.array([zlib.crc32(x[0].astype("<u4").tobytes()) for x in flat], pa.int64()),
                       pa.array([voc.decode(x[0].tolist()) == t for x, t in zip(flat, own)], pa.bool_())]
                names = ["n_pieces", "ids_crc32", "decodes"]
            else:
                mid, names = [pa.array([x[0] for x in flat], pa.list_(pa.int32()))], ["ids"]
            yield pa.RecordBatch.from_arrays([*base, *mid, *tail], names=[*key_cols, "sample", *names, "log_prob", "value",
                                                                         "inclusion"])
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key_cols)
    mid = "n_pieces long, ids_crc32 long, decodes boolean" if digest else "ids array<int>"
    return map_batches(src, run, f"{kinds}, sample int, {mid}, log_prob double, value double, inclusion double")


def decode(rows: DataFrame, proto: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their piece ids (null ids: null)."""
    from pyspark.sql import types as T
    shared = rows.sparkSession.sparkContext.broadcast(proto)
    at = rows.columns.index(ids_col)

    def run(batches):
        import zlib
        voc = per_process(f"pieces-{ALPHA}-{zlib.crc32(shared.value)}", lambda: Vocabulary(shared.value, ALPHA))
        for b in batches:
            text = [None if i is None else voc.decode(i) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, out_col])
    return map_batches(rows, run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))
