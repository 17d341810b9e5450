"""Secret spans: fixed patterns plus a linear-chain conditional random field.

Patterns (base spans, always kept): ``assign``, ``access`` and ``hex``, leftmost non-overlapping per
kind.  The field tags white-space tokens B, I or O (begin, inside, outside of a secret) from the
token's shape, the neighbouring words and features of the whole file, and is decoded by Viterbi; its
spans are added where they overlap no base span (kind ``crf``).

The field is fitted on token windows of a bounded sample (``sample_docs`` documents with a base match and
as many without, taken in the order of a hash of their id); its labels are the base spans.  Positions are
code points, ends exclusive.  Null text counts as empty; repeated rows are tagged alike.

Decoding is exact: a position is fixed to O when no neighbouring tags could make B or I score higher;
Viterbi runs over the remaining stretches, whose neighbours are then known.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, per_process, share, shared_value

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_HEXMAP = bytes(0x68 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
SAMPLE_DOCS = 1000
WINDOW = 20
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, value start) of the pattern matches, by start and kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in text.encode("utf-8", "replace").translate(_HEXMAP):
        found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


# -- token features ---------------------------------------------------------------------------------

_EDGE = "\"'`,;:()[]{}<>|!%$*&#?.=~"
_CUE = re.compile(r"passw|pwd|secret|token|api|key|auth|cred|bearer|access|private", re.IGNORECASE)
N_FEATURES = 48


def core_of(word: str) -> tuple[int, int]:
    """Offsets of the word without its surrounding punctuation."""
    a = len(word) - len(word.lstrip(_EDGE))
    b = len(word.rstrip(_EDGE))
    return (a, b) if b > a else (0, len(word))


def features(word: str) -> tuple[int, ...]:
    """Indices of the features that hold for a word (below N_FEATURES)."""
    a, b = core_of(word)
    w = word[a:b]
    n = len(w)
    f = [0, 1 + min(9, int(2 * math.log2(n + 1)) - 1 if n else 0)]  # bias, length
    if w.isalpha() and (w.islower() or w.isupper() or w[1:].islower()):  # an ordinary word
        f += [11, 15 if w.islower() else 16 if w.isupper() else 17, 24]
        if w.isascii():
            f.append(22 if n >= 16 else 23)
            if not w.strip("abcdefABCDEF"):
                f.append(20 if n >= 16 else 21)
        else:
            f.append(44)
        return tuple(sorted({*f, *_marks(word, w)}))
    digits = sum(c.isdigit() for c in w)
    upper = sum(c.isupper() for c in w)
    lower = sum(c.islower() for c in w)
    f.append(11 + (0 if digits == 0 else 1 if digits == n else 2 if 3 * digits < n else 3))
    f.append(15 + (0 if upper == 0 else 1 if upper == n else 2 if w[:1].isupper() and upper == 1 else 3))
    if digits and (upper or lower):
        f.append(19)
    if re.fullmatch(r"[0-9a-fA-F]+", w):
        f.append(20 if n >= 16 else 21)
    if re.fullmatch(r"[A-Za-z0-9+/_=-]+", w):
        f.append(22 if n >= 16 else 23)
    changes = sum((x.isdigit() != y.isdigit()) or (x.isupper() != y.isupper()) for x, y in zip(w, w[1:]))
    f.append(24 + min(4, changes // 3))
    if digits:
        counts = [w.count(c) for c in set(w)]
        f.append(29 + min(5, int(-sum(c / n * math.log2(c / n) for c in counts))))
    if "=" in w or ":" in w:
        f.append(38)
    if "@" in w:
        f.append(40)
    if "://" in w or w.startswith("www."):
        f.append(41)
    if w.count(".") >= 2:
        f.append(42)
    if "-" in w:
        f.append(43)
    if not w.isascii():
        f.append(44)
    if not any(c.isalnum() for c in w):
        f.append(45)
    if upper and lower and digits:
        f.append(46)
    return tuple(sorted({*f, *_marks(word, w)}))


def _marks(word: str, w: str) -> list[int]:
    """Features of cue words and of the punctuation around a word."""
    f = []
    if _CUE.search(w):
        f.append(35)
    if word in ("=", ":", "=>", ":="):
        f.append(36)
    if word[-1:] in (":", "=") and w:
        f.append(37)
    if word[:1] in ("\"", "'", "`"):
        f.append(39)
    return f


class Classes:
    """Words with the same features share a class; a word's class is kept for words seen before."""

    def __init__(self, limit: int = 300_000):
        self.words, self.ids, self.rows, self.limit = {}, {}, [], limit

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.words
        out = [known.get(w, -1) for w in words]
        if -1 in out:
            if len(known) > self.limit:
                known.clear()
            for i, c in enumerate(out):
                if c < 0:
                    f = features(words[i])
                    c = self.ids.get(f)
                    if c is None:
                        c = self.ids[f] = len(self.rows)
                        self.rows.append(f)
                    out[i] = known[words[i]] = c
        return np.array(out, np.int64)

    def matrix(self) -> np.ndarray:
        m = np.zeros((len(self.rows), N_FEATURES))
        for i, f in enumerate(self.rows):
            m[i, list(f)] = 1
        return m


N_FILE = 8


def file_features(n: int, cues: int) -> int:
    """Feature of the whole file: its length in words (four ranges) and whether a cue word occurs."""
    return min(3, int(math.log10(n + 1))) + 4 * (cues > 0)


# -- the field --------------------------------------------------------------------------------------

class Field:
    """Weights: word, previous two, next (features x 3), file (N_FILE x 3), transitions, start."""

    def __init__(self):
        self.w = {k: np.zeros((N_FEATURES, 3)) for k in ("cur", "p1", "p2", "n1")}
        self.w["file"] = np.zeros((N_FILE, 3))
        self.w["trans"] = np.zeros((3, 3))
        self.w["start"] = np.zeros(3)

    def tables(self, m: np.ndarray) -> dict:
        """Class scores with an all-zero row at the end for positions outside the text."""
        return {k: np.vstack([m @ self.w[k], np.zeros(3)]) for k in ("cur", "p1", "p2", "n1")}

    def fit(self, c: np.ndarray, files: np.ndarray, y: np.ndarray, m: np.ndarray, steps: int = 100,
            l2: float = 0.3, rate: float = 0.15):
        """Maximise the penalised log-likelihood of windows c (n, T) of classes with tags y (n, T); class -1
        pads (tag O); Adam on the full sample."""
        n, t = c.shape
        pad = len(m)
        c = np.where(c < 0, pad, c)
        side = np.full((n, 2), pad)
        ext = np.concatenate([side, c, side[:, :1]], axis=1)
        views = {"cur": ext[:, 2:-1], "p1": ext[:, 1:-2], "p2": ext[:, :-3], "n1": ext[:, 3:]}
        inside = (c != pad)[..., None]
        hot = np.eye(3)[y]
        mom = {k: np.zeros_like(v) for k, v in self.w.items()}
        var = {k: np.zeros_like(v) for k, v in self.w.items()}
        trans_obs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
        for step in range(1, steps + 1):
            tab = self.tables(m)
            e = sum(tab[k][v] for k, v in views.items()) + self.w["file"][files][:, None, :]
            tr = self.w["trans"]
            alpha, beta = np.zeros((n, t, 3)), np.zeros((n, t, 3))
            alpha[:, 0] = e[:, 0] + self.w["start"]
            for i in range(1, t):
                x = alpha[:, i - 1, :, None] + tr
                top = x.max(axis=1, keepdims=True)
                alpha[:, i] = e[:, i] + (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]
            for i in range(t - 2, -1, -1):
                x = tr + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
                top = x.max(axis=2, keepdims=True)
                beta[:, i] = (top + np.log(np.exp(x - top).sum(axis=2, keepdims=True)))[..., 0]
            z = np.log(np.exp(alpha[:, -1] - alpha[:, -1].max(1, keepdims=True)).sum(1)) + alpha[:, -1].max(1)
            post = np.exp(alpha + beta - z[:, None, None])
            diff = (hot - post) * inside
            g = {}
            for k, v in views.items():
                by = np.stack([np.bincount(v.ravel(), diff[..., s].ravel(), minlength=pad + 1)[:pad] for s in range(3)], 1)
                g[k] = m.T @ by
            per = diff.sum(axis=1)
            g["file"] = np.stack([np.bincount(files, per[:, s], minlength=N_FILE) for s in range(3)], 1)
            pair = np.exp(alpha[:, :-1, :, None] + tr + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
            g["trans"] = trans_obs - pair.sum(axis=(0, 1))
            g["start"] = (hot[:, 0] - post[:, 0]).sum(0)
            for k in self.w:
                grad = g[k] - l2 * self.w[k]
                mom[k] = 0.9 * mom[k] + 0.1 * grad
                var[k] = 0.99 * var[k] + 0.01 * grad ** 2
                self.w[k] += rate * (mom[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.99 ** step)) + 1e-8)
        return self

    def viterbi(self, e: np.ndarray, before: int | None, after: int | None) -> np.ndarray:
        """Best tags of one stretch, given the tag before and after it (None at the ends of the text)."""
        tr = self.w["trans"]
        s = e[0] + (self.w["start"] if before is None else tr[before])
        back = []
        for i in range(1, len(e)):
            x = s[:, None] + tr
            back.append(x.argmax(0))
            s = x.max(0) + e[i]
        if after is not None:
            s = s + tr[:, after]
        tags = [int(s.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return np.array(tags[::-1])

    def margin(self) -> float:
        """The most that neighbouring tags can favour B or I over O at one position."""
        tr, st = self.w["trans"], self.w["start"]
        best = -np.inf
        for x in (B, I):
            left = max([st[x] - st[O]] + [tr[a, x] - tr[a, O] for a in range(3)])
            right = max([0.0] + [tr[x, b] - tr[O, b] for b in range(3)])
            best = max(best, left + right)
        return best


def decode(field: Field, tables: dict, c: np.ndarray, n: np.ndarray, files: np.ndarray) -> np.ndarray:
    """Tags of texts laid end to end (classes c, lengths n)."""
    total = len(c)
    if not total:
        return np.zeros(0, np.int64)
    starts = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(total) - starts[doc]
    pad = len(tables["cur"]) - 1

    def beside(pos, by):
        """Classes of the words ``by`` places from pos, the padding class outside their text."""
        inside = (place[pos] + by >= 0) & (place[pos] + by < n[doc[pos]])
        return np.where(inside, c[np.clip(pos + by, 0, total - 1)], pad)

    # the three scores differ from O's by two numbers per class: look those up
    rel = {k: t[:, 1:] - t[:, :1] for k, t in tables.items()}
    file_rel = field.w["file"][:, 1:] - field.w["file"][:, :1]
    limit = rel["p1"].max(0) + rel["p2"].max(0) + rel["n1"].max(0) + file_rel.max(0)
    margin = field.margin()
    could = (rel["cur"] + limit).max(1) + margin >= 0  # words of other classes are O whatever surrounds them
    maybe = np.flatnonzero(could[c])
    out = np.zeros(total, np.int64)
    if not len(maybe):
        return out
    full = (rel["cur"][c[maybe]] + rel["p1"][beside(maybe, -1)] + rel["p2"][beside(maybe, -2)] + rel["n1"][beside(maybe, 1)]
            + file_rel[files[doc[maybe]]])
    stay = full.max(1) + margin >= 0
    maybe, full = maybe[stay], full[stay]
    if not len(maybe):
        return out
    runs = np.flatnonzero(np.r_[True, (np.diff(maybe) > 1) | (doc[maybe][1:] != doc[maybe][:-1])])
    for a, z in zip(runs, np.r_[runs[1:], len(maybe)]):
        first, last = maybe[a], maybe[z - 1]
        sc = np.concatenate([np.zeros((z - a, 1)), full[a:z]], axis=1)
        before = None if place[first] == 0 else O
        after = None if place[last] == n[doc[last]] - 1 else O
        out[first: last + 1] = field.viterbi(sc, before, after)
    return out


def _token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def _windows(texts: list[str], classes: Classes, seed_of: list[int]):
    """Training windows: around every labelled token, or one per text without labels."""
    out = []
    for text, seed in zip(texts, seed_of):
        words = text.split()
        if not words:
            continue
        c = classes(words)
        y = np.zeros(len(words), np.int64)
        spans = _token_spans(text)
        begin = [a for a, _ in spans]
        for _, _, end, value in base_spans(text):
            i = int(np.searchsorted(begin, value, "right")) - 1
            tag = B
            while i < len(spans) and spans[i][0] < end:
                y[i] = tag
                tag, i = I, i + 1
        # a mixed token after a cue word that no pattern matches may be a secret: not an example of either
        mixed = np.array([19 in f or 46 in f for f in (classes.rows[x] for x in c)])
        cued = np.array([35 in classes.rows[x] for x in c])
        after = np.r_[False, cued[:-1]] | np.r_[False, False, cued[:-2]][: len(c)]
        unsure = mixed & after & (y == O)
        at = list(np.flatnonzero(y == B)[:8]) or [seed % len(words)]
        cue = sum(35 in classes.rows[x] for x in set(c.tolist()))
        for p in at:
            lo = max(0, p - WINDOW)
            if unsure[lo: p + WINDOW + 1].any():
                continue
            cc, yy = c[lo: p + WINDOW + 1], y[lo: p + WINDOW + 1]
            padded = np.full(2 * WINDOW + 1, -1)
            padded[: len(cc)] = cc
            tags = np.zeros(2 * WINDOW + 1, np.int64)
            tags[: len(yy)] = yy
            out.append((padded, tags, file_features(len(words), cue)))
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Field fitted on at most 2 * ``sample_docs`` documents."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text")).where("text <> ''")
    has = (F.lower("text").rlike(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9+/_.=-]{8}")
           | F.col("text").rlike("AKIA[A-Z0-9]{12}") | F.col("text").rlike("[0-9a-f]{32}"))
    marked = base.select("doc_id", F.xxhash64("doc_id").alias("h"), has.alias("has"))
    picked = []
    for flag in (True, False):  # ids first, so that no task keeps long texts
        picked += marked.where(F.col("has") == F.lit(flag)).orderBy("h", "doc_id").limit(sample_docs).select(
            "doc_id").toPandas()["doc_id"].dropna().astype("int64").tolist()
    rows = base.where(F.col("doc_id").isin(picked)).orderBy("doc_id", "text").limit(3 * sample_docs).collect() \
        if picked else []
    classes = Classes()
    win = _windows([r["text"] for r in rows], classes, [int(r["doc_id"]) * 2654435761 % (1 << 31) for r in rows])
    field = Field()
    if win:
        c, y, f = (np.array([w[i] for w in win]) for i in range(3))
        field.fit(c, f, y, classes.matrix())
    return field


def find_spans(texts: list[str], field: Field, classes: Classes, cache: dict) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of every text: base spans, and those of the field that overlap none of them."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    c = classes([x for w in words for x in w])
    if cache.get("size") != len(classes.rows):
        m = classes.matrix()
        cache.update(size=len(classes.rows), tables=field.tables(m), cue=m[:, 35] > 0)
    bounds = np.r_[0, np.cumsum(n)]
    cue = np.r_[0, np.cumsum(cache["cue"][c])] if len(c) else np.zeros(1, np.int64)
    files = np.array([file_features(int(k), int(cue[z] - cue[a])) for k, a, z in zip(n, bounds, bounds[1:])], np.int64)
    tags = decode(field, cache["tables"], c, n, files)
    out = []
    for i, text in enumerate(texts):
        base = [(s, k, e) for s, k, e, _ in base_spans(text)]
        mine = tags[bounds[i]: bounds[i + 1]]
        if mine.any():
            where, added, run = _token_spans(text), [], None
            for j in np.flatnonzero(mine):
                a, z = where[j]
                x, y = core_of(text[a:z])
                if run is not None and mine[j] == I and run[1] == j - 1:
                    run = (run[0], j, run[2], a + y)
                    added[-1] = run
                else:
                    run = (j, j, a + x, a + y)
                    added.append(run)
            base += [(s, 3, e) for _, _, s, e in added if not any(s < e2 and s2 < e for s2, _, e2 in base)]
        out.append(sorted(base))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _tag(docs: DataFrame, text_col: str, model, make):
    """Append columns that ``make(texts, spans)`` builds to every row."""
    shared = share(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches):
        field = shared_value(shared)
        classes, cache = per_process("secret-classes", Classes), {}  # classes do not depend on the fit
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            arrays, names = make(texts, find_spans(texts, field, classes, cache))
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *names])
    return run


def scan(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, all spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, sample_docs)

    def make(texts, spans):
        base = [[x for x in s if x[1] < 3] for s in spans]
        count = [pa.array([sum(x[1] == k for x in s) for s in spans], pa.int64()) for k in range(4)]
        return ([*count, pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]),
                 pa.array([_joined(s) for s in spans])],
                ["n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])
    out = map_batches(docs, _tag(docs, "text", model, make),
                      "doc_id long, text string, n_assign long, n_access long, n_hex long, n_crf long, "
                      "base_sha256 string, spans string")
    return out.drop("text")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows with every span of their text replaced by ``mark`` (assignments keep the name)."""
    new, = fresh(docs, "redacted")
    model = train(docs.select("doc_id", F.col(text_col).alias("text")), sample_docs)

    def make(texts, spans):
        out = []
        for t, s in zip(texts, spans):
            done, at = [], 0
            value = {x[0]: x[3] for x in base_spans(t) if x[1] == 0} if s else {}
            for a, k, e in s:
                a = value.get(a, a) if k == 0 else a
                if e > at:
                    done += [t[at: max(a, at)], mark if a >= at else ""]
                    at = e
            out.append("".join(done) + t[at:])
        return [pa.array(out)], [new]
    got = map_batches(docs, _tag(docs, text_col, model, make),
                      T.StructType([*docs.schema.fields, T.StructField(new, T.StringType())]))
    return got.select(*[F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
