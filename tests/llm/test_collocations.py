"""Collocations against brute force; the pointer sort against plain counts."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import DOCS, text_rows


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        f = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang if lang is not None else "und"] += len(w)
            for k in range(1, 5):
                f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {}
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i:i + k]] = max(held.get(p[i:i + k], 0), a)
        best = []
        for p, a in cand.items():
            if 100 * held.get(p, 0) >= 80 * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def run(docs, **kw):
    from tabloom.llm.collocations import collocations
    return sorted(tuple(r) for r in collocations(docs, **kw).collect())


def crowd(n=400):
    r = random.Random(8)
    frames = ["New York City hall", "of the", "a a a a a", "Straße 中文 é", "as well as the", "one,two;three"]
    rows = []
    for i in range(n):
        words = [r.choice(frames) if r.random() < 0.6 else "w%d" % int(r.paretovariate(0.5)) for _ in range(r.randrange(60))]
        rows.append((i, r.choice([" ", "  ", "\t"]).join(w + r.choice(["", "", "", ".", "\n", "\x0c"]) for w in words), r.choice(["en", "de", None])))
    return rows + [(9000, None, "en"), (9001, "", None), (9002, " . , ", "xx"), (9003, "in der Tat " * 3000, "long"), (9003, "in der Tat " * 3000, "long")]


def test_against_brute_force(llm, no_docs, odd_docs):
    rows = crowd()
    docs = llm.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS).repartition(5).selectExpr("*", "1 as n", "'x' as lead", "2 as rank")
    want = brute([(t, lang) for _, t, lang in rows], 30, 2000)
    assert len({x[0] for x in want}) == 4 and len(want) > 40
    assert run(docs) == want
    assert run(docs, least=5, top=7) == brute([(t, lang) for _, t, lang in rows], 5, 7)
    assert run(no_docs) == []
    assert run(odd_docs, least=3) == brute([(t, "en") for _, t in text_rows()], 3, 2000)


def test_small_blocks_sorts_and_hot_leads(llm, monkeypatch):
    """Blocks of some words, sorts that break one leading pair, and hot pairs dealt to several tasks."""
    import tabloom.llm.collocations as C
    rows = crowd(120)
    docs = llm.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    want = brute([(t, lang) for _, t, lang in rows], 4, 500)
    monkeypatch.setattr(C, "HOT_SHARE", 40)
    monkeypatch.setattr(C, "SALTS", 3)
    assert run(docs, least=4, top=500) == want
    pointers = [("en", "a b", r, n) for r, n in (("c d", 3), ("c e", 4), ("c", 2), ("x y", 1), ("c d", 5))] * 3 + [("en", "q r", "s", 9)]
    import pyarrow as pa
    cols = list(zip(*pointers))
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:3]), pa.array(cols[3], pa.int64()), pa.array([False] * len(pointers))],
                                       names=["lang", "lead", "rest", "n", "hot"])
    full = {("a b c", 42), ("a b c d", 24), ("a b c e", 12), ("q r s", 9)}
    for size in (1 << 20, 1, 4):
        total = Counter()
        for b in C.sort_routed(9, size)(iter([batch.slice(i, 2) for i in range(0, len(pointers), 2)])):
            for p, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                total[p] += n
        assert {(p, n) for p, n in total.items() if n >= 9} == full


@pytest.mark.parametrize("least", [1, 5])
def test_pointer_sort(least):
    from tabloom.llm.collocations import equal_parts
    r = np.random.default_rng(2)
    keys = r.integers(0, 4, (3000, 3))
    keys[r.random(3000) < 0.2, 2] = -1
    weight = r.integers(1, 4, 3000)
    want = Counter()
    for k, w in zip(keys.tolist(), weight.tolist()):
        for d in range(1, 4):
            if k[d - 1] >= 0:
                want[tuple(k[:d])] += w
    found = [(tuple(keys[i, :d].tolist()), n) for i, d, n in equal_parts(keys, weight, least)]
    total = Counter()
    for k, n in found:
        total[k] += n
    assert len(total) == len(found) and total == {k: n for k, n in want.items() if n >= least}


def test_scores_beyond_64_bits(llm):
    row = llm.sql("select (cast(2000000 as decimal(38, 0)) * 9000000000000000) div (9000000000000000L + 9100000000000000L) as s").first()
    assert row["s"] == 2000000 * 9 * 10 ** 15 // (181 * 10 ** 14)
