"""Word windows that start earlier, against brute force."""
import hashlib
import random

import numpy as np
import pytest
from conftest import DOCS, make_words, text_rows


def brute(rows, length):
    first = {}
    split = [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, split):
        if d is not None:
            for i in range(len(w) - length + 1):
                g = tuple(w[i:i + length])
                first[g] = min(first.get(g, (d, i)), (d, i))
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        if d is not None:
            for i in range(len(w) - length + 1):
                if (d, i) > first[tuple(w[i:i + length])]:
                    gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rows_of_all_kinds(docs, odd_docs, no_docs):
    from tabloom.llm.recompress import drop_repeated_words, report
    want = brute(text_rows(), 20)
    assert sum(n for _, _, n, _ in want) > 200
    assert got(report(docs)) == want
    assert got(report(odd_docs)) == want
    assert got(report(odd_docs.withColumnRenamed("x", "n_words").withColumnRenamed("row", "start"))) == want
    assert report(no_docs).collect() == []
    left = drop_repeated_words(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count()
    clean = {r["doc_id"]: r["text"] for r in left.where("doc_id in (1, 2, 14, 8)").collect()}
    texts = dict(text_rows())
    assert clean == {1: texts[1], 2: "", 14: texts[14], 8: texts[8]}


@pytest.mark.parametrize("seed,vocabulary", [(1, 2), (3, 40)])
def test_periodic_and_crowded_texts(llm, seed, vocabulary):
    """Few words: runs, periods, repeats inside a document and windows that only cross other repeats."""
    from tabloom.llm.recompress import report
    r = random.Random(seed)
    passages = [["v%d" % r.randrange(vocabulary) for _ in range(r.randrange(5, 60))] for _ in range(12)]
    rows = [(1, "a " * 100), (2, "a b " * 30), (3, "b a " * 12), (3, "a a b"), (4, "a " * 20), (7, "a " * 19)]
    for i in range(60):
        w = [x for _ in range(r.randrange(1, 6)) for x in
             (r.choice(passages) if r.random() < 0.7 else ["u%d" % r.randrange(10 ** 6) for _ in range(r.randrange(1, 30))])]
        rows.append((r.randrange(5, 60), "\t".join(w)))
    rows += rows[-5:]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    for length in (20, 5):
        assert got(report(df, length)) == brute(rows, length)


def test_one_passage_in_many_documents_and_parts_of_long_texts(llm, monkeypatch):
    import tabloom.llm.recompress as R
    passage = make_words(9, 70)
    rows = [(i, " ".join(make_words(500 + i, 5 + i % 9) + passage + make_words(900 + i, 6))) for i in range(300)]
    rows += [(1000 + i, " ".join(passage)) for i in range(100)]
    rows += [(2000, " ".join(make_words(77, 3000, 10 ** 6) + passage + make_words(78, 40)))]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 20)
    assert got(R.report(df)) == want
    # parts of 64 words give every window the anchor it has in the whole text
    texts = [t for _, t in rows[-4:]]

    def named():
        return {(int(r), int(s)): (int(n), int(w)) for row, start, name, _, win in R.named_windows(texts, 20, 3)
                for r, s, n, w in zip(row, start, name, win)}
    whole = named()
    monkeypatch.setattr(R, "PIECE", 64)
    monkeypatch.setattr(R, "CHUNK", 50)
    assert named() == whole


def test_equal_windows_have_equal_anchors():
    import tabloom.llm.recompress as R
    r = np.random.default_rng(3)
    core = r.integers(1, 6, 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seen = []
    for _ in range(30):
        around = [r.integers(1, 6, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in r.integers(0, 30, 2)]
        words = np.concatenate([[0], around[0], core, around[1], [0]]).astype(np.uint64)
        wall = np.zeros(len(words), bool)
        wall[[0, -1]] = True
        name, _ = R.anchors(R.parse(words, wall), 1 + len(around[0]) + np.arange(21), 20)
        seen.append(name.tolist())
    assert all(x == seen[0] for x in seen)


def test_null_texts_only(llm):
    from tabloom.llm.recompress import report
    df = llm.createDataFrame([(1, None, None, None, None), (None, None, None, None, None)], DOCS)
    assert got(report(df)) == sorted([(1, 0, 0, hashlib.sha256().hexdigest()), (None, 0, 0, hashlib.sha256().hexdigest())], key=str)
