"""Filter interactions by the retraction stream, against brute force over all orders."""
import itertools
import os
import random
import re
import tempfile

import pytest
from conftest import DOCS, make_words, text_rows

LABELS = "doc_id long, quality int, toxic int"


def write(docs, parts):
    path = tempfile.mkdtemp(prefix="tabloom-test-", dir="/tmp") + "/documents.parquet"
    docs.repartition(parts).write.parquet(path)
    return path


def brute(rows, labels):
    texts = {}
    for d, t, _ in rows:
        if d is not None:
            texts.setdefault(t or "", set()).add(d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": d is not None and min(texts[t]) < d}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for k, f in enumerate(order, 1):
                r = out.setdefault((lang or "", "".join(order), k), [0] * 7)
                removed = fails[f] and not gone
                r[0] += not gone and not fails[f]
                r[1] += removed
                r[2] += fails[f] and gone
                r[3] += fails[f] and sum(fails.values()) == 1
                r[4] += removed and d in good
                r[5] += removed and d in bad
                gone = gone or fails[f]
    shap = {}
    for (part, order, k), r in out.items():
        shap[part, order[k - 1]] = shap.get((part, order[k - 1]), 0) + r[1]
    return sorted((*key, *r[:6], shap[key[0], key[1][key[2] - 1]]) for key, r in out.items())


def got(df):
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def rows_of():
    r = random.Random(4)
    base = [(i, t, ["en", "de", None, ""][n % 4]) for n, (i, t) in enumerate(text_rows())]
    long = " ".join(make_words(40, 130))
    copies = [(900 - 7 * i, long, "en" if i % 3 else "fr") for i in range(40)] + [(5000, long, "fr"), (None, long, "fr")]
    odd = [(3000 + i, " ".join(w.upper() if r.random() < 0.3 else w for w in make_words(700 + i, 90 + i)) + " $" * (i % 2), "fr")
           for i in range(20)]
    return base + copies + odd


def labels_of(rows):
    r = random.Random(5)
    out = [(d, r.randrange(2), int(r.random() < 0.2)) for d, _, _ in rows if d is not None and r.random() < 0.6]
    return out + [(None, 1, 1), (99999, 1, 1), (out[0][0], None, 1)]


def test_all_orders_against_brute_force(llm):
    from tabloom.llm.retraction import audit
    rows = rows_of()
    labels = labels_of(rows)
    docs = llm.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in rows], DOCS).selectExpr("*", "1 as mask", "'x' as part", "2 as n")
    marks = llm.createDataFrame(labels, LABELS)
    want = brute(rows, labels)
    assert sum(r[4] for r in want) > 0 and len(want) == 600 * len({x or "" for _, _, x in rows})
    # one file a micro-batch: smaller ids keep coming after larger ones were counted
    assert got(audit(llm, write(docs.orderBy("doc_id"), 6), marks, files_per_batch=1)) == want
    assert got(audit(llm, write(docs, 3), marks, micro_batches=1)) == want
    folder = write(docs, 1)
    (file,) = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    assert got(audit(llm, f"{folder}/{file}", marks)) == want


def test_retraction_of_earlier_masks(llm):
    """Ids arrive in descending order, one file each: every file retracts the mask counted before."""
    from tabloom.llm.retraction import counted_masks
    text = " ".join(make_words(1, 150))
    path = tempfile.mkdtemp(prefix="tabloom-test-", dir="/tmp") + "/documents.parquet"
    ids = [50, 40, 30, 30, 20]
    for i, d in enumerate(ids):
        llm.createDataFrame([(d, text, "en", "s", 0)], DOCS).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):  # the stream takes files by their time
            if f.endswith(".parquet"):
                full = os.path.join(path, f)
                if os.path.getmtime(full) > 2e9 or os.path.getmtime(full) > 1e9 + 100:
                    os.utime(full, (1e9 + i, 1e9 + i))
    none = llm.createDataFrame([], LABELS)
    for per in (1, 2):
        masks = {(r["part"], r["mask"]): r["n"] for r in counted_masks(llm, path, none, files_per_batch=per).collect()}
        assert masks == {("en", 0): 1, ("en", 16): 4}


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, None, None), (2, "", "en"), (2, "", "en")]])
def test_empty_and_null_tables(llm, rows):
    from tabloom.llm.retraction import audit
    docs = llm.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in rows], DOCS)
    assert got(audit(llm, write(docs, 1), llm.createDataFrame([], LABELS))) == brute(rows, [])


def test_settled_rows_of_a_batch():
    import pyarrow as pa

    from tabloom.llm.retraction import judge
    b = pa.RecordBatch.from_arrays([pa.array([3, 1, None, 1, 2], pa.int64()), pa.array(["x"] * 4 + ["y"]), pa.array([None, "a", "a", "b", "a"])],
                                   names=["doc_id", "text", "lang"])
    rows = list(zip(*(c.to_pylist() for c in next(judge([b])).columns)))
    assert [(k is None, i, p, m) for k, i, p, m in rows] == [
        (True, 3, "", 17), (False, 1, "a", 1), (True, None, "a", 1), (False, 1, "b", 1), (False, 2, "a", 1)]
