"""Near-duplicates, suffix ranks and fingerprints against brute force."""
import hashlib

import numpy as np
from conftest import text_rows


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def run_near(docs, width):
    from tabloom.llm.minhash import near_duplicates
    got = near_duplicates(docs, width=width).collect()
    for r in got:
        assert r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"])
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str)


def test_near_duplicates_brute_force(docs, odd_docs):
    for width in (2, 5):
        assert run_near(docs, width) == brute_components(text_rows(), width, 80)
    assert run_near(odd_docs, 5) == brute_components(text_rows(), 5, 80)


def test_near_duplicates_chain_and_hot_group(llm):
    # a chain whose ends are unlike, and many different near copies of one text
    from conftest import make_words
    from tabloom.llm.minhash import near_duplicates
    base = make_words(50, 100)
    rows = []
    for i in range(8):
        rows.append((100 + i, " ".join(["n%d" % j for j in range(3 * i)] + base[3 * i:])))
    other = make_words(51, 150)
    for i in range(150):
        t = list(other)
        t[i] = "edit%d" % i
        rows.append((500 + i, " ".join(t)))
    r = __import__("random").Random(3)
    for i in range(200):  # copies edited so much that many are unlike the middle one
        t = list(other)
        for _ in range(r.randrange(24)):
            t[r.randrange(150)] = "far%d" % r.randrange(10 ** 6)
        rows.append((2000 + i, " ".join(t)))
    df = llm.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2, 80)
    assert len({c for _, _, c in want}) > 20
    for block in (4096, 40):  # members of one key in one block, and in several
        got = near_duplicates(df, width=2, block=block).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_near_duplicates_bridged_by_a_row_without_id(llm):
    from conftest import make_words
    base = make_words(60, 100)
    rows = [(1, " ".join(base)), (None, " ".join(["a%d" % j for j in range(6)] + base[6:])),
            (2, " ".join(["a%d" % j for j in range(6)] + base[6:91] + ["b%d" % j for j in range(9)])), (3, "far off")]
    want = brute_components(rows, 2, 80)
    assert len({c for _, _, c in want}) == 2  # 1 and 2 meet only through the row without id
    assert run_near(llm.createDataFrame(rows, "doc_id long, text string"), 2) == want


def test_near_dedup_stage_repeated_ids(llm):
    from conftest import DOCS, make_words
    from corpus_pipeline import near_dedup
    base, clean, twice = make_words(61, 90), " ".join(make_words(62, 90)), " ".join(make_words(63, 90))
    near = " ".join(base[:89] + ["changed"])
    rows = [(1, " ".join(base)), (2, near), (2, clean), (3, twice), (3, twice), (None, clean + " more"), (None, None), (None, None)]
    docs = llm.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    got = near_dedup(llm, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == sorted(
        [("1", " ".join(base)), ("2", clean), ("3", twice), ("None", ""), ("None", "")])


def test_full_sets_are_fetched_for_likely_pairs_only(llm):
    """Classes that share a key by chance go no further than their signatures; a pair counts under its first key."""
    from tabloom.llm.minhash import PERMS, joining_links, with_partner
    near = [bytes([1] * 2 * PERMS), bytes([1] * (2 * PERMS - 10) + [9] * 10)]
    rows = [(7, 6, 1, 1, 10, [5, 7, 8], near[0]), (7, 6, 2, 2, 10, [4, 7, 8], near[1])]  # alike, in two components
    rows += [(7, 6, d, d, 10, [d * 10, 7, d * 11], bytes([d] * 2 * PERMS)) for d in (3, 4, 5)]  # unrelated
    rows += [(7, 6, 6, 2, 10, [d, 7, 3], near[1]) for d in (99,)]  # alike with 1 too
    rows += [(8, 2, *r[2:]) for r in rows[:2]]  # the same pair under another key
    members = llm.createDataFrame(rows, "key long, m long, digest long, root long, n int, bands array<long>, sig binary")
    sets = llm.createDataFrame([(1, list(range(10))), (2, list(range(1, 11))), (6, list(range(50, 60)))], "digest long, s array<long>")
    for block in (1024, 2):
        got = with_partner(members, 80, block).collect()
        assert {(r["key"], r["digest"]) for r in got} == {(7, 1), (7, 2), (7, 6)}
        assert {(r["a"], r["b"]) for r in joining_links(members, sets, 80, block).collect()} == {(1, 2)}


def test_likely_rows_lose_no_wanted_one(llm):
    from tabloom.llm.common import likely
    rows = llm.createDataFrame([(i, str(i)) for i in range(-3000, 3000)] + [(None, "none"), (7, "again")], "doc_id long, Part string")
    wanted = llm.createDataFrame([(i,) for i in range(-2999, 3000, 50)] + [(7,), (1 << 60,)], "doc_id long")
    have = {r["doc_id"] for r in wanted.collect()}
    for bits, most in ((26, 10), (16, 200)):
        got = likely(rows, wanted, "doc_id", bits)
        assert got.columns == rows.columns
        got = [(r[0], r[1]) for r in got.collect()]
        assert {x for x in got if x[0] in have} == {(r[0], r[1]) for r in rows.collect() if r[0] in have}
        assert len(got) == len(set(got)) and sum(x[0] not in have for x in got) <= most
    assert likely(rows, wanted.limit(0), "doc_id").collect() == []


def test_near_duplicates_empty(no_docs):
    assert run_near(no_docs, 2) == []


def brute_repeats(rows, length=50):
    out = []
    where = {}
    for d, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            if d is not None:
                w = b[j:j + length]
                where[w] = min(where.get(w, d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if d is not None and where[b[j:j + length]] < d:
                gone[j:j + length] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_suffix_ranks_brute_force(docs, odd_docs, no_docs):
    from tabloom.llm.suffixes import report
    want = brute_repeats(text_rows())
    for d in (docs, odd_docs):
        assert sorted((tuple(r) for r in report(d).collect()), key=str) == want
    assert report(no_docs).collect() == []


def test_suffix_ranks_common_passage(llm, monkeypatch):
    """Ranks above the bound for sorted runs are aggregated instead; the result is the same."""
    from conftest import make_words
    from tabloom.llm import suffixes
    passage = " ".join(make_words(9, 30))
    rows = [(i, " ".join(make_words(1000 + i, 20)) + (" " + passage + " ") * (i % 3) + "ä" * i) for i in range(60)]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    assert sorted((tuple(r) for r in suffixes.report(df).collect()), key=str) == want
    monkeypatch.setattr(suffixes, "HOT_FLOOR", 5)
    assert sorted((tuple(r) for r in suffixes.report(df).collect()), key=str) == want


def test_drop_repeats_keeps_columns(odd_docs):
    from tabloom.llm.suffixes import drop_repeats
    out = drop_repeats(odd_docs)
    assert out.columns == odd_docs.columns
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()}
    assert (4, None, None) in got and (5, "", 0) in got and (6, "one", 3) in got
    assert all(r[0] != 2 for r in got)  # nothing of the exact copy is left


def test_fingerprints_brute_force(docs, odd_docs, no_docs):
    from tabloom.llm.fingerprint import fingerprints
    rows = [(d, t or "") for d, t in text_rows()]
    got = fingerprints(docs).collect()
    assert len(got) == len(rows)
    unique = [r for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1]
    by_id = {r["doc_id"]: r for r in got}
    order = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    text = dict(unique)
    for d, t in unique:
        at = order.index(d)
        if at + 1 < len(order) and order[at + 1] in text:
            half = len(t) // 2
            edited = t[:len(t) - half] + text[order[at + 1]][:half]
            assert by_id[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), d
        assert by_id[d]["n_chars"] == len(t) and 0 <= by_id[d]["near_edited"] <= 1 and 0 <= by_id[d]["near_next"] <= 1
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] and by_id[2]["near_next"] == 1.0
    assert sorted(map(str, fingerprints(odd_docs).collect())) == sorted(map(str, got))
    assert fingerprints(no_docs).collect() == []


def test_fingerprint_ring_over_buckets(llm):
    from tabloom.llm.fingerprint import with_next
    rows = [(i * 3, f"text {i} of many words here") for i in range(200)]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in with_next(df, bucket_rows=16).collect()}
    text = dict(rows)
    assert all(got[d] == text[d - 3 if d else 199 * 3] for d in text)


def test_sketch_keeps_a_fixed_fraction(llm):
    """The estimate of containment follows the true share; sketches merge by union."""
    from conftest import make_words
    from pyspark.sql import functions as F
    from tabloom.llm.fingerprint import containment, sketch
    a, b = make_words(70, 400, 10 ** 6), make_words(71, 20_000, 10 ** 6)
    df = llm.createDataFrame([(" ".join(a), " ".join(b[:10_000] + a[:200] + b[10_000:]))], "a string, b string")
    r = df.select(sketch(F.col("a")).alias("a"), sketch(F.col("b")).alias("b")).select(
        containment(F.col("a"), F.col("b")).alias("c"), F.size("b").alias("n")).first()
    assert 0.35 < r["c"] < 0.65 and 0.2 < r["n"] / 20_196 < 0.3
