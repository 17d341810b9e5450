"""Language model, toxicity, secret scan and the pipeline."""
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from conftest import DOCS, make_words, text_rows


def test_base_scores_brute_force(docs, odd_docs, no_docs, monkeypatch):
    from tabloom.llm import lm
    rows = text_rows()
    words = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), h, len(ws), sum(c[w] > 0 for w in ws), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6))
                  for (d, _), ws, h in zip(rows, words, held))
    for top in (lm.TOP_WORDS, 3):
        monkeypatch.setattr(lm, "TOP_WORDS", top)
        got = lm.scores(odd_docs if top == 3 else docs).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["train_tokens"] == n and r["score"] <= 0 for r in got)
    assert lm.scores(no_docs).collect() == []


def test_model_probabilities_sum_to_one_at_most(llm):
    from tabloom.llm import lm
    from tabloom.llm.common import WordHash
    rows = [(" ".join(make_words(i, 200, 60)),) for i in range(30)]
    model, _, n, v = lm.train(llm.createDataFrame(rows, "text string"))
    hashes = WordHash()
    vocabulary = sorted({w for (t,) in rows for w in t.encode().split()})
    for context in vocabulary[:10]:
        h = np.array([x for w in vocabulary for x in (hashes[context], hashes[w], lm.END)] + [hashes[context], lm.END], np.uint64)
        p = 10 ** model.log_probs(h, np.array([3] * len(vocabulary) + [2]))
        total = p[1:-2:3].sum() + p[-1]
        assert 0.7 < total < 1.02


def test_scores_past_the_broadcast_keep_every_bigram(docs):
    from tabloom.llm import lm
    def by_row(got):
        return sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got.collect())
    kept, past = by_row(lm.scores(docs)), by_row(lm.scores(docs, max_shards=0))
    assert [r[:2] for r in past] == [r[:2] for r in kept]
    # the same counts, but for the false positives of the filter
    assert np.allclose([r[2] for r in past], [r[2] for r in kept], rtol=0.01)


def test_scores_past_the_broadcast_by_brute_force(docs, monkeypatch):
    from tabloom.llm import lm
    from tabloom.llm.common import WordHash
    rows, hashes = text_rows(), WordHash()
    flat = [[hashes[w] for w in (t or "").encode().lower().split()] + [lm.END] for _, t in rows]
    pairs = [[(a >> 32, b & 0xFFFFFFFF) for a, b in zip([lm.START, *h], h)] for h in flat]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    one = Counter(w for h, x in zip(flat, held) if not x for w in h)
    two = Counter(p for ps, x in zip(pairs, held) if not x for p in ps)
    v1, v2 = lm.values(lm.B1), lm.values(lm.B2)
    level = lambda c, base: int(1 + np.floor(np.log(c) / np.log(base) + 1e-9)) if c else 0
    t, u = Counter(), Counter()
    for (a, b), c in two.items():
        t[a] += int(v2[level(c, lm.B2)])
        u[a] += 1
    n1, n2 = (sum(c == k for c in two.values()) for k in (1, 2))
    d, total = n1 / (n1 + 2 * n2), sum(v1[level(c, lm.B1)] for c in one.values()) + len(one) + 1

    def score(h, ps):
        out = 0.0
        for w, (a, b) in zip(h, ps):
            p1 = (v1[level(one[w], lm.B1)] + 1) / total
            top, k = v1[level(t[a], lm.B1) + 1], v1[level(u[a], lm.B1)]
            out += np.log10(min(1.0, max(v2[level(two[a, b], lm.B2)] - d, 0) / top + d * k / top * p1 if u[a] else p1))
        return round(out, 6)

    want = sorted((str(i), len(h), score(h, ps)) for (i, _), h, ps in zip(rows, flat, pairs))
    for chunk, shard in ((lm.CHUNK_TOKENS, lm.SHARD_TOKENS), (500, 200), (3000, 8)):  # shards by the word alone, and by context too
        monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
        monkeypatch.setattr(lm, "SHARD_TOKENS", shard)
        got = lm.scores(docs, max_shards=0).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["score"], 6)) for r in got) == want


def test_scores_past_the_broadcast_write_no_row_per_document_and_bigram(llm, monkeypatch):
    """What is written on the way: 3 bytes a token (17 with lists of every document's bigrams)."""
    import os
    from tabloom.llm import lm
    rows = [(i, " ".join(make_words(300 + i, 600, 3000)), "en", "s", None) for i in range(150)]
    written, cut = [], lm.cut

    def weighed(df, name):
        out = cut(df, name)
        written.extend(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(lm, "cut", weighed)
    assert lm.scores(llm.createDataFrame(rows, DOCS).repartition(2), max_shards=0).count() == 150
    assert sum(written) < 8 * 150 * 601


def test_spread_keys_come_back():
    from tabloom.llm import lm
    from tabloom.llm.common import mix, pack_sorted, unpack_sorted
    key = np.r_[mix(np.arange(5000, dtype=np.uint64)), np.array([0, 2 ** 64 - 1], np.uint64)]
    for bits in (1, 3, 4, 5, 11, 16):
        out = lm._spread(key, bits)
        assert (lm._gather(out, bits) == key).all()
        out.sort()
        assert (unpack_sorted(pack_sorted(out), len(out)) == out).all()
        ends = lm._cuts(out, bits)
        assert ends[0] == 0 and ends[-1] == len(out) and len(ends) == (1 << bits) + 1
        assert all(len(set((out[lo:hi] >> np.uint64(64 - bits)).tolist())) <= 1 for lo, hi in zip(ends[:-1], ends[1:]))


def test_word_levels_are_a_tenth_apart():
    from tabloom.llm import lm
    v = lm.values(lm.B1, 120)
    v = v[v > 1000]
    assert (v[1:] / v[:-1]).max() < 1.11


def test_filter_counts_never_too_low(llm):
    from tabloom.llm import bloom
    from tabloom.llm.common import mix
    rows = [(i * 7919, 1 + i % 9) for i in range(20_000)]
    f = bloom.build(llm.createDataFrame(rows, "k long, q int"), 1, lambda k: mix(k.view(np.uint64)))
    k, q = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])
    got = f.count_levels(mix(k))
    assert (got >= q).all() and (got == q).mean() > 0.98
    assert (f.count_levels(mix(k + np.uint64(1))) > 0).mean() < 0.02


def labelled(llm, n=600):
    r = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = make_words(2000 + i, int(r.integers(20, 200)), 5000)
        if toxic:
            w = [x if r.random() > 0.1 else str(r.choice(["vile", "Nasty,", "wretch"])) for x in w] + ["vile"]
        rows.append((i, " ".join(w), "en", "s", None))
        if i % 2 == 0 or toxic:
            labels.append((i, 0, int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", "", "", 0), (None, "vile nasty", "en", "s", 3)]
    labels += [(n, 0, 0), (None, 1, 1), (n + 7, 1, None)]
    return (llm.createDataFrame(rows, DOCS).repartition(3),
            llm.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_held_out(llm, no_docs):
    from tabloom.llm.toxicity import drop_toxic, toxicity
    docs, labels = labelled(llm)
    got = toxicity(docs, labels).collect()
    assert len(got) == 603
    y = {i: i % 6 == 0 for i in range(600)}
    held = [r for r in got if r["held_out"] and r["doc_id"] in y]
    assert len(held) > 80 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (600, 601)}
    assert len(blank) == 1 and blank.pop() < 0.5
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 480 <= kept.count() <= 520
    # other labels of held-out rows change nothing
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert {(r["doc_id"], r["score"]) for r in toxicity(docs, flipped).collect()} == {(r["doc_id"], r["score"]) for r in got}
    none = toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 603 and all(r["score"] == 0.0 for r in none)
    assert toxicity(no_docs, labels).collect() == []


def test_no_example_of_one_class_rejects_nothing(llm):
    """Only toxic labels, and a label of the other class whose document is absent."""
    from tabloom.llm.toxicity import drop_toxic, toxicity
    docs = llm.createDataFrame([(i, f"plain words number {i} here", "en", "s", 9) for i in range(1, 21)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for rows in ([(1, 0, 1), (2, 0, 1)], [(1, 0, 1), (999, 0, 0)], [(999, 0, 1), (2, 0, 0)], [(3, 1, 0)]):
        labels = llm.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert drop_toxic(docs, labels).count() == 20
        assert {(r["score"], r["predicted"]) for r in toxicity(docs, labels).collect()} == {(0.0, 0)}


def test_copies_of_toxic_examples_without_telling_words(llm):
    from tabloom.llm.toxicity import drop_toxic, toxicity
    docs, labels = labelled(llm)
    own = {i: " ".join("own%dx%d" % (i, j) for j in range(40)) for i in range(5000, 5020)}  # words of one example each
    more = llm.createDataFrame([(i + k, t, "en", "s", None) for i, t in own.items() for k in (0, 1000)], DOCS)
    docs = docs.union(more)
    labels = labels.union(llm.createDataFrame([(i, 0, 1) for i in own], labels.schema))
    used = {i for i in own if zlib.crc32(str(i).encode()) % 5}
    got = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    for i in used:
        assert i in got[i + 1000]["neighbours"] and got[i + 1000]["cosines"][0] == 1.0
    assert all(got[i + 1000]["score"] > got[600]["score"] for i in used)
    assert used and not used & {r["doc_id"] - 1000 for r in drop_toxic(docs, labels).collect() if (r["doc_id"] or 0) > 5999}


def test_term_ids_keep_no_copy_of_the_vocabulary():
    import tracemalloc
    from collections import Counter
    from tabloom.llm.toxicity import TermIds, terms_of
    text = "The cat, the CAT and catalogues: abc*d naïveté naïve x ##"
    every = sorted({t for w in text.encode().lower().split() for t in terms_of(w)})
    big = np.unique(np.r_[np.arange(300_000), np.array(every[::2], np.int64)])
    tracemalloc.start()
    try:
        ids = TermIds(big)
        got = ids.counts([text, None, "", "cat unknown cat", text])
        assert tracemalloc.get_traced_memory()[1] < 1 << 20  # a dict of the vocabulary takes some 30 MB
    finally:
        tracemalloc.stop()
    for t, (term, n) in zip([text, "", "", "cat unknown cat", text], got):
        want = Counter(h for w in t.encode().lower().split() for h in terms_of(w) if h in set(every[::2]))
        assert dict(zip(big[term].tolist(), n.tolist())) == want and (np.diff(term) > 0).all()
    ids.limit = 1
    again = ids.counts([text])[0]  # emptied before the batch
    assert [x.tolist() for x in again] == [x.tolist() for x in got[0]]


def test_sent_model_holds_arrays_and_finds_the_same():
    """What is broadcast is no pickle of the model beside the model, and blocks scored all at once give the same cosines."""
    from tabloom.llm.toxicity import Index, Model
    r = np.random.default_rng(8)
    sizes = r.integers(1, 40, 700)
    term = np.concatenate([r.choice(3000, n, replace=False) for n in sizes])
    idf = r.random(3000) + 0.5
    model = Model(np.arange(3000), idf, Index((term, r.integers(1, 5, len(term)), sizes), np.arange(700), np.zeros(700, int), 3000, idf),
                  0.5, (1.0, 1.0))

    class Context:
        broadcast = staticmethod(lambda value: value)

    class Session:
        sparkContext = Context
    value = model.send(Session)
    assert model.send(Session) is value and not any(isinstance(x, (bytes, Model, Index)) for x in value)
    sent = Model.received(value)
    queries = [model.vector(r.choice(3000, 30, replace=False), r.integers(1, 5, 30)) for _ in range(40)]
    dense = np.zeros((700, 3000))
    begin = np.r_[0, np.cumsum(sizes)]
    for i, at in enumerate(model.index.ids):
        dense[i, term[begin[at]: begin[at + 1]]] = 1
    for t, w in queries:
        a, b = model.index.nearest((t, w), 9), sent.index.nearest((t, w), 9)
        assert a == b and len(a[0]) == min(9, int((dense[:, t].sum(axis=1) > 0).sum()))
        assert all(dense[i, t].any() for i in a[0])


def test_neighbours_are_exact():
    from tabloom.llm.toxicity import Index
    r = np.random.default_rng(2)
    vec = []
    for _ in range(500):
        t = r.choice(40, r.integers(0, 6), replace=False)
        w = r.random(len(t)) + 0.1
        vec.append(dict(zip(t.tolist(), (w / np.sqrt((w * w).sum())).tolist())) if len(t) else {})
    ids = np.arange(500) * 3
    index = Index(vec, ids, np.zeros(500, int), 40)
    for q in vec[:60]:
        if q:
            at, sim = index.nearest(q, 7)
            all_sim = [sum(w * v.get(t, 0) for t, w in q.items()) for v in vec]
            want = sorted(((-s, i) for s, i in zip(all_sim, ids) if s > 0))[:7]
            assert np.allclose(sim, [-w[0] for w in want])
            assert sorted(np.round(sim, 9)) == sorted(np.round([-w[0] for w in want], 9))


def secret_docs(llm):
    r = np.random.default_rng(4)
    rows = []
    for i in range(400):
        w = make_words(3000 + i, 60)
        s = "".join(r.choice(list("0123456789abcdef"), 40))
        if i % 4 == 0:
            w[30:30] = ["token", "=", f'"{s}"']
        if i % 50 == 1:
            w[20:20] = ["AKIA" + "".join(r.choice(list("ABCDEFGH234567"), 16))]
        if i % 50 == 2:  # no pattern matches this one
            w[20:20] = ["token", "=>", '"' + s[:20].upper() + s[20:28] + '"']
        rows.append((i, " ".join(w), "en", "s", None))
    rows += [(900, None, "en", "s", None), (901, "", "en", "s", 0), (902, "PASSWORD: short", None, None, None),
             (903, "paſſword: longer-than-eight", None, None, None), (None, "api_key='abcdefgh12345'", None, None, None)]
    return rows, llm.createDataFrame(rows, DOCS).repartition(3)


def test_secrets_base_and_field(llm, no_docs):
    from tabloom.llm.secretscan import KINDS, redact, scan
    rows, docs = secret_docs(llm)
    got = {r["doc_id"]: r for r in scan(docs).collect()}
    assert len(got) == len(rows)
    pats = (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
            re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"))
    for i, t, *_ in rows:
        base = []
        for k, (p, least) in enumerate(zip(pats, (8, 16, 32))):
            for m in p.finditer(t or ""):
                if len(m.group(2) if k == 0 else m.group()) >= least:
                    base.append((m.start(), k, m.end()))
        text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base))
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("crf")] == [s for s in text.split(",") if s]
    assert sum(r["n_crf"] for i, r in got.items() if i is not None and i % 50 == 2 and i < 400) >= 4  # the field's own finds
    assert sum(r["n_crf"] for i, r in got.items() if i is not None and i % 50 != 2 and i < 900) == 0
    out = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert 'token = "[SECRET]"' in out[0] and "AKIA" not in out[1] and out[901] == "" and out[None] == "api_key='[SECRET]'"
    assert scan(no_docs).collect() == []


def test_viterbi_on_stretches_equals_whole_text():
    from tabloom.llm.secretscan import Classes, Field, decode
    r = np.random.default_rng(8)
    f = Field()
    for k in f.w:
        f.w[k] = r.normal(size=f.w[k].shape)
    f.w["cur"][:, 0] += 0.4
    classes = Classes()
    texts = [make_words(i, n) for i, n in enumerate([0, 1, 2, 40, 300])] + [["=", "token", '"aB3dE5fG7h"', "x"]]
    cs = [classes(t) for t in texts]
    tab = f.tables(classes.matrix())
    files = np.array([i % 8 for i in range(len(texts))])
    got = decode(f, tab, np.concatenate(cs), np.array([len(c) for c in cs]), files)
    want = []
    pad = len(tab["cur"]) - 1
    for c, fl in zip(cs, files):
        if len(c):
            e = np.concatenate([[pad, pad], c, [pad]]).astype(int)
            sc = tab["cur"][c] + tab["p1"][e[1:-2]] + tab["p2"][e[:-3]] + tab["n1"][e[3:]] + f.w["file"][fl]
            want.append(f.viterbi(sc, None, None))
    assert (got == np.concatenate(want)).all()


def test_pipeline_stages(llm, tmpdir_path):
    import corpus_pipeline
    docs, labels = labelled(llm)
    rows, secret = secret_docs(llm)
    sec = secret.where("doc_id is not null").selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars")
    copies = docs.where("doc_id < 40").selectExpr("doc_id + 9000 as doc_id", "text", "lang", "source", "n_chars")
    docs.unionAll(sec).unionAll(copies).write.parquet(f"{tmpdir_path}/documents.parquet")
    labels.write.parquet(f"{tmpdir_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "secret_scan", "packing"]
    at = llm.read.parquet(f"{tmpdir_path}/documents.parquet")
    columns, sizes = at.columns, [at.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(llm, at, tmpdir_path).write.parquet(f"{tmpdir_path}/s{k}")
        at = llm.read.parquet(f"{tmpdir_path}/s{k}")
        if name != "packing":
            assert at.columns == columns
            sizes.append(at.count())
        if name == "near_dedup":
            assert at.where("doc_id >= 9000").count() == 0
        if name == "secret_scan":
            assert at.where("text like '%AKIA%'").count() == 0 and at.where("text like '%[SECRET]%'").count() >= 100
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    got = corpus_pipeline.run(llm, tmpdir_path)
    assert sorted(map(str, got.select("doc_id", "start", "length", "ids_crc32").collect())) == \
        sorted(map(str, at.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_toxicity_candidates_and_terms():
    """Cosines are those of a full product whatever the four-byte scores say (equal examples: smaller ids first), terms of
    many words are those of each, and what is laid out for queries stays below the eight-byte matrix of before."""
    from tabloom.llm.toxicity import Index, term_hashes, terms_of
    r = np.random.default_rng(12)
    n, terms = 1500, 4000
    full = np.where(r.random((n, terms)) < r.random(terms) ** 4 * 0.3, r.random((n, terms)) + 0.1, 0.0)
    full[700:1100] = full[700]  # a large group of copies
    full[1200] = full[1201] * (1 + 1e-7)  # apart by less than four bytes tell
    vec = [{int(t): float(x[t]) for t in np.flatnonzero(x)} for x in full]
    ids = r.permutation(n) * 2
    index = Index(vec, ids, np.zeros(n, int), terms)
    for i in (0, 5, 700, 900, 1200, 1201):
        sim = np.round(full @ full[i], 12)
        want = sorted((-s, j) for s, j in zip(sim, ids) if s > 0)[:15]
        at, got = index.nearest(vec[i], 15)
        assert np.allclose(got, [-s for s, _ in want], atol=1e-10) and [int(index.ids[a]) for a in at] == [j for _, j in want]
        at, _ = index.nearest(vec[i], 15, index.place[int(ids[i])])
        assert [int(index.ids[a]) for a in at] == [j for _, j in sorted((-s, j) for s, j in zip(sim, ids) if s > 0 and j != ids[i])[:15]]
    assert index.dense.dtype == np.float32 and index.weight.dtype == np.float32
    words = [b"Cat!", b"catalogue", "naïveté".encode(), "abcdé".encode(), b"##", b"x", b"abcdefghijk", b"\xff\xfeabc"]
    h, of = term_hashes(words)
    for i, w in enumerate(words):
        assert sorted(h[of == i].tolist()) == sorted(terms_of(w))
    assert len(set(terms_of("abcdé".encode())) & set(terms_of(b"abcdef"))) == 2  # abc*, abcd*
    assert len(terms_of(b"abcdefghijk")) == 6 and terms_of(b"##") == []


def test_lattice_cells_of_equal_rest_are_one_matrix():
    """Edges out of a place have probabilities in proportion to their weight times that of what follows; the cells of all
    places with as many characters left lie side by side, so that no pass gathers them."""
    import math
    import public_tokenizers
    from tabloom.llm.pieces import MARK, Lattices, Vocabulary
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        voc = Vocabulary(f.read(), 1.0)
    chunks = [MARK + "the", MARK + "extraordinarily", "x", MARK + "日本é", MARK * 3, MARK + "q" * 40, MARK + "then"]
    lat = Lattices(chunks, voc)
    weights = {}
    for i in range(voc.sp.get_piece_size()):
        if not (voc.sp.is_byte(i) or voc.sp.is_control(i) or voc.sp.is_unknown(i) or voc.sp.is_unused(i)):
            weights[voc.sp.id_to_piece(i)] = i
    first = min(weights.values())
    for c, begin in zip(chunks, lat.begin.tolist()):
        beta = [0.0] * (len(c) + 1)
        for at in range(len(c) - 1, -1, -1):
            edge = {n: -math.log(2 + weights[c[at: at + n]] - first) for n in range(1, min(len(c) - at, voc.most) + 1)
                    if c[at: at + n] in weights}
            edge.setdefault(1, voc.fallback)
            beta[at] = math.log(sum(math.exp(w + beta[at + n]) for n, w in edge.items()))
            got = lat.edges(begin + at)
            want = [edge[n] + beta[at + n] - beta[at] if n in edge else -math.inf for n in range(1, len(got) + 1)]
            assert np.allclose(got, want) and lat.last[begin + at] == max(edge) - 1
            assert abs(lat.cum[lat.cell(begin + at, len(got))] - 1) < 1e-5
            for n in edge:
                i = lat.ids[lat.cell(begin + at, n)]
                assert i == weights.get(c[at: at + n], -1)
    rest = np.concatenate([np.arange(len(c), -1, -1) for c in chunks])
    for r in range(1, rest.max() + 1):
        assert (np.diff(np.sort(lat.off[rest == r])) == 1).all()
