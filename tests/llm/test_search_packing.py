"""Exact search, packing, revisits and piece sampling against brute force or exact round trips."""
import math
import zlib

import numpy as np
from conftest import text_rows


def test_top_k_brute_force(llm):
    from tabloom.llm.topk import embeddings_top_k, quantise, top_k
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(700, None), (701, [1.0, None] + [0.0] * 6), (702, [float("nan")] * 8), (703, [float("inf")] * 8),
             (None, [1.0] * 8), (750, [])]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v is not None and
            all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 50 == 0:
            n = min
            s = sorted((-int(sum(a * b for a, b in zip(q, v))), j) for j, v in good if j != i)[:5]
            want += [(i, k + 1, j, -t) for k, (t, j) in enumerate(s)]
    assert sorted(map(tuple, embeddings_top_k(df).collect())) == sorted(want)
    v = quantise(df)
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    assert sorted(map(tuple, top_k(q, v, 5, group_rows=64).collect())) == sorted(want)
    assert embeddings_top_k(df.limit(0)).collect() == []
    one = llm.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embeddings_top_k(one).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]


def check_packing(rows, got, window=2048):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(d), zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))
                  for d, t in rows)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    total = 0
    for r in got:
        total += r["length"]
        assert any(len(x) == r["doc_tokens"] and
                   zlib.crc32(x[r["start"]: r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert total == sum(len(x) for v in ids.values() for x in v) and len(want) == len(rows)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == window or (at < window and at & (at - 1) == 0)


def test_packing_round_trip(docs, odd_docs, no_docs):
    from tabloom.llm.packing import pack
    from tabloom.llm.queries import word_tokenizer
    check_packing(text_rows(), pack(docs, word_tokenizer()).collect())
    check_packing(text_rows(), pack(odd_docs, word_tokenizer(), shard_docs=7).collect())
    assert pack(no_docs, word_tokenizer()).collect() == []


def test_chunk_ids_equal_whole_texts():
    import public_tokenizers
    from tabloom.llm.packing import ChunkIds
    from tabloom.llm.queries import word_tokenizer
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    c = ChunkIds(word_tokenizer())
    for t in ["", "  a\tB  c\n", "a\x1cb\x85c\xa0d <|endoftext|>x<|startoftext|>", "İSTANBUL ΣΑΣ e ́x I'LL 's",
              "x" * 5000, "　wide space here"]:
        chunks = t.encode().split()
        c.add(set(chunks))
        assert b"".join(c[w] for w in chunks) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_prefers_lexical_neighbours():
    from tabloom.llm.packing import pack_shard
    r = np.random.default_rng(1)
    topics = [r.integers(1000 * k, 1000 * k + 40, 300).astype("<u2") for k in range(1, 5) for _ in range(6)]
    order = list(r.permutation(len(topics)))
    windows = pack_shard([topics[i] for i in order], window=1800)
    same = [len({order[d] // 6 for d, _, _ in w}) for w in windows]
    assert same == [1, 1, 1, 1]


def test_packing_deals_copies_to_one_shard(llm):
    from conftest import make_words
    from tabloom.llm.packing import pack
    from tabloom.llm.queries import word_tokenizer
    rows = [(i + k, " ".join(make_words(700 + i, 60, 5000))) for i in range(150) for k in (0, 1000)]
    got = pack(llm.createDataFrame(rows, "doc_id long, text string"), word_tokenizer(), shard_docs=30).collect()
    check_packing(rows, got)
    shard = {r["doc_id"]: r["sequence_id"] >> 32 for r in got}
    assert set(shard.values()) == set(range(10))
    assert sum(shard[i] == shard[i + 1000] for i in range(150)) > 130


def brute_revisits(rows):
    from_url = {"http://www.A.org:80/x/#f": "a.org/x", "https://a.org/x": "a.org/x", "b.org/?z=1&a=2": "b.org?a=2&z=1", None: ""}
    out = {}
    for rec in rows:
        i, u, ts, kind, status, h, p = rec
        if kind != "revisit":
            out[i] = ("response", None, p)
            continue
        prior = [x for x in rows if x[3] == "response" and x[4] == 200 and from_url[x[1]] == from_url[u]
                 and (x[2] if x[2] is not None else -1e99, x[0]) < (ts if ts is not None else -1e99, i)]
        if not prior:
            out[i] = ("orphan", None, None)
            continue
        s = max(prior, key=lambda x: (x[2], x[0]))
        h = {k.lower(): v for k, v in (h or {}).items()}
        sh = {k.lower(): v for k, v in (s[5] or {}).items()}
        if "etag" in h:
            o = "resolved" if h["etag"].removeprefix("W/") == (sh.get("etag") or "").removeprefix("W/") else "mismatch"
        elif "last-modified" in h:
            o = "resolved" if h["last-modified"] == sh.get("last-modified") else "mismatch"
        else:
            o = "unchecked"
        out[i] = (o, s[0], s[6] if o != "mismatch" else None)
    return out


def test_revisits_brute_force(llm):
    from tabloom.llm.warc import resolve_revisits
    urls = ["http://www.A.org:80/x/#f", "https://a.org/x", "b.org/?z=1&a=2", None]
    r = np.random.default_rng(3)
    rows = []
    for i in range(300):
        kind = "response" if r.random() < 0.3 else "revisit"
        h = {"ETag": str(r.choice(['"a"', 'W/"a"', '"b"'])), "Server": "s"} if r.random() < 0.5 else \
            {"Last-Modified": str(r.integers(3)), "Date": str(i)} if r.random() < 0.8 else None
        rows.append((i, urls[r.integers(4)], int(r.integers(60)), kind, 200 if r.random() < 0.9 else 404, h, f"body {i}"))
    df = llm.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, "
                                   "payload string")
    want = brute_revisits(rows)
    for size in (1_000_000, 20):
        got = {x["record_id"]: x for x in resolve_revisits(df, slice_rows=size).collect()}
        assert len(got) == 300
        for i, (o, ref, p) in want.items():
            assert (got[i]["outcome"], got[i]["refers_to"]) == (o, ref), (i, size)
            if o in ("resolved", "unchecked"):
                assert got[i]["payload"] == p
                assert got[i]["headers"].get("date") == (rows[i][5] or {}).get("Date", ({k.lower(): v for k, v in (rows[ref][5] or {}).items()}).get("date"))
    assert resolve_revisits(df.limit(0)).collect() == []


def test_piece_sampling_exact_distribution():
    import public_tokenizers
    from tabloom.llm.pieces import Vocabulary, sample_texts
    voc = Vocabulary(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read(), 1.0)
    n = 6000
    got = sample_texts(["the cat"] * n, np.arange(n, dtype=np.uint64), 3, voc)
    p = {tuple(y[0].tolist()): math.exp(y[1]) for x in got for y in x}
    assert abs(sum(p.values()) - 1) < 1e-4
    assert all(len({tuple(y[0].tolist()) for y in x}) == 3 for x in got)
    assert all(x[0][2] >= x[1][2] >= x[2][2] for x in got)
    for s, q in p.items():
        first = sum(tuple(x[0][0].tolist()) == s for x in got) / n
        second = sum(tuple(x[1][0].tolist()) == s for x in got) / n
        assert abs(first - q) < 0.03
        assert abs(second - sum(a * q / (1 - a) for t, a in p.items() if t != s)) < 0.03
    # inclusion scores: the inverse-weighted sum of probabilities estimates one
    two = sample_texts(["the cat"] * n, np.arange(n, dtype=np.uint64), 2, voc)
    assert abs(np.mean([sum(math.exp(y[1]) / y[3] for y in x) for x in two]) - 1) < 0.05


def test_piece_sampling_frees_its_lattices():
    """Lattices of a part go when it is done, without a collection of reference cycles."""
    import gc
    import public_tokenizers
    from tabloom.llm.pieces import Lattices, Vocabulary, sample_texts
    voc = Vocabulary(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read(), 1.0)
    gc.collect()
    gc.disable()
    try:
        got = sample_texts(["the cat sat", "", "on the mat"], np.arange(3, dtype=np.uint64), 2, voc)
        assert [len(x) for x in got] == [2, 1, 2]
        assert not any(isinstance(x, Lattices) for x in gc.get_objects())
    finally:
        gc.enable()


def test_piece_sampling_round_trip(docs, odd_docs, no_docs):
    import public_tokenizers
    from tabloom.llm.pieces import decode, sample_encode
    proto = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    got = decode(sample_encode(docs, proto, ("doc_id",)), proto).collect()
    want = [(d, t or "") for d, t in text_rows()]
    assert {(r["doc_id"], r["decoded"]) for r in got} == set(want)
    assert sum(r["sample"] == 1 for r in got) == len(want)
    again = sample_encode(odd_docs.repartition(5), proto, ("doc_id",)).collect()
    key = lambda r: (str(r["doc_id"]), r["sample"], tuple(r["ids"]))
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert sample_encode(no_docs, proto, ("doc_id",)).collect() == []
    short = [r for r in got if r["doc_id"] in (4, 5)]
    assert len(short) == 2 and all(r["inclusion"] == 1.0 and len(r["ids"]) == 0 for r in short)
