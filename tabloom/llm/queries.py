"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .registry import query

OP8_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op8_exact_topk", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import embeddings_top_k
    return embeddings_top_k(table(spark, sf_dir, "embeddings"))


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints
    return fingerprints(table(spark, sf_dir, "documents"))

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, greatest(len(w), 2))]) AS s
  FROM w WHERE len(w) > 0
), x AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles,
       least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.b, w.doc_id)) AS kept
FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""


@query("op1_minhash_near_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op2_lm_scores")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scores
    return scores(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import scan
    return scan(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def word_tokenizer() -> str:
    """Definition of the word BPE tokenizer (its path comes from the tokenizers' own package)."""
    import public_tokenizers

    from .packing import read_definition
    return read_definition(public_tokenizers.path("word_bpe_49k.json"))


@query("op5_retrieval_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import report
    return report(table(spark, sf_dir, "documents"))

OP3_SQL = r"""
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS p, coalesce(html, '') AS body, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
         regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages WHERE page_id IS NOT NULL
), c AS (
  SELECT p, body, tag, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '')
         || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '')) AS q FROM p)
), r AS (
  SELECT p * 3 AS id, url, p * 10 + 86400 AS ts, 'response' AS kind, tag AS etag, p, body, tag FROM c
  UNION ALL SELECT p * 3 + 1, url, p * 10 + 172800, 'again', tag, p, body, tag FROM c
  UNION ALL SELECT p * 3 + 2, url, CASE WHEN p % 11 = 5 THEN p * 10 ELSE p * 10 + 259200 END, 'odd',
         CASE WHEN p % 7 = 3 THEN '"other"' WHEN p % 7 = 4 THEN NULL ELSE tag END, p, body, tag FROM c
), f AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN id END IGNORE NULLS) OVER
    (PARTITION BY url ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM r
), j AS (
  SELECT f.*, s.tag AS stag, s.body AS sbody, s.ts AS sts,
         CASE WHEN f.kind = 'response' THEN 'response' WHEN f.ref IS NULL THEN 'orphan' WHEN f.etag IS NULL THEN 'unchecked'
              WHEN f.etag = s.tag THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM f LEFT JOIN r s ON f.kind <> 'response' AND s.id = f.ref
)
SELECT id AS record_id, url AS canonical_url, outcome, CASE WHEN kind <> 'response' THEN ref END AS refers_to,
  CASE WHEN kind = 'response' THEN 'cache-control: max-age=60|content-length: ' || strlen(body) ||
            '|content-type: text/html|date: d' || ts || '|etag: ' || tag
       WHEN outcome IN ('resolved', 'unchecked') THEN
            'cache-control: ' || CASE WHEN kind = 'again' THEN 'max-age=120' ELSE 'max-age=60' END ||
            '|content-length: ' || strlen(sbody) || '|content-type: text/html|date: ' ||
            CASE WHEN kind = 'again' THEN 'd' || ts WHEN etag IS NULL THEN 'later' ELSE 'd' || sts END ||
            '|etag: ' || CASE WHEN kind = 'again' THEN 'W/' || tag WHEN etag IS NULL THEN stag ELSE etag END ||
            CASE WHEN kind = 'odd' AND etag IS NOT NULL THEN '|expires: never' ELSE '' END
       WHEN kind = 'again' THEN 'cache-control: max-age=120|content-length: 0|date: d' || ts || '|etag: W/' || tag
       WHEN p % 7 = 3 THEN 'date: later|etag: "other"'
       WHEN p % 7 = 4 THEN 'date: later|server: x' ELSE 'etag: ' || tag || '|expires: never' END AS headers,
  CASE WHEN kind = 'response' THEN md5(body) WHEN outcome IN ('resolved', 'unchecked') THEN md5(sbody) END AS payload_md5,
  CAST(CASE WHEN kind = 'response' THEN strlen(body) WHEN outcome IN ('resolved', 'unchecked') THEN strlen(sbody) ELSE 0 END
       AS BIGINT) AS payload_bytes
FROM j
"""


@query("op3_warc_revisits", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import resolved_pages
    return resolved_pages(table(spark, sf_dir, "pages"))


@query("op9_piece_sampling")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations without replacement of every document."""
    import public_tokenizers

    from .pieces import sample_encode
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto = f.read()
    return sample_encode(table(spark, sf_dir, "documents"), proto, ("doc_id",), digest=True)


OP11_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE doc_id IS NOT NULL AND len(w) >= 20)
), m AS (SELECT g, min({'d': doc_id, 'i': i}) AS m FROM g GROUP BY g HAVING count(*) > 1
), c AS (
  SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 20)) AS j FROM g JOIN m USING (g) WHERE {'d': doc_id, 'i': i} > m)
), k AS (
  SELECT w.r, w.doc_id, x.i, x.w, c.j IS NOT NULL AS gone
  FROM (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM w) x JOIN w ON w.r = x.r LEFT JOIN c ON c.r = x.r AND c.j = x.i
), s AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM k GROUP BY r
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON s.r = w.r
"""


@query("op11_substring_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompress import report
    return report(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i, (VALUES (1), (2), (3), (4)) t(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30),
x AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * x.a // (l.f + r.f) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.k = x.cut AND l.phrase = array_to_string(x.w[1:x.cut], ' ')
         JOIN f r ON r.lang = x.lang AND r.k = x.k - x.cut AND r.phrase = array_to_string(x.w[x.cut + 1:x.k], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
y AS (SELECT lang, w, a, k, unnest(range(2, k)) AS m FROM c),
h AS (
  SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM y) GROUP BY ALL
), r AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score,
         row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.held IS NULL OR 100 * h.held < 80 * b.a
)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations
    out = collocations(table(spark, sf_dir, "documents"))
    return out.withColumn("rank", out["rank"].cast("long"))


OP13_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), m AS (
  SELECT t.r, part,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.toxic = 1) AS bad FROM t
), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.l <> a.l JOIN f c ON c.l NOT IN (a.l, b.l) JOIN f d ON d.l NOT IN (a.l, b.l, c.l)
           JOIN f e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier FROM o, range(1, 6) x(step)),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY ALL),
h AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & bit = 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM g, (SELECT filter_order, step, bit, CAST(earlier AS INTEGER) AS earlier FROM s) GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM h
"""


@query("op13_filter_interactions", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .retraction import audit
    return audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
