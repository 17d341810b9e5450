"""Document fingerprints: threshold-scaled sketches (DataFrame functions only).

A text's shingles are its distinct five-word sequences (fewer words: the whole sequence); the sketch
keeps every shingle hash in the lowest ``fraction`` of the 64-bit range.  The threshold does not
depend on the document, so sketches merge by set union, and containment can be estimated between
texts of very unequal length.  Null texts count as empty; an empty sketch is like another empty
sketch exactly when the texts are equal (1.0, else 0.0).

``edited_pairs`` orders the documents by descending id without a global window: rows are dealt to id
ranges (edges from approximate percentiles, ``buckets`` bounded by ``max_buckets``), the neighbour is
taken inside a range, and the last row of a range takes the first row of the next one (one row per
range).  Ties of the id are ordered by a hash of the text; null ids come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRACTION = 0.25
WIDTH = 5


def sketch(text: Column, fraction: float = FRACTION, width: int = WIDTH) -> Column:
    """Sorted distinct shingle hashes below ``fraction`` of the range (array of long)."""
    limit = -(1 << 63) + int(fraction * (1 << 64))
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.greatest(F.size(h) - (width - 1), F.least(F.size(h), F.lit(1)))
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))

    # a one-element array binds the word hashes to a lambda variable: they are computed once per row
    kept = F.flatten(F.transform(F.array(hashes), lambda h: F.filter(shingles(h), lambda s: s < F.lit(limit))))
    return F.array_sort(F.array_distinct(kept))


def as_text(sk: Column) -> Column:
    """The sketch as hex words, 16 digits each, comma-joined."""
    return F.array_join(F.transform(sk, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ",")


def likeness(a: Column, b: Column, same_text: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets (0 to 1)."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.when(same_text, F.lit(1.0)).otherwise(F.lit(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; null when a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def with_next(docs: DataFrame, bucket_rows: int = 8192, max_buckets: int = 512) -> DataFrame:
    """(doc_id, text, sk, next_text, next_sk): every document beside the next by descending id."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = base.count()
    k = max(1, min(max_buckets, -(-n // bucket_rows)))
    edges = [] if k == 1 else base.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 100 * k)
                                          ).first()[0] or []
    edges = sorted(set(edges))
    bucket = (F.size(F.filter(F.lit(edges), lambda e: e <= F.col("doc_id"))) if edges else F.lit(0)).cast("int")
    tie = F.xxhash64("text")
    order = [F.col("doc_id").desc_nulls_last(), tie.desc()]
    from pyspark.sql import Window
    dealt = base.withColumn("bucket", bucket)
    rows = dealt.withColumn("sk", sketch(F.col("text")))
    w = Window.partitionBy("bucket").orderBy(*order)
    rows = rows.withColumn("nx", F.lead(F.struct("text", "sk")).over(w))
    # first row of each range: its neighbour is the last row of the range above, the top one's that of the lowest
    heads = dealt.groupBy("bucket").agg(
        F.max_by("text", F.struct(F.col("doc_id"), tie.alias("tie"))).alias("text"))
    heads = heads.withColumn("sk", sketch(F.col("text")))
    ring = Window.partitionBy(F.lit(0)).orderBy(F.col("bucket").desc())
    everything = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = heads.select(
        "bucket", F.coalesce(F.lead(F.struct("text", "sk")).over(ring),
                             F.first(F.struct("text", "sk")).over(everything)).alias("hx"))
    return (rows.join(nxt, "bucket", "left")
            .select("doc_id", "text", "sk", F.coalesce("nx", "hx").alias("n"))
            .select("doc_id", "text", "sk", F.col("n.text").alias("next_text"), F.col("n.sk").alias("next_sk")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint, that of its edited text, and their likeness."""
    d = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.select("doc_id", "text", "sk", "next_text", "next_sk", n.cast("long").alias("n_chars"),
                 F.concat(F.substring("text", F.lit(1), n - half),
                          F.substring("next_text", F.lit(1), half)).alias("edited"))
    d = d.withColumn("esk", sketch(F.col("edited")))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sk")).alias("fingerprint"), as_text(F.col("esk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("esk"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk"), F.col("text") == F.col("next_text")).alias("near_next"),
        containment(F.col("sk"), F.col("esk")).alias("contained_in_edited"))
