"""Not-modified revisit records resolved to the full responses they refer to.

A revisit refers to the latest earlier full response (status 200) of its canonical URL; "earlier" is by
(time, record id).  Validators are checked: the entity tag where the revisit has one (weak and strong
tags compare alike), else the modification date; with neither the link is accepted as ``unchecked``.
A resolved record takes the response's payload columns and its headers, updated by those a 304 answer
may update (``PERMITTED``); a mismatch or a missing response leaves the record's own headers.

The as-of join has no window over a whole URL: time is cut into slices (edges by approximate
percentiles, at most ``max_slices``); inside (URL, slice) a window finds the last full response, and one
summary row per (URL, slice) carries it to later slices.  Payloads travel only in the final join on the
response's id.

Header names compare without case (they are lower-cased).  Null url, time or headers: the URL is empty,
the time sorts first, the headers are none.  Records without an id are not resolved to (a revisit
without one is resolved like any other).  Repeated record ids: the first by payload order is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: headers that a 304 answer may update (fixed by the HTTP specification)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment and trailing slash removed; host lower-cased; query
    parameters sorted."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _lowered(headers: Column) -> Column:
    return F.coalesce(F.transform_keys(headers, lambda k, v: F.lower(k)), F.create_map().cast("map<string,string>"))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^\s*W/", "")


def resolve_revisits(records: DataFrame, payload: tuple[str, ...] = ("payload",), slice_rows: int = 1_000_000,
                     max_slices: int = 256) -> DataFrame:
    """``records`` (record_id long, url, ts long, kind 'response' | 'revisit', status int, headers
    map<string,string>, payload columns) with canonical_url, refers_to, outcome ('response', 'resolved',
    'unchecked', 'mismatch', 'orphan'), merged headers and the payload columns of the response."""
    r = records.select("record_id", "url", F.coalesce("ts", F.lit(-(1 << 62))).alias("ts"), "kind", "status",
                       F.map_from_entries(F.array_distinct(F.map_entries(F.coalesce("headers", F.create_map().cast(
                           "map<string,string>"))))).alias("headers"), *payload)
    r = r.withColumn("headers", _lowered(F.col("headers"))).withColumn("canonical_url", canonical_url(F.col("url")))
    n = r.count()
    k = max(1, min(max_slices, -(-n // slice_rows)))
    edges = [] if k == 1 else sorted(set(r.select(F.percentile_approx("ts", [i / k for i in range(1, k)], 10_000)).first()[0] or []))
    piece = (F.size(F.filter(F.lit(edges), lambda e: e <= F.col("ts"))) if edges else F.lit(0)).cast("int")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    slim = r.select("record_id", "canonical_url", "ts", piece.alias("piece"), "kind",
                    F.when(full, F.struct("record_id", F.col("headers")["etag"].alias("etag"),
                                          F.col("headers")["last-modified"].alias("modified"))).alias("full"),
                    F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"))
    w = (Window.partitionBy("canonical_url", "piece").orderBy("ts", "record_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    here = slim.where("kind = 'revisit' or full is not null").withColumn("near", F.last("full", ignorenulls=True).over(w))
    last = (slim.where("full is not null").groupBy("canonical_url", "piece")
            .agg(F.max_by("full", F.struct("ts", "record_id")).alias("full")))
    # the last full response of all earlier slices: one row per (URL, slice that has any record)
    slots = here.select("canonical_url", "piece").distinct().join(last, ["canonical_url", "piece"], "left")
    before = slots.withColumn("far", F.last("full", ignorenulls=True).over(
        Window.partitionBy("canonical_url").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))).drop("full")
    got = (here.where("kind = 'revisit'").join(before, ["canonical_url", "piece"], "left")
           .withColumn("found", F.coalesce("near", "far")))
    checked = (F.when(F.col("found").isNull(), "orphan")
               .when(F.col("etag").isNotNull(),
                     F.when(_tag(F.col("etag")) == _tag(F.col("found.etag")), "resolved").otherwise("mismatch"))
               .when(F.col("modified").isNotNull(),
                     F.when(F.col("modified") == F.col("found.modified"), "resolved").otherwise("mismatch"))
               .otherwise("unchecked"))
    links = got.select("record_id", "canonical_url", "ts", checked.alias("outcome"),
                       F.col("found.record_id").alias("refers_to")).dropDuplicates(["record_id", "canonical_url", "ts"])
    revisits = (r.where("kind = 'revisit'").alias("v").join(
        links.alias("l"), F.expr("v.record_id <=> l.record_id and v.canonical_url = l.canonical_url and v.ts = l.ts"), "left")
        .select("v.*", "l.outcome", "l.refers_to"))
    source = r.where(full).groupBy(F.col("record_id").alias("refers_to")).agg(
        F.min(F.struct(*payload, F.to_json("headers").alias("h"))).alias("s"))
    taken = F.col("outcome").isin("resolved", "unchecked")
    kept = F.from_json("s.h", "map<string,string>")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(kept, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    solved = revisits.join(source, "refers_to", "left").select(
        "record_id", "url", "canonical_url", "ts", "kind", "status", "outcome", "refers_to",
        F.when(taken, merged).otherwise(F.col("headers")).alias("headers"),
        *[F.when(taken, F.col(f"s.{p}")).otherwise(F.col(p)).alias(p) for p in payload])
    plain = r.where("kind is null or kind <> 'revisit'").select(
        "record_id", "url", "canonical_url", "ts", "kind", "status", F.lit("response").alias("outcome"),
        F.lit(None).cast("long").alias("refers_to"), "headers", *payload)
    return plain.unionByName(solved)


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of the pages: a full response, a revisit that confirms it, and a later one that for
    some pages names another entity tag, has no validator, or precedes every response."""
    p = F.col("page_id").cast("long")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    day = F.lit(86_400)
    body = F.coalesce("html", F.lit(""))

    def headers(*pairs):
        return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])

    def record(n, ts, kind, status, h, *body_cols):
        return F.struct((p * 3 + n).alias("record_id"), ts.cast("long").alias("ts"), F.lit(kind).alias("kind"),
                        F.lit(status).alias("status"), h.alias("headers"),
                        body_cols[0].alias("payload_md5"), body_cols[1].cast("long").alias("payload_bytes"))
    first = record(0, p * 10 + day, "response", 200,
                   headers(("Content-Type", F.lit("text/html")), ("ETag", tag), ("Date", F.concat(F.lit("d"), p * 10 + day)),
                           ("Content-Length", F.octet_length(body).cast("string")), ("Cache-Control", F.lit("max-age=60"))),
                   F.md5(body), F.octet_length(body))
    again = record(1, p * 10 + 2 * day, "revisit", 304,
                   headers(("ETag", F.concat(F.lit("W/"), tag)), ("Date", F.concat(F.lit("d"), p * 10 + 2 * day)),
                           ("Content-Length", F.lit("0")), ("Cache-Control", F.lit("max-age=120"))),
                   F.lit(None).cast("string"), F.lit(0))
    odd = record(2, F.when(p % 11 == 5, p * 10).otherwise(p * 10 + 3 * day), "revisit", 304,
                 F.when(p % 7 == 3, headers(("ETag", F.lit('"other"')), ("Date", F.lit("later"))))
                 .when(p % 7 == 4, headers(("Date", F.lit("later")), ("Server", F.lit("x"))))
                 .otherwise(headers(("ETag", tag), ("Expires", F.lit("never")))),
                 F.lit(None).cast("string"), F.lit(0))
    return pages.where(p.isNotNull()).select("url", F.explode(F.array(first, again, odd)).alias("c")).select("url", "c.*")


def resolved_pages(pages: DataFrame) -> DataFrame:
    got = resolve_revisits(captures(pages), ("payload_md5", "payload_bytes"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return got.select("record_id", "canonical_url", "outcome", "refers_to", F.array_join(lines, "|").alias("headers"),
                      "payload_md5", F.col("payload_bytes").cast("long").alias("payload_bytes"))
