"""Resolve not-modified revisit records of web archives.

A revisit record says that a server answered "not modified". It is resolved by an as-of join: by canonical url
to the latest earlier full response. Validators are checked (entity tags by weak comparison, else the
modification dates, else payload digests), and the response's headers are updated with those that a 304 may
carry. Payloads never move; only ids, headers and digests do.

The as-of join has two levels, so that a url with a third of all records is no single window: within chunks of
``chunk_s`` seconds of a url, and over the last response of each chunk (a row a chunk).

Nulls and edges: a null url or time resolves to nothing (``missing``); records at the same time are ordered by record id; repeated records are
kept; a record that is neither a full response (kind ``response``, status 200) nor a revisit only passes by; an empty table gives an
empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: response headers that a 304 answer may update (lower case).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without default port and fragment; an empty path is ``/``."""
    bare = F.substring_index(F.trim(url), "#", 1)
    scheme = F.lower(F.regexp_extract(bare, r"^([^:/?#]+)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[^:/?#]+://([^/?#]*)", 1))
    host = F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", "")).when((scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_extract(bare, r"^[^:/?#]+://[^/?#]*(.*)$", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme == "", bare).otherwise(F.concat(scheme, F.lit("://"), host, rest))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last stays."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, updated by the permitted ones of the revisit. Names must be lower case."""
    new = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(response, lambda k, _: ~F.map_contains_key(new, k)), new)


def resolve(records: DataFrame, chunk_s: int = 86_400) -> DataFrame:
    """One row a revisit: record_id, url_key, ts, response_id, response_ts, status, headers, digest.

    ``records``: record_id long, url string, ts timestamp or seconds, kind string, http_status int, headers map, digest string.
    ``status`` is ``resolved``, ``mismatch`` (a validator differs), ``unverified`` (no validator on both sides) or ``missing``.
    """
    ts = F.col("ts").cast("double") if dict(records.dtypes)["ts"] != "timestamp_ntz" else F.col("ts").cast("timestamp").cast("double")
    full = (F.col("kind") == "response") & (F.col("http_status") == 200)
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), ts.alias("ts"), full.alias("full"), (F.col("kind") == "revisit").alias("revisit"), lower_names(F.col("headers")).alias("headers"), "digest")
    placed = rows.filter(F.col("url_key").isNotNull() & F.col("ts").isNotNull()).withColumn("chunk", F.floor(F.col("ts") / chunk_s))
    own = F.struct("ts", "record_id", "headers", "digest")
    near = Window.partitionBy("url_key", "chunk").orderBy("ts", "record_id", F.col("full").desc()).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("near", F.last(F.when(F.col("full"), own), ignorenulls=True).over(near)).filter("revisit")
    ends = placed.filter("full").groupBy("url_key", "chunk").agg(F.max_by(own, F.struct("ts", "record_id")).alias("end"))
    marks = ends.unionByName(within.filter(F.col("near").isNull()).select("url_key", "chunk").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType)))
    far = Window.partitionBy("url_key").orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("far", F.last("end", ignorenulls=True).over(far)).groupBy("url_key", "chunk").agg(F.first("far", ignorenulls=True).alias("far"))
    found = within.join(carried.select(F.col("url_key").alias("k"), F.col("chunk").alias("c"), "far"), (F.col("url_key") == F.col("k")) & (F.col("chunk") == F.col("c")), "left")
    lost = rows.filter("revisit").filter(F.col("url_key").isNull() | F.col("ts").isNull()).withColumn("base", F.lit(None).cast(ends.schema["end"].dataType))
    joined = found.withColumn("base", F.coalesce("near", "far")).select(*lost.columns).unionByName(lost)
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    base = F.col("base")
    mine, theirs = F.col("headers"), base["headers"]
    same = F.coalesce(tag(mine) == tag(theirs), mine["last-modified"] == theirs["last-modified"], F.col("digest") == base["digest"])
    status = F.when(base.isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    out = joined.withColumn("status", status)
    good = F.col("status").isin("resolved", "unverified")
    return out.select("record_id", "url_key", "ts", base["record_id"].alias("response_id"), base["ts"].alias("response_ts"), "status", F.when(good, merge_headers(theirs, mine)).alias("headers"), F.when(good, base["digest"]).alias("digest"))
