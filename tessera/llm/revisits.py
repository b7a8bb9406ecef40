"""Not-modified captures in web archives: an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.scratch import materialize

#: Headers of a 304 answer that replace those of the stored response (fixed values, RFC 9110 section 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical_url(url: Column) -> Column:
    """The URL without scheme, fragment, default port, ref and utm parameters, index page and closing slash, its host in lower case."""
    out = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(out, "^[^/?]*", 0)
    rest = F.substr(out, F.length(host) + 1)
    rest = F.regexp_replace(rest, "(^|[?&])(ref|utm_[a-z]+)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "[?]&+", "?")
    rest = F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "/(index[.]html?)?$", "")
    return F.concat(F.regexp_replace(F.lower(host), ":(80|443)$", ""), rest)


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each revisit of a sorted partition the full response before it; the partition's last response follows as its edge."""
    part, last, wanted = TaskContext.get().partitionId(), None, None
    for rows in batches:
        wanted = rows.schema
        if last is not None:
            rows = pa.Table.from_batches([last, rows]).combine_chunks().to_batches()[0]
        full = np.asarray(rows.column("full"))
        place = np.maximum.accumulate(np.where(full, np.arange(len(full)), -1))
        ask = np.flatnonzero(~full)
        at = place[ask]
        source = rows.column("url").take(pa.array(np.maximum(at, 0)))
        same = np.asarray(pc.fill_null(pc.equal(source, rows.column("url").take(pa.array(ask))), False)) & (at >= 0)
        response = rows.column("response").take(pa.array(at, mask=~same))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ask), part)), rows.column("url").take(pa.array(ask)), rows.column("revisit").take(pa.array(ask)), response], ["part", "url", "revisit", "response"])
        if place[-1] >= 0:
            last = rows.slice(int(place[-1]), 1)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part]), last.column("url"), pa.nulls(1, wanted.field("revisit").type), last.column("response")], ["part", "url", "revisit", "response"])


def resolve(records: DataFrame) -> DataFrame:
    """For each revisit: record_id, url (canonical), response_id, outcome, headers and digest.

    records: record_id, url, ts, full (boolean), etag, last_modified, headers (map<string,string>, lower-case names), digest.
    The latest full response of the same canonical URL before the revisit (of equal times, the largest record_id) is the one
    that counts. outcome: `resolved` if its entity tag is the revisit's (weak tags compare without W/), or, where one has none, its
    last_modified; `mismatch` if they differ or nothing can be compared; `missing` without an earlier response. Resolved rows take
    the response's headers and digest, with the permitted headers of the revisit over them; others have null there.
    A null URL or time never matches; full null is false; a null record_id stays null; repeated revisits stay repeated; other
    columns go; an empty table gives no rows. Rows are sorted by URL and time in range partitions, so that a URL with very many captures spreads over many.
    """
    key, number = F.col("key"), records.schema["record_id"].dataType
    is_full = F.coalesce("full", F.lit(False))
    usable = F.col("url").isNotNull() & F.col("ts").isNotNull()
    rows = records.select(
        F.when(usable, canonical_url(F.col("url"))).alias("url"), F.col("ts"), is_full.alias("full"), F.col("record_id").alias("key"),
        F.when(~is_full, F.struct("record_id", "etag", "last_modified", "headers")).alias("revisit"),
        F.when(is_full, F.struct("record_id", "etag", "last_modified", "headers", "digest")).alias("response"),
    ).where(~is_full | usable)
    # a revisit sorts before a response of the same time: only earlier ones count
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, "url", "ts", "full", "key").sortWithinPartitions("url", "ts", "full", "key")
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("url", T.StringType()), rows.schema["revisit"], rows.schema["response"]])
    filled = materialize(spread.select("url", "full", "revisit", "response").mapInArrow(_fill, schema), "revisits")
    edges = filled.where("revisit is null").select("part", F.struct("url", "response").alias("edge"))
    every = filled.select("part").distinct().join(edges, "part", "left")  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    incoming = every.select("part", F.last("edge", ignorenulls=True).over(before).alias("edge"))
    asks = filled.where("revisit is not null").join(F.broadcast(incoming), "part", "left")
    response = F.coalesce("response", F.when(F.col("edge.url") == F.col("url"), F.col("edge.response")))
    asks = asks.select("url", "revisit", response.alias("found"))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.coalesce(tag(F.col("revisit.etag")) == tag(F.col("found.etag")), F.col("revisit.last_modified") == F.col("found.last_modified"), F.lit(False))
    outcome = F.when(F.col("found").isNull(), "missing").when(same, "resolved").otherwise("mismatch")
    empty = F.create_map().cast("map<string,string>")
    over = F.map_filter(F.coalesce("revisit.headers", empty), lambda k, _: k.isin(PERMITTED))
    under = F.map_filter(F.coalesce("found.headers", empty), lambda k, _: ~F.array_contains(F.map_keys(over), k))
    good = outcome == "resolved"
    return asks.select(
        F.col("revisit.record_id").cast(number).alias("record_id"), "url", F.col("found.record_id").alias("response_id"), outcome.alias("outcome"),
        F.when(good, F.map_concat(under, over)).alias("headers"), F.when(good, F.col("found.digest")).alias("digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records for `resolve` from page_id, url and html: each page as a full response, and a later revisit of its URL.

    The revisit's entity tag is the page's, weak or strong; where the URL's checksum starts with 0 it is another one, and where
    it starts with 1 only the date of the last change is given. Times are seconds; a revisit comes up to 18 hours after its page.
    """
    sum_of = lambda c, digits: F.conv(F.substr(F.md5(F.coalesce(c, F.lit(""))), F.lit(1), F.lit(digits)), 16, 10).cast("long")
    check = sum_of("url", 1)
    tag, changed = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"')), F.concat(F.lit("t"), (F.col("page_id") % 1000).cast("string"))
    at = F.col("page_id") * 60
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit(True).alias("full"), tag.alias("etag"), changed.alias("last_modified"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), at.cast("string")).alias("headers"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
    )
    later = at + 1 + sum_of("html", 4)
    given = F.when(check == 0, F.lit('"other"')).when(check == 1, F.lit(None)).when(check % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit(False).alias("full"), given.alias("etag"), changed.alias("last_modified"),
        F.create_map(F.lit("date"), later.cast("string"), F.lit("content-type"), F.lit("none"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(revisit)
