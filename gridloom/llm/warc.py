"""Not-modified revisits of web archives, resolved by an as-of join.

A revisit record says that a url had not changed since an earlier capture. Each is joined to the latest earlier full response of its
canonical url, validators are compared, and the headers that a 304 response may update are merged into the response's.

The as-of join has no group for a url: records are range-sorted by (url, time, type, id), so a url with very many captures lies over
several partitions. Within a partition the last response before a revisit is a window's work; a url that runs on from earlier partitions
takes the last response of the nearest of them, found in a table of one row for each partition and url at a border.

Defined results: a record without url (null) is in no url's history, so its revisits have no response; records of equal time count in the
order response, revisit, then id, so a revisit sees a response of its own time; a null time sorts first; repeated records are each
resolved; null headers are an empty map; header names compare in lower case, of names that differ in case only the last by code points counts; revisits without validators are unverified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._support import store

#: Response header fields that a 304 response may carry for the stored response to be updated (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not tell pages apart.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|session_?id|sid"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, http for https, no www., default port, fragment, tracking parameters or last slash; parameters sorted."""
    whole = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    head = F.regexp_replace(F.regexp_extract(whole, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1), r"(?i):(80|443)$", "")
    rest = F.substring(whole, F.length(F.regexp_extract(whole, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)) + 1, F.length(whole))
    head = F.regexp_replace(F.regexp_replace(F.lower(head), "^https://", "http://"), r"^http://www\.", "http://")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^([^?]*)", 1), r"(?s)/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(f"(?i)^({TRACKING})(=.*)?$"))))
    return F.concat(head, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _by_name(pairs: Column) -> Column:
    """A map of an array of (name, own, value): of equal names the last in order counts."""
    last = F.transform(F.array(F.array_sort(pairs)), lambda every: F.filter(every, lambda e, i: ~F.coalesce(F.get(every, i + 1)["name"] == e["name"], F.lit(False))))[0]
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["name"], e["value"])))


def lower_keys(headers: Column) -> Column:
    """headers with names in lower case; of names that differ in case only, the last by code points ("etag" after "ETag") counts."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    return _by_name(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("name"), e["key"].alias("own"), e["value"].alias("value"))))


def _fields(block: Column) -> Column:
    """The fields of a block of header lines, its first line apart, by names in lower case; of repeated names the last line's."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x, i: (i > 0) & x.contains(":"))
    pair = lambda x, i: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), i.cast("string").alias("own"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))
    return _by_name(F.transform(lines, lambda x, i: pair(x, F.lpad(i.cast("string"), 9, "0"))))


def read_records(raw: DataFrame, record: str = "record") -> DataFrame:
    """record_id, url, time, type, headers of whole archive records, a row each (text: version, fields, empty line, and of responses and
    revisits the status line and its header fields). Fields that a record lacks are null; a null or empty record has only nulls."""
    text = F.coalesce(F.col(record).cast("string"), F.lit(""))
    parts = F.split(text, "\r?\n\r?\n", 3)
    own = _fields(F.get(parts, F.lit(0)))
    http = F.when(F.size(parts) > 1, _fields(F.get(parts, F.lit(1))))
    fields = raw.select(own.alias("own"), http.alias("http"))
    return fields.select(F.col("own")["warc-record-id"].alias("record_id"), F.col("own")["warc-target-uri"].alias("url"), F.col("own")["warc-date"].alias("time"), F.col("own")["warc-type"].alias("type"), F.col("http").alias("headers"))


def merge_headers(stored: Column, update: Column) -> Column:
    """stored with those of update that a 304 response may change."""
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """record_id, url, time, refers_to, state, headers of each revisit.

    records: record_id, url, time, type ("response" or "revisit"), headers (map). refers_to is the response's record_id where the state
    is matched (an entity tag or date agrees) or unverified (the revisit carries neither); for mismatched (validators differ) and missing
    (no earlier response) it is null, and so is headers.
    """
    spark = records.sparkSession
    headers = lower_keys(F.col("headers"))
    slim = records.where(F.col("type").isin("response", "revisit")).select(canonical(F.col("url")).alias("url"), F.col("time"), (F.col("type") == "revisit").alias("revisit"), F.col("record_id"), headers.alias("headers"))
    order = ["url", "time", "revisit", "record_id"]
    dealt = slim.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = store(dealt.withColumn("pid", F.spark_partition_id()), "records")
    response = F.when(~F.col("revisit"), F.struct("record_id", "headers"))
    before = Window.partitionBy("pid", "url").orderBy("time", "revisit", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # null urls would be one history in the window
    near = dealt.where("url is not null").withColumn("last", F.last(response, ignorenulls=True).over(before)).where("revisit")
    lone = dealt.where("url is null and revisit").withColumn("last", F.lit(None).cast(near.schema["last"].dataType))
    near = near.unionByName(lone)
    # the last response of each url that lies over a partition's end, carried to the partitions behind
    spread = dealt.groupBy("pid").agg(F.min("url").alias("first"), F.max("url").alias("last"))
    border = spread.select(F.explode(F.array("first", "last")).alias("url")).distinct()
    ends = dealt.join(border, "url").groupBy("url", "pid").agg(F.max_by(response, F.when(~F.col("revisit"), F.struct("time", "record_id"))).alias("last"))
    earlier = Window.partitionBy("url").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "pid", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    found = near.join(carried, ["url", "pid"], "left").withColumn("last", F.coalesce("last", "carried"))
    tag, date = [(F.col("headers")[h], F.col("last.headers")[h]) for h in ("etag", "last-modified")]
    state = (
        F.when(F.col("last").isNull(), "missing")
        .when(tag[0].isNotNull() & tag[1].isNotNull(), F.when(_weak(tag[0]) == _weak(tag[1]), "matched").otherwise("mismatched"))
        .when(date[0].isNotNull() & date[1].isNotNull(), F.when(date[0] == date[1], "matched").otherwise("mismatched"))
        .otherwise("unverified")
    )
    judged = found.withColumn("state", state)
    good = F.col("state").isin("matched", "unverified")
    return judged.select("record_id", "url", "time", F.when(good, F.col("last.record_id")).alias("refers_to"), "state", F.when(good, merge_headers(F.col("last.headers"), F.col("headers"))).alias("headers"))


def with_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """resolved with the payload of the response each revisit refers to."""
    return resolved.join(records.where(F.col("type") == "response").select(F.col("record_id").alias("refers_to"), payload), "refers_to", "left")


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records of crawled pages: a full response at each page's place in time, and a revisit some time behind it.

    The pages carry no headers; those here follow from their content: the entity tag is its digest, and a revisit asks for the tag of its
    own page (a weak one for even ids), or, where the id ends in 7, for none and by date. A later capture of the same url lies between a
    page and its revisit where ids are near: then validators tell whether the content is still the same.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    tag = F.md5(body.cast("binary"))
    date = F.concat(F.lit("day "), (F.col("page_id") / 1000).cast("bigint"))
    own = F.when(F.col("page_id") % 10 != 7, F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('W/"'), tag, F.lit('"'))).otherwise(F.concat(F.lit('"'), tag, F.lit('"'))))
    full = F.map_from_arrays(F.array(F.lit("ETag"), F.lit("Last-Modified"), F.lit("Content-Length"), F.lit("Date")), F.array(F.concat(F.lit('"'), tag, F.lit('"')), date, F.octet_length(body).cast("string"), F.col("page_id").cast("string")))
    again = F.map_filter(F.map_from_arrays(F.array(F.lit("ETag"), F.lit("Last-Modified"), F.lit("Content-Length"), F.lit("Date")), F.array(own, date, F.lit("0"), (F.col("page_id") + 500).cast("string"))), lambda k, v: v.isNotNull())
    response = pages.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("time"), F.lit("response").alias("type"), full.alias("headers"))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + 20_000).alias("time"), F.lit("revisit").alias("type"), again.alias("headers"))
    return response.union(revisit)
