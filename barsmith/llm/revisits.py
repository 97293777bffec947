"""Resolution of not-modified revisits in a web archive.

A revisit record (304) is resolved to the latest earlier full response of its
canonical URL, if its validators agree, and the response's headers are updated
with those that a 304 may change.

The as-of join does not gather a URL in a task.  Captures are range-partitioned
by (URL, time), so a URL with a third of all captures spans many partitions of
even size.  Each partition carries the last response forward by a window inside
(partition, URL); what crosses a border is one row per partition and URL, and a
window over those few rows hands it on.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import cut, small
from barsmith.llm.lines import lower_ascii

#: Headers that describe the body or the connection; a 304 must
#: not change them in the stored response.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-location", "content-md5",
                "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization",
                "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that do not name content.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")


def canonical_url(url: Column) -> Column:
    """Host lower-cased without ``www.`` and default port, path without a final
    slash, remaining parameters sorted; no scheme, user or fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(lower_ascii(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    named = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    named = F.array_join(F.array_sort(named), "&")
    return F.concat(host, path, F.when(named != "", F.concat(F.lit("?"), named)).otherwise(""))


def _tag(etag: Column) -> Column:
    """Weak comparison: without the weakness mark."""
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id, url_key, ts, refers_to, resolution,
    headers, payload_digest, payload_length``.

    Captures have ``record_id`` (long), ``url``, ``ts`` (long), ``kind``
    (``response`` or ``revisit``, others are ignored), ``etag``,
    ``last_modified``, ``headers`` (map, names in lower case), and the payload's
    digest and length.  ``resolution``:

    * ``etag``, ``modified``: the revisit's entity tag (compared weakly) or,
      if it has none, its modification date equals the response's;
    * ``unvalidated``: neither record has a validator;
    * ``changed``: validators differ or only one record has any; not resolved;
    * ``missing``: no earlier response, or a null URL or time; not resolved.

    Earlier is strictly earlier; of responses at one time the largest record id
    counts.  Repeated rows give repeated results.  Columns that are not named
    here are ignored."""
    spark = captures.sparkSession
    full = F.col("kind") == "response"
    response = F.when(full & F.col("ts").isNotNull(), F.struct(
        "record_id", "etag", "last_modified", "headers", "payload_digest", "payload_length"))
    rows = captures.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", full.cast("int").alias("phase"),
        "etag", "last_modified", "headers", response.alias("response"))
    lost = rows.where("phase = 0 AND (url_key IS NULL OR ts IS NULL)")
    rows = rows.where("url_key IS NOT NULL AND ts IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["ts", "phase", "record_id"]
    rows = cut(rows.repartitionByRange(parts, "url_key", *order).withColumn("pid", F.spark_partition_id()))

    tails = cut(rows.groupBy("pid", "url_key").agg(F.max_by("response", F.when(
        F.col("response").isNotNull(), F.struct(*order))).alias("tail")))
    spans = tails.groupBy("url_key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("url_key")
    over = Window.partitionBy("url_key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(tails.join(spans, "url_key", "left_semi").withColumn("carried", F.last("tail", True).over(over))
                  .where("carried IS NOT NULL").select("pid", "url_key", "carried"))
    upto = Window.partitionBy("pid", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("before", F.last("response", True).over(upto)).where("phase = 0")
    found = found.join(small(carried), ["pid", "url_key"], "left").withColumn("r", F.coalesce("before", "carried"))
    return _settle(found.drop("before", "carried", "pid").unionByName(lost.withColumn("r", F.lit(None).cast(
        found.schema["r"].dataType))))


def _settle(found: DataFrame) -> DataFrame:
    tags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    dates = F.col("etag").isNull() & F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    bare = (F.coalesce("etag", "last_modified").isNull()
            & F.coalesce(F.col("r.etag"), F.col("r.last_modified")).isNull())
    how = (F.when(F.col("r").isNull(), "missing")
           .when(tags & (_tag(F.col("etag")) == _tag(F.col("r.etag"))), "etag")
           .when(dates & (F.col("last_modified") == F.col("r.last_modified")), "modified")
           .when(bare, "unvalidated").otherwise("changed"))
    out = found.withColumn("resolution", how)
    good = F.col("resolution").isin("etag", "modified", "unvalidated")
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(F.col("r.headers"), empty), F.coalesce(F.col("headers"), empty)
    new = F.map_filter(new, lambda k, v: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return out.select("record_id", "url_key", "ts", F.when(good, F.col("r.record_id")).alias("refers_to"), "resolution",
                      F.when(good, merged).alias("headers"), F.when(good, F.col("r.payload_digest")).alias("payload_digest"),
                      F.when(good, F.col("r.payload_length")).alias("payload_length"))


#: Capture log that a crawl of the pages would leave, in SQL that Spark and
#: DuckDB both read (but for ``{each}``, which numbers the copies of a row).  Each page is fetched in full and revisited up to three
#: times; with every page its host's robots.txt is asked for, which changes
#: with every 50th page.
CAPTURES_SQL = """
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS chars,
    split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL),
own AS (
  SELECT page_id * 10 + n AS record_id,
    CASE n WHEN 1 THEN concat(url, '#again') WHEN 2 THEN replace(url, 'http://', 'https://') ELSE url END AS url,
    page_id * 100 + CASE WHEN n = 3 AND page_id % 5 = 0 THEN -7 ELSE n * 13 END AS ts,
    CASE WHEN n = 0 THEN 'response' ELSE 'revisit' END AS kind,
    CASE WHEN page_id % 7 = 0 THEN NULL WHEN n = 2 AND page_id % 3 = 0 THEN 'stale'
         WHEN n = 1 THEN concat('W/', digest) ELSE digest END AS etag,
    CASE WHEN page_id % 14 = 0 THEN NULL ELSE concat('day ', page_id % 28) END AS last_modified,
    CASE WHEN n = 0 THEN digest END AS payload_digest, CASE WHEN n = 0 THEN chars END AS payload_length
  FROM p{each} WHERE n <= page_id % 4),
robots AS (
  SELECT page_id * 10 + 9 AS record_id, concat('https://', host, '/robots.txt') AS url, page_id * 100 + 1 AS ts,
    CASE WHEN page_id % 50 = 0 THEN 'response' ELSE 'revisit' END AS kind,
    CASE WHEN page_id % 11 = 0 THEN 'stale' ELSE concat('robots of ', host) END AS etag,
    CAST(NULL AS STRING) AS last_modified,
    CASE WHEN page_id % 50 = 0 THEN md5(concat(host, CAST(page_id AS STRING))) END AS payload_digest,
    CASE WHEN page_id % 50 = 0 THEN 40 END AS payload_length
  FROM p)
SELECT *, concat('day ', ts % 365) AS h_date,
  CASE WHEN kind = 'response' THEN 'text/html' ELSE 'none' END AS h_type,
  CASE WHEN kind = 'response' OR record_id % 2 = 0 THEN concat('max-age=', record_id % 1000) END AS h_cache
FROM (SELECT * FROM own UNION ALL SELECT * FROM robots) c
"""


def crawl_log(pages: DataFrame) -> DataFrame:
    """The captures of :data:`CAPTURES_SQL` with their headers as a map."""
    spark = pages.sparkSession
    pages.createOrReplaceTempView("__crawled_pages")
    each = " LATERAL VIEW explode(sequence(0, 3)) copies AS n"
    log = spark.sql(CAPTURES_SQL.replace("FROM pages", "FROM __crawled_pages").replace("{each}", each))
    given = F.map_from_arrays(F.array(F.lit("date"), F.lit("content-type"), F.lit("cache-control")),
                              F.array("h_date", "h_type", "h_cache"))
    return log.withColumn("headers", F.map_filter(given, lambda k, v: v.isNotNull()))


def revisits_sql() -> str:
    return f"""
WITH log AS ({CAPTURES_SQL.replace("{each}", ", (SELECT unnest(range(4)) AS n)")}),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', ''), '^www\\.', '') AS rest FROM log),
c AS (SELECT *, concat(lower(regexp_extract(rest, '^[^/?]*', 0)),
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', ''),
    CASE WHEN rest LIKE '%?%' THEN coalesce('?' || nullif(array_to_string(list_sort(list_filter(
      string_split(split_part(rest, '?', 2), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN
      {TRACKING})), '&'), ''), '') ELSE '' END) AS url_key FROM k),
r AS (SELECT * FROM c WHERE kind = 'response'
      QUALIFY row_number() OVER (PARTITION BY url_key, ts ORDER BY record_id DESC) = 1),
j AS (SELECT v.*, r.record_id AS rid, r.etag AS retag, r.last_modified AS rmod, r.h_cache AS rcache,
        r.h_type AS rtype, r.payload_digest AS rdigest, r.payload_length AS rlength
      FROM (SELECT * FROM c WHERE kind = 'revisit') v ASOF LEFT JOIN r ON v.url_key = r.url_key AND v.ts > r.ts),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'missing'
    WHEN regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', '') THEN 'etag'
    WHEN etag IS NULL AND last_modified = rmod THEN 'modified'
    WHEN etag IS NULL AND last_modified IS NULL AND retag IS NULL AND rmod IS NULL THEN 'unvalidated'
    ELSE 'changed' END AS resolution FROM j),
g AS (SELECT *, resolution IN ('etag', 'modified', 'unvalidated') AS good FROM s)
SELECT record_id, url_key, ts, CASE WHEN good THEN rid END AS refers_to, resolution,
  CASE WHEN good THEN h_date END AS date, CASE WHEN good THEN rtype END AS content_type,
  CASE WHEN good THEN coalesce(h_cache, rcache) END AS cache_control,
  CASE WHEN good THEN rdigest END AS payload_digest, CASE WHEN good THEN rlength END AS payload_length FROM g"""
