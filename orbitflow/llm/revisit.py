"""Resolution of not-modified revisits in web archives.

A revisit is joined to the latest earlier full response (status 200) of its canonical URL, its validators are compared
(entity tag, else modification date, else payload digest), and where they agree the response's headers are updated with those that
a 304 may carry.

The as-of join is one sort by time within a URL. As one URL may hold a large share of all captures, time is cut at
quantiles into slices of ``ROWS`` captures or fewer (``SLICES`` at least, ``SLICES ** 2`` at most) and a URL's slices are sorted apart; each slice hands its last response on,
and these few rows for each URL say what a slice starts with. Captures of one instant stay in one slice. Payloads are never moved, only their digests.

Defined results: a null or blank URL is the canonical URL '' and resolves like any other; a revisit with no earlier full
response is ``unresolved``, one whose validators differ ``changed``, one without any ``unverified`` (all without headers), others
``resolved``. Of captures at the same time responses come first and the larger record_id is the later. Repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES, ROWS = 32, 250_000
# Header fields that a 304 response may carry to update a stored one.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
# Query parameters that only track.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"


def canonical(url: Column) -> Column:
    """No scheme, user, port 80 or 443, leading www., fragment, tracking parameter or closing slash; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), rf"&{TRACKING}=[^&]*", ""), r"^&+", "")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _slice(cuts: list[float]) -> Column:
    """Number of ``cuts`` (sorted) below ts, found in two steps: groups of SLICES first."""
    ts = F.col("ts").cast("double")
    below = lambda some: F.aggregate(some, F.lit(0), lambda n, c: n + (ts > c).cast("int"))
    if len(cuts) <= SLICES:
        return below(F.array(*map(F.lit, cuts))) if cuts else F.lit(0)
    groups = [cuts[i : i + SLICES] for i in range(0, len(cuts), SLICES)]
    first = below(F.array(*[F.lit(g[0]) for g in groups[1:]]))
    return first * SLICES + below(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), first))


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit of ``records``.

    ``records``: record_id long, url string, ts long, kind 'response' or 'revisit', status int, headers map<string,string>
    (lower-case names), digest string. Result: record_id, canonical_url, ts, response_id, state, headers.
    """
    spark = records.sparkSession
    r = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), F.coalesce("ts", F.lit(0)).cast("long").alias("ts"), "kind", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest")
    slices = min(SLICES**2, max(SLICES, -(-r.count() // ROWS)))
    cuts = sorted(set(r.approxQuantile("ts", [k / slices for k in range(1, slices)], 0.3 / slices)))
    r = r.withColumn("slice", _slice(cuts))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    seen = F.when(full, F.struct("record_id", "headers", "digest"))
    late = F.when(full, F.struct("ts", "record_id"))
    order = Window.partitionBy("canonical_url", "slice").orderBy("ts", F.col("kind") == "revisit", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("prior", F.last(seen, ignorenulls=True).over(order)).where("kind = 'revisit'")
    ends = r.where(full).groupBy("canonical_url", "slice").agg(F.max_by(seen, late).alias("end"))
    # What a slice starts with: the last end of the URL's slices before it (at most SLICES rows for each URL).
    starts = near.where("prior IS NULL").select("canonical_url", "slice").distinct().withColumn("asks", F.lit(True))
    by_url = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(starts, ["canonical_url", "slice"], "full").withColumn("start", F.last("end", ignorenulls=True).over(by_url)).where("asks AND start IS NOT NULL")
    met = near.join(carried.select("canonical_url", "slice", "start"), ["canonical_url", "slice"], "left").withColumn("to", F.coalesce("prior", "start"))

    def plain(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    own, theirs = F.col("headers"), F.col("to.headers")
    same = (
        F.when(own["etag"].isNotNull(), plain(own["etag"]).eqNullSafe(plain(theirs["etag"])))
        .when(own["last-modified"].isNotNull(), own["last-modified"].eqNullSafe(theirs["last-modified"]))
        .when(F.col("digest").isNotNull(), F.col("digest").eqNullSafe(F.col("to.digest")))
    )
    state = F.when(F.col("to").isNull(), "unresolved").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed")
    update = F.map_filter(own, lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    out = met.withColumn("state", state)
    return out.select("record_id", "canonical_url", "ts", F.col("to.record_id").alias("response_id"), "state", F.when(F.col("state") == "resolved", merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Records of ``pages(page_id, url, html)``: each page is a response at time 10 * page_id, and is asked for again up to 120 pages later.

    A third of the pages are captures of one URL, a third of 97 others, in four spellings each; the rest keep their own. Contents of shared URLs change every 40 pages.
    What is stored and which validators are sent is drawn for each capture (case): 0-1 only part of the page was stored (206); 2 another entity tag; 4-5
    no entity tag, only a date; 6 no validator; 7-8 only a digest; else a weak entity tag.
    """
    n = F.col("page_id").cast("long")
    host = F.when(n % 3 == 0, "hot.example/all").otherwise(F.concat(F.lit("site"), (n % 97).cast("string"), F.lit(".example/p")))
    spelled = F.when(n % 4 == 0, F.concat(F.lit("http://"), host)).when(n % 4 == 1, F.concat(F.lit("HTTPS://www."), host, F.lit("/"))).when(n % 4 == 2, F.concat(host, F.lit("?utm_source=p"))).otherwise(F.concat(F.lit("https://u@"), host, F.lit("?ref=a#top")))
    shared = F.coalesce(n % 3 < 2, F.lit(False))
    delay = n * 7919 % 120
    p = pages.select(n.alias("n"), F.when(shared, spelled).otherwise(F.col("url")).alias("url"), shared.alias("shared"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("own"), (n * 7 + F.floor(n / 10)).alias("mix"), delay.alias("delay"))
    c, n = F.col("mix") % 10, F.col("n")

    def version(at: Column) -> Column:
        return F.when(F.col("shared"), F.concat(F.lit("v"), F.floor(at / 40).cast("string"))).otherwise(F.substring("own", 1, 16))

    def tag(at: Column) -> Column:
        return F.concat(F.lit('"'), version(at), F.lit('"'))

    asked_at = n + F.col("delay")
    stored = F.create_map(F.lit("etag"), tag(n), F.lit("last-modified"), version(n), F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.concat(F.lit("t"), n))
    own_tag = F.when(c == 2, F.lit('"other"')).when(~c.between(4, 8), F.concat(F.lit("W/"), tag(asked_at)))
    asked = F.map_filter(F.create_map(F.lit("etag"), own_tag, F.lit("last-modified"), F.when(c.between(4, 5), version(asked_at)), F.lit("date"), F.concat(F.lit("r"), n), F.lit("server"), F.lit("s")), lambda k, v: v.isNotNull())
    first = p.select((n * 2).alias("record_id"), "url", (n * 10).alias("ts"), F.lit("response").alias("kind"), F.when(c < 2, 206).otherwise(200).alias("status"), stored.alias("headers"), F.md5(version(n).cast("binary")).alias("digest"))
    again = p.select((n * 2 + 1).alias("record_id"), "url", (asked_at * 10 + 5).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), asked.alias("headers"), F.when(c.between(7, 8), F.md5(version(asked_at).cast("binary"))).alias("digest"))
    return first.unionByName(again)
