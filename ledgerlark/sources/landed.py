"""Sources over landed payloads: fetching is outside the engine, everything after it is here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as T
from ..operators.temporal import first_per

FEED_ENTRIES = 60


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database (driver jar needed); partition options are Spark's own."""
    return spark.read.format("jdbc").options(url=normalize_db_url(url), dbtable=table, **options).load()


def normalize_db_url(url: str) -> str:
    """Short forms of database addresses as JDBC ones."""
    for short, full in (("postgres://", "jdbc:postgresql://"), ("postgresql://", "jdbc:postgresql://"), ("postgresql+asyncpg://", "jdbc:postgresql://"), ("sqlite+aiosqlite:///", "jdbc:sqlite:"), ("sqlite:///", "jdbc:sqlite:")):
        if url.startswith(short):
            return full + url.removeprefix(short)
    return url


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document per file; nested lists are exploded by the caller."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def cookies(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of a Netscape cookie file: domain, name, value. '#HttpOnly_' rows count, other comments and short rows do not."""
    raw = F.regexp_replace(F.col(line), "^#HttpOnly_", "")
    f = F.split(raw, "\t")
    return lines.where(~F.startswith(raw, F.lit("#")) & (F.size(f) >= 7)).select(F.regexp_replace(f[0], r"^\.", "").alias("domain"), f[5].alias("name"), f[6].alias("value"))


def site_cookies(found: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site (base) a cookie header: cookies whose domain is the base or below it, the first of each name."""
    hit = (F.col("domain") == F.col("base")) | F.endswith("domain", F.concat(F.lit("."), F.col("base")))
    j = found.join(sites.select("base"), hit).groupBy("base", "name").agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("o"))
    pairs = F.array_sort(F.collect_list(F.struct("o", F.concat("name", F.lit("="), F.col("value")).alias("c"))))
    return j.groupBy("base").agg(F.array_join(F.transform(pairs, lambda r: r["c"]), "; ").alias("header"))


def rss_posts(landed: DataFrame, xml: str = "xml", handle: str = "handle") -> DataFrame:
    """Landed profile feeds (handle, xml) as posts; typing from the title and the author."""
    e = landed.where(T.looks_like_rss(xml)).select(handle, F.posexplode(M.feed_entries(F.col(xml))).alias("pos", "e")).select(handle, "pos", "e.*")
    title, creator = F.coalesce("title", F.lit("")), F.regexp_replace(F.coalesce("creator", F.lit("")), "^@+", "")
    retweet = F.startswith(title, F.lit("RT by ")) | ((creator != "") & (F.lower(creator) != F.lower(F.col(handle))))
    reply = F.startswith(title, F.lit("R to "))
    out = e.select(
        T.post_guid(handle, "link").alias("guid"), F.coalesce("link", F.lit("")).alias("url"), F.trim(M.unescape_all(T.squeeze(T.strip_tags(title)))).alias("content"), T.feed_time("published", "updated").alias("published_at"),
        retweet.alias("is_retweet"), reply.alias("is_reply"), F.when(retweet, "retweet").when(reply, "reply").otherwise("original").alias("post_type"),
        F.when(reply, F.nullif(F.regexp_extract(title, r"^R to @?([A-Za-z0-9_]+)", 1), F.lit(""))).alias("reply_to_handle"), T.link_image("summary").alias("media_url"), F.lit("rss").alias("collected_via"), handle, "pos",
    )
    return out.where(F.col("content") != "").withColumn("word_count", T.word_count("content"))


def timeline_posts(landed: DataFrame, html: str = "html", handle: str = "handle", base: str = "") -> DataFrame:
    """Landed profile pages as posts with engagement. A repost outranks a quote, a quote a reply."""
    p = landed.select(handle, F.col(html)).withColumn("_t", M.timeline(F.col(html))).select(handle, F.posexplode("_t.posts").alias("pos", "p")).select(handle, "pos", "p.*")
    full = lambda c: F.when(F.startswith(F.col(c), F.lit("/")) & F.lit(bool(base)), F.concat(F.lit(base.rstrip("/")), F.col(c))).otherwise(F.col(c))
    kind = F.when(F.col("is_retweet"), "retweet").when(F.col("is_quote"), "quote").when(F.col("is_reply"), "reply").otherwise("original")
    counts = [F.when(F.col(c).isNotNull(), T.parse_count(c)).alias(c) for c in ("replies", "retweets", "quotes", "likes")]
    return p.select(
        T.post_guid(handle, "link").alias("guid"), full("link").alias("url"), "content", T.timeline_time("date").alias("published_at"), "is_retweet", "is_reply", kind.alias("post_type"),
        F.when(F.col("is_reply"), F.col("reply_to_handle")).alias("reply_to_handle"), full("quoted_link").alias("quoted_url"), "quoted_handle", "quoted_content", full("media").alias("media_url"), F.lit("html").alias("collected_via"),
        *counts, T.word_count("content").alias("word_count"), handle, "pos",
    )


def next_cursors(landed: DataFrame, html: str = "html", handle: str = "handle") -> DataFrame:
    return landed.select(handle, M.timeline(F.col(html))["next_cursor"].alias("next_cursor"))


def press_entries(landed: DataFrame, xml: str = "xml", source: str = "media_source_id", most: int = FEED_ENTRIES) -> DataFrame:
    """The first entries of each landed press feed, full text and summary cleaned."""
    e = landed.select(source, F.posexplode(M.feed_entries(F.col(xml))).alias("pos", "e")).where(F.col("pos") < most).select(source, "pos", "e.*")
    clean = lambda c: M.unescape_all(T.squeeze(T.strip_tags(F.coalesce(c, F.lit("")))))
    return e.select(source, "pos", clean("title").alias("title"), "link", clean("summary").alias("summary"), clean("content").alias("content"), T.feed_time("published", "updated").alias("published_at"))


def feed_status(landed: DataFrame, xml: str = "xml", status: str = "status") -> DataFrame:
    """ok, http_N, empty or bozo for each landed feed."""
    n = F.size(M.feed_entries(F.col(xml)))
    state = F.when(F.col(status) != 200, F.concat(F.lit("http_"), F.col(status).cast("string"))).when(n > 0, "ok").when(~F.coalesce(F.col(xml), F.lit("")).rlike(r"(?i)<(rss|feed|rdf)"), "bozo").otherwise("empty")
    return landed.withColumn("state", state)


def discover_feeds(sites: DataFrame, probes: DataFrame, patterns: list[str], least: int = 3) -> DataFrame:
    """Per site the first address pattern that gave at least `least` entries. probes: base, pattern, n_entries."""
    order = sites.sparkSession.createDataFrame(list(enumerate(patterns)), "ord int, pattern string")
    found = probes.where(F.col("n_entries") >= least).join(F.broadcast(order), "pattern").groupBy("base").agg(F.min_by("pattern", "ord").alias("pattern"))
    return sites.select("base").join(found, "base").withColumn("rss_url", F.concat("base", "pattern"))


def wayback(payload: Column | str) -> Column:
    """The closest snapshot of an availability answer: struct<available, url, timestamp, status>."""
    schema = "struct<archived_snapshots:struct<closest:struct<available:boolean,url:string,timestamp:string,status:string>>>"
    c = F.from_json(T.col(payload), schema)["archived_snapshots"]["closest"]
    ok = F.coalesce(c["available"], F.lit(False)) | F.coalesce(F.startswith(c["status"], F.lit("2")), F.lit(False))
    return F.struct((ok & c["url"].isNotNull()).alias("available"), c["url"].alias("url"), c["timestamp"].alias("timestamp"), c["status"].alias("status"))


def best_attempt(attempts: DataFrame, url: str = "url") -> DataFrame:
    """Per address the best extraction: complete ones first, then most words, then the earliest."""
    order = F.struct(F.coalesce("is_complete", F.lit(False)).alias("c"), F.coalesce("word_count", F.lit(0)).alias("w"), (-F.col("attempt")).alias("a"))
    return attempts.groupBy(url).agg(F.max_by(F.struct(*[c for c in attempts.columns if c != url]), order).alias("r")).select(url, "r.*")


def stopped_attempts(attempts: DataFrame, target_words: int = 500, url: str = "url") -> DataFrame:
    """The attempts that a cascade would have made: it stops after one that is complete or has 0.95 of the wanted words."""
    from pyspark.sql import Window

    before = Window.partitionBy(url).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("is_complete") | (F.col("word_count") > 0.95 * target_words)
    return attempts.withColumn("_s", F.coalesce(F.max(stop.cast("int")).over(before), F.lit(0))).where("_s = 0").drop("_s")


def longest_clean(attempts: DataFrame, url: str = "url", least_chars: int = 350) -> DataFrame:
    """Per address: the first clean text that is long enough, else the longest clean one, else the longest."""
    n, clean = F.length(F.coalesce("text", F.lit(""))), ~F.col("paywalled")
    good = clean & (n >= least_chars)
    order = F.struct(good.alias("g"), F.when(good, 0).otherwise(clean.cast("int")).alias("c"), F.when(good, 0).otherwise(n).alias("n"), (-F.col("attempt")).alias("a"))
    return attempts.groupBy(url).agg(F.max_by(F.struct(*[c for c in attempts.columns if c != url]), order).alias("r")).select(url, "r.*")


def first_entries(entries: DataFrame, by: str, n: int = FEED_ENTRIES) -> DataFrame:
    return first_per(entries, by, [F.col("pos")], n)


def new_domains(candidates: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Candidates (site) whose domain is in no catalogue entry (homepage)."""
    known = catalogue.select(T.domain("homepage").alias("_d")).distinct()
    return candidates.withColumn("_d", T.domain("site")).join(known, "_d", "left_anti").drop("_d")
