"""Queries of the relational operators: scans, filters, joins, aggregation, paging, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports, temporal, views
from ..sources import landed, sinks
from .registry import Tables, query

NOW = "TIMESTAMP '2026-01-01 00:00:00'"


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


# ---------------------------------------------------------------- filters, projections, paging


@query("s01_p01_p03_p07_scan_filters", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderpriority IS NOT NULL")
def _(t: Tables) -> DataFrame:
    df = views.where_equal(t.orders, o_orderstatus="F", o_orderpriority="")
    return df.where("o_totalprice >= 100000 and o_orderpriority is not null").select("o_orderkey", "o_custkey", "o_totalprice")


@query("s03_point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def _(t: Tables) -> DataFrame:
    return views.by_key(t.customer, 42, "c_custkey")


@query("p02_ilike", "SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%er#%5%'")
def _(t: Tables) -> DataFrame:
    return views.where_like(t.supplier, " @ER#%5", "s_name").select("s_suppkey", "s_name")


@query("p04_p05_boolean_in", "SELECT event_id, event_type FROM events WHERE (value > 50) AND event_type IN ('click', 'purchase')")
def _(t: Tables) -> DataFrame:
    return t.events.withColumn("large", F.col("value") > 50).where(F.col("large") & F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


@query("p06_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t: Tables) -> DataFrame:
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(keys, "o_custkey", "left_semi").select("o_orderkey")


@query(
    "p08_p09_nested_projection",
    "SELECT o_orderkey, c_name AS author_name, n_name AS author_nation, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
def _(t: Tables) -> DataFrame:
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("n_name").alias("nation")).alias("author"))
    return t.orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("author.name").alias("author_name"), F.col("author.nation").alias("author_nation"), "o_orderdate")


@query("p11_exclude_families", "SELECT n_nationkey, n_name FROM nation WHERE lower(coalesce(n_name, '')) NOT IN ('france', 'germany')")
def _(t: Tables) -> DataFrame:
    return t.nation.where(~F.lower(F.coalesce("n_name", F.lit(""))).isin("france", "germany")).select("n_nationkey", "n_name")


@query("p13_since_cutoff", "SELECT event_id FROM events WHERE CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END IS NULL OR ts >= (SELECT min(ts) + INTERVAL 3 DAY FROM events)")
def _(t: Tables) -> DataFrame:
    since = t.events.agg((F.min("ts") + F.expr("interval 3 days")).alias("since"))
    df = t.events.withColumn("at", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    return df.join(F.broadcast(since)).where("at is null or at >= since").select("event_id")


@query("o01_feed_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 100")
def _(t: Tables) -> DataFrame:
    return views.page(t.orders.select("o_orderkey", "o_orderdate"), *views.newest("o_orderdate", "o_orderkey"), limit=50, offset=100)


@query("o01_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def _(t: Tables) -> DataFrame:
    return views.total(views.where_equal(t.orders, o_orderstatus="O"))


@query("o02_o04_score_page", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 200")
def _(t: Tables) -> DataFrame:
    return views.page(t.part.select("p_partkey", "p_retailprice"), F.desc("p_retailprice"), F.desc("p_partkey"), limit=500)


@query("o03_series", "SELECT event_id, ts, value FROM events WHERE user_id = 7 AND value IS NOT NULL ORDER BY ts NULLS LAST, event_id")
def _(t: Tables) -> DataFrame:
    c = t.events.select("event_id", F.col("event_id").alias("id"), F.col("user_id").alias("referent_key"), F.col("value").alias("qty_value"), F.col("ts").alias("published_at"))
    return views.series(c, 7).select("event_id", F.col("published_at").alias("ts"), F.col("qty_value").alias("value"))


@query("o12_batch_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy("doc_id").limit(100)


# ---------------------------------------------------------------- joins


@query("j01_inner_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("j02_dimension_join", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query(
    "j03_lookup_coalesce",
    "SELECT event_type AS referent_key, coalesce(label, event_type) AS label, count(*) AS n FROM events LEFT JOIN (VALUES ('click', 'Clic'), ('view', 'Vue')) AS l(key, label) ON key = event_type GROUP BY 1, 2",
)
def _(t: Tables) -> DataFrame:
    labels = t.spark.createDataFrame([("click", "Clic"), ("view", "Vue")], "referent_key string, label string")
    df = t.events.groupBy(F.col("event_type").alias("referent_key")).agg(F.count(F.lit(1)).alias("n"))
    return df.join(F.broadcast(labels), "referent_key", "left").select("referent_key", F.coalesce("label", "referent_key").alias("label"), "n")


@query(
    "j04_provenance",
    """SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN c_name END, CASE WHEN event_id % 2 = 1 THEN s_name END) AS source_url
       FROM events LEFT JOIN customer ON event_id % 2 = 0 AND c_custkey = user_id LEFT JOIN supplier ON event_id % 2 = 1 AND s_suppkey = user_id""",
)
def _(t: Tables) -> DataFrame:
    claims = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("post_id"), F.when(F.col("event_id") % 2 == 1, F.col("user_id")).alias("article_id"))
    posts = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("url"))
    return views.claim_urls(claims, posts, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("url"))).select("event_id", "source_url")


@query(
    "j05_nested_children",
    """SELECT r.r_regionkey, r_name, string_agg(n_name || ':' || n_suppliers, ',' ORDER BY n_name || ':' || n_suppliers) AS children FROM region r
       LEFT JOIN (SELECT n_regionkey, n_name, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey, n_name) ON n_regionkey = r_regionkey
       GROUP BY r.r_regionkey, r_name""",
)
def _(t: Tables) -> DataFrame:
    themes = t.region.select(F.col("r_regionkey").cast("string").alias("id"), "r_name", F.col("r_regionkey").alias("order"))
    subs = t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("string").alias("theme_id"), F.col("n_name").alias("label"))
    refs = t.supplier.select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_nationkey").cast("string").alias("subtheme_id"), F.col("s_name").alias("label"), F.lit("").alias("unit"))
    out = views.referential(themes, subs, refs)
    line = F.array_sort(F.transform("subthemes", lambda s: F.concat(s["label"], F.lit(":"), F.size(s["referents"]).cast("string"))))
    return out.select(F.col("order").alias("r_regionkey"), "r_name", F.array_join(line, ",").alias("children"))


_AFFILIATIONS = """(SELECT c_custkey * 10 + k AS id, c_custkey AS person, 'P' || ((c_custkey + k) % 5) AS party,
    CASE WHEN c_custkey % 7 = 0 AND k = 0 THEN NULL ELSE CAST(DATE '1992-01-01' + CAST((c_custkey * 13 + k * 900) % 2000 AS INTEGER) AS DATE) END AS date_start,
    CASE WHEN (c_custkey + k) % 3 = 0 THEN NULL ELSE CAST(DATE '1992-01-01' + CAST((c_custkey * 13 + k * 900) % 2000 + 600 AS INTEGER) AS DATE) END AS date_end
  FROM customer, (VALUES (0), (1), (2)) AS v(k) WHERE c_custkey % 10 <> 9)"""


def _affiliations(t: Tables) -> DataFrame:
    start = lambda extra: F.date_add(F.lit("1992-01-01").cast("date"), ((F.col("c_custkey") * 13 + F.col("k") * 900) % 2000 + extra).cast("int"))
    c = t.customer.where("c_custkey % 10 <> 9").select("c_custkey", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    return c.select(
        (F.col("c_custkey") * 10 + F.col("k")).alias("id"), F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("P"), ((F.col("c_custkey") + F.col("k")) % 5).cast("string")).alias("party"),
        F.when(~((F.col("c_custkey") % 7 == 0) & (F.col("k") == 0)), start(0)).alias("date_start"), F.when((F.col("c_custkey") + F.col("k")) % 3 != 0, start(600)).alias("date_end"),
    )


@query(
    "j06_affiliation_at_date",
    f"""WITH a AS {_AFFILIATIONS}, i AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders),
    r AS (SELECT o_orderkey, party, row_number() OVER (PARTITION BY o_orderkey ORDER BY
        CASE WHEN d IS NOT NULL AND (date_start IS NULL OR date_start <= d) AND (date_end IS NULL OR d <= date_end) THEN 0 WHEN date_end IS NULL THEN 1 ELSE 2 END,
        CASE WHEN NOT coalesce(d IS NOT NULL AND (date_start IS NULL OR date_start <= d) AND (date_end IS NULL OR d <= date_end), false) AND date_end IS NOT NULL THEN coalesce(date_start, DATE '0001-01-01') END DESC NULLS FIRST, id) AS n
      FROM i JOIN a ON person = o_custkey)
    SELECT i.o_orderkey, party AS party_at_date FROM i LEFT JOIN r ON r.o_orderkey = i.o_orderkey AND n = 1""",
)
def _(t: Tables) -> DataFrame:
    items = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")).alias("at"))
    return temporal.affiliation_at(items, _affiliations(t), "o_orderkey", "o_custkey", "at").select("o_orderkey", "party_at_date")


@query("j10_not_processed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query(
    "j15_merge_pools",
    """SELECT coalesce(a.name, b.name) AS full_name, coalesce(b.handle, a.handle) AS handle FROM
       (SELECT c_name AS name, 'h' || c_custkey AS handle FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN
       (SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'v' || c_custkey END AS handle FROM customer WHERE c_custkey % 5 <> 0) b ON a.name = b.name""",
)
def _(t: Tables) -> DataFrame:
    c = t.customer
    none = F.lit(None).cast("string")
    a = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("full_name"), F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("handle"), none.alias("famille"), none.alias("role"))
    b = c.where("c_custkey % 5 <> 0").select(F.upper("c_name").alias("u"), F.col("c_name").alias("full_name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("v"), F.col("c_custkey").cast("string"))).alias("handle"), none.alias("famille"), none.alias("role"), F.lit("ok").alias("verif"))
    return sinks.merge_pools(a, b, T.normalize_name).select("full_name", "handle")


@query("j16_new_domains", "SELECT page_id FROM pages WHERE regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), 'www\\.', '', 'g') NOT IN (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), 'www\\.', '', 'g') FROM pages WHERE page_id % 7 = 0)")
def _(t: Tables) -> DataFrame:
    p = t.pages.withColumn("site", F.col("url"))
    return landed.new_domains(p, t.pages.where("page_id % 7 = 0").select(F.col("url").alias("homepage"))).select("page_id")


@query(
    "j17_s12_site_cookies",
    """WITH c AS (SELECT n_nationkey AS ord, 'sub' || n_nationkey % 3 || '.site' || n_nationkey % 4 || '.fr' AS domain, 'k' || n_nationkey % 5 AS name, n_name AS value FROM nation),
       f AS (SELECT 'site' || k || '.fr' AS base, name, arg_min(value, ord) AS value, min(ord) AS o FROM c, (VALUES (0), (1), (2), (3)) AS v(k) WHERE ends_with(domain, '.site' || k || '.fr') GROUP BY 1, 2)
       SELECT base, string_agg(name || '=' || value, '; ' ORDER BY o) AS header FROM f GROUP BY base""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    lines = t.nation.select(n.alias("ord"), F.concat_ws("\t", F.concat(F.lit("#HttpOnly_.sub"), n % 3, F.lit(".site"), n % 4, F.lit(".fr")), F.lit("TRUE"), F.lit("/"), F.lit("TRUE"), F.lit("0"), F.concat(F.lit("k"), n % 5), F.col("n_name")).alias("value"))
    found = lines.select("ord", "value").join(landed.cookies(lines).withColumnRenamed("value", "v"), F.endswith("value", F.concat(F.lit("\t"), F.col("v")))).select("ord", "domain", "name", F.col("v").alias("value"))
    sites = t.spark.range(4).select(F.concat(F.lit("site"), F.col("id").cast("string"), F.lit(".fr")).alias("base"))
    return landed.site_cookies(found, sites)


@query(
    "j18_membership_count",
    """WITH e AS (SELECT l_orderkey AS a, l_partkey AS b, l_linenumber AS n FROM lineitem)
       SELECT p_partkey % 10 AS bucket, count(DISTINCT (a, b)) AS contradictions FROM e JOIN part ON p_partkey = a OR p_partkey = b GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    ends = e.select("a", "b", F.explode(F.array("a", "b")).alias("p_partkey"))
    return ends.join(t.part.select("p_partkey"), "p_partkey").groupBy((F.col("p_partkey") % 10).alias("bucket")).agg(F.count_distinct("a", "b").alias("contradictions"))


# ---------------------------------------------------------------- aggregation and reports


@query("a01_a10_counts", "SELECT count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS large FROM events")
def _(t: Tables) -> DataFrame:
    return reports.counts(t.events, clicks=F.col("event_type") == "click", large=F.col("value") > 50)


@query("a10_distinct", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))


@query(
    "a02_counters",
    """SELECT l_returnflag AS referent_key, l_linestatus AS unit, count(*) AS n_claims, min(l_quantity) AS min, max(l_quantity) AS max,
       nullif(round(avg(l_quantity), 2), 0.0) AS avg, round(max(l_quantity) - min(l_quantity), 2) AS spread, l_returnflag AS label FROM lineitem GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    labels = t.spark.createDataFrame([], "key string, label string")
    return reports.counters(t.lineitem, labels, "l_returnflag", "l_linestatus", "l_quantity")


@query("a03_group_count", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def _(t: Tables) -> DataFrame:
    return reports.group_counts(t.documents, "lang")


@query(
    "a04_theme_tree",
    """WITH k AS (SELECT n_nationkey, n_name, n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS posts, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS articles FROM nation)
       SELECT r_name AS label, sum(posts)::BIGINT AS posts, sum(articles)::BIGINT AS articles, sum(posts) + sum(articles) = 0 AS empty,
              string_agg(n_name || '|' || posts || '|' || articles, ';' ORDER BY n_name) AS children FROM region JOIN k ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def _(t: Tables) -> DataFrame:
    nr = t.nation.select("n_nationkey", F.col("n_regionkey").cast("string").alias("theme"))
    posts = t.customer.join(nr, F.col("c_nationkey") == F.col("n_nationkey")).select("theme", F.col("c_nationkey").cast("string").alias("subtheme"))
    arts = t.supplier.join(nr, F.col("s_nationkey") == F.col("n_nationkey")).select("theme", F.col("s_nationkey").cast("string").alias("subtheme"))
    themes = t.region.select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("label"), F.col("r_regionkey").alias("order"))
    subs = t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").cast("string").alias("theme_id"))
    out = reports.theme_tree(themes, subs, posts, arts)
    kids = F.array_join(F.transform("children", lambda c: F.concat_ws("|", c["label"], c["posts"].cast("string"), c["articles"].cast("string"))), ";")
    return out.select("label", "posts", "articles", "empty", kids.alias("children"))


@query(
    "a05_f37_distribution",
    """SELECT coalesce(CASE WHEN lang = 'es' THEN NULL ELSE lang END, 'unclassified') AS value, count(*) AS n, round(100.0 * count(*)::DOUBLE / (SELECT count(*) FROM documents), 1) AS pct,
       repeat('█', (count(*) * 30 // (SELECT count(*) FROM documents))::INTEGER) AS bar FROM documents GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return reports.distribution(t.documents.withColumn("theme", F.nullif("lang", F.lit("es"))), "theme")


@query(
    "a06_f16_completeness_floor",
    """SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS en, (100 * count(*) FILTER (lang = 'en') // count(*))::INTEGER AS en_pct,
       count(*) FILTER (n_chars > 2000) AS long, (100 * count(*) FILTER (n_chars > 2000) // count(*))::INTEGER AS long_pct FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return reports.ratios(t.documents, floor=True, en=F.col("lang") == "en", long=F.col("n_chars") > 2000)


@query(
    "a07_source_completeness",
    """SELECT source, count(*) AS n, count(*) FILTER (w >= 200) AS "full", (100 * count(*) FILTER (w >= 200) // count(*))::INTEGER AS full_pct, count(quality) AS labelled, (100 * count(quality) // count(*))::INTEGER AS labelled_pct
       FROM (SELECT source, quality, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY source""",
)
def _(t: Tables) -> DataFrame:
    df = t.documents.join(t.labels, "doc_id", "left")
    return reports.ratios(df, "source", floor=True, full=T.word_count("text") >= 200, labelled=F.col("quality").isNotNull())


@query(
    "a08_collection_report",
    """WITH x AS (SELECT count(*) AS posts, count(*) FILTER (event_type <> 'view') AS with_engagement, count(*) FILTER (user_id % 2 = 0) AS html, count(*) FILTER (event_id % 3 = 0) AS arch FROM events),
       a AS (SELECT count(*) AS articles, count(*) FILTER (n_chars >= 350) AS f, count(*) FILTER (doc_id % 9 = 0) AS w, count(*) FILTER (lang = 'fr') AS p, count(*) FILTER (doc_id % 4 = 0) AS e, count(*) FILTER (doc_id % 5 = 0) AS r FROM documents),
       c AS (SELECT count(*) AS personalities, count(*) FILTER (c_acctbal > 0 AND c_custkey % 3 <> 0) AS handles_active, count(*) FILTER (c_custkey % 2 = 0) AS handles_collected FROM customer),
       s AS (SELECT count(*) FILTER (s_acctbal > 0) AS sources_active, count(*) FILTER (s_acctbal > 0 AND s_suppkey % 4 >= 2) AS sources_failing FROM supplier)
       SELECT posts, with_engagement, round(100.0::DOUBLE * with_engagement / posts, 1) AS engagement_pct, round(100.0::DOUBLE * html / posts, 1) AS via_html_pct, round(100.0::DOUBLE * arch / posts, 1) AS x_archived_pct,
              articles, f AS full_text, round(100.0::DOUBLE * f / articles, 1) AS full_text_pct, round(100.0::DOUBLE * w / articles, 1) AS paywalled_pct, p AS prises_de_parole, round(100.0::DOUBLE * p / articles, 1) AS pdp_pct,
              round(100.0::DOUBLE * e / articles, 1) AS date_estimated_pct, round(100.0::DOUBLE * r / articles, 1) AS press_archived_pct,
              personalities, handles_active, handles_collected, round(100.0::DOUBLE * handles_collected / handles_active, 1) AS handle_coverage_pct, sources_active, sources_failing FROM x, a, c, s""",
)
def _(t: Tables) -> DataFrame:
    flag = lambda c: F.when(c, F.lit("y"))
    posts = t.events.select(F.when(F.col("event_type") != "view", 1).alias("likes"), F.when(F.col("user_id") % 2 == 0, "html").otherwise("rss").alias("collected_via"), flag(F.col("event_id") % 3 == 0).alias("snapshot_url"))
    arts = t.documents.select((F.col("n_chars") >= 350).alias("is_full_text"), (F.col("doc_id") % 9 == 0).alias("paywalled"), F.when(F.col("lang") == "fr", "prise_de_parole").otherwise("mention").alias("nature"), (F.col("doc_id") % 4 == 0).alias("published_estimated"), flag(F.col("doc_id") % 5 == 0).alias("snapshot_url"))
    people = t.customer.select((F.col("c_acctbal") > 0).alias("is_active"), flag(F.col("c_custkey") % 3 != 0).alias("handle"), F.when(F.col("c_custkey") % 2 == 0, now()).alias("last_collected_at"))
    sources = t.supplier.select((F.col("s_acctbal") > 0).alias("is_active"), (F.col("s_suppkey") % 4).alias("consecutive_failures"))
    return reports.collection_report(posts, arts, people, sources)


@query("a09_last_completed", "SELECT event_type AS kind, max(ts) AS completed_at FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    log = t.events.select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 2 == 0, "COMPLETED").otherwise("FAILED").alias("status"), F.col("ts").alias("at"))
    return sinks.last_completed(log)


@query(
    "a11_o11_dossiers",
    """WITH c AS (SELECT event_id AS id, user_id AS personality_id, event_type AS theme, CASE WHEN event_id % 2 = 0 THEN 'quantitatif' ELSE 'normatif' END AS claim_type, ts AS published_at, props AS verbatim FROM events),
       r AS (SELECT *, row_number() OVER (PARTITION BY personality_id ORDER BY published_at DESC, id DESC) AS n FROM c),
       f AS (SELECT personality_id, string_agg('- [' || strftime(published_at, '%Y-%m-%d') || '] (' || theme || '/' || claim_type || ') ' || left(trim(verbatim), 200), chr(10) ORDER BY n) AS facts FROM r WHERE n <= 50 GROUP BY 1),
       th AS (SELECT personality_id, string_agg(theme || '=' || k, ',' ORDER BY theme) AS by_theme FROM (SELECT personality_id, theme, count(*) AS k FROM c GROUP BY 1, 2) GROUP BY 1),
       b AS (SELECT personality_id, count(*) AS n_claims, min(published_at) AS first_at, max(published_at) AS last_at FROM c GROUP BY 1 HAVING count(*) >= 3),
       e AS (SELECT personality_id, count(DISTINCT (x, y)) AS contradictions FROM (SELECT event_id AS x, event_id + 1 AS y FROM events WHERE event_id % 10 = 0) JOIN c ON id = x OR id = y GROUP BY 1)
       SELECT b.personality_id, n_claims, first_at, last_at, by_theme, facts, coalesce(contradictions, 0) AS contradictions FROM b JOIN th USING (personality_id) JOIN f USING (personality_id) LEFT JOIN e USING (personality_id)""",
)
def _(t: Tables) -> DataFrame:
    claims = t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("personality_id"), F.col("event_type").alias("theme"), F.when(F.col("event_id") % 2 == 0, "quantitatif").otherwise("normatif").alias("claim_type"),
        F.col("ts").alias("published_at"), F.lit(None).cast("string").alias("canonical"), F.col("props").alias("verbatim"),
    )
    edges = t.events.where("event_id % 10 = 0").select(F.col("event_id").alias("claim_a_id"), (F.col("event_id") + 1).alias("claim_b_id"))
    out = reports.dossiers(claims, edges)
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("by_theme")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("personality_id", "n_claims", "first_at", "last_at", pairs.alias("by_theme"), "facts", "contradictions")


@query(
    "a12_funnel",
    """SELECT source, count(*) AS n, count(*) FILTER (lang = 'fr') AS pdp, (100 * count(*) FILTER (lang = 'fr') // count(*))::INTEGER AS pdp_pct, count(*) FILTER (lang = 'en') AS mention, (100 * count(*) FILTER (lang = 'en') // count(*))::INTEGER AS mention_pct,
       count(*) FILTER (lang NOT IN ('fr', 'en')) AS reject, (100 * count(*) FILTER (lang NOT IN ('fr', 'en')) // count(*))::INTEGER AS reject_pct FROM documents GROUP BY source""",
)
def _(t: Tables) -> DataFrame:
    return reports.funnel(t.documents.withColumn("nature", F.when(F.col("lang") == "fr", "prise_de_parole").when(F.col("lang") == "en", "mention")), "source")


@query(
    "a13_run_totals",
    "SELECT event_type AS kind, count(*)::BIGINT AS new, sum(user_id)::BIGINT AS scanned, sum(event_id % 2)::BIGINT AS pdp, sum(event_id % 3)::BIGINT AS mentions, count(*) FILTER (event_id % 1000 = 0) AS n_errors FROM events GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    runs = t.events.select(F.col("event_type").alias("kind"), F.lit(1).alias("new"), F.col("user_id").alias("scanned"), (F.col("event_id") % 2).alias("pdp"), (F.col("event_id") % 3).alias("mentions"), F.when(F.col("event_id") % 1000 == 0, F.col("event_id").cast("string")).alias("error"))
    return reports.run_totals(runs, "kind").select("kind", "new", "scanned", "pdp", "mentions", F.size("errors").cast("bigint").alias("n_errors"))


@query(
    "a14_method_stats",
    """SELECT event_type AS method, count(*) AS attempts, count(*) FILTER (user_id % 3 <> 0) AS successes, round(100.0::DOUBLE * count(*) FILTER (user_id % 3 <> 0) / count(*), 1) AS success_rate,
       count(*) FILTER (user_id % 3 <> 0) / count(*) > 0.5 AS healthy FROM events GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    a = t.events.select(F.col("event_type").alias("method"), (F.col("user_id") % 3 != 0).alias("success"), F.col("value").alias("duration_ms"))
    return reports.method_stats(a).drop("avg_duration_ms")


@query(
    "a15_batch_report",
    """SELECT lang AS country, count(*) AS n, count(*) FILTER (n_chars > 100) AS successes, round(100.0::DOUBLE * count(*) FILTER (n_chars > 100) / count(*), 1) AS success_rate,
       count(*) FILTER (n_chars > 3000) AS complete, round(100.0::DOUBLE * count(*) FILTER (n_chars > 3000) / count(*), 1) AS completeness_rate FROM documents GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return reports.batch_report(t.documents.select(F.col("lang").alias("country"), (F.col("n_chars") > 100).alias("success"), (F.col("n_chars") > 3000).alias("is_complete")), "country")


@query(
    "a16_issue_groups",
    """SELECT issue, n, samples FROM (SELECT n_regionkey AS issue, count(*) AS n FROM nation GROUP BY 1)
       JOIN (SELECT n_regionkey AS issue, string_agg(n_name, ',' ORDER BY n_name) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation) WHERE k <= 3 GROUP BY 1) USING (issue)""",
)
def _(t: Tables) -> DataFrame:
    out = reports.issue_groups(t.nation.select(F.col("n_regionkey").alias("issue"), F.col("n_name").alias("name")))
    return out.withColumn("samples", F.array_join("samples", ","))


@query("a17_positive_desc", "SELECT p_size, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1 HAVING count(*) > 0")
def _(t: Tables) -> DataFrame:
    return t.part.where("p_size > 40").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).where("n > 0").orderBy(F.desc("n"), "p_size")


# ---------------------------------------------------------------- freshness, health, sinks


@query(
    "d24_o07_freshness",
    f"""WITH s AS (SELECT c_custkey, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
       a AS (SELECT c_custkey, round((epoch_us({NOW}) - epoch_us(last)) / 3.6e9, 1) AS age_hours FROM s)
       SELECT c_custkey, age_hours, age_hours IS NULL OR age_hours > 240000 AS stale FROM a ORDER BY age_hours DESC NULLS FIRST, c_custkey""",
)
def _(t: Tables) -> DataFrame:
    last = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.max("o_orderdate").alias("last_collected_at"))
    return temporal.freshness(last, now(), stale_hours=240000).select("c_custkey", "age_hours", "stale").orderBy(F.desc_nulls_first("age_hours"), "c_custkey")


_STREAKS = """WITH l AS (SELECT user_id, max(event_id) FILTER (event_type <> 'error') AS ok, arg_max(event_type, event_id) AS last_status FROM events GROUP BY 1)
  SELECT user_id, CASE WHEN last_status = 'error' THEN 'error' ELSE 'ok' END AS last_status, (SELECT count(*) FROM events e WHERE e.user_id = l.user_id AND event_type = 'error' AND (ok IS NULL OR event_id > ok)) AS consecutive_failures FROM l"""


def _streaks(t: Tables) -> DataFrame:
    a = t.events.select("user_id", F.col("event_id").alias("attempt_id"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    return temporal.failure_streaks(a, "user_id")


@query("k08_failure_streaks", _STREAKS)
def _(t: Tables) -> DataFrame:
    return _streaks(t).select("user_id", "last_status", "consecutive_failures")


@query("d25_failing_collectors", f"SELECT user_id AS id, consecutive_failures FROM ({_STREAKS}) WHERE consecutive_failures >= 1 AND user_id % 2 = 0")
def _(t: Tables) -> DataFrame:
    h = _streaks(t).select(F.col("user_id").alias("id"), "consecutive_failures", (F.col("user_id") % 2 == 0).alias("is_active"))
    return temporal.failing(h, least=1).select("id", "consecutive_failures")


@query(
    "k01_k02_a18_insert_absent",
    """SELECT count(*) AS inserted FROM (SELECT DISTINCT sha256(trim(text)) AS k FROM documents WHERE doc_id % 2 = 0) WHERE k NOT IN (SELECT sha256(trim(text)) FROM documents WHERE doc_id % 2 = 1)""",
)
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2(F.trim("text"), 256).alias("guid"))
    return views.total(sinks.only_new(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "guid")).withColumnRenamed("total", "inserted")


@query(
    "k03_k04_merge",
    """SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, coalesce(b.c_name, a.c_name) AS c_name, coalesce(b.c_acctbal, a.c_acctbal) AS c_acctbal FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) a
       FULL JOIN (SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey""",
)
def _(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return sinks.merge(c.where("c_custkey % 3 <> 0"), new, "c_custkey")


@query(
    "k05_prune",
    """SELECT n_nationkey, 'kept' AS fate FROM nation WHERE NOT (n_nationkey % 2 = 1 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20))
       UNION ALL SELECT n_nationkey, 'skipped' FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20)""",
)
def _(t: Tables) -> DataFrame:
    kept, skipped = sinks.prune(t.nation, t.nation.where("n_nationkey % 2 = 0"), t.supplier.where("s_suppkey < 20"), "n_nationkey", "s_nationkey")
    return kept.select("n_nationkey", F.lit("kept").alias("fate")).unionByName(skipped.select("n_nationkey", F.lit("skipped").alias("fate")))


@query("k06_rebuild_affiliations", "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'known' ELSE c_mktsegment END AS party, count(*) AS n FROM customer GROUP BY 1")
def _(t: Tables) -> DataFrame:
    people = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("famille"), F.lit("RN").alias("group_code"))
    known = people.where("id % 10 = 0").select(F.col("id").alias("personality_id"), F.lit("known").alias("party"), F.lit(None).cast("date").alias("date_start"), F.lit(None).cast("date").alias("date_end"))
    return temporal.seed_affiliations(people, known).groupBy("party").agg(F.count(F.lit(1)).alias("n"))


@query("k07_fill_column", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE lang END, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END) AS lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL OR d.doc_id % 3 <> 0")
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    u = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("lang"))
    return sinks.fill_column(d, u, "doc_id", "lang").where("lang is not null")


@query(
    "k09_run_log",
    "SELECT user_id AS run_id, arg_max(CASE WHEN event_type = 'view' THEN 'RUNNING' ELSE 'COMPLETED' END, event_id) AS status, min(event_id) AS started_at, max(event_id) FILTER (event_type <> 'view') AS completed_at FROM events GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("run_id"), F.lit("x").alias("kind"), F.when(F.col("event_type") == "view", "RUNNING").otherwise("COMPLETED").alias("status"), F.col("event_id").alias("at"))
    return sinks.run_state(log).select("run_id", "status", "started_at", "completed_at")


@query("k11_f13_unique_slugs", "SELECT slug FROM (SELECT DISTINCT regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part) WHERE slug NOT IN (SELECT regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') FROM part WHERE p_partkey < 10)")
def _(t: Tables) -> DataFrame:
    have = t.part.where("p_partkey < 10").select(T.slug("p_type").alias("slug"))
    return sinks.create_unique(t.part.select("p_type"), have, "p_type", T.slug)[0].select("slug")


@query("k15_to_archive", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 ORDER BY doc_id DESC LIMIT 40")
def _(t: Tables) -> DataFrame:
    items = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, now()).alias("archived_at"))
    return sinks.to_archive(items).select("id")


@query(
    "k10_validation",
    """WITH d AS (SELECT event_id % 100 AS e, arg_max(event_type, event_id) AS decision FROM events WHERE event_type IN ('click', 'error') GROUP BY 1)
       SELECT c_custkey, CASE WHEN decision = 'click' THEN 'confirmed' WHEN decision = 'error' THEN 'rejected' ELSE 'pending' END AS status FROM customer LEFT JOIN d ON e = c_custkey""",
)
def _(t: Tables) -> DataFrame:
    from ..operators.contradictions import apply_validation

    edges = t.customer.select(F.col("c_custkey").alias("claim_a_id"), F.lit(0).alias("claim_b_id"), F.lit("pending").alias("status"))
    d = t.events.select((F.col("event_id") % 100).alias("claim_a_id"), F.lit(0).alias("claim_b_id"), F.when(F.col("event_type") == "click", "confirmed").when(F.col("event_type") == "error", "rejected").otherwise("unknown").alias("decision"), F.lit("v").alias("validator"), F.col("event_id").alias("validated_at"))
    return apply_validation(edges, d).select(F.col("claim_a_id").alias("c_custkey"), "status")


@query(
    "o05_o06_s15_best_attempt",
    """WITH a AS (SELECT doc_id % 300 AS url, doc_id AS attempt, n_chars > 3000 AS is_complete, n_chars AS word_count FROM documents)
       SELECT url, attempt, word_count FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY is_complete DESC, word_count DESC, attempt) AS k FROM a) WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    a = t.documents.select((F.col("doc_id") % 300).alias("url"), F.col("doc_id").alias("attempt"), (F.col("n_chars") > 3000).alias("is_complete"), F.col("n_chars").alias("word_count"))
    return landed.best_attempt(a).select("url", "attempt", "word_count")


@query(
    "s15_early_stop",
    """WITH a AS (SELECT doc_id % 300 AS url, doc_id AS attempt, n_chars > 3000 AS done, n_chars AS word_count FROM documents),
       s AS (SELECT *, coalesce(max((done OR word_count > 1900)::INT) OVER (PARTITION BY url ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM a)
       SELECT url, attempt FROM s WHERE stopped = 0""",
)
def _(t: Tables) -> DataFrame:
    a = t.documents.select((F.col("doc_id") % 300).alias("url"), F.col("doc_id").alias("attempt"), (F.col("n_chars") > 3000).alias("is_complete"), F.col("n_chars").alias("word_count"))
    return landed.stopped_attempts(a, target_words=2000).select("url", "attempt")


@query(
    "s14_longest_clean",
    """WITH a AS (SELECT doc_id % 300 AS url, doc_id AS attempt, text, doc_id % 4 = 0 AS wall, length(text) AS n FROM documents)
       SELECT url, attempt FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY (NOT wall AND n >= 350) DESC, CASE WHEN NOT wall AND n >= 350 THEN 0 ELSE (NOT wall)::INT END DESC, CASE WHEN NOT wall AND n >= 350 THEN 0 ELSE n END DESC, attempt) AS k FROM a) WHERE k = 1""",
)
def _(t: Tables) -> DataFrame:
    a = t.documents.select((F.col("doc_id") % 300).alias("url"), F.col("doc_id").alias("attempt"), "text", (F.col("doc_id") % 4 == 0).alias("paywalled"))
    return landed.longest_clean(a).select("url", "attempt")


@query(
    "s08_first_entries",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 60",
)
def _(t: Tables) -> DataFrame:
    return landed.first_entries(t.events.select("user_id", "event_id", F.col("event_id").alias("pos")), "user_id").select("user_id", "event_id")


@query(
    "s13_discover_feeds",
    """WITH p AS (SELECT user_id AS base, '/p' || (event_id % 10) AS pattern, event_id % 10 AS o, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) >= 3)
       SELECT base::VARCHAR AS base, arg_min(pattern, o) AS pattern FROM p GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    probes = t.events.groupBy(F.col("user_id").cast("string").alias("base"), F.concat(F.lit("/p"), (F.col("event_id") % 10).cast("string")).alias("pattern")).agg(F.count(F.lit(1)).alias("n_entries"))
    return landed.discover_feeds(probes.select("base").distinct(), probes, [f"/p{i}" for i in range(10)]).select("base", "pattern")


@query("n8_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"))).distinct()


@query(
    "d16_refresh_dossiers",
    """WITH n AS (SELECT user_id, count(*) AS k FROM events GROUP BY 1)
       SELECT user_id AS personality_id, CASE WHEN user_id % 3 = 0 THEN 7 ELSE k END::BIGINT AS n_claims, CASE WHEN user_id % 3 = 0 THEN 'old' WHEN k < 20 THEN NULL WHEN least(k, 50) % 4 = 0 THEN NULL ELSE least(k, 50) || ' facts' END AS summary,
         CASE WHEN user_id % 3 = 0 THEN 'cached' WHEN k < 20 THEN 'skipped' WHEN least(k, 50) % 4 = 0 THEN 'failed' ELSE 'generated' END AS state FROM n""",
)
def _(t: Tables) -> DataFrame:
    claims = t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("personality_id"), F.col("event_type").alias("theme"), F.lit("normatif").alias("claim_type"),
        F.col("ts").alias("published_at"), F.lit(None).cast("string").alias("canonical"), F.col("props").alias("verbatim"),
    )
    edges = t.events.where("event_id % 10 = 0").select(F.col("event_id").alias("claim_a_id"), (F.col("event_id") + 1).alias("claim_b_id"))
    kept = claims.where("personality_id % 3 = 0").select("personality_id").distinct().select("personality_id", F.lit(7).cast("bigint").alias("n_claims"), F.lit("old").alias("summary"))

    def summarise(facts):
        sizes = [len(f.split("\n")) for f in facts]
        return [None if n % 4 == 0 else f"{n} facts" for n in sizes]

    return reports.refresh_dossiers(claims, edges, kept, summarise, least=20)
