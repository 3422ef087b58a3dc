"""Queries of the scalar, HTML and cleaning functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as T
from ..operators import extraction as X
from ..operators.lexicon import escape
from ..sources import landed
from .registry import Tables, query

_ACCENTS = f"lower(translate(regexp_replace({{0}}, '\\p{{{{Mn}}}}+', '', 'g'), '{T.ACCENTED}', '{T.UNACCENTED}'))"


def plain_sql(x: str) -> str:
    """text.unaccent over the characters of the driver's tables."""
    return _ACCENTS.format(x)


WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> ''))"


def words_sql(x: str) -> str:
    return WORDS.format(x)


@query("f01_f12_f39_hashes", "SELECT doc_id, sha256(trim(text)) AS sha, sha256(lower(trim(text))) AS content_hash, left(sha256(text), 16) AS short FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.sha256("text").alias("sha"), T.content_hash("text").alias("content_hash"), T.short_hash("text").alias("short"))


@query("k01_dedup_by_content", "SELECT min(doc_id) AS doc_id, sha256(lower(trim(text))) AS h FROM documents GROUP BY 2")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy(T.content_hash("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("f02_f30_clean_html", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\\s\\v\\p{Z}\\x{85}]+', ' ', 'g')) AS body FROM pages""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.clean_html("html").alias("body"))


@query("f03_f04_unaccent", f"SELECT doc_id, trim(regexp_replace({plain_sql('text')}, '\\s+', ' ', 'g')) AS norm FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.normal("text").alias("norm"))


@query("f05_f06_words_minutes", f"SELECT doc_id, {words_sql('text')}::BIGINT AS words, greatest(1, {words_sql('text')} // 200)::BIGINT AS minutes FROM documents")
def _(t: Tables) -> DataFrame:
    n = T.word_count("text")
    return t.documents.select("doc_id", n.cast("bigint").alias("words"), T.reading_minutes(n).cast("bigint").alias("minutes"))


@query("f07_parse_count", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 90 + 1) * 1000 WHEN 1 THEN event_id * 1000 + 234 ELSE 0 END::BIGINT AS n FROM events")
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    shown = F.when(i % 3 == 0, F.concat((i % 90 + 1).cast("string"), F.lit("K"))).when(i % 3 == 1, F.concat(i.cast("string"), F.lit(",234"))).otherwise("")
    return t.events.select("event_id", T.parse_count(shown).alias("n"))


@query("f08_f09_dates", "SELECT event_id, date_trunc('second', ts) AS rss, date_trunc('minute', ts) AS html FROM events")
def _(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    df = t.events.select("event_id", F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("p"), F.concat(F.date_format(ts, "MMM d, yyyy"), F.lit(" · "), F.date_format(ts, "h:mm a"), F.lit(" UTC")).alias("q"), F.lit(None).cast("string").alias("u"))
    return df.select("event_id", T.feed_time("p", "u").alias("rss"), T.timeline_time("q").alias("html"))


@query("f10_f11_guid", "SELECT event_id, user_id::VARCHAR AS sid, sha256('u' || event_id % 9 || '/status/' || user_id) AS guid FROM events")
def _(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://mirror.example/U/status/"), F.col("user_id").cast("string"), F.lit("#m"))
    df = t.events.select("event_id", url.alias("url"), F.concat(F.lit("U"), (F.col("event_id") % 9).cast("string")).alias("handle"))
    return df.select("event_id", T.status_id("url").alias("sid"), T.post_guid("handle", "url").alias("guid"))


@query("f13_slug", f"SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace({plain_sql('text')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '-+$', '') AS slug FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.slug("text").alias("slug"))


@query("f15_f16_f17_numbers", "SELECT event_id, abs(value - user_id) / greatest(abs(value), abs(user_id::DOUBLE), 1.0::DOUBLE) AS diff, round(100.0::DOUBLE * (event_id % 7) / 8, 1) AS pct, round((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(ts)) / 3.6e9, 1) AS age FROM events")
def _(t: Tables) -> DataFrame:
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return t.events.select("event_id", T.relative_difference(F.col("value"), F.col("user_id").cast("double")).alias("diff"), T.percent(F.col("event_id") % 7, F.lit(8)).alias("pct"), T.age_hours("ts", now).alias("age"))


@query("f18_f19_f20_labels", "SELECT event_id, coalesce(strftime(CASE WHEN event_id % 4 <> 0 THEN ts END, '%Y-%m-%d'), '?') AS day, left(event_type, 3) AS cut, CASE WHEN event_id % 2 = 0 THEN event_type ELSE trim(props) END AS shown FROM events")
def _(t: Tables) -> DataFrame:
    df = t.events.withColumn("at", F.when(F.col("event_id") % 4 != 0, F.col("ts"))).withColumn("canonical", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(""))
    return df.select("event_id", T.iso_date("at").alias("day"), T.truncate("event_type", 3).alias("cut"), T.representative("canonical", "props").alias("shown"))


#: text.plain_text: tags, link targets, addresses and e-mail addresses.
_PLAIN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), 'https?://\\S+|www\\.\\S+', '', 'g'), "
    "'\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b', '', 'g')"
)


@query("f21_plain_text", f"SELECT doc_id, {_PLAIN} AS body FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.plain_text("text").alias("body"))


def _boilerplate_sql() -> str:
    out = "text"
    for pattern in T.BOILERPLATE:
        out = f"regexp_replace({out}, '(?im){pattern.replace(chr(39), chr(39) * 2)}', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+|[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}]+$', '', 'g')"


@query("f22_boilerplate", f"SELECT doc_id, length(x)::BIGINT AS n, sha256(x) AS sha FROM (SELECT doc_id, {_boilerplate_sql()} AS x FROM documents)")
def _(t: Tables) -> DataFrame:
    clean = t.documents.select("doc_id", T.clean_boilerplate("text").alias("x"))
    return clean.select("doc_id", F.length("x").cast("bigint").alias("n"), F.sha2("x", 256).alias("sha"))


@query("f23_truncate_words", f"SELECT doc_id, CASE WHEN {words_sql('text')} <= 50 THEN text ELSE array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:50], ' ') || '...' END AS head FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.truncate_words("text", 50).alias("head"))


@query(
    "f24_jaccard",
    """WITH p AS (SELECT a.doc_id, list_distinct(list_filter(string_split_regex(a.text, '\\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split_regex(b.text, '\\s+'), lambda x: x <> '')) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
       SELECT doc_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) END AS similarity FROM p""",
)
def _(t: Tables) -> DataFrame:
    b = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return t.documents.select("doc_id", "text").join(b, "doc_id").select("doc_id", T.jaccard("text", "other").alias("similarity"))


@query("f25_paragraphs", "SELECT doc_id, len(list_filter(string_split_regex(trim(text), '\\n\\s*\\n'), lambda p: length(trim(p)) > 20))::BIGINT AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.paragraphs("text")).cast("bigint").alias("n"))


@query("f26_script_language", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))::DOUBLE / length(text) > 0.3 THEN 'en' ELSE 'unknown' END AS script FROM documents WHERE length(text) > 0")
def _(t: Tables) -> DataFrame:
    return t.documents.where("length(text) > 0").select("doc_id", T.script_language("text").alias("script"))


_SIGNS = "len(list_filter([" + ", ".join("'" + s.replace("'", "''") + "'" for s in X.TEXT_WALL) + "], lambda s: contains(lower(text), s)))"
_CUT = "regexp_matches(right(trim(text), {0}), '(?m)\\.\\.\\.$|…$|\\[\\.\\.\\.\\]{1}')"


@query("f27_wall_signs", f"SELECT doc_id, {_SIGNS}::BIGINT AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.wall_signs("text")).cast("bigint").alias("n"))


@query(
    "f28_f29_meta_json_ld",
    """SELECT page_id, nullif(regexp_extract(html, '(?is)<meta[^>]+(?:property|name)=["'']viewport["''][^>]+content=["'']([^"'']*)["'']', 1), '') AS viewport,
       len(regexp_extract_all(html, '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1))::BIGINT AS blocks FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", M.meta_content("html", "viewport").alias("viewport"), F.size(M.json_ld("html")).cast("bigint").alias("blocks"))


@query(
    "d26_page_metadata",
    """WITH p AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>|<!--.*?-->', ' ', 'g') AS page, html FROM pages)
       SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), ''),
                                nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '')) AS title,
       trim(regexp_replace(regexp_replace(CASE WHEN regexp_extract(page, '(?is)<article\\b[^>]*>(.*?)</article>', 1) <> '' THEN regexp_extract(page, '(?is)<article\\b[^>]*>(.*?)</article>', 1) ELSE page END, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM p""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", M.title("html").alias("title"), M.body("html").alias("body"))


@query(
    "f31_f32_links",
    """SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1)))::BIGINT AS n_links,
       list_sort(list_distinct(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1)))[1] AS first FROM pages""",
)
def _(t: Tables) -> DataFrame:
    ls = M.links("html")
    return t.pages.select("page_id", F.size(ls).cast("bigint").alias("n_links"), F.get(F.array_sort(ls), F.lit(0)).alias("first"))


@query(
    "p12_f33_domain",
    "SELECT page_id, replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), 'www.', '') AS domain, false AS premium FROM pages",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.domain("url").alias("domain"), T.is_premium("url").alias("premium"))


@query("d27_archive_target", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'https://x.com/a/status/' || event_id ELSE 'https://m.example/a/status/' || event_id END AS target FROM events")
def _(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://m.example/a/status/"), F.col("event_id").cast("string"))
    kind = F.when(F.col("event_id") % 2 == 0, "x").otherwise("press")
    return t.events.select("event_id", T.archive_target(kind, url).alias("target"))


@query("f34_d21_handles", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'h' || c_custkey ELSE c_name END AS handle, trim(lower(replace(c_name, '#', '#'))) AS name FROM customer")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "@ à confirmer").when(k % 4 == 1, F.concat(F.lit(" @@h"), k.cast("string"))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", T.clean_handle(raw).alias("handle"), T.normalize_name("c_name").alias("name"))


@query("d23_media_mapping", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'far_right' WHEN 1 THEN 'far_left' WHEN 2 THEN 'right' WHEN 3 THEN 'left' ELSE 'center' END AS leaning, CASE n_nationkey % 4 WHEN 0 THEN 'regional' WHEN 1 THEN 'pure_player' WHEN 2 THEN 'magazine' ELSE 'national' END AS category FROM nation")
def _(t: Tables) -> DataFrame:
    pick = lambda n, values: F.get(F.array(*map(F.lit, values)), F.col("n_nationkey") % n)
    o = pick(5, ["Extreme droite", "gauche radicale", "droite", "gauche", "divers"])
    return t.nation.select("n_nationkey", T.leaning(o).alias("leaning"), T.media_category(pick(4, ["", "Pure player", "hebdo", "quotidien"]), pick(4, ["Regional", "", "", ""])).alias("category"))


WORTH = "len(regexp_extract_all(regexp_replace({0}, 'https?://\\S+|www\\.\\S+', '', 'g'), '[A-Za-zÀ-ÿ]{{2,}}')) >= 5"
#: A repost mark is a word of its own; the letters of the driver's tables are \pL.
_CLASSIFIABLE = "len(regexp_extract_all(regexp_replace(regexp_replace({0}, '(?i)https?://\\S+|@[\\pL\\pN_]+|#[\\pL\\pN_]+', ' ', 'g'), '(?i)(^|[^\\pL\\pN_])RT( by)?($|[^\\pL\\pN_])', '\\1 \\3', 'g'), '\\pL{{2,}}')) >= 4"


@query("p10_substance", f"SELECT doc_id, {WORTH.format('text')} AS worth, {_CLASSIFIABLE.format('text')} AS classifiable FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.worth_segmenting("text").alias("worth"), T.classifiable("text").alias("classifiable"))


#: text.canonical_quote over the characters of the driver's tables.
_QUOTE = "trim(regexp_replace(" + plain_sql("replace(replace(translate({0}, '«»“”’‘–—', '\"\"\"\"''''--'), '…', '...'), '\"', ' ')") + ", '[\\s\\x0B\\x1C-\\x1F]+', ' ', 'g'))"


def quote_sql(x: str) -> str:
    return _QUOTE.replace("{0}", x)


# words from the middle of each text, of which every third has another letter at its end
_SAID = "substr(text, (length(text) // 2 + 1)::INT, 60) || CASE doc_id % 3 WHEN 0 THEN 'x' ELSE '' END"


@query("d08_verbatim_in_source", f"SELECT doc_id, length({quote_sql(_SAID)}) >= 12 AND contains({quote_sql('text')}, {quote_sql(_SAID)}) AS found FROM documents")
def _(t: Tables) -> DataFrame:
    said = F.concat(F.substr("text", (F.floor(F.length("text") / 2) + 1).cast("int"), F.lit(60)), F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))
    return t.documents.select("doc_id", T.verbatim_in_source(said, "text").alias("found"))


@query(
    "d19_completeness_score",
    f"""SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {words_sql('text')} / 500.0::DOUBLE) - least(0.5::DOUBLE, {_SIGNS} * 0.25::DOUBLE) - CASE WHEN {_CUT.format(50, '')} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END), 3) AS score FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.completeness_score("text").alias("score"))


@query(
    "d19_completeness_reason",
    f"""SELECT doc_id, CASE WHEN text = '' THEN 'empty_content' WHEN {words_sql('text')} < 150 THEN 'word_count_too_low:' || {words_sql('text')} || '<150' WHEN length(text) / {words_sql('text')} < 3 THEN 'low_char_ratio'
        WHEN {_SIGNS} > 0 THEN 'paywall_indicators:' || {_SIGNS} WHEN {_CUT.format(100, '|' + chr(92) + '(' + chr(92) + 's*' + chr(92) + '.{3,}' + chr(92) + 's*' + chr(92) + ')')} THEN 'truncation_pattern' ELSE 'complete' END AS reason FROM documents""",
)
def _(t: Tables) -> DataFrame:
    r = X.completeness_reason("text")
    return t.documents.select("doc_id", F.regexp_replace(F.regexp_replace(r, "^(low_char_ratio|truncation_pattern):.*", "$1"), "$", "").alias("reason"))


@query("d19_extraction", "SELECT doc_id, NOT regexp_matches(left(text, 4000), '(?i)abonnez-vous|pour lire la suite') AND length(text) >= 350 AS is_full FROM documents WHERE text <> ''")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text <> ''").select("doc_id", X.extraction("text", F.lit("jina_ai"))["is_full"].alias("is_full"))


@query(
    "d19_d28_confidence",
    f"""SELECT doc_id, least(1.0::DOUBLE, CASE doc_id % 3 WHEN 0 THEN 0.85::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END + CASE WHEN {words_sql('text')} > 500 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {words_sql('text')} > 1000 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) AS confidence,
        {words_sql('text')} < 200 AND length(text) > 400 AND {words_sql('text')} >= 80 AND {words_sql('text')} >= 150 AND {_SIGNS} = 0 AS accepted FROM documents""",
)
def _(t: Tables) -> DataFrame:
    m = F.when(F.col("doc_id") % 3 == 0, "curl_cffi").when(F.col("doc_id") % 3 == 1, "playwright_stealth").otherwise("other")
    return t.documents.select("doc_id", X.confidence(m, T.word_count("text")).alias("confidence"), X.accept_cleanup("text", "text").alias("accepted"))


@query("f41_page_state", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN CASE WHEN length(html) > 1000 THEN 'accessible' ELSE 'empty_page' END WHEN 1 THEN 'forbidden' WHEN 2 THEN 'not_found' WHEN 3 THEN 'server_error' ELSE 'timeout' END AS state FROM pages")
def _(t: Tables) -> DataFrame:
    status = F.get(F.array(F.lit(200), F.lit(403), F.lit(404), F.lit(502), F.lit(None).cast("int")), F.col("page_id") % 5)
    return t.pages.select("page_id", X.page_state(status, F.regexp_replace("html", "(?i)blocked|denied|cloudflare", "")).alias("state"))


@query("d03_sentences", "SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s) <> ''))::BIGINT AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.sentences("text")).cast("bigint").alias("n"))


def _clean_sql(boilerplate: str) -> str:
    """Articles without the lines (s, normalised n) that meet a condition, and without repeats of the line before."""
    return f"""WITH l AS (SELECT doc_id, u.i, trim(regexp_replace(s, '[ \\t]+', ' ', 'g')) AS s FROM (SELECT doc_id, string_split({_PLAIN}, chr(10)) AS a FROM documents), unnest(range(1, len(a) + 1)) AS u(i), unnest([a[u.i]]) AS v(s)),
       k AS (SELECT * FROM (SELECT *, trim({plain_sql('s')}) AS n FROM l) WHERE NOT ({boilerplate})),
       p AS (SELECT *, last_value(nullif(s, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
       c AS (SELECT doc_id, trim(regexp_replace(coalesce(string_agg(s, chr(10) ORDER BY i), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS cleaned FROM p WHERE s = '' OR before IS NULL OR s <> before GROUP BY doc_id)
       SELECT doc_id, coalesce(cleaned, '') AS cleaned FROM documents LEFT JOIN c USING (doc_id)"""


_any_of = lambda terms: "|".join(map(escape, terms)).replace("'", "''")
_DEFAULT = f"n <> '' AND (regexp_matches(n, '^(?:{_any_of(X.LINE_PREFIXES)})') OR regexp_matches(n, '^\\d+\\s*min(utes?)?\\b') AND {words_sql('n')} <= {X.READING_WORDS} OR {words_sql('n')} <= {X.SHORT_WORDS} AND regexp_matches(n, '{_any_of(X.SHORT_MARKERS)}'))"


@query("d17_clean_article", _clean_sql("starts_with(n, 'the ') OR starts_with(n, 'de ')"))
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_article("text", prefixes=("the ", "de "), markers=("\u0001",)).alias("cleaned"))


@query("d17_clean_article_default", f"SELECT doc_id, length(cleaned)::BIGINT AS n, sha256(cleaned) AS sha FROM ({_clean_sql(_DEFAULT)})")
def _(t: Tables) -> DataFrame:
    clean = t.documents.select("doc_id", X.clean_article("text").alias("x"))
    return clean.select("doc_id", F.length("x").cast("bigint").alias("n"), F.sha2("x", 256).alias("sha"))


@query("s18_wayback", "SELECT page_id, page_id % 2 = 0 OR page_id % 3 = 0 AS available, CASE WHEN page_id % 5 <> 0 THEN url END AS url FROM pages WHERE page_id % 5 <> 0")
def _(t: Tables) -> DataFrame:
    body = F.concat(F.lit('{"archived_snapshots":{"closest":{"available":'), (F.col("page_id") % 2 == 0).cast("string"), F.lit(',"url":"'), F.col("url"), F.lit('","status":"'), F.when(F.col("page_id") % 3 == 0, "200").otherwise("404"), F.lit('"}}}'))
    w = landed.wayback(body)
    return t.pages.where("page_id % 5 <> 0").select("page_id", w["available"].alias("available"), w["url"].alias("url"))


@query("s06_d20_rss_posts", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'retweet' WHEN 1 THEN 'reply' ELSE 'original' END AS post_type, sha256('u/status/' || event_id) AS guid, date_trunc('second', ts) AS published_at, (CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 5 ELSE 2 END)::INTEGER AS word_count FROM events")
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    title = F.concat(F.when(i % 3 == 0, "RT by @u: ").when(i % 3 == 1, "R to @v: ").otherwise(""), F.col("event_type"), F.lit(" &amp;amp;"))
    item = F.concat(F.lit('<?xml version="1.0"?><rss><channel><item><title>'), title, F.lit("</title><link>http://m/u/status/"), i.cast("string"), F.lit("#m</link><pubDate>"), F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item></channel></rss>"))
    feeds = t.events.select("event_id", F.concat(F.lit("u")).alias("handle"), item.alias("xml"))
    out = landed.rss_posts(feeds)
    return out.select(T.status_id("url").cast("bigint").alias("event_id"), "post_type", "guid", "published_at", "word_count")


@query("s07_f09_timeline_posts", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'retweet' WHEN 1 THEN 'reply' ELSE 'original' END AS post_type, (event_id * 1000 + 234)::BIGINT AS likes, date_trunc('minute', ts) AS published_at FROM events")
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    head = F.when(i % 3 == 0, '<div class="retweet-header">x</div>').when(i % 3 == 1, '<div class="replying-to">Replying to <a>@v</a></div>').otherwise("")
    page = F.concat(
        F.lit('<div class="timeline-item">'), head, F.lit('<span class="tweet-date"><a href="/u/status/'), i.cast("string"), F.lit('#m" title="'), F.date_format(ts, "MMM d, yyyy"), F.lit(" · "), F.date_format(ts, "h:mm a"),
        F.lit(' UTC">d</a></span><div class="tweet-content">'), F.col("event_type"), F.lit('</div><div class="tweet-stats"><span class="tweet-stat"><div><span class="icon-heart"></span> '), i.cast("string"), F.lit(",234</div></span></div></div>"),
    )
    out = landed.timeline_posts(t.events.select(F.lit("u").alias("handle"), page.alias("html")))
    return out.select(T.status_id("url").cast("bigint").alias("event_id"), "post_type", F.col("likes").cast("bigint").alias("likes"), "published_at")


@query("s08_s09_press_entries", "SELECT doc_id, doc_id % 3 AS pos, trim(left(regexp_replace(text, '[^a-z ]', '', 'g'), 40)) <> '' AS titled FROM documents")
def _(t: Tables) -> DataFrame:
    safe = F.regexp_replace("text", "[^a-z ]", "")
    item = F.concat(F.lit("<item><title>"), F.substring(safe, 1, 40), F.lit("</title><link>http://p/"), F.col("doc_id").cast("string"), F.lit("</link></item>"))
    feeds = t.documents.groupBy(F.floor(F.col("doc_id") / 3).alias("media_source_id")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("x"))))["x"], ""), F.lit("</channel></rss>")).alias("xml"))
    out = landed.press_entries(feeds)
    return out.select(F.regexp_extract("link", "([0-9]+)$", 1).cast("bigint").alias("doc_id"), F.col("pos").cast("bigint").alias("pos"), (F.col("title") != "").alias("titled"))


_MONTHS = ", ".join(f"'{m}'" for m in T.MONTHS)
_SHORT = ", ".join(f"'{m}'" for m in T.SHORT_MONTHS)
_AGE = "(epoch_us(TIMESTAMP '2024-01-20 00:00:00') // 1000000 - epoch_us(ts) // 1000000)"


@query(
    "f38_presentation",
    f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' WHEN {_AGE} < 60 THEN 'à l''instant' WHEN {_AGE} < 3600 THEN 'il y a ' || {_AGE} // 60 || ' min' WHEN {_AGE} < 86400 THEN 'il y a ' || {_AGE} // 3600 || ' h'
      WHEN {_AGE} < 604800 THEN 'il y a ' || {_AGE} // 86400 || ' j' ELSE day(ts) || ' ' || [{_SHORT}][month(ts)] || ' ' || year(ts) END AS age,
      day(ts) || ' ' || [{_MONTHS}][month(ts)] || ' ' || year(ts) || ' à ' || strftime(ts, '%H:%M') AS day, replace(format('{{:,}}', event_id * 1237), ',', chr(8239)) AS number,
      'a &amp; &lt;b&gt; <a href="https://x.y/' || event_id || '">https://x.y/' || event_id || '</a> <b>@' || event_type || '</b> <i>#t' || event_id || '</i> c@d' AS html FROM events""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("event_id").cast("string")
    text = F.concat(F.lit("a & <b> https://x.y/"), i, F.lit(" @"), F.col("event_type"), F.lit(" #t"), i, F.lit(" c@d"))
    at = F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("timestamp"))
    return t.events.select("event_id", T.relative_time(at, F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("age"), T.exact_date(F.col("ts").cast("timestamp")).alias("day"), T.french_number(F.col("event_id") * 1237).alias("number"), T.linkify(text).alias("html"))


@query(
    "f35_sniffers",
    """SELECT page_id, nullif(regexp_extract(html, '(?i)<img[^>]+src=["'']([^"'']+)', 1), '') AS image, page_id % 3 = 0 AS rss, contains(html, 'timeline-item') AND length(html) > 2000 OR page_id % 5 = 0 AND length(html) > 2000 - 13 AS timeline FROM pages""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("page_id")
    feed = F.concat(F.when(i % 3 == 0, "  <?xml version='1.0'?>\n<RSS>").otherwise("<?xml version='1.0'?>"), F.regexp_replace("html", "(?i)<rss", ""))
    page = F.concat(F.when(i % 5 == 0, "timeline-item").otherwise(""), "html")
    return t.pages.select("page_id", T.link_image("html").alias("image"), T.looks_like_rss(feed).alias("rss"), T.looks_like_timeline(page).alias("timeline"))
