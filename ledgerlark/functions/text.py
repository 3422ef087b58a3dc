"""Scalar text functions as Column expressions; no Python workers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose compatibility decomposition is one ASCII character once marks are dropped, by rule from the Unicode table.
_PLAIN = {c: d for c in map(chr, range(0xA0, 0x250)) if len(d := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()) == 1 and d.isascii()}
ACCENTED, UNACCENTED = "".join(_PLAIN), "".join(_PLAIN.values())
#: Characters that decompose into several. Fixed values.
WIDE = {"…": "...", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "™": "tm", "№": "no"}
SPACE = r"(?U)\s"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACE + "+", " "))


def unaccent(c: Column | str) -> Column:
    """Lower case without accents: compatibility decomposition of the Latin blocks, marks dropped. Null gives ''."""
    out = F.coalesce(col(c), F.lit(""))
    for wide, plain in WIDE.items():
        out = F.replace(out, F.lit(wide), F.lit(plain))
    return F.lower(F.translate(F.regexp_replace(out, r"\p{Mn}+", ""), ACCENTED, UNACCENTED))


def normal(c: Column | str) -> Column:
    """unaccent, then squeeze."""
    return squeeze(unaccent(c))


def sha256(c: Column | str) -> Column:
    return F.sha2(strip(c), 256)


def content_hash(c: Column | str) -> Column:
    return sha256(F.lower(col(c)))


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 16)


def words(c: Column | str) -> Column:
    """Tokens between white space, null and blank texts have none."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def reading_minutes(n: Column | str, per_minute: int = 200) -> Column:
    return F.greatest(F.lit(1), F.floor(col(n) / per_minute).cast("int"))


def slug(c: Column | str, length: int = 80) -> Column:
    """Lower-case ASCII words joined by '-'; 'x' if nothing is left."""
    out = F.substring(F.regexp_replace(F.regexp_replace(unaccent(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length)
    out = F.regexp_replace(out, "-+$", "")
    return F.when(out == "", "x").otherwise(out)


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def truncate_words(c: Column | str, n: int) -> Column:
    """At most n words, then '...'; a short text is unchanged; null gives ''."""
    w = words(c)
    return F.when(F.size(w) <= n, F.coalesce(col(c), F.lit(""))).otherwise(F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("...")))


def representative(canonical: Column | str, verbatim: Column | str) -> Column:
    """The canonical wording, else the verbatim, else ''."""
    return strip(F.coalesce(F.nullif(col(canonical), F.lit("")), col(verbatim), F.lit("")))


def parse_count(c: Column | str) -> Column:
    """Displayed counts: '1.2K', '12K', '3M' are scaled; '1 234', '1,234', '1.234' are whole; without digits 0, not a number null."""
    t = F.translate(F.coalesce(col(c), F.lit("")), " \u00a0", "")
    raw, unit = (F.regexp_extract(t, r"([0-9.,]+)\s*([KkMm])?", k) for k in (1, 2))
    scaled = F.floor(F.replace(raw, F.lit(","), F.lit(".")).try_cast("double") * F.when(F.lower(unit) == "k", 1_000).otherwise(1_000_000)).cast("bigint")
    return F.when(raw == "", F.lit(0).cast("bigint")).when(unit != "", scaled).otherwise(F.translate(raw, ",.", "").try_cast("bigint"))


def status_id(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(url), r"/status/([0-9]+)", 1), F.lit(""))


def post_guid(handle: Column | str, url: Column | str) -> Column:
    """One identifier for all forms of a post's address: lower-case handle and status number, else the address."""
    return sha256(F.coalesce(F.concat(F.lower(col(handle)), F.lit("/status/"), status_id(url)), col(url), F.lit("")))


def domain(url: Column | str) -> Column:
    """Host without 'www.'; not an address: ''."""
    return F.replace(F.lower(F.coalesce(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))), F.lit("www."), F.lit(""))


#: Hosts known to have a pay wall. Fixed values.
PREMIUM = ("haaretz.com", "lemonde.fr", "lefigaro.fr", "nytimes.com", "wsj.com", "ft.com", "thetimes.co.uk", "telegraph.co.uk", "washingtonpost.com", "bloomberg.com", "economist.com")


def is_premium(url: Column | str) -> Column:
    host = domain(url)
    out = F.lit(False)
    for d in PREMIUM:
        out = out | F.contains(host, F.lit(d))
    return out


def archive_target(kind: Column | str, url: Column | str) -> Column:
    """Posts seen on a mirror are archived under their canonical address; press addresses are kept."""
    u = col(url)
    path = F.regexp_extract(u, r"^[a-zA-Z]+://[^/]*(/[^?#]*)", 1)
    return F.when((col(kind) == "x") & F.contains(path, F.lit("/status/")), F.concat(F.lit("https://x.com"), path)).otherwise(u)


def clean_handle(c: Column | str) -> Column:
    """A handle without '@'; null if it is empty, 'x' or still to be confirmed."""
    t = F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), "^@+", "")
    return F.when((t == "") | (F.lower(t) == "x") | F.contains(F.lower(t), F.lit("confirmer")), None).otherwise(t)


def handle_of_path(path: Column | str) -> Column:
    """'/name/status/1#m' gives 'name'."""
    return F.nullif(F.substring_index(F.regexp_replace(F.coalesce(col(path), F.lit("")), "^/+", ""), "/", 1), F.lit(""))


def normalize_name(c: Column | str) -> Column:
    """Names compared: no title, no accents, punctuation as blanks."""
    t = F.replace(F.replace(F.coalesce(col(c), F.lit("")), F.lit("M."), F.lit(" ")), F.lit("Mme"), F.lit(" "))
    return squeeze(F.translate(unaccent(t), "'’.-_()", "       "))


def group_of_family(c: Column | str) -> Column:
    f = F.lower(F.trim(col(c)))
    return F.when(f == "rn", "RN").when(f == "udr", "UDR").otherwise("FIGURE")


def _any(t: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.contains(t, F.lit(k))
    return out


def leaning(orientation: Column | str) -> Column:
    """Political leaning of a medium from its description; the more specific wording first."""
    o = F.lower(F.coalesce(col(orientation), F.lit("")))
    far_right = ("extreme droite", "extreme-droite", "droite radicale", "nouvelle droite", "proche extreme droite", "agregateur extreme")
    far_left = ("extreme gauche", "gauche radicale", "gauche communiste")
    return F.when(_any(o, far_right), "far_right").when(_any(o, far_left), "far_left").when(_any(o, ("droite",)), "right").when(_any(o, ("gauche",)), "left").otherwise("center")


def media_category(kind: Column | str, reach: Column | str) -> Column:
    t = F.lower(F.coalesce(col(kind), F.lit("")))
    return (
        F.when(F.contains(F.lower(F.coalesce(col(reach), F.lit(""))), F.lit("regional")), "regional")
        .when(_any(t, ("pure player",)), "pure_player")
        .when(_any(t, ("hebdo", "mensuel", "revue", "magazine")), "magazine")
        .otherwise("national")
    )


def bar(n: Column, total: Column, width: int = 30) -> Column:
    return F.when(total > 0, F.repeat(F.lit("█"), F.floor(n * width / total).cast("int"))).otherwise("")


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "<[^>]+>", " ")


#: Named references of HTML that occur in feeds; numeric ones are handled by rule. Fixed values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#8217;": "’", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&eacute;": "é", "&egrave;": "è", "&agrave;": "à", "&ecirc;": "ê", "&ccedil;": "ç", "&laquo;": "«", "&raquo;": "»", "&hellip;": "…", "&rsquo;": "’", "&euro;": "€", "&amp;": "&"}


def unescape(c: Column | str) -> Column:
    """Common references; functions.markup.unescape_all knows every one."""
    out = col(c)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def clean_html(c: Column | str) -> Column:
    """Tags as blanks, references resolved, white space squeezed; null gives ''."""
    return squeeze(unescape(strip_tags(F.coalesce(col(c), F.lit("")))))


def plain_text(c: Column | str) -> Column:
    """Without tags, link targets, addresses and e-mail addresses."""
    t = strip_tags(c)
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"https?://\S+|www\.\S+", "")
    return F.regexp_replace(t, r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "")


#: Lines of these kinds are boilerplate; each goes up to its end. Fixed values.
BOILERPLATE = (
    r"©\s*\d{4}.*?\n", r"Copyright\s*©?\s*\d{4}.*?\n", r"Tous droits réservés.*?\n", r"All rights reserved.*?\n", r"Share this article.*?\n", r"Partager sur.*?\n",
    r"Partagez.*?\n", r"Suivez-nous.*?\n", r"Follow us.*?\n", r"Subscribe to.*?\n", r"Abonnez-vous.*?\n", r"Newsletter.*?\n", r"Read next.*?\n", r"Article suivant.*?\n",
    r"Article précédent.*?\n", r"Related articles.*?\n", r"Articles liés.*?\n", r"Voir aussi.*?\n", r"See also.*?\n", r"Plus de sujets.*?\n", r"More on this topic.*?\n",
    r"Show comments.*?\n", r"Afficher les commentaires.*?\n", r"Leave a comment.*?\n", r"Laisser un commentaire.*?\n", r"Tags\s*:.*?\n", r"Mots-clés\s*:.*?\n",
    r"Categories\s*:.*?\n", r"Catégories\s*:.*?\n", r"About the author.*?\n", r"À propos de l'auteur.*?\n", r"\d+\s*min(?:utes?)?\s*(?:de lecture|read)?.*?\n",
    r"Lecture\s*:\s*\d+.*?\n", r"^Taille du texte.*?\n", r"^La suite de l'article.*?\n", r"^La suite après.*?\n", r"^Continuer.*?\n",
)


def clean_boilerplate(c: Column | str) -> Column:
    out = col(c)
    for pattern in BOILERPLATE:
        out = F.regexp_replace(out, "(?imu)" + pattern, "\n")
    return strip(F.regexp_replace(out, r"\n\s*\n\s*\n+", "\n\n"))


def paragraphs(c: Column | str, least: int = 20) -> Column:
    """Paragraphs (blank lines between) of more than `least` characters."""
    return F.filter(F.transform(F.split(strip(F.coalesce(col(c), F.lit(""))), r"\n\s*\n"), strip), lambda p: F.length(p) > least)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared share of two texts' word sets; 0 if one is empty."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def merge_fragments(fragments: Column | str, similar: float = 0.8) -> Column:
    """Fragments in order, without those whose word set resembles an earlier kept one; joined by blank lines."""
    zero = F.array().cast("array<string>")
    norm = lambda f: squeeze(F.lower(f))
    fold = F.aggregate(
        col(fragments),
        F.struct(zero.alias("seen"), zero.alias("kept")),
        lambda a, f: F.when(F.exists(a["seen"], lambda s: jaccard(norm(f), s) > similar), a).otherwise(
            F.struct(F.concat(a["seen"], F.array(norm(f))).alias("seen"), F.concat(a["kept"], F.array(f)).alias("kept"))
        ),
    )
    return F.array_join(fold["kept"], "\n\n")


def script_language(c: Column | str) -> Column:
    """Language by script: ar, he, ru above a tenth of the characters, en for Latin above three tenths, else unknown; empty gives null."""
    t = col(c)
    share = lambda rx: (F.length(t) - F.length(F.regexp_replace(t, rx, ""))) / F.length(t)
    return (
        F.when(t.isNull() | (F.length(t) == 0), F.lit(None).cast("string"))
        .when(share("[\\u0600-\\u06FF]") > 0.1, "ar")
        .when(share("[\\u0590-\\u05FF]") > 0.1, "he")
        .when(share("[\\u0400-\\u04FF]") > 0.1, "ru")
        .when(share("[a-zA-Z]") > 0.3, "en")
        .otherwise("unknown")
    )


def iso_date(c: Column | str) -> Column:
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd"), F.lit("?"))


def feed_time(published: Column | str, updated: Column | str) -> Column:
    """RFC 822 or ISO dates as UTC: published, else updated, else null."""
    read = lambda x: F.coalesce(F.try_to_timestamp(F.regexp_replace(col(x), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(col(x), r"^[A-Za-z]{3},\s*", ""), r"\s*(?:GMT|UTC)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(col(x)))
    return F.coalesce(read(published), read(updated))


def timeline_time(c: Column | str) -> Column:
    """'Jun 20, 2026 · 1:56 PM UTC' as a timestamp."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(col(c), r"\s*·\s*", " "), r"\s*UTC$", ""), F.lit("MMM d, yyyy h:mm a"))


def age_hours(at: Column | str, now: Column) -> Column:
    return F.round((F.unix_micros(now.cast("timestamp")) - F.unix_micros(col(at).cast("timestamp"))) / 3.6e9, 1)


def percent(part: Column, total: Column) -> Column:
    """One decimal; 0.0 of nothing."""
    return F.when(total == 0, 0.0).otherwise(F.round(100.0 * part / total, 1))


def percent_floor(part: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.floor(100 * part / total).cast("int"))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


# --- Fixed values: French month names, long and short ---
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
SHORT_MONTHS = ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")
# ---


def _day(at: Column, months: tuple[str, ...]) -> Column:
    return F.concat_ws(" ", F.dayofmonth(at).cast("string"), F.get(F.array(*map(F.lit, months)), F.month(at) - 1), F.year(at).cast("string"))


def relative_time(at: Column | str, now: Column) -> Column:
    """Age in words for lists, from a week on the day; '' for null."""
    t = col(at)
    s = F.unix_timestamp(now) - F.unix_timestamp(t)
    ago = lambda n, unit: F.concat(F.lit("il y a "), F.floor(s / n).cast("string"), F.lit(unit))
    words = F.when(s < 60, "à l'instant").when(s < 3600, ago(60, " min")).when(s < 86400, ago(3600, " h")).when(s < 604800, ago(86400, " j"))
    return F.when(t.isNull(), "").otherwise(F.coalesce(words, _day(t, SHORT_MONTHS)))


def exact_date(at: Column | str) -> Column:
    """Day and minute in French; '' for null."""
    t = col(at)
    return F.when(t.isNull(), "").otherwise(F.concat(_day(t, MONTHS), F.lit(" à "), F.date_format(t, "HH:mm")))


def french_number(n: Column | str) -> Column:
    """A number with groups of three digits apart (narrow no-break space), decimal comma, at most three decimals; null is 0."""
    x = F.round(F.coalesce(col(n).cast("double"), F.lit(0.0)), 3)
    text = F.regexp_replace(F.regexp_replace(F.format_number(x, 3), "0+$", ""), r"\.$", "")
    return F.translate(text, ",.", "\u202f,")


def escape_html(c: Column | str) -> Column:
    out = F.coalesce(col(c), F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def linkify(c: Column | str, link: str = '<a href="$1">$1</a>', handle: str = "<b>@$2</b>", tag: str = "<i>#$2</i>") -> Column:
    """Text as HTML: escaped, with addresses, handles (of up to 15 letters) and tags marked up."""
    out = F.regexp_replace(escape_html(c), r"(?U)(https?://[^\s]+)", link)
    out = F.regexp_replace(out, r"(^|(?U:\s))@(\w{1,15})", "$1" + handle)
    return F.regexp_replace(out, r"(^|(?U:\s))#(\w+)", "$1" + tag)


def link_image(summary: Column | str) -> Column:
    """Address of the first image of a feed entry."""
    return F.nullif(F.regexp_extract(col(summary), r'(?i)<img[^>]+src=["\']([^"\']+)', 1), F.lit(""))


def looks_like_rss(c: Column | str) -> Column:
    head = F.lower(F.substring(col(c), 1, 2000))
    return F.startswith(F.ltrim(F.substring(head, 1, 400)), F.lit("<?xml")) & F.contains(head, F.lit("<rss"))


def looks_like_timeline(c: Column | str) -> Column:
    return F.contains(col(c), F.lit("timeline-item")) & (F.length(col(c)) > 2000)


def canonical_quote(c: Column | str) -> Column:
    """Wording compared across sources: typographic signs as ASCII, quotation marks as blanks, no accents."""
    t = F.translate(F.coalesce(col(c), F.lit("")), "«»“”’‘–—", "\"\"\"\"''--")
    return normal(F.replace(F.replace(t, F.lit("…"), F.lit("...")), F.lit('"'), F.lit(" ")))


def verbatim_in_source(verbatim: Column | str, source: Column | str, least: int = 12) -> Column:
    v = canonical_quote(verbatim)
    return F.when(F.length(v) < least, False).otherwise(F.contains(canonical_quote(source), v))


def worth_segmenting(c: Column | str, least: int = 5) -> Column:
    """At least five words of letters besides links."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"https?://\S+|www\.\S+", "")
    return F.size(F.regexp_extract_all(t, F.lit("[A-Za-zÀ-ÿ]{2,}"), F.lit(0))) >= least


def classifiable(c: Column | str, least: int = 4) -> Column:
    """At least four words besides links, mentions, tags and repost marks."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?iU)https?://\S+|@\w+|#\w+|\bRT by\b|\bRT\b", " ")
    return F.size(F.regexp_extract_all(t, F.lit(r"(?U)[^\W\d_]{2,}"), F.lit(0))) >= least
