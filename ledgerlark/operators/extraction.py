"""From text to claims: cleaning, completeness, sentences, quantified claims, declarations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..functions.text import col, content_hash, let, plain_text, squeeze, strip, unaccent, verbatim_in_source, word_count, worth_segmenting
from .lexicon import escape, plain

# --- Fixed values: article lines that go by how they begin, and short lines that go by what they hold ---
LINE_PREFIXES = (
    "lire aussi", "a lire aussi", "a lire egalement", "a lire", "voir aussi", "sur le meme sujet", "le meme sujet", "a decouvrir", "a voir aussi", "ceci peut vous interesser",
    "vous aimerez aussi", "ces articles peuvent", "dans la meme rubrique", "pour aller plus loin", "en savoir plus", "publie le", "mis a jour le", "modifie le", "credit photo",
    "credits photo", "photo :", "illustration :", "source afp", "avec afp", "abonnez-vous", "s'abonner", "newsletter", "inscrivez-vous", "recevez", "suivez-nous",
    "suivez l'actualite", "suivez toute l'actualite", "partager", "partagez", "tweeter", "commenter", "reagir", "0 commentaire", "la suite apres cette publicite", "publicite",
    "lecture :", "temps de lecture", "cet article est reserve", "video :", "regardez :", "en images",
)
SHORT_MARKERS = (
    "partager sur", "partager l'article", "sur facebook", "sur twitter", "sur whatsapp", "sur linkedin", "copier le lien", "min de lecture", "minutes de lecture", "accepter les cookies",
    "gerer les cookies", "afficher les commentaires", "laisser un commentaire", "tous droits reserves", "mots-cles", "voir les commentaires", "ajouter aux favoris",
)
SHORT_WORDS, READING_WORDS = 9, 6
LINE_ENDS = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029]"
# ---


def is_boilerplate(line: Column, prefixes: tuple[str, ...] = LINE_PREFIXES, markers: tuple[str, ...] = SHORT_MARKERS) -> Column:
    norm = strip(unaccent(line))
    n = word_count(norm)
    alt = lambda terms: "|".join(map(escape, terms))
    begins = norm.rlike(f"^(?:{alt(prefixes)})")
    reading = norm.rlike(r"^\d+\s*min(utes?)?\b") & (n <= READING_WORDS)
    return F.when(norm == "", False).otherwise(begins | reading | ((n <= SHORT_WORDS) & norm.rlike(alt(markers))))


def clean_article(text: Column | str, prefixes: tuple[str, ...] = LINE_PREFIXES, markers: tuple[str, ...] = SHORT_MARKERS) -> Column:
    """Article text without links, addresses, boilerplate lines and repeats of the line before; null gives ''.

    A line is a repeat if it equals the last kept line that was not empty.
    """
    lines = F.transform(F.split(plain_text(F.coalesce(col(text), F.lit(""))), LINE_ENDS), lambda s: F.trim(F.regexp_replace(s, "[ \\t\\u00A0]+", " ")))
    kept = F.filter(lines, lambda s: ~is_boilerplate(s, prefixes, markers))
    return strip(F.regexp_replace(F.array_join(let(kept, _without_repeats), "\n"), "\n{3,}", "\n\n"))


def _without_repeats(lines: Column) -> Column:
    """Each line that is not empty is compared with the one before it that is not; empty lines stay. Linear in the lines."""
    full = F.filter(F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda r: r["s"] != "")
    again = let(full, lambda f: F.filter(f, lambda r, k: (k > 0) & (r["s"] == F.get(f, k - 1)["s"])))
    left = lambda gone: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone["i"])
    return let(again, lambda gone: F.when(F.size(gone) > 0, F.transform(left(gone), lambda i: F.get(lines, i))).otherwise(lines))


# --- Fixed values: signs of cut texts, for texts, press extracts, pages and rests of subscription offers ---
TEXT_WALL = (
    "pour lire la suite", "lire la suite", "continuer la lecture", "article réservé aux abonnés", "abonnez-vous", "déjà abonné", "connectez-vous", "premium", "contenu exclusif",
    "réservé aux membres", "inscrivez-vous", "s'abonner", "version complète", "article complet disponible", "subscribe to read", "subscribe now", "sign up to continue",
    "create an account", "premium content", "members only", "exclusive content", "login to read", "register to continue", "full article available", "upgrade to premium",
    "subscription required", "access denied", "unlock full story", "continue reading", "read more", "لقراءة المزيد", "متابعة القراءة", "للمشتركين فقط", "اشترك الآن",
    "تسجيل الدخول", "devamını oku", "abone ol", "üye girişi", "tam sürüm", "המשך לקרוא", "מנוי פרימיום",
)
PRESS_WALL = r"(?iu)il vous reste\s+\d+|article réservé|réservé aux abonné|pour lire la suite|abonnez-vous|déjà abonné|%\s+à lire|s['’]abonner pour lire|soutenir.{0,30}journalisme|connectez-vous pour lire"
PAGE_WALL = (
    'class="[^"]*paywall[^"]*"', 'class="[^"]*premium[^"]*"', 'class="[^"]*subscription[^"]*"', 'class="[^"]*subscriber[^"]*"', 'id="[^"]*paywall[^"]*"', "data-paywall",
    "data-access-level", "subscribe to continue reading", "premium content", "members only", "subscription required", "article réservé aux abonnés", "contenu premium",
    "pour lire la suite", "abonnez-vous", "create an account to read", "sign in to read", "login to continue", "s'identifier pour lire", "upgrade to premium",
    "passer à la version premium", "unlock this article", "débloquer cet article", "full access with subscription", "accès complet avec abonnement", r"window\.paywall",
    "paywallconfig", "gtm.*paywall", "gtm.*premium",
)
PAGE_WALL_SURE = ("data-paywall", "article réservé aux abonnés", "subscription required", "premium content", "contenu premium", "abonnez-vous pour lire")
RESIDUE = r"(?iu)(?:abonnez[\-\s]?vous|s'abonner|subscribe (?:now|to read)|continue reading|להמשך\s+קריאה|اشترك\s+(?:الآن|للقراءة)|sign\s+(?:up|in)\s+to\s+(?:read|continue))"
CUT_ENDS = (r"(?m)\.\.\.$", r"(?m)…$", r"\[\.\.\.\]", r"\(\s*\.{3,}\s*\)")
FULL_CHARS, PRESS_HEAD = 350, 4000
# ---


def wall_signs(text: Column | str, signs: tuple[str, ...] = TEXT_WALL) -> Column:
    """The signs of a cut text that occur, in list order."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(s), F.lit(s)) for s in signs]))


def press_walled(text: Column | str) -> Column:
    return F.coalesce(F.substring(col(text), 1, PRESS_HEAD).rlike(PRESS_WALL), F.lit(False))


def extraction(text: Column | str, method: Column | str, confidence: Column | None = None) -> Column:
    """struct<text, method, is_full, paywalled, confidence>; null for an empty text."""
    t, wall = col(text), press_walled(text)
    made = F.struct(t.alias("text"), col(method).alias("method"), (~wall & (F.length(t) >= FULL_CHARS)).alias("is_full"), wall.alias("paywalled"), (confidence if confidence is not None else F.lit(None).cast("double")).alias("confidence"))
    return F.when(F.coalesce(t, F.lit("")) != "", made)


def page_walled(html: Column | str) -> Column:
    low = F.lower(F.coalesce(col(html), F.lit("")))
    sure = F.lit(False)
    for s in PAGE_WALL_SURE:
        sure = sure | F.contains(low, F.lit(s))
    return sure | (F.size(wall_signs(html, PAGE_WALL)) >= 3)


def looks_walled(text: Column | str, least_words: int = 200) -> Column:
    return (word_count(text) < least_words) | (F.size(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(RESIDUE), F.lit(0))) >= 2)


def _tail(text: Column | str, n: int) -> Column:
    return F.right(strip(F.coalesce(col(text), F.lit(""))), F.lit(n))


def completeness_reason(text: Column | str, least_words: int = 150, least_ratio: float = 3.0, most_signs: int = 0) -> Column:
    """'complete', or the first reason why a text is not."""
    t = F.coalesce(col(text), F.lit(""))
    n, signs = word_count(t), F.size(wall_signs(t))
    ratio = F.length(t) / F.greatest(n, F.lit(1))
    out = F.when(t == "", "empty_content").when(n < least_words, F.concat(F.lit("word_count_too_low:"), n.cast("string"), F.lit(f"<{least_words}")))
    out = out.when(ratio < least_ratio, F.concat(F.lit("low_char_ratio:"), F.format_string("%.1f", ratio), F.lit(f"<{least_ratio}")))
    out = out.when(signs > most_signs, F.concat(F.lit("paywall_indicators:"), signs.cast("string")))
    for rx in CUT_ENDS:
        out = out.when(_tail(t, 100).rlike(rx), F.lit("truncation_pattern:" + rx.removeprefix("(?m)")))
    return out.otherwise("complete")


def completeness_score(text: Column | str, target_words: int = 500) -> Column:
    """Share of the wanted words, less a quarter per sign of a wall (half at most) and 0.3 for a cut end; 0..1, three decimals."""
    t = F.coalesce(col(text), F.lit(""))
    cut = F.lit(False)
    for rx in CUT_ENDS[:3]:
        cut = cut | _tail(t, 50).rlike(rx)
    words = F.least(F.lit(1.0), word_count(t) / F.lit(float(target_words)))
    return F.round(F.greatest(F.lit(0.0), words - F.least(F.lit(0.5), F.size(wall_signs(t)) * 0.25) - F.when(cut, 0.3).otherwise(0.0)), 3)


def attempt_complete(content: Column | str, words: Column | str, least_words: int = 150) -> Column:
    """Whether an extraction attempt holds the whole article."""
    t = F.coalesce(col(content), F.lit(""))
    return (t != "") & (F.size(wall_signs(t)) == 0) & (col(words) >= least_words) & (F.length(t) / F.greatest(col(words), F.lit(1)) >= 3)


def accept_cleanup(original: Column | str, cleaned: Column | str) -> Column:
    """Whether a cleaned-up text replaces an original that still looks walled: enough words, and complete or without a wall."""
    asked = looks_walled(original) & (F.length(col(original)) > 400)
    enough = word_count(cleaned) >= F.greatest(F.lit(80), F.floor(word_count(original) * 0.3))
    return F.coalesce(asked & enough & (attempt_complete(cleaned, word_count(cleaned)) | ~looks_walled(cleaned)), F.lit(False))


# --- Fixed values: confidence by extraction method ---
METHOD_CONFIDENCE = {"curl_cffi": 0.85, "playwright_stealth": 0.9, "scrapling_cf": 0.8, "jina_ai": 0.75, "wayback": 0.7, "fallback": 0.5}
# ---


def confidence(method: Column | str, words: Column | str, base: dict[str, float] | None = None, default: float = 0.6) -> Column:
    out = F.lit(default)
    for name, value in (base or METHOD_CONFIDENCE).items():
        out = F.when(col(method) == name, value).otherwise(out)
    return F.least(F.lit(1.0), out + F.when(col(words) > 500, 0.1).otherwise(0.0) + F.when(col(words) > 1000, 0.05).otherwise(0.0))


# --- sentences and claims ---


def sentences(text: Column | str) -> Column:
    """Sentences: after . ! ? … and white space, and at line ends; a text without any is one sentence."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), r"(?U)(?<=[.!?…])\s+|\n+"), strip), lambda s: s != "")


CLAIM = "array<struct<referent_key:string,value:double,unit:string,unit_kind:string>>"
VERBATIM_CHARS = 600


def triggers_from_json(raw: str) -> dict:
    """{"referents": {key: {"unit_kinds", "unit", "triggers"}}} as the operator's parameter, in file order."""
    return json.loads(raw)["referents"]


def extract_claims(df: DataFrame, triggers: dict, text: str = "text") -> DataFrame:
    """A row for each quantified claim: the other columns, sentence_no, referent_key, value, unit, unit_kind, verbatim.

    In each sentence every referent whose first trigger (in list order) occurs takes the accepted
    quantity nearest to it; plain numbers only where no typed one is accepted and `nb` is. The unit is
    the referent's, the kind the quantity's. Cheap tests come first: only sentences with a digit and a
    trigger reach Python.
    """
    import re

    specs = [(key, s["unit"], frozenset(s["unit_kinds"]), [r"\b" + escape(plain(t)) + r"\b" for t in s["triggers"]]) for key, s in triggers.items()]

    @F.pandas_udf(CLAIM)
    def claims(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = [(k, u, kinds, [re.compile(p) for p in ps]) for k, u, kinds, ps in specs]

        def find(sentence: str) -> list[dict]:
            norm, out, typed, bare = plain(sentence), [], None, None
            for key, unit, kinds, patterns in own:
                at = next((m.start() for p in patterns if (m := p.search(norm))), None)
                if at is None:
                    continue
                typed = Q.typed(sentence) if typed is None else typed
                fit = [q for q in typed if q["unit_kind"] in kinds]
                if not fit and "nb" in kinds:
                    bare = Q.plain(sentence, typed) if bare is None else bare
                    fit = bare
                if fit:
                    q = min(fit, key=lambda c: abs(c["start"] - at))
                    out.append({"referent_key": key, "value": q["value"], "unit": unit, "unit_kind": q["unit_kind"]})
            return out

        for batch in batches:
            yield batch.map(find)

    every = "|".join(p for *_, ps in specs for p in ps)
    rows = df.select("*", F.posexplode(sentences(text)).alias("sentence_no", "_s"))
    rows = rows.where(F.col("_s").rlike("[0-9]") & unaccent("_s").rlike(every))
    rows = rows.withColumn("_c", F.explode(claims("_s")))
    return rows.select(*df.columns, "sentence_no", "_c.*", F.substring("_s", 1, VERBATIM_CHARS).alias("verbatim"))


def dedup_key(source: Column, referent: Column | str, value: Column | str, kind: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", source, col(referent), col(value).cast("string"), col(kind)), 256)


def assemble_claims(posts: DataFrame, people: DataFrame, articles: DataFrame, referents: DataFrame, triggers: dict) -> DataFrame:
    """Claims of posts (no reposts; the author speaks) and articles (their only matched person speaks), one per key.

    posts: id, personality_id, content, is_retweet, published_at. people: id, full_name, famille, group_code.
    articles: id, title, content, matched_personalities, published_at. referents: key, theme, subtheme.
    """
    who = people.select(F.col("id").alias("personality_id"), F.col("full_name").alias("speaker_name"), F.coalesce(F.nullif("famille", F.lit("")), "group_code").alias("party"))
    x = posts.where(~F.col("is_retweet")).join(who, "personality_id")
    x = x.select(F.lit("x").alias("platform"), F.col("id").alias("post_id"), F.lit(None).cast("bigint").alias("article_id"), "personality_id", "speaker_name", "party", "published_at", F.col("content").alias("_t"))
    single = F.when(F.size("matched_personalities") == 1, F.get("matched_personalities", F.lit(0)))
    press = articles.select(
        F.lit("press").alias("platform"), F.lit(None).cast("bigint").alias("post_id"), F.col("id").alias("article_id"), F.lit(None).cast("bigint").alias("personality_id"),
        single.alias("speaker_name"), F.lit(None).cast("string").alias("party"), "published_at", F.concat_ws(". ", "title", "content").alias("_t"),
    )
    found = extract_claims(x.unionByName(press), triggers, "_t").drop("_t")
    source = F.when(F.col("platform") == "x", F.concat(F.lit("post"), F.col("post_id").cast("string"))).otherwise(F.concat(F.lit("art"), F.col("article_id").cast("string")))
    keyed = found.withColumn("dedup_key", dedup_key(source, "referent_key", "value", "unit_kind"))
    theme = referents.select(F.col("key").alias("referent_key"), "theme", "subtheme")
    first = keyed.groupBy("dedup_key").agg(F.min_by(F.struct(*[c for c in keyed.columns if c != "dedup_key"]), "sentence_no").alias("r")).select("dedup_key", "r.*")
    out = first.join(theme, "referent_key", "left")
    return out.select(
        "dedup_key", "platform", "post_id", "article_id", "personality_id", "speaker_name", "party", "verbatim", F.lit("quantitatif").alias("claim_type"), "theme", "subtheme", "referent_key",
        F.col("value").alias("qty_value"), F.col("unit").alias("qty_unit"), F.col("unit_kind").alias("qty_unit_kind"), F.lit(0.5).alias("confidence"), F.lit("deterministic").alias("extraction_method"), "published_at",
    )


def apply_refinements(claims: DataFrame, refinements: DataFrame, allowed: DataFrame) -> DataFrame:
    """Claims after a reviewer's or model's verdicts (dedup_key, is_valid, referent_key, value).

    Invalid ones and those moved to 'none' go; an allowed other referent and a value that is not null
    replace the claim's; a claim without verdict stays as it is.
    """
    r = refinements.select("dedup_key", F.col("is_valid").alias("_ok"), F.col("referent_key").alias("_ref"), F.col("value").alias("_v"))
    known = allowed.select(F.col("key").alias("_ref"), F.lit(True).alias("_known"))
    out = claims.join(r.join(known, "_ref", "left"), "dedup_key", "left").where(F.col("_ok").isNull() | (F.col("_ok") & (F.coalesce("_ref", F.lit("")) != "none")))
    return out.withColumn("referent_key", F.when(F.col("_known"), F.col("_ref")).otherwise(F.col("referent_key"))).withColumn("qty_value", F.coalesce("_v", "qty_value")).select(claims.columns)


DECLARATION_CHARS = 2000


def declarations(sources: DataFrame, done: DataFrame, segments: DataFrame | Callable[[DataFrame], DataFrame], key: str = "source_id", text: str = "text", limit: int | None = None) -> DataFrame:
    """Check-worthy declarations whose wording is really in their source.

    sources already in `done` and texts without substance are left out first. segments is a table, or
    a function that makes one from the sources left: key, verbatim, theme, check_worthy.
    """
    left = sources.join(done.select(key).distinct(), key, "left_anti").where(worth_segmenting(text))
    if limit:
        left = left.orderBy(F.desc_nulls_last("published_at"), F.desc(key)).limit(limit)
    made = segments(left) if callable(segments) else segments
    out = left.join(made, key).where(F.col("check_worthy") & verbatim_in_source("verbatim", text))
    return out.select(
        key, F.substring("verbatim", 1, DECLARATION_CHARS).alias("verbatim"), F.nullif("theme", F.lit("autre")).alias("theme"), F.lit(0.7).alias("confidence"), F.lit("llm_segment").alias("extraction_method"),
        F.sha2(F.concat_ws(":", F.col(key).cast("string"), squeeze("verbatim")), 256).alias("dedup_key"),
    )


# --- press pipeline ---

FEED_FULL_CHARS = 1200


def press_articles(entries: DataFrame, known: DataFrame, names: list[str], keywords: dict, fetched_at: Column) -> DataFrame:
    """Feed entries to articles: gate on title and summary, new addresses only, body, cleaning, verdict on the whole.

    entries: media_source_id, title, link, summary, content (feed's full text), body (extracted, may be
    null), published_at. A missing date becomes `fetched_at` and is marked as estimated.
    """
    from .lexicon import assess_relevance

    e = entries.withColumn("url_hash", F.sha2(strip("link"), 256)).dropDuplicates(["url_hash"])
    e = e.join(known.select("url_hash"), "url_hash", "left_anti").withColumn("_gate", F.concat_ws(". ", "title", "summary"))
    e = assess_relevance(e, names, keywords, "_gate").where("relevant").select(e.columns)
    feed = F.coalesce("content", F.lit(""))
    full = F.length(feed) >= FEED_FULL_CHARS
    # the longest of the feed's texts, the first of equals; the extracted body if it is at least as long
    texts = [feed, F.coalesce("summary", F.lit("")), F.coalesce("title", F.lit(""))]
    longest = F.array_max(F.array(*[F.struct(F.length(t).alias("n"), F.lit(-k).alias("k"), t.alias("t")) for k, t in enumerate(texts)]))
    best = F.when(full, feed).when(F.length("body") >= longest["n"], F.col("body")).otherwise(longest["t"])
    e = e.withColumn("content", clean_article(best)).withColumn("_all", F.concat_ws(". ", "title", "content"))
    out = assess_relevance(e.withColumn("is_full_text", full), names, keywords, "_all").where("relevant")
    return out.select(
        "url_hash", "media_source_id", "title", F.col("link").alias("url"), "content", "nature", "is_statement", "genre", F.col("personalities").alias("matched_personalities"), F.col("keywords").alias("matched_keywords"),
        "is_full_text", F.coalesce("published_at", fetched_at).alias("published_at"), F.col("published_at").isNull().alias("published_estimated"), word_count("content").alias("word_count"), content_hash("content").alias("content_hash"),
    )


def page_state(status: Column | str, html: Column | str, least_chars: int = 1000) -> Column:
    """State of a fetched page, first that holds; no status means that nothing came."""
    low, st = F.lower(F.coalesce(col(html), F.lit(""))), col(status)
    has = lambda *keys: F.forall(F.array(*map(F.lit, keys)), lambda k: F.contains(low, k))
    found = F.when(has("cloudflare", "challenge"), "cloudflare_challenge").when(has("access denied"), "access_denied").when(has("blocked", "ip"), "ip_blocked")
    found = found.when(F.length(low) > least_chars, "accessible").otherwise("empty_page")
    other = F.when(st == 403, "forbidden").when(st == 404, "not_found").when(st == 429, "rate_limited").when(st >= 500, "server_error")
    return F.when(st.isNull(), "timeout").when(st == 200, found).otherwise(other.otherwise(F.concat(F.lit("http_"), st.cast("string"))))
