"""List views: filters, paging, provenance. Falsy filter values mean no filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import affiliation_at

PAGE, LARGEST_PAGE = 50, 200


def where_equal(df: DataFrame, **wanted: object) -> DataFrame:
    for name, value in wanted.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def where_like(df: DataFrame, q: str | None, *columns: str) -> DataFrame:
    """Case-insensitive substring of any column; % and _ in q stay wildcards."""
    q = (q or "").strip().lstrip("@")
    if not q:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{q}%"), F.lit(False))
    return df.where(hit)


def page(df: DataFrame, *order: Column, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """One page in a total order; Catalyst plans it as a top-k. Its total is `total(df)`."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), LARGEST_PAGE))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def newest(at: str = "published_at", key: str = "id") -> list[Column]:
    return [F.desc_nulls_last(at), F.desc(key)]


def feed(posts: DataFrame, people: DataFrame, affiliations: DataFrame, group: str | None = None, q: str | None = None, retweets: bool = True, since=None, limit: int = PAGE, offset: int = 0, **equal: object) -> DataFrame:
    """A page of posts, newest first, with nested author and the author's party at the date."""
    p = people.select(F.col("id").alias("personality_id"), "full_name", "handle", "group_code")
    df = posts.join(p, "personality_id")
    df = where_like(where_equal(df, group_code=(group or "").upper(), **equal), q, "content", "full_name")
    if not retweets:
        df = df.where(~F.col("is_retweet"))
    if since is not None:
        df = df.where(F.col("published_at").isNull() | (F.col("published_at") >= since))
    shown = page(df, *newest(), limit=limit, offset=offset)
    out = affiliation_at(shown, affiliations, "id", "personality_id", "published_at")
    return out.withColumn("personality", F.struct("personality_id", "full_name", "handle", "group_code")).drop("full_name", "handle", "group_code").orderBy(*newest())


def reached_cutoff(posts: DataFrame, since: Column) -> DataFrame:
    return posts.agg(F.coalesce(F.bool_or(F.col("published_at") < since), F.lit(False)).alias("reached"))


def articles(articles_: DataFrame, sources: DataFrame, leaning: str | None = None, statements_only: bool = False, limit: int = PAGE, offset: int = 0, **equal: object) -> DataFrame:
    """A page of articles, newest first, with source name and leaning; a leaning selects by semi-join."""
    df = where_equal(articles_, **equal)
    if leaning:
        df = df.join(sources.where(F.col("leaning") == leaning).select(F.col("id").alias("media_source_id")), "media_source_id", "left_semi")
    if statements_only:
        df = df.where("is_statement")
    shown = page(df, *newest(), limit=limit, offset=offset)
    s = sources.select(F.col("id").alias("media_source_id"), F.col("name").alias("source_name"), "leaning")
    return shown.join(s, "media_source_id", "left").orderBy(*newest())


def by_key(df: DataFrame, key: object, name: str = "id") -> DataFrame:
    """The row of a key; no row means not found."""
    return df.where(F.col(name) == key)


def claim_urls(claims: DataFrame, posts: DataFrame, articles_: DataFrame) -> DataFrame:
    """Claims with the address of their source: the post's, else the article's."""
    p = posts.select(F.col("id").alias("post_id"), F.col("url").alias("_p"))
    a = articles_.select(F.col("id").alias("article_id"), F.col("url").alias("_a"))
    out = claims.join(p, "post_id", "left").join(a, "article_id", "left")
    return out.withColumn("source_url", F.coalesce(F.nullif("_p", F.lit("")), "_a")).select(*claims.columns, "source_url")


def series(claims: DataFrame, key: str) -> DataFrame:
    """All values of one referent over time, undated last."""
    return claims.where((F.col("referent_key") == key) & F.col("qty_value").isNotNull()).orderBy(F.asc_nulls_last("published_at"), "id")


def ledger(claims: DataFrame, posts: DataFrame, articles_: DataFrame, q: str | None = None, speaker: str | None = None, limit: int = PAGE, offset: int = 0, **equal: object) -> DataFrame:
    df = where_like(where_like(where_equal(claims, **equal), speaker, "speaker_name"), q, "verbatim", "speaker_name")
    return claim_urls(page(df, *newest(), limit=limit, offset=offset), posts, articles_).orderBy(*newest())


def contradictions(edges: DataFrame, claims: DataFrame, limit: int = PAGE, offset: int = 0, **equal: object) -> DataFrame:
    """A page of edges by score with both claims nested."""
    shown = page(where_equal(edges, **equal), F.desc("score"), F.desc("id"), limit=limit, offset=offset)
    side = lambda s: claims.select(F.col("id").alias(f"claim_{s}_id"), F.struct(*claims.columns).alias(f"claim_{s}"))
    return shown.join(side("a"), "claim_a_id", "left").join(side("b"), "claim_b_id", "left").orderBy(F.desc("score"), F.desc("id"))


def referential(themes: DataFrame, subthemes: DataFrame, referents: DataFrame) -> DataFrame:
    """Themes in order, with sub-themes and their referents nested."""
    r = referents.groupBy("subtheme_id").agg(F.array_sort(F.collect_list(F.struct("key", "label", "unit"))).alias("referents"))
    s = subthemes.join(r, F.col("id") == F.col("subtheme_id"), "left").withColumn("referents", F.coalesce("referents", F.array().cast("array<struct<key:string,label:string,unit:string>>")))
    s = s.groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", "referents"))).alias("subthemes"))
    return themes.join(s, F.col("id") == F.col("theme_id"), "left").drop("theme_id").orderBy("order")


#: Controlled vocabularies. Fixed values.
VOCABULARY = {
    "nature": ("prise_de_parole", "mention"),
    "genre": ("interview", "tribune", "communique"),
    "platform": ("x", "press"),
    "post_type": ("original", "reply", "quote", "retweet"),
    "stance": ("pour", "contre", "nuance", "inconnu"),
    "contradiction_status": ("pending", "confirmed", "rejected"),
}
