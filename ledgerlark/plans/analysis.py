"""The analysis run: clean, extract, attach, detect. Each step is a DataFrame to DataFrame function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contradictions, extraction, lexicon, similarity
from ..sources.sinks import fill_column


def clean_articles(articles: DataFrame) -> DataFrame:
    """Articles with cleaned content, and how many characters went."""
    return articles.withColumn("_c", extraction.clean_article("content")).withColumn("removed_chars", F.length("content") - F.length("_c")).withColumn("content", F.col("_c")).drop("_c")


def classify(items: DataFrame, themes: dict, anchors: DataFrame | None = None, key: str = "id", text: str = "text", least: float = 0.42) -> DataFrame:
    """theme, subtheme and method: lexicon first; for texts of substance that it misses, the nearest theme anchor (items need `embedding`)."""
    from ..functions.text import classifiable

    out = lexicon.classify_themes(items, themes, text)
    if anchors is None:
        return out.withColumn("method", F.when(F.col("theme").isNotNull(), "lexicon"))
    missed = out.where(F.col("theme").isNull() & classifiable(text))
    near = similarity.nearest_anchor(missed, anchors, key, "theme_id", least).select(key, F.col("theme_id").alias("_t"))
    out = out.join(near, key, "left").withColumn("method", F.when(F.col("theme").isNotNull(), "lexicon").when(F.col("_t").isNotNull(), "embedding"))
    return out.withColumn("theme", F.coalesce("theme", "_t")).drop("_t")


def enrich(claims: DataFrame, themes: dict, referents: DataFrame, least: float = 0.5) -> DataFrame:
    """Claims without a theme get the lexicon's; embedded claims without a referent get the nearest one, theme and sub-theme only where null."""
    themed = lexicon.classify_themes(claims.where("theme is null").select("id", "verbatim"), themes, "verbatim").select("id", "theme", "subtheme")
    out = fill_column(fill_column(claims, themed, "id", "theme"), themed, "id", "subtheme")
    near = similarity.nearest_anchor(out.where("referent_key is null"), referents, "id", "key", least)
    near = near.join(referents.select("key", F.col("theme").alias("theme"), F.col("subtheme").alias("subtheme")), "key").withColumnRenamed("key", "referent_key")
    for c in ("referent_key", "theme", "subtheme"):
        out = fill_column(out, near, "id", c)
    return out


def run(posts: DataFrame, people: DataFrame, articles: DataFrame, referents: DataFrame, triggers: dict, known_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims, contradictions) recomputed from the stored wording."""
    claims = extraction.assemble_claims(posts, people, clean_articles(articles), referents, triggers)
    claims = claims.withColumn("id", F.xxhash64("dedup_key")).withColumn("stance_polarity", F.lit(None).cast("string"))
    return claims, contradictions.detect(claims, known_edges)
