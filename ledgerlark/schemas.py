"""Tables of the domain, as Spark DDL. Columns are only ever added; sinks.conform fills new ones with null."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "personalities": "id bigint, full_name string, handle string, group_code string, group_long string, famille string, role string, verif string, circo string, departement string, photo_url string, an_id string, is_active boolean, last_checked_at timestamp, last_collected_at timestamp, last_status string, last_error string, consecutive_failures int",
    "posts": "id bigint, guid string, personality_id bigint, source string, url string, content string, post_type string, reply_to_handle string, reply_to_url string, quoted_handle string, quoted_url string, quoted_content string, media_url string, collected_via string, lang string, content_hash string, snapshot_path string, snapshot_url string, theme string, subtheme string, is_retweet boolean, is_reply boolean, likes bigint, retweets bigint, replies bigint, quotes bigint, views bigint, word_count int, published_at timestamp, engagement_captured_at timestamp, archived_at timestamp",
    "media_sources": "id string, name string, homepage string, rss_url string, category string, leaning string, is_active boolean, last_checked_at timestamp, last_collected_at timestamp, last_status string, last_error string, consecutive_failures int",
    "articles": "id bigint, url_hash string, media_source_id string, url string, title string, content string, author string, extraction_method string, lang string, section string, nature string, genre string, snapshot_path string, snapshot_url string, theme string, subtheme string, published_at timestamp, published_estimated boolean, is_full_text boolean, paywalled boolean, is_statement boolean, confidence_score double, matched_keywords array<string>, matched_personalities array<string>, word_count int, archived_at timestamp",
    "claims": "id bigint, dedup_key string, platform string, post_id bigint, article_id bigint, personality_id bigint, speaker_name string, party string, verbatim string, canonical string, claim_type string, theme string, subtheme string, referent_key string, qty_value double, qty_unit string, qty_unit_kind string, qty_horizon string, qty_modality string, stance_polarity string, extraction_method string, extraction_model string, confidence double, human_validated boolean, embedding array<float>, published_at timestamp",
    "contradictions": "id bigint, claim_a_id bigint, claim_b_id bigint, referent_key string, type smallint, score double, rationale string, status string, validator string, detected_at timestamp, validated_at timestamp",
    "speaker_affiliations": "id bigint, personality_id bigint, party string, role string, date_start date, date_end date",
    "themes": "id string, label string, `order` int, version string, code int, salience string",
    "subthemes": "id string, theme_id string, label string, `order` int, version string",
    "referents": "key string, subtheme_id string, label string, unit string, version string, embedding array<float>",
    "sujets": "id bigint, slug string, label string, description string, theme_id string, subtheme_id string, is_active boolean",
    "actualites": "id bigint, slug string, label string, description string, theme_id string, subtheme_id string, event_date date",
    "dossiers": "personality_id bigint, summary string, n_claims int, model string, by_theme map<string,bigint>, by_claim_type map<string,bigint>, contradictions bigint, generated_at timestamp",
    "collection_runs": "run_id bigint, kind string, status string, instance_used string, personalities_polled int, posts_new int, errors int, notes string, at timestamp",
}
TABLES: dict[str, StructType] = {}


def schema(name: str) -> StructType:
    if name not in TABLES:
        TABLES[name] = StructType.fromDDL(_DDL[name])
    return TABLES[name]


def names() -> list[str]:
    return list(_DDL)
