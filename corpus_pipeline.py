"""A training-data pipeline over `documents`: five stages, each an operator of ledgerlark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Stages are written and read again between one another, so a lost executor costs at most
a part of the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bpe, decontaminate, langid, lines, simhash
from ledgerlark.llm.queries import vocabulary
from ledgerlark.llm.scratch import Scratch
from ledgerlark.session import ship, table

#: Near-duplicates: five-word shingles, 128-bit fingerprints of the distinct ones. A Jaccard similarity of 0.8 is
#: a cosine of 0.89 and lets about 19 of 128 bits differ (deviation 4); 36 bits are four deviations more, and unrelated
#: texts, at 64 bits (deviation 6), stay five deviations away. What they link is then held to the similarity itself.
SHINGLE_WORDS, BITS_APART, SIMILARITY = 5, 36, 0.8
#: Workers stay between stages and several may have encoded; each keeps so many pre-tokens (about 30 MB).
CACHE_TOKENS = 150_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: those with a letter and a positive score. Learns from every labelled row."""
    ship(spark)
    out = langid.identify(docs, docs, carry=docs.columns)
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0)).select("row.*")


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs, intervals of the suffix order, are cut out; a document of which nothing is left goes."""
    ship(spark)
    out = lines.drop_repeated_lines(docs).where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    cut = F.col("n_removed") > 0
    changed = {"text": F.col("kept"), "n_chars": F.when(cut, F.length("kept").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays. Rows with a null doc_id stay."""
    ship(spark)
    found = simhash.near_duplicates(docs, size=SHINGLE_WORDS, radius=BITS_APART, words=2, by_length=SIMILARITY, similarity=SIMILARITY)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return out.where(~F.col("contaminated")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, packed as little-endian unsigned 32-bit integers, and whether they decode to its text."""
    ship(spark)
    out = bpe.encode_decode(docs, vocabulary(), carry=["doc_id", "lang", "source"], cache_tokens=CACHE_TOKENS)
    return out.select("row.*", "n_tokens", "token_bytes", "round_trip")


STAGES = [
    ("language ID", language),
    ("line dedup", line_runs),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", clean_of_benchmarks),
    ("BPE encoding and decoding", tokens),
]

#: Random vectors, hashes and tokenization are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
