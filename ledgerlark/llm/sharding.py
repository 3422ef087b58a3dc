"""Operator 10: size-bounded shards by extendible hashing, with DataFrame functions only.

The directory is a binary trie over the bits of a 60-bit hash of the row. A bucket is split on
one more bit only while its bytes exceed the limit, so shards have different depths, as in the
classic structure. The directory is found from bytes per hash prefix, never from the rows, and
rows are never gathered by bucket.

Rows that agree in key and content agree in all 60 bits, and no bit can part them. Such a bucket
is dealt out by count: its equal rows are interchangeable, so they get shard numbers by division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

HASH_BITS = 60
LIMIT_BYTES = 16 << 20


def row_hash(*cols: Column) -> Column:
    """60 bits of MD5 over the given columns; nulls and empty strings differ."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("bigint")


def _prefix(h: Column, depth: Column | int) -> Column:
    """The first `depth` bits of the hash as 0/1 text, '' at depth 0."""
    return F.substring(F.lpad(F.bin(h), HASH_BITS, "0"), F.lit(1), F.lit(depth) if isinstance(depth, int) else depth)


def extendible_shards(
    rows: DataFrame, key: str = "doc_id", text: str = "text", limit_bytes: int = LIMIT_BYTES, first_bits: int = 16, step_bits: int = 16
) -> DataFrame:
    """Rows' key with the shard that holds each: key, n_bytes, shard, depth, shard_bytes.

    Every shard's texts take at most `limit_bytes`, except where one text alone is larger; that
    text is then the only member of its shard at 60 bits. Null text counts 0 bytes; null keys and
    repeated rows are rows like any other; an empty table gives no rows; other columns are not read.
    Prefix totals are refined from `first_bits` by `step_bits` and only for prefixes that are still
    too large, so the number of jobs depends on the hash length, not on the data.
    """
    scratch = Scratch(rows.sparkSession, "shards")
    base = rows.select(
        F.col(key).alias("_k"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("_b"),
        row_hash(F.col(key), F.col(text)).alias("_h"),
    )
    # one row per distinct hash: the repeats of a row are counted before anything is joined
    hashes = scratch.write(base.groupBy("_h").agg(F.sum("_b").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("_b").alias("each")))
    cuts = list(range(first_bits, HASH_BITS, step_bits)) + [HASH_BITS]
    # bytes of every ancestor prefix; levels beyond the first cut exist only below prefixes that are too large
    level = hashes.withColumn("cut", F.lit(cuts[0]))
    leaves = None
    low = 0
    for i, cut in enumerate(cuts):
        depths = F.sequence(F.lit(low), F.lit(cut))
        fine = level.groupBy(_prefix(F.col("_h"), cut).alias("p")).agg(F.sum("bytes").alias("bytes"))
        totals = (
            fine.select(F.explode(F.transform(depths, lambda d: F.substring(F.col("p"), F.lit(1), d))).alias("q"), "bytes")
            .groupBy("q")
            .agg(F.sum("bytes").alias("shard_bytes"))
        )
        totals = scratch.write(totals)
        parent = totals.select(F.col("q").alias("_pq"), F.col("shard_bytes").alias("parent_bytes"))
        fits = (
            totals.join(parent, F.col("_pq") == F.expr("substring(q, 1, length(q) - 1)"), "left")
            .where(F.col("shard_bytes") <= limit_bytes)
            .where((F.length("q") == 0) | (F.col("parent_bytes") > limit_bytes) if i == 0 else (F.col("parent_bytes") > limit_bytes))
            .select("q", "shard_bytes")
        )
        if cut == HASH_BITS:
            fits = fits.unionByName(totals.where((F.length("q") == cut) & (F.col("shard_bytes") > limit_bytes)).select("q", "shard_bytes"))
        leaves = fits if leaves is None else leaves.unionByName(fits)
        big = totals.where((F.length("q") == cut) & (F.col("shard_bytes") > limit_bytes)).select("q")
        if cut == HASH_BITS or not big.limit(1).count():
            break
        level = scratch.write(level.join(big, _prefix(F.col("_h"), cut) == F.col("q"), "left_semi"))
        low = cut
    leaves = scratch.write(leaves)
    # a leaf's depth differs from leaf to leaf: equi-join once per depth that occurs, on the hash's own prefix
    depths = [r[0] for r in leaves.select(F.length("q").alias("d")).distinct().orderBy("d").limit(HASH_BITS + 1).collect()]
    candidates = F.array(*[_prefix(F.col("_h"), d) for d in depths]) if depths else F.array(F.lit(""))
    placed = (
        hashes.select("_h", "n", "each", F.explode(candidates).alias("q"))
        .join(leaves, "q")
        .select("_h", "n", "each", F.col("q").alias("shard"), F.length("q").alias("depth"), "shard_bytes")
    )
    normal = placed.where((F.col("shard_bytes") <= limit_bytes) | (F.col("n") == 1))
    out = base.join(normal, "_h").select(
        F.col("_k").alias(key), F.col("_b").alias("n_bytes"), "shard", "depth", "shard_bytes"
    )
    # equal rows that are together too large: deal them out by count, in two steps so that no task makes them all
    per = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.col("each"))).cast("bigint")
    keyed = base.groupBy("_h").agg(F.first("_k").alias("_k"))
    packs = (
        placed.where((F.col("shard_bytes") > limit_bytes) & (F.col("n") > 1))
        .withColumn("per", per)
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n - 1) div per"))).alias("pack"))
        .withColumn("in_pack", F.least(F.col("per"), F.col("n") - F.col("pack") * F.col("per")))
        .withColumn("members", F.explode(F.expr("sequence(1L, (in_pack + 1023L) div 1024L)")))
        .withColumn("m", F.least(F.lit(1024).cast("bigint"), F.col("in_pack") - (F.col("members") - 1) * 1024))
        .join(keyed, "_h")
        .repartition("_h", "pack", "members")
        .select("*", F.explode(F.expr("sequence(1L, m)")).alias("_i"))
        .select(
            F.col("_k").alias(key),
            F.col("each").alias("n_bytes"),
            F.concat("shard", F.lit("#"), F.col("pack").cast("string")).alias("shard"),
            "depth",
            (F.col("in_pack") * F.col("each")).alias("shard_bytes"),
        )
    )
    return out.unionByName(packs)


def oracle(limit_bytes: int = LIMIT_BYTES) -> str:
    """The same result in DuckDB's SQL: each row's shard is its shortest hash prefix whose rows fit."""
    part = lambda c: f"coalesce('v' || {c}::VARCHAR, 'n')"
    nibbles = ", ".join(f"'{k:04b}'" for k in range(16))
    return f"""
WITH base AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS b, left(md5({part('doc_id')} || chr(31) || {part('text')}), 15) AS hex FROM documents),
bits AS (SELECT doc_id, b, array_to_string(list_transform(string_split(hex, ''), lambda c: [{nibbles}][strpos('0123456789abcdef', c)]), '') AS h FROM base),
same AS (SELECT h, count(*) AS n, sum(b) AS bytes, max(b) AS each FROM bits GROUP BY h),
total AS (SELECT left(h, k) AS q, sum(bytes)::BIGINT AS bytes FROM same, range(0, {HASH_BITS + 1}) AS r(k) GROUP BY 1),
leaf AS (SELECT h, min(length(q)) AS depth FROM same, range(0, {HASH_BITS + 1}) AS r(k) JOIN total ON q = left(h, k) WHERE total.bytes <= {limit_bytes} GROUP BY h),
rows_ AS (SELECT doc_id, b, bits.h, n, each, coalesce(depth, {HASH_BITS})::INTEGER AS depth, depth IS NULL AND n > 1 AS cut, (row_number() OVER (PARTITION BY bits.h) - 1) // greatest(1, {limit_bytes} // greatest(each, 1)) AS pack
          FROM bits JOIN same ON same.h = bits.h LEFT JOIN leaf ON leaf.h = bits.h)
SELECT doc_id, b AS n_bytes, left(h, depth) || CASE WHEN cut THEN '#' || pack ELSE '' END AS shard, depth,
       (CASE WHEN cut THEN count(*) OVER (PARTITION BY h, pack) * each ELSE total.bytes END)::BIGINT AS shard_bytes
FROM rows_ JOIN total ON q = left(h, depth)"""
