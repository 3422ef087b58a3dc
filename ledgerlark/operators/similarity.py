"""Cosine similarity: nearest anchors, fusion candidates, greedy near-duplicate groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, truncate
from ..session import written

#: Anchors (referents, themes) are a closed vocabulary. So many are sent to every task at once; a larger table is
#: taken in parts, each sent by itself, and one of more than MOST_PARTS parts is refused.
ANCHOR_ROWS, MOST_PARTS = 10_000, 16


def dot(a: Column | str, b: Column | str) -> Column:
    prod = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Over the shorter length; 0 where a vector is empty or has no length."""
    n = norm(a) * norm(b)
    return F.when(F.coalesce(n, F.lit(0.0)) == 0, 0.0).otherwise(dot(a, b) / n)


def _anchor_parts(df: DataFrame, key: str) -> list[DataFrame]:
    """The anchors in parts of about ANCHOR_ROWS rows, each to be broadcast: the count, not an estimate, decides."""
    parts = -(-df.count() // ANCHOR_ROWS)
    if parts > MOST_PARTS:
        raise ValueError(f"more than {ANCHOR_ROWS * MOST_PARTS} anchors; they are a closed vocabulary")
    if parts < 2:
        return [F.broadcast(df)]
    return [F.broadcast(df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)) for k in range(parts)]


def nearest_anchor(items: DataFrame, anchors: DataFrame, item_key: str, anchor_key: str, least: float, vector: str = "embedding", strict: bool = True) -> DataFrame:
    """item_key, anchor_key, score of the best anchor, from `least` on; only positive scores, ties to the smaller anchor.

    Norms are computed once per row, not per pair. Every part of the anchors hands on one candidate an item.
    """
    a = anchors.where(F.col(vector).isNotNull()).select(F.col(anchor_key).alias("_k"), F.col(vector).alias("_v"), norm(vector).alias("_n"))
    i = items.where(F.col(vector).isNotNull()).select(item_key, F.col(vector).alias("_w"), norm(vector).alias("_m"))
    score = F.when(F.col("_n") * F.col("_m") == 0, 0.0).otherwise(dot("_v", "_w") / (F.col("_n") * F.col("_m")))
    pairs = reduce(DataFrame.unionByName, [i.join(part, F.lit(True)).select(item_key, "_k", score.alias("score")) for part in _anchor_parts(a, "_k")])
    best = pairs.groupBy(item_key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_k").alias("k"))).alias("b"))
    out = best.select(item_key, F.col("b.k").alias(anchor_key), (-F.col("b.s")).alias("score"))
    return out.where((F.col("score") > 0) & (F.col("score") >= least)) if strict else out


def top_anchors(query: list[float], anchors: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """The k anchors nearest to one vector, with scores of four decimals."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return anchors.where(F.col(vector).isNotNull()).select(*[c for c in anchors.columns if c != vector], F.round(cosine(vector, q), 4).alias("score")).orderBy(F.desc("score"), anchors.columns[0]).limit(k)


def fusion_candidates(anchors: DataFrame, threshold: float, key: str = "key", vector: str = "embedding") -> DataFrame:
    """Pairs of anchors (each once) at least as similar as the threshold, most similar first.

    Any number of anchors: rows are dealt to parts by their key, and every two parts are compared by a task as
    matrices. What comes near the threshold is computed again component by component, as `cosine` does it.
    """
    x = F.col(vector)
    whole = ~F.exists(x, lambda c: c.isNull())
    a = anchors.where(x.isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.when(whole, x).otherwise(F.transform(x, lambda c: F.coalesce(c, F.lit(0).cast("float")))).alias("v"), F.when(~whole, F.transform(x, lambda c: c.isNotNull())).alias("held"), norm(x).alias("n")
    )
    parts = max(1, -(-a.count() // TILE_ROWS))
    own = F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")
    dealt = a.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.select("k", "v", "held", "n", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), (F.col("own") > F.col("other")).alias("right"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        alone = pdf["g"].iloc[0] == pdf["h"].iloc[0]
        left, right = (pdf, pdf) if alone else (pdf[~pdf["right"]], pdf[pdf["right"]])
        width = int(pdf["v"].map(len).max())
        (u, u_held), (w, w_held) = _matrix(left, width), _matrix(right, width)
        gaps = not (u_held.all() and w_held.all())
        p, q = left["k"].to_numpy(), right["k"].to_numpy()
        m, n = left["n"].to_numpy(dtype=float), right["n"].to_numpy(dtype=float)
        columns, others = np.ascontiguousarray(u.T), np.ascontiguousarray(w.T)
        for lo in range(0, len(left) if len(right) else 0, 256):
            with np.errstate(all="ignore"):
                length = m[lo : lo + 256, None] * n[None, :]
                rough = np.where(length == 0, 0.0, u[lo : lo + 256] @ w.T / length)
                # not a number counts as more than any
                i, j = np.nonzero(~(rough < threshold - 1e-9))
                i += lo
                ordered = p[i] < q[j] if alone else p[i] != q[j]
                i, j = i[ordered.astype(bool)], j[ordered.astype(bool)]
                total = np.zeros(len(i))
                for c in range(width):
                    product = columns[c][i] * others[c][j]
                    total += np.where(u_held[i, c] & w_held[j, c], product, 0.0) if gaps else product
                length = m[i] * n[j]
                score = np.where(length == 0, 0.0, total / length)
            kept = ~(score < threshold)
            i, j, score = i[kept], j[kept], score[kept]
            first = (p[i] < q[j]).astype(bool)
            yield pd.DataFrame({"a": np.where(first, p[i], q[j]), "b": np.where(first, q[j], p[i]), "score": score})

    kind = dict(a.dtypes)["k"]
    pairs = dealt.groupBy("g", "h").applyInPandas(compare, f"a {kind}, b {kind}, score double")
    # pandas hands on what is not a number as null; there is no other null
    return pairs.withColumn("score", F.coalesce("score", F.lit(float("nan")))).orderBy(F.desc("score"), "a", "b")


def _matrix(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of one matrix, and which of its components are there."""
    out, held = np.zeros((len(rows), width)), np.ones((len(rows), width), dtype=bool)
    for r, (v, there) in enumerate(zip(rows["v"], rows["held"], strict=True)):
        out[r, : len(v)] = v
        held[r, len(v) :] = False
        if there is not None:
            held[r, : len(v)] = there
    return out, held


def greedy_groups(ids: list, vectors: np.ndarray, threshold: float) -> list[list]:
    """First-fit groups in order: a row joins the first group whose first member is near enough, else opens one."""
    unit = _unit(vectors)
    pivots = np.empty_like(unit)
    groups: list[list] = []
    for i, v in zip(ids, unit, strict=True):
        at = np.flatnonzero(pivots[: len(groups)] @ v >= threshold)
        if len(at):
            groups[at[0]].append(i)
        else:
            pivots[len(groups)] = v
            groups.append([i])
    return groups


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


#: Rows of a block that one task compares with one another, or with so many others.
TILE_ROWS = 4096


def near_duplicate_members(claims: DataFrame, threshold: float = 0.92, block: str = "referent_key", key: str = "id", vector: str = "embedding") -> DataFrame:
    """(block, pivot, member), a row for each claim that has a vector, pivots with themselves; a null block is one of its own.

    Per block in order of key, a claim joins the first pivot that is near enough, else it is one. Blocks
    of up to TILE_ROWS rows are settled by a task each. Of larger ones all rows are compared tile by
    tile, in rounds: a row without a smaller undecided one near it is a pivot, and those near a new
    pivot are decided. Tasks hand on one row for each that they compare, never pairs.
    """
    rows = claims.where(F.col(vector).isNotNull()).select(F.col(block).alias("b"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("parts"))
    sizes = written(sizes.withColumn("bid", F.monotonically_increasing_id()), "blocks")
    rows = rows.join(sizes.withColumnRenamed("b", "c"), F.col("b").eqNullSafe(F.col("c"))).drop("c")
    kinds = dict(rows.dtypes)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        groups = greedy_groups(pdf["k"].tolist(), np.stack(pdf["v"].to_numpy()).astype(float), threshold)
        return pd.DataFrame([(pdf["b"].iloc[0], g[0], m) for g in groups for m in g], columns=["b", "p", "k"], dtype=object)

    out = rows.where("parts = 1").select("bid", "b", "k", "v").groupBy("bid").applyInPandas(settle, f"b {kinds['b']}, p {kinds['k']}, k {kinds['k']}")
    if not sizes.where("parts > 1").isEmpty():
        out = out.unionByName(_by_rounds(written(rows.where("parts > 1"), "large-blocks"), threshold))
    return out.select(F.col("b").alias(block), F.col("p").alias("pivot"), F.col("k").alias("member"))


def _by_rounds(rows: DataFrame, threshold: float) -> DataFrame:
    """(b, p, k) of blocks of several tiles; rows: b, k, v, bid, parts."""
    same = ["bid", "k"]

    def first_near(left: DataFrame, right: DataFrame) -> DataFrame:
        """(bid, k, p): the smallest row of the right, before the left one, that is near enough."""
        deal = lambda df, own, other, side: df.select("bid", "k", "v", F.pmod(F.xxhash64("k"), F.col("parts")).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias(other), F.lit(side).alias("side"))
        dealt = deal(left, "h", "g", 0).unionByName(deal(right, "g", "h", 1))

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("k")
            found = []
            if len(a) and len(b):
                keys, unit = b["k"].to_numpy(), _unit(np.stack(b["v"].to_numpy()).astype(float))
                for lo in range(0, len(a), 256):
                    part = a.iloc[lo : lo + 256]
                    near = _unit(np.stack(part["v"].to_numpy()).astype(float)) @ unit.T >= threshold
                    for k, at, any_ in zip(part["k"], near.argmax(1), near.any(1), strict=True):
                        if any_ and keys[at] < k:
                            found.append((pdf["bid"].iloc[0], k, keys[at]))
            return pd.DataFrame(found, columns=["bid", "k", "p"], dtype=object)

        kind = dict(left.dtypes)["k"]
        each = dealt.groupBy("bid", "h", "g").applyInPandas(compare, f"bid long, k {kind}, p {kind}")
        return each.groupBy(same).agg(F.min("p").alias("p"))

    undecided, pivots = rows, None
    while True:
        lower = written(first_near(undecided, undecided), "lower")
        fresh = written(undecided.join(lower, same, "left_anti"), "pivots")
        pivots = fresh if pivots is None else pivots.unionByName(fresh)
        rest = undecided.join(lower, same, "left_semi")
        undecided = written(rest.join(first_near(rest, fresh), same, "left_anti"), "undecided")
        if undecided.isEmpty():
            break
    joined = first_near(rows.join(pivots, same, "left_anti"), pivots)
    every = joined.unionByName(pivots.select("bid", "k", F.col("k").alias("p")))
    return every.join(rows.select("bid", "b", "k"), same).select("b", "p", "k")


def near_duplicate_groups(claims: DataFrame, threshold: float = 0.92, block: str = "referent_key", key: str = "id", vector: str = "embedding") -> DataFrame:
    """(block, pivot, members, size) of groups of two and more, members in order of key."""
    found = near_duplicate_members(claims, threshold, block, key, vector)
    return found.groupBy(block, "pivot").agg(F.array_sort(F.collect_list("member")).alias("members"), F.count(F.lit(1)).cast("int").alias("size")).where("size > 1")


def embed(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 96, most_chars: int = 1500) -> DataFrame:
    """Adds `embedding` by an injected function over at most `batch` texts of at most `most_chars` characters."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        values = texts.fillna("").tolist()
        return pd.Series([v for lo in range(0, len(values), batch) for v in embedder(values[lo : lo + batch])])

    return df.withColumn("embedding", vectors(truncate(text, most_chars)))
