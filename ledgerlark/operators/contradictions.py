"""Contradictions: claims blocked by referent, compared by blocked self-joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_date, relative_difference
from ..session import written

# --- Fixed values ---
EPSILON, NORMATIVE_SCORE = 0.02, 0.7
FLOOR = {1: 0.85, 2: 0.6, 3: 0.6, 6: 0.0}
LABELS = {1: "revirement intra-locuteur", 2: "contradiction intra-parti", 3: "divergence inter-partis", 4: "écart au programme", 5: "contradiction vérité externe", 6: "variance numérique"}
# ---


def contradiction_type(a: str = "a", b: str = "b") -> Column:
    """1: one speaker, two dates; 2: one party, other speakers; 3: other parties; 6: else. A missing speaker differs from any name."""
    f = lambda side, name: F.col(f"{side}.{name}")
    named = lambda side, name: F.coalesce(f(side, name), F.lit("")) != ""
    same_speaker = named(a, "speaker_name") & named(b, "speaker_name") & (f(a, "speaker_name") == f(b, "speaker_name"))
    turned = same_speaker & F.coalesce(f(a, "published_at") != f(b, "published_at"), F.lit(False))
    parties = named(a, "party") & named(b, "party")
    other_speaker = ~f(a, "speaker_name").eqNullSafe(f(b, "speaker_name"))
    return (
        F.when(turned, 1)
        .when(parties & other_speaker & (f(a, "party") == f(b, "party")), 2)
        .when(parties & (f(a, "party") != f(b, "party")), 3)
        .otherwise(6)
    )


def _floor(kind: Column) -> Column:
    out = F.lit(0.0)
    for k, v in FLOOR.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _who(side: str) -> Column:
    f = lambda n: F.nullif(F.col(f"{side}.{n}"), F.lit(""))
    return F.coalesce(f("speaker_name"), f("party"), F.lit("source presse"))


def general_number(x: Column) -> Column:
    """Six significant digits without trailing zeros, as %g writes them."""
    a = F.abs(x)
    e = F.floor(F.log10(a)).cast("int")
    digits = F.greatest(F.lit(0), F.lit(5) - e)
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)), "0+$", ""), r"\.$", "")
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", x / F.pow(F.lit(10.0), e)), "0+$", ""), r"\.$", "")
    scientific = F.concat(mantissa, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    return F.when(x == 0, "0").when((a >= 1e6) | (a < 1e-4), scientific).otherwise(fixed)


def _pairs(claims: DataFrame, block: list[str], fields: list[str]) -> DataFrame:
    """Each pair of a block once, the earlier claim as a. Blocks are equi-keys (null-safe); a hot one may be split by adaptive execution."""
    kept = claims.select(*block, F.struct("id", *fields).alias("a"))
    other = kept.select(*[F.col(k).alias(f"_{k}") for k in block], F.col("a").alias("b"))
    same = F.lit(True)
    for k in block:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    order = lambda s: F.struct(F.col(f"{s}.published_at").isNull(), F.col(f"{s}.published_at"), F.col(f"{s}.id"))
    return kept.join(other, same & (order("a") < order("b")))


#: What each comparison needs of a claim; nothing else is shuffled.
NUMERIC_FIELDS = ["speaker_name", "party", "published_at", "qty_value", "qty_unit"]
STANCE_FIELDS = ["speaker_name", "party", "published_at", "verbatim", "stance_polarity"]


def _edges(pairs: DataFrame, score: Column, rationale: Column) -> DataFrame:
    return pairs.select(
        F.least("a.id", "b.id").alias("claim_a_id"), F.greatest("a.id", "b.id").alias("claim_b_id"), "referent_key", F.col("_type").alias("type"), score.alias("score"), rationale.alias("rationale"), F.lit("pending").alias("status")
    )


def _label(kind: Column) -> Column:
    out = F.lit("")
    for k, v in LABELS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def numeric_contradictions(claims: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Edges between claims of one referent and unit kind whose values differ by more than `epsilon`, relatively."""
    c = claims.where("referent_key is not null and qty_value is not null")
    pairs = _pairs(c, ["referent_key", "qty_unit_kind"], NUMERIC_FIELDS)
    diff = relative_difference(F.col("a.qty_value"), F.col("b.qty_value"))
    pairs = pairs.withColumn("_diff", diff).where(F.col("_diff") > epsilon).withColumn("_type", contradiction_type())
    side = lambda s: F.concat(general_number(F.col(f"{s}.qty_value")), F.lit(" "), F.coalesce(f"{s}.qty_unit", F.lit("")), F.lit(" ("), _who(s), F.lit(", "), iso_date(f"{s}.published_at"), F.lit(")"))
    score = F.round(F.least(F.greatest(F.col("_diff"), _floor(F.col("_type"))), F.lit(1.0)), 3)
    return _edges(pairs, score, F.concat(_label(F.col("_type")), F.lit(" — "), side("a"), F.lit("  ≠  "), side("b")))


def stance_contradictions(claims: DataFrame) -> DataFrame:
    """Edges between claims of one referent that are for and against it."""
    c = claims.where("referent_key is not null and qty_value is null and stance_polarity in ('pour', 'contre')")
    pairs = _pairs(c, ["referent_key"], STANCE_FIELDS).where(F.col("a.stance_polarity") != F.col("b.stance_polarity")).withColumn("_type", contradiction_type())
    quote = lambda s: F.concat(F.col(f"{s}.stance_polarity"), F.lit(" ("), _who(s), F.lit(", "), iso_date(f"{s}.published_at"), F.lit(") : « "), F.substring(F.coalesce(f"{s}.verbatim", F.lit("")), 1, 90), F.lit(" »"))
    score = F.round(F.greatest(F.lit(NORMATIVE_SCORE), _floor(F.col("_type"))), 3)
    return _edges(pairs, score, F.concat(_label(F.col("_type")), F.lit(" — "), quote("a"), F.lit("  ⇄  "), quote("b")))


def new_edges(edges: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges whose pair, in either order, is not known yet."""
    seen = existing.select(F.least("claim_a_id", "claim_b_id").alias("claim_a_id"), F.greatest("claim_a_id", "claim_b_id").alias("claim_b_id"))
    return edges.join(seen, ["claim_a_id", "claim_b_id"], "left_anti")


def detect(claims: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    edges = numeric_contradictions(claims).unionByName(stance_contradictions(claims))
    return new_edges(edges, existing) if existing is not None else edges


def detection_stats(claims: DataFrame, existing: DataFrame) -> DataFrame:
    """blocks, incompatible pairs (known ones too), new numeric and normative edges."""
    numeric, stance = numeric_contradictions(claims), stance_contradictions(claims)
    blocks = claims.where("referent_key is not null and qty_value is not null").select("referent_key", "qty_unit_kind").distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = count(blocks, "blocks")
    for df, name in ((numeric, "pairs_incompatible"), (new_edges(numeric, existing), "contradictions_new"), (new_edges(stance, existing), "normative_new")):
        out = out.crossJoin(count(df, name))  # one row each
    return out


def apply_validation(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges with the decisions of reviewers (claim_a_id, claim_b_id, decision, validator, validated_at); the last decision holds."""
    last = decisions.where("decision in ('confirmed', 'rejected')").groupBy("claim_a_id", "claim_b_id").agg(F.max_by(F.struct("decision", "validator", "validated_at"), "validated_at").alias("d"))
    return edges.join(last, ["claim_a_id", "claim_b_id"], "left").withColumn("status", F.coalesce("d.decision", "status")).withColumn("validator", F.col("d.validator")).withColumn("validated_at", F.col("d.validated_at")).drop("d")


# --- counts without pairs -------------------------------------------------------------------------

#: Pairs of a type are sums and differences of pairs within groups of claims that agree in something:
#: columns of a group besides its block, which claims take part, and the sign for each type.
_SAID = "coalesce(speaker_name, '') <> '' and published_at is not null"
_MEMBER = "coalesce(party, '') <> ''"
GROUPINGS = [
    ([], "true", {6: 1}),
    (["speaker_name"], _SAID, {1: 1, 6: -1}),
    (["speaker_name", "published_at"], f"{_SAID} and same_date", {1: -1, 6: 1}),
    (["party"], _MEMBER, {2: 1, 3: -1}),
    (["party", "speaker_name"], _MEMBER, {2: -1, 6: 1}),
    (["_member"], _MEMBER, {3: 1, 6: -1}),
    # a speaker's turn between two parties is no divergence of parties; nothing to do for speakers of one party
    (["speaker_name", "_member"], f"{_SAID} and {_MEMBER} and parties", {3: -1, 6: 1}),
    (["speaker_name", "_member", "published_at"], f"{_SAID} and {_MEMBER} and parties and same_date", {3: 1, 6: -1}),
    (["speaker_name", "party"], f"{_SAID} and {_MEMBER} and parties", {3: 1, 6: -1}),
    (["speaker_name", "party", "published_at"], f"{_SAID} and {_MEMBER} and parties and same_date", {3: -1, 6: 1}),
]


def _histogram(claims: DataFrame, block: list[str], value: Column) -> DataFrame:
    """(code, referent_key, g1, g2, x, n): how often a value occurs in each group of each grouping (written)."""
    rows = claims.select(*block, "speaker_name", "party", "published_at", value.alias("x"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    named = rows.where(_SAID)
    twice = named.groupBy(*block, "speaker_name", "published_at").agg(F.sum("n").alias("_n")).where("_n > 1").select(*block, "speaker_name", "published_at", F.lit(True).alias("same_date"))
    moved = named.where(_MEMBER).groupBy(*block, "speaker_name").agg((F.min("party") != F.max("party")).alias("parties")).where("parties")
    rows = written(_joined(_joined(rows, twice, [*block, "speaker_name", "published_at"]), moved, [*block, "speaker_name"]), "claims")
    rows = rows.withColumn("_member", F.lit(True))
    parts = []
    for code, (more, where, _) in enumerate(GROUPINGS):
        key = [c for k in [*block, *more] for c in (F.col(k), F.col(k).isNull())]
        parts.append(rows.where(where).select(F.lit(code).alias("code"), "referent_key", F.xxhash64(F.lit(code), *key).alias("g1"), F.xxhash64(F.lit(-1 - code), *key).alias("g2"), "x", "n"))
    return written(reduce(DataFrame.unionByName, parts).groupBy("code", "referent_key", "g1", "g2", "x").agg(F.sum("n").alias("n")), "values")


def _joined(rows: DataFrame, marks: DataFrame, on: list[str]) -> DataFrame:
    """Null-safe left join."""
    marks = marks.select(*[F.col(k).alias(f"_{k}") if k in on else F.col(k) for k in marks.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on])
    return rows.join(marks, same, "left").drop(*[f"_{k}" for k in on])


def _largest_near(epsilon: float) -> Callable:
    """For each value the largest one above it that does not differ by more than epsilon, to the last bit."""

    def near(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (w - v) / np.maximum(np.maximum(np.abs(v), np.abs(w)), 1.0) <= epsilon

    # doubles in their order, as whole numbers
    low = np.iinfo(np.int64).min
    flip = lambda i: np.where(i < 0, low - i, i)

    def largest(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        lo, hi = flip(v.view(np.int64)), np.full(len(v), np.inf).view(np.int64)
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(64):
                middle = (lo >> 1) + (hi >> 1) + (lo & hi & 1)
                ok = near(v, flip(middle).view(np.float64))
                lo, hi = np.where(ok, middle, lo), np.where(ok, hi, middle)
        return pd.Series(flip(lo).view(np.float64))

    return F.pandas_udf(largest, "double")


def _near_pairs(values: DataFrame, epsilon: float) -> DataFrame:
    """(code, referent_key, near): pairs within the groups that do not differ by more than epsilon.

    Values, and for each the largest one near it, are sorted together over all groups: the number of rows
    between the two is the difference of two running counts. No task needs to hold a group.
    """
    own = values.where("not isnan(x) and abs(x) < double('infinity')")
    point = F.struct(F.col("x").alias("x"), F.lit(0).alias("side"))
    last = F.struct(F.col("last").alias("x"), F.lit(1).alias("side"))
    both = own.withColumn("last", _largest_near(epsilon)("x")).select("code", "referent_key", "g1", "g2", "n", F.explode(F.array(point, last)).alias("e")).select("code", "referent_key", "g1", "g2", "n", "e.*")
    by = ["g1", "g2", "x", "side"]
    ordered = written(both, "ends").repartitionByRange(*by).sortWithinPartitions(*by)

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, found, part = 0, [], TaskContext.get().partitionId()
        for pdf in batches:
            n, side = pdf["n"].to_numpy(), pdf["side"].to_numpy()
            rows = np.where(side == 0, n, 0)
            upto = count + np.cumsum(rows)
            count = int(upto[-1]) if len(upto) else count
            weight = np.where(side == 0, -n, n)
            # rows of the value itself: each pair once
            own = np.where(side == 0, n * (n - 1) // 2, 0)
            out = pd.DataFrame({"code": pdf["code"], "referent_key": pdf["referent_key"], "near": weight * upto + own, "weight": weight, "rows": 0})
            found.append(out.groupby(["code", "referent_key"], as_index=False).sum())
        found.append(pd.DataFrame({"code": [-1], "referent_key": [""], "near": [0], "weight": [0], "rows": [count]}))
        yield pd.concat(found).assign(part=part).astype({"code": "int32", "part": "int32"})

    sums = written(ordered.mapInPandas(running, "code int, referent_key string, near long, weight long, rows long, part int"), "running")
    # one row for each partition of the sort
    before = sums.where("code < 0").select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    return sums.where("code >= 0").join(F.broadcast(before), "part").groupBy("code", "referent_key").agg(F.sum(F.col("near") + F.col("weight") * F.col("before")).alias("near"))


def _by_type(counts: DataFrame) -> DataFrame:
    """(referent_key, type, n) from (code, referent_key, n)."""
    signs = F.lit(None).cast("map<int,int>")
    for code, (*_, of) in enumerate(GROUPINGS):
        signs = F.when(F.col("code") == code, F.create_map(*[F.lit(x) for kv in of.items() for x in kv])).otherwise(signs)
    out = counts.select("referent_key", F.explode(signs).alias("type", "sign"), "n")
    return out.groupBy("referent_key", "type").agg(F.sum(F.col("sign") * F.col("n")).alias("n"))


def edge_counts(claims: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(referent_key, type, n): how many edges of each type `detect` finds, without making them.

    Ids are unique. epsilon < 0.5: then values that differ from a smaller one by more are those above a bound.
    """
    if not 0 <= epsilon < 0.5:
        raise ValueError("epsilon must be at least 0 and below 0.5")
    group = ["code", "referent_key", "g1", "g2"]
    numbers = _histogram(claims.where("referent_key is not null and qty_value is not null"), ["referent_key", "qty_unit_kind"], F.col("qty_value"))
    every = numbers.groupBy(*group).agg(F.sum("n").alias("_n")).groupBy("code", "referent_key").agg(F.sum(F.expr("_n * (_n - 1) div 2")).alias("every"))
    far = every.join(_near_pairs(numbers, epsilon), ["code", "referent_key"], "left").select("code", "referent_key", (F.col("every") - F.coalesce("near", F.lit(0))).alias("n"))
    stances = _histogram(claims.where("referent_key is not null and qty_value is null and stance_polarity in ('pour', 'contre')"), ["referent_key"], F.col("stance_polarity"))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("x") == s, F.col("n"))), F.lit(0))
    against = stances.groupBy(*group).agg((side("pour") * side("contre")).alias("_n")).groupBy("code", "referent_key").agg(F.sum("_n").alias("n"))
    return _by_type(far.unionByName(against)).where("n > 0")
