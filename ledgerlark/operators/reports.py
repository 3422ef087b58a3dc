"""Reports: one conditional aggregation each instead of a query per figure."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bar, iso_date, percent, percent_floor, representative
from .temporal import first_per


def counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """n, and the number of rows of each condition, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()])


def ratios(df: DataFrame, by: str | None = None, floor: bool = False, **conditions: Column) -> DataFrame:
    """n and, for each condition, its rows and its percentage (one decimal, or whole and rounded down)."""
    n = F.count(F.lit(1))
    made = [n.alias("n")]
    for k, c in conditions.items():
        hit = F.count_if(F.coalesce(c, F.lit(False)))
        made += [hit.alias(k), (percent_floor(hit, n) if floor else percent(hit, n)).alias(f"{k}_pct")]
    return (df.groupBy(by) if by else df).agg(*made)


def counters(claims: DataFrame, labels: DataFrame | None = None, key: str = "referent_key", unit: str = "qty_unit", value: str = "qty_value") -> DataFrame:
    """Per referent and unit: label, n_claims, min, max, avg (0 gives null), spread; most claims first, then key and unit."""
    v = F.col(value)
    out = claims.where(v.isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("referent_key"), F.col(unit).alias("unit")).agg(
        F.count(F.lit(1)).alias("n_claims"), F.min(v).alias("min"), F.max(v).alias("max"), F.nullif(F.round(F.avg(v), 2), F.lit(0.0)).alias("avg"), F.round(F.max(v) - F.min(v), 2).alias("spread")
    )
    if labels is not None:
        out = out.join(labels.select(F.col("key").alias("referent_key"), "label"), "referent_key", "left").withColumn("label", F.coalesce("label", "referent_key"))
    return out.orderBy(F.desc("n_claims"), "referent_key", "unit")


def group_counts(df: DataFrame, by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def theme_tree(themes: DataFrame, subthemes: DataFrame, posts: DataFrame, articles: DataFrame) -> DataFrame:
    """Themes in order, each with posts, articles, empty, and children (id, label, posts, articles, empty) by label."""

    def counted(dim: DataFrame, by: str) -> DataFrame:
        p, a = (group_counts(df, by).select(F.col(by).alias("id"), F.col("n").alias(k)) for df, k in ((posts, "posts"), (articles, "articles")))
        out = dim.join(p, "id", "left").join(a, "id", "left").fillna(0, ["posts", "articles"])
        return out.withColumn("empty", F.col("posts") + F.col("articles") == 0)

    children = counted(subthemes, "subtheme").groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct("label", "id", "posts", "articles", "empty"))).alias("children"))
    return counted(themes, "theme").join(children, F.col("id") == F.col("theme_id"), "left").drop("theme_id").orderBy("order")


def distribution(df: DataFrame, by: str, width: int = 30, examples: str | None = None, key: str = "id", n_examples: int = 3) -> DataFrame:
    """Rows per value, most first, with share, text bar and first examples; null is 'unclassified'."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    out = out.select(F.coalesce(by, F.lit("unclassified")).alias("value"), "n", percent(F.col("n"), F.col("total")).alias("pct"), bar(F.col("n"), F.col("total"), width).alias("bar"))
    if examples:
        first = first_per(df.where(F.col(by).isNotNull()), by, [F.col(key)], n_examples).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(key, examples))), lambda r: r[examples]).alias("examples"))
        out = out.join(first, F.col("value") == F.col(by), "left").drop(by)
    return out.orderBy(F.desc("n"), "value")


def collection_report(posts: DataFrame, articles: DataFrame, people: DataFrame, sources: DataFrame, fail_from: int = 2) -> DataFrame:
    """One row with coverage, completeness and archiving of both channels."""
    full = lambda c: F.col(c).isNotNull()
    x = counts(posts, eng=full("likes"), html=F.col("collected_via") == "html", arch=full("snapshot_url"))
    x = x.select(F.col("n").alias("posts"), F.col("eng").alias("with_engagement"), percent(F.col("eng"), F.col("n")).alias("engagement_pct"), percent(F.col("html"), F.col("n")).alias("via_html_pct"), percent(F.col("arch"), F.col("n")).alias("x_archived_pct"))
    a = counts(articles, full=F.col("is_full_text"), wall=F.col("paywalled"), pdp=F.col("nature") == "prise_de_parole", est=F.col("published_estimated"), arch=full("snapshot_url"))
    pct = lambda k: percent(F.col(k), F.col("n"))
    a = a.select(F.col("n").alias("articles"), F.col("full").alias("full_text"), pct("full").alias("full_text_pct"), pct("wall").alias("paywalled_pct"), F.col("pdp").alias("prises_de_parole"), pct("pdp").alias("pdp_pct"), pct("est").alias("date_estimated_pct"), pct("arch").alias("press_archived_pct"))
    # the numerator is not restricted to active handles, so coverage can pass 100
    p = counts(people, handles=F.col("is_active") & full("handle"), seen=full("last_collected_at"))
    p = p.select(F.col("n").alias("personalities"), F.col("handles").alias("handles_active"), F.col("seen").alias("handles_collected"), percent(F.col("seen"), F.col("handles")).alias("handle_coverage_pct"))
    s = counts(sources, active=F.col("is_active"), failing=F.col("is_active") & (F.col("consecutive_failures") >= fail_from)).select(F.col("active").alias("sources_active"), F.col("failing").alias("sources_failing"))
    return x.crossJoin(a).crossJoin(p).crossJoin(s)  # one row each


def funnel(df: DataFrame, by: str | None = None, nature: str = "nature") -> DataFrame:
    return ratios(df, by, floor=True, pdp=F.col(nature) == "prise_de_parole", mention=F.col(nature) == "mention", reject=F.col(nature).isNull())


def run_totals(runs: DataFrame, by: str | None = None) -> DataFrame:
    """Sums of the passes' figures, and their errors."""
    return (runs.groupBy(by) if by else runs).agg(*[F.sum(c).alias(c) for c in ("new", "scanned", "pdp", "mentions")], F.array_sort(F.collect_list("error")).alias("errors"))


def method_stats(attempts: DataFrame, method: str = "method", ok: str = "success", ms: str = "duration_ms") -> DataFrame:
    """Per method: attempts, successes, success_rate, mean duration, and healthy above one half."""
    n, hit = F.count(F.lit(1)), F.count_if(F.col(ok))
    return attempts.groupBy(method).agg(n.alias("attempts"), hit.alias("successes"), percent(hit, n).alias("success_rate"), F.round(F.avg(ms), 1).alias("avg_duration_ms"), (hit / n > 0.5).alias("healthy"))


def batch_report(results: DataFrame, by: str) -> DataFrame:
    n, ok, whole = F.count(F.lit(1)), F.count_if("success"), F.count_if("is_complete")
    return results.groupBy(by).agg(n.alias("n"), ok.alias("successes"), percent(ok, n).alias("success_rate"), whole.alias("complete"), percent(whole, n).alias("completeness_rate"))


def issue_groups(results: DataFrame, issue: str = "issue", name: str = "name", samples: int = 3) -> DataFrame:
    """Per issue: how many, and the first names."""
    first = first_per(results, issue, [F.col(name)], samples).groupBy(issue).agg(F.array_sort(F.collect_list(name)).alias("samples"))
    return results.groupBy(issue).agg(F.count(F.lit(1)).alias("n")).join(first, issue).orderBy(F.desc("n"), issue)


FACTS, FACT_CHARS, LEAST_CLAIMS = 50, 200, 3


def facts(claims: DataFrame, by: str = "personality_id", cap: int = FACTS) -> DataFrame:
    """Per person the newest `cap` claims, a dated line each; bounded whatever the number of claims."""
    ranked = first_per(claims, by, [F.desc_nulls_last("published_at"), F.desc("id")], cap)
    line = F.concat(F.lit("- ["), iso_date("published_at"), F.lit("] ("), F.coalesce("theme", F.lit("?")), F.lit("/"), F.coalesce("claim_type", F.lit("?")), F.lit(") "), F.substring(representative("canonical", "verbatim"), 1, FACT_CHARS))
    order = F.struct(F.col("published_at").isNull().alias("x"), (-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("t"), (-F.col("id")).alias("i"), line.alias("line"))
    return ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["line"]), "\n").alias("facts"))


def dossiers(claims: DataFrame, edges: DataFrame, by: str = "personality_id", least: int = LEAST_CLAIMS) -> DataFrame:
    """Per person with enough claims: n_claims, maps of claims per theme and type, period, contradictions, facts."""
    tally = lambda c: claims.groupBy(by, F.coalesce(c, F.lit("?")).alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"by_{c}"))
    base = claims.groupBy(by).agg(F.count(F.lit(1)).alias("n_claims"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at")).where(F.col("n_claims") >= least)
    ends = edges.select("claim_a_id", "claim_b_id", F.explode(F.array("claim_a_id", "claim_b_id")).alias("id")).join(claims.select("id", by), "id")
    linked = ends.groupBy(by).agg(F.count_distinct("claim_a_id", "claim_b_id").alias("contradictions"))
    out = base.join(tally("theme"), by).join(tally("claim_type"), by).join(facts(claims, by), by).join(linked, by, "left")
    return out.fillna(0, ["contradictions"])


def refresh_dossiers(claims: DataFrame, edges: DataFrame, kept: DataFrame, summarise: Callable[[list[str]], list[str | None]], by: str = "personality_id", least: int = LEAST_CLAIMS, force: bool = False) -> DataFrame:
    """(person, n_claims, summary, state) for everyone with claims or a dossier.

    kept: (person, n_claims, summary), dossiers made before. They stay as they are (`cached`) unless
    `force`; people with fewer claims than `least` are `skipped`; for the others an injected function
    sums up the facts, batch by batch (`generated`; `failed` where it gives null).
    """
    cached = kept.select(by, "n_claims", "summary", F.lit("cached").alias("state"))
    todo = claims if force else claims.join(kept.select(by).distinct(), by, "left_anti")

    @F.pandas_udf("string")
    def summed_up(facts: pd.Series) -> pd.Series:
        return pd.Series(summarise(facts.tolist()), dtype=object)

    made = dossiers(todo, edges, by, least).select(by, "n_claims", summed_up("facts").alias("summary"))
    made = made.withColumn("state", F.when(F.col("summary").isNull(), "failed").otherwise("generated"))
    few = todo.groupBy(by).agg(F.count(F.lit(1)).alias("n_claims")).where(F.col("n_claims") < least).select(by, "n_claims", F.lit(None).cast("string").alias("summary"), F.lit("skipped").alias("state"))
    new = made.unionByName(few)
    return new.unionByName(cached.join(new.select(by), by, "left_anti") if force else cached)
