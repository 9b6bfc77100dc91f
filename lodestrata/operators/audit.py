"""Audit of stored facts against archived sources, history events, and what pages over the catalog show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import PROVIDERS, lifecycle_diff, pivot, semantic_key

STAMP = r"^\d{4}-\d\d-\d\dT.*(Z|[+-]\d\d:\d\d)$"
# What a failed predicate is called and how it reads; suffixes serve for all others.
REASONS = {
    "documentation_not_eligible": ("documentation", "excluded_documentation", "documentation disposition is not eligible for this query"),
    "provider_mismatch": ("provider", "excluded_provider", "provider does not match the requested provider filter"),
    "lifecycle_not_verified": ("lifecycle", "missing_verified_evidence", "lifecycle is not verified"),
    "lifecycle_mismatch": ("lifecycle", "excluded_lifecycle", "verified lifecycle does not match the requested lifecycle"),
    "context_window_kind_mismatch": ("context_window", "incompatible_context_kind", "verified context kind does not match the requested kind"),
    "context_window_below_minimum": ("context_window", "below_context_threshold", "verified context window is below the requested threshold"),
    "missing_compatible_context_limit": ("context_window", "missing_verified_evidence", "no verified compatible context limit"),
}


def refresh_id(stamp: Column) -> Column:
    """The archive's name of the refresh that a timestamp stands for."""
    return F.regexp_replace(F.regexp_replace(F.trim(stamp), r"[+-]00:00$", "Z"), ":", "-")


def provider_clocks(facts: DataFrame, generations: DataFrame) -> DataFrame:
    """status, evidence_count, n_timestamps of each selected generation (provider, generation).

    invalid: a timestamp without zone or date; missing: none; conflict: several; historical: one, of another refresh;
    resolved: one, of this. Facts: provider, verified_at. Nothing is put in a missing timestamp's place.
    """
    seen = facts.where("verified_at IS NOT NULL").groupBy("provider").agg(F.count("*").alias("n"), F.count_distinct("verified_at").alias("k"), F.min("verified_at").alias("one"), F.bool_or(~F.col("verified_at").rlike(STAMP)).alias("bad"))
    g = generations.join(seen, "provider", "left")
    status = F.when(F.col("bad"), "invalid").when(F.col("n").isNull(), "missing").when(F.col("k") > 1, "conflict").when(refresh_id(F.col("one")) != F.col("generation"), "historical").otherwise("resolved")
    return g.select("provider", "generation", status.alias("status"), F.coalesce("n", F.lit(0)).alias("evidence_count"), F.coalesce("k", F.lit(0)).alias("n_timestamps"))


def reproducibility(stored: DataFrame, rebuilt: DataFrame, generations: DataFrame, hashes: DataFrame) -> DataFrame:
    """One row per stored fact of the selected generations' providers: comparable, mismatching, or not_comparable with a reason.

    stored: provider, model_key, fact_name, status, value, verified_at, content_hash. rebuilt: model_key, fact_name,
    status, value as parsed from the archive again. hashes: provider, content_hash of the archive. A fact is compared
    only if it was stated in that very refresh and its bytes are there; an equal hash of another refresh is not enough.
    """
    known = hashes.distinct().withColumn("tied", F.lit(True))
    new = rebuilt.select("model_key", "fact_name", F.col("status").alias("new_status"), F.col("value").alias("new_value"))
    j = stored.join(generations, "provider").join(known, ["provider", "content_hash"], "left").join(new, ["model_key", "fact_name"], "left")
    reason = (
        F.when(F.col("status") == "not_verified", "not_verified")
        .when(F.col("status").isin("unknown", "not_applicable"), "unknown_global_fact")
        .when(F.col("verified_at").isNull(), "missing_generation_metadata")
        .when(~F.col("verified_at").rlike(STAMP), "ambiguous_generation_provenance")
        .when(refresh_id(F.col("verified_at")) != F.col("generation"), "retained_older_generation")
        .when(F.col("tied").isNull() | F.col("new_status").isNull(), "required_archive_evidence_absent")
    )
    same = semantic_key(F.col("status"), F.col("value")).eqNullSafe(semantic_key(F.col("new_status"), F.col("new_value")))
    return j.select("provider", "model_key", "fact_name", "generation", F.when(reason.isNotNull(), "not_comparable").when(same, "comparable").otherwise("mismatching").alias("status"), reason.alias("reason"))


def check_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("provider").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("comparable", "mismatching", "not_comparable")))


def verified_sources(archived: DataFrame) -> DataFrame:
    """provider, source_id, state of archived sources: their bytes are missing, differ in hash or in length, or are verified."""
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("body").cast("binary"), 256))
    return archived.select("provider", "source_id", F.when(F.col("body").isNull(), "blob_missing").when(digest != F.col("content_hash"), "hash_mismatch").when(F.octet_length("body") != F.col("n_bytes"), "length_mismatch").otherwise("verified").alias("state"))


def notice_providers(notices: DataFrame) -> DataFrame:
    """code and the provider whose refresh owns the notice (null: none); failures to write history belong to no refresh."""
    named = F.get(F.split("code", ":"), F.lit(1))
    source = F.nullif(F.regexp_extract("code", f"({'|'.join(PROVIDERS)})-docs-", 1), F.lit(""))
    return notices.select("code", F.when(F.startswith("code", F.lit("HISTORY_WRITE_FAILED")), None).when(F.col("code") == "PARTIAL_MODEL_PAGES", "openai").when(named.isin(*PROVIDERS), named).otherwise(source).alias("provider"))


def keep_absent(previous: DataFrame, incoming: DataFrame, provider: str, complete: bool) -> DataFrame:
    """incoming and the provider's models that it lacks, which a complete capture marks as not observed, never as retired."""
    gone = previous.where(F.col("provider") == provider).join(incoming.where(F.col("provider") == provider).select("model_key").distinct(), "model_key", "left_anti")
    return incoming.unionByName(gone.withColumn("disposition", F.lit("not_observed_in_current_capture")) if complete else gone)


def explanations(evaluated: DataFrame) -> DataFrame:
    """model_key, predicate, code, text of every failed predicate of catalog.evaluate()."""
    reason = F.col("reason")
    fixed = lambda k: F.create_map(*(F.lit(x) for r, own in REASONS.items() for x in (r, own[k])))[reason]
    unsure, against = reason.endswith("_not_verified"), reason.endswith("_mismatch")
    one = evaluated.select("model_key", F.explode("reasons").alias("reason"))
    return one.select(
        "model_key",
        F.coalesce(fixed(0), F.regexp_replace(reason, "_(not_verified|mismatch)$", "")).alias("predicate"),
        F.coalesce(fixed(1), F.when(unsure, "missing_verified_evidence").when(against, "verified_opposite").otherwise(reason)).alias("code"),
        F.coalesce(fixed(2), F.when(unsure, "requested fact is unknown or not verified").when(against, "verified fact does not satisfy the requested condition").otherwise(reason)).alias("text"),
    )


def filter_models(records: DataFrame, text: str = "", lifecycle: str = "all", provider: str = "all") -> DataFrame:
    """model_key, provider of the models that a search shows: text in a key, a known display name or a known alias,
    folded to lower case. lifecycle uncertain: not known; active: known and currently documented."""
    wide = pivot(records, ("lifecycle", "display_name", "aliases"))
    known = F.col("lifecycle.status") == "known"
    if lifecycle == "uncertain":
        wide = wide.where(~known)
    elif lifecycle != "all":
        ok = known & (F.col("lifecycle.value") == lifecycle)
        wide = wide.where(ok & (F.col("disposition") == "currently_documented") if lifecycle == "active" else ok)
    if provider != "all":
        wide = wide.where(F.col("provider") == provider)
    if needle := text.strip().lower():
        said = lambda n: F.when(F.col(f"{n}.status") == "known", F.col(f"{n}.value"))
        places = F.array(F.col("model_key"), said("display_name"))
        every = F.concat(places, F.coalesce(F.split(said("aliases"), ","), F.array().cast("array<string>")))
        wide = wide.where(F.exists(every, lambda x: F.coalesce(F.contains(F.lower(x), F.lit(needle)), F.lit(False))))
    return wide.select("model_key", "provider")


def history_events(before: DataFrame, after: DataFrame, observed_at: str) -> DataFrame:
    """Changes as rows for an append-only log: model_key, change, change_order, observed_at and the facts before and after.

    Facts are what lifecycle_diff() compares: = and the value, ! and the claims, or ? for what is not established.
    Added and removed models carry all four facts of their side; a change carries the fact that changed, and a change
    of lifecycle also the retirement date and replacement as they are now.
    """
    names = ("lifecycle", "deprecated_at", "retirement_at", "replacement")

    def side(df: DataFrame, n: str) -> DataFrame:
        wide = pivot(df, names)
        return wide.select("model_key", *(semantic_key(F.col(f"{x}.status"), F.col(f"{x}.value")).alias(f"{n}_{x}") for x in names), F.col("disposition").alias(f"{n}_disposition"))

    of = {"lifecycle": ["lifecycle_changed"], "deprecated_at": ["deprecation_date_changed"], "retirement_at": ["retirement_date_changed"], "replacement": ["replacement_changed"], "disposition": ["documentation_changed"]}

    def shown(n: str, x: str) -> Column:
        when = of[x] + (["added" if n == "current" else "removed"] if x != "disposition" else []) + (["lifecycle_changed"] if n == "current" and x in ("retirement_at", "replacement") else [])
        return F.when(F.col("change").isin(*when), F.col(f"{n}_{x}")).alias(f"{n}_{x}")

    j = lifecycle_diff(before, after).join(side(before, "previous"), "model_key", "left").join(side(after, "current"), "model_key", "left")
    return j.select("model_key", "change", "change_order", F.lit(observed_at).alias("observed_at"), *(shown(n, x) for x in (*names, "disposition") for n in ("previous", "current")))
