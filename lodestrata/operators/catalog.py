"""Queries, comparison, lifecycle diff, merge, retention and export of a catalog of models.

records_long: model_key, provider, disposition (null: legacy), fact_name, status, value, source_id, verified_at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Providers in the order of an export, lifecycle facts in the order of a diff.
PROVIDERS = ("openai", "anthropic", "google", "fireworks", "together")
# Changes of a model that is in both catalogs, in order, by the fact that differs.
CHANGES = {"documentation": "documentation_changed", "lifecycle": "lifecycle_changed", "deprecated_at": "deprecation_date_changed", "retirement_at": "retirement_date_changed", "replacement": "replacement_changed"}


@dataclass(frozen=True)
class ModelQuery:
    """What a record must state; None or empty asks nothing."""

    providers: tuple[str, ...] = ()
    lifecycle: str | None = None
    api_access: bool | None = None
    tool_calling: bool | None = None
    structured_output: bool | None = None
    input_modalities: tuple[str, ...] = ()
    output_modalities: tuple[str, ...] = ()
    min_context: int | None = None
    context_kind: str | None = None
    documented_only: bool = True
    dispositions: tuple[str, ...] = field(default=("currently_documented", "legacy_uncertified"))

    def __post_init__(self):
        if (self.min_context is None) != (self.context_kind is None):
            raise ValueError("a smallest context needs a kind, and a kind a smallest context")
        if self.min_context is not None and self.min_context <= 0:
            raise ValueError("the smallest context must be positive")


def pivot(records: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row per model, a struct (status, value) for each fact name; facts without a row are not_verified."""
    one = lambda n: F.coalesce(F.max(F.when(F.col("fact_name") == n, F.struct("status", "value"))), F.struct(F.lit("not_verified").alias("status"), F.lit(None).cast("string").alias("value"))).alias(n)
    return records.groupBy("model_key", "provider", F.coalesce("disposition", F.lit("legacy_uncertified")).alias("disposition")).agg(*map(one, names))


FACTS = ("lifecycle", "api_access", "tool_calling", "structured_output", "input_modalities", "output_modalities", "context_window")


def _known(name: str) -> Column:
    return F.col(f"{name}.status") == "known"


def evaluate(records: DataFrame, q: ModelQuery) -> DataFrame:
    """model_key, provider, disposition, matched, reasons (all failed predicates, in fixed order).

    A record that is not documented fails with that reason alone. A fact that is not known never satisfies a predicate,
    nor its negation: its reason says so.
    """
    wide = pivot(records, FACTS)
    tests: list[Column] = []
    if q.providers:
        tests.append(F.when(~F.col("provider").isin(*q.providers), "provider_mismatch"))
    if q.lifecycle is not None:
        tests.append(F.when(~_known("lifecycle"), "lifecycle_not_verified").when(F.col("lifecycle.value") != q.lifecycle, "lifecycle_mismatch"))
    for name in ("api_access", "tool_calling", "structured_output"):
        if (want := getattr(q, name)) is not None:
            tests.append(F.when(~_known(name), f"{name}_not_verified").when(F.col(f"{name}.value") != str(want).lower(), f"{name}_mismatch"))
    for name in ("input_modalities", "output_modalities"):
        if want := getattr(q, name):
            lacks = F.size(F.array_except(F.array(*map(F.lit, want)), F.split(F.col(f"{name}.value"), ","))) > 0
            tests.append(F.when(~_known(name), f"{name}_not_verified").when(lacks, f"{name}_mismatch"))
    if q.min_context is not None:
        parts = F.split(F.col("context_window.value"), ":")
        tests.append(F.when(~_known("context_window"), "missing_compatible_context_limit").when(F.get(parts, F.lit(0)) != q.context_kind, "context_window_kind_mismatch").when(F.get(parts, F.lit(1)).cast("long") < q.min_context, "context_window_below_minimum"))
    none = F.array().cast("array<string>")
    failed = F.array_compact(F.array(*tests)) if tests else none
    gate = ~F.col("disposition").isin(*q.dispositions) if q.documented_only else F.lit(False)
    out = wide.withColumn("reasons", F.when(gate, F.array(F.lit("documentation_not_eligible"))).otherwise(failed))
    return out.select("model_key", "provider", "disposition", (F.size("reasons") == 0).alias("matched"), "reasons")


def reason_counts(evaluated: DataFrame) -> DataFrame:
    return evaluated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def comparable(records: DataFrame, keys: list[str]) -> DataFrame:
    """fact_name, comparable: whether all of two or three models know the fact; contexts must be of one kind that is known."""
    if len(set(keys)) != len(keys) or not 2 <= len(keys) <= 3:
        raise ValueError("two or three different models are compared")
    own = records.where(F.col("model_key").isin(*keys))
    g = own.groupBy("fact_name").agg(F.count_if(F.col("status") == "known").alias("n"), F.collect_set(F.when(F.col("fact_name") == "context_window", F.substring_index("value", ":", 1))).alias("kinds"))
    ok = (F.col("n") == len(keys)) & ((F.col("fact_name") != "context_window") | ((F.size("kinds") == 1) & ~F.array_contains("kinds", "unknown")))
    return g.select("fact_name", ok.alias("comparable"))


def semantic_key(status: Column, value: Column) -> Column:
    """What a diff compares: unknown and not_verified are alike, conflicts are sets of values (claims joined by |)."""
    return F.when(status == "known", F.concat(F.lit("="), value)).when(status == "conflict", F.concat(F.lit("!"), F.array_join(F.sort_array(F.array_distinct(F.split(value, r"\|"))), "|"))).when(status == "not_applicable", "n/a").otherwise("?")


def lifecycle_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """model_key, change, before_value, after_value: models added and removed, and changes of disposition and lifecycle facts.

    Providers that had no rows before give none. Changes of one model come in fixed order, in column change_order.
    """
    old_providers = before.select("provider").distinct()
    keys = before.select("model_key", "provider").distinct().withColumn("a", F.lit(1)).join(after.select("model_key", "provider").distinct().withColumn("b", F.lit(1)), ["model_key", "provider"], "full_outer").join(old_providers, "provider", "left_semi")
    ends = keys.where("a IS NULL OR b IS NULL").select("model_key", F.when(F.col("a").isNull(), "added").otherwise("removed").alias("change"), F.when(F.col("a").isNull(), 0).otherwise(1).alias("change_order"), F.lit(None).cast("string").alias("before_value"), F.lit(None).cast("string").alias("after_value"))
    table = lambda k: F.create_map(*(F.lit(x) for i, (f, name) in enumerate(CHANGES.items()) for x in (f, (name, i + 2)[k])))[F.col("fact_name")]

    def pick(df: DataFrame, n: str) -> DataFrame:
        own = df.where(F.col("fact_name").isin(*CHANGES)).select("model_key", "fact_name", semantic_key(F.col("status"), F.col("value")).alias(n))
        return own.union(df.select("model_key", F.lit("documentation"), F.coalesce("disposition", F.lit("legacy_uncertified"))).distinct())

    both = keys.where("a IS NOT NULL AND b IS NOT NULL").select("model_key")
    facts = pick(before, "before_value").join(pick(after, "after_value"), ["model_key", "fact_name"], "full_outer").fillna("?", ["before_value", "after_value"]).where("before_value <> after_value").join(both, "model_key", "left_semi")
    return ends.unionByName(facts.select("model_key", table(0).alias("change"), table(1).alias("change_order"), "before_value", "after_value"))


def merge_provider(previous: DataFrame, incoming: DataFrame, provider: str) -> DataFrame:
    """The catalog with one provider's rows replaced."""
    return previous.where(~F.col("provider").eqNullSafe(F.lit(provider))).unionByName(incoming.where(F.col("provider") == provider))


def retained(previous: DataFrame, incoming: DataFrame, failed_sources: list[str]) -> DataFrame:
    """Models missing from incoming whose every source failed in this refresh; they stay as they were."""
    gone = previous.join(incoming.select("model_key").distinct(), "model_key", "left_anti")
    failed = F.array(*map(F.lit, failed_sources)) if failed_sources else F.array().cast("array<string>")
    sources = gone.where("source_id IS NOT NULL").groupBy("model_key").agg(F.collect_set("source_id").alias("s"))
    # pages are optional: a model is present through its other sources, if it has any
    core = F.filter("s", lambda x: ~x.contains("model-page:"))
    presence = F.when(F.size(core) > 0, core).otherwise(F.col("s"))
    return previous.join(sources.where((F.size(F.array_except(presence, failed)) == 0)).select("model_key"), "model_key", "left_semi")


def export_coverage(records: DataFrame, generated_at: str, notices: DataFrame) -> DataFrame:
    """provider, position, n_models, reasons, complete for the supported providers and any others.

    notices: provider, code. Reasons: provider_missing, facts_not_from_this_snapshot (a provenanced fact whose
    verified_at text differs, or is null), optional_source_failed, history_write_failed.
    """
    spark = records.sparkSession
    own = spark.createDataFrame([(p, i) for i, p in enumerate(PROVIDERS)], "provider string, position int")
    other = records.select("provider").distinct().join(own, "provider", "left_anti").withColumn("position", F.lit(len(PROVIDERS)))
    stale = F.max((F.col("source_id").isNotNull() & ~F.col("verified_at").eqNullSafe(F.lit(generated_at))).cast("int"))
    have = records.groupBy("provider").agg(F.count_distinct("model_key").alias("n_models"), stale.alias("stale"))
    told = notices.groupBy("provider").agg(F.max(F.col("code").startswith("PARTIAL").cast("int")).alias("partial"), F.max(F.col("code").startswith("HISTORY_WRITE_FAILED").cast("int")).alias("history"))
    j = own.unionByName(other).join(have, "provider", "left").join(told, "provider", "left")
    reasons = F.array_compact(F.array(F.when(F.col("n_models").isNull(), "provider_missing"), F.when(F.col("stale") == 1, "facts_not_from_this_snapshot"), F.when(F.col("partial") == 1, "optional_source_failed"), F.when(F.col("history") == 1, "history_write_failed")))
    return j.select("provider", "position", F.coalesce("n_models", F.lit(0)).cast("long").alias("n_models"), F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("complete"))


def dangling(records: DataFrame) -> DataFrame:
    """Aliases whose target is not a model, or is itself an alias: model_key, target, problem."""
    edges = records.where("fact_name = 'resolves_to' AND status = 'known'").select("model_key", F.col("value").alias("target"))
    keys = records.select(F.col("model_key").alias("target")).distinct().withColumn("is_model", F.lit(True))
    aliases = edges.select(F.col("model_key").alias("target")).withColumn("is_alias", F.lit(True))
    j = edges.join(keys, "target", "left").join(aliases, "target", "left")
    return j.withColumn("problem", F.when(F.col("is_model").isNull(), "target_missing").when(F.col("is_alias"), "alias_of_alias")).where("problem IS NOT NULL").select("model_key", "target", "problem")


def token_label(n: Column) -> Column:
    """1M, 128K or the digits."""
    return F.when((n >= 1_000_000) & (n % 1_000_000 == 0), F.concat((n / 1_000_000).cast("long").cast("string"), F.lit("M"))).when((n >= 1000) & (n % 1000 == 0), F.concat((n / 1000).cast("long").cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def resolve(references: DataFrame, records: DataFrame) -> DataFrame:
    """references (path, line, provider or null, model_id) with match and the catalog's key: exact, not_in_catalog,
    provider_not_in_catalog, unique or ambiguous (no provider: by model id alone). An empty id stays unresolved."""
    keys = records.select("provider", "model_key", F.substring("model_key", 1, 0).alias("_x"), F.expr("substr(model_key, locate(':', model_key) + 1)").alias("model_id")).drop("_x").distinct()
    known = keys.select("provider").distinct().withColumn("has_provider", F.lit(True))
    named = references.join(keys.withColumnRenamed("model_key", "exact_key"), ["provider", "model_id"], "left").join(known, "provider", "left")
    by_id = keys.groupBy("model_id").agg(F.count("*").alias("n"), F.min("model_key").alias("only_key"))
    j = named.join(by_id, "model_id", "left")
    match = (
        F.when(F.col("model_id") == "", "unresolved")
        .when(F.col("provider").isNotNull(), F.when(F.col("exact_key").isNotNull(), "exact").when(F.col("has_provider"), "not_in_catalog").otherwise("provider_not_in_catalog"))
        .when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("not_in_catalog")
    )
    j = j.withColumn("match", match)
    return j.select("path", "line", "provider", "model_id", "match", F.when(F.col("match") == "exact", F.col("exact_key")).when(F.col("match") == "unique", F.col("only_key")).alias("model_key"))


def lifecycle_findings(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """path, line, model_key, severity of references whose model is deprecated, retired or unknown, or ambiguous.

    Only an exact match speaks about lifecycle: uniqueness in the catalog does not establish a provider.
    """
    life = records.where("fact_name = 'lifecycle'").select("model_key", "status", "value")
    j = resolved.join(life, "model_key", "left")
    exact = F.col("match") == "exact"
    code = F.when(exact & (F.col("status") == "known") & F.col("value").isin("deprecated", "retired"), F.concat(F.lit("MODEL_"), F.upper("value"))).when(F.col("match") == "not_in_catalog", "MODEL_UNKNOWN").when(F.col("match") == "ambiguous", "MODEL_AMBIGUOUS")
    severity = F.when(F.col("code") == "MODEL_RETIRED", "high").when(F.col("code") == "MODEL_DEPRECATED", "medium").otherwise("info")
    return j.withColumn("code", code).where("code IS NOT NULL").select("path", "line", "model_id", "code", severity.alias("severity"))


def shown_lifecycle(records: DataFrame) -> DataFrame:
    """model_key, provider, shown: the known lifecycle, but uncertain where it is not known or an active model is not currently documented."""
    wide = pivot(records, ("lifecycle",))
    active_elsewhere = (F.col("lifecycle.value") == "active") & (F.col("disposition") != "currently_documented")
    return wide.select("model_key", "provider", F.when(~_known("lifecycle") | active_elsewhere, "uncertain").otherwise(F.col("lifecycle.value")).alias("shown"))


def lifecycle_counts(records: DataFrame) -> DataFrame:
    return shown_lifecycle(records).groupBy("shown").agg(F.count("*").alias("n"))


def context_audit(records: DataFrame) -> DataFrame:
    """provider, models with a known context window of a stated kind, of unknown kind, in conflict, and not known."""
    wide = pivot(records, ("context_window",))
    kind = F.substring_index("context_window.value", ":", 1)
    state = F.when(F.col("context_window.status") == "conflict", "conflict").when(~_known("context_window"), "not_known").when(kind == "unknown", "kind_unknown").otherwise("kind_stated")
    own = wide.select("provider", state.alias("state"))
    return own.groupBy("provider").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("kind_stated", "kind_unknown", "conflict", "not_known")))


def expired_blobs(manifests: DataFrame, keep: int) -> DataFrame:
    """hash of contents that only expired generations refer to. manifests: provider, generation (sortable), complete, hash.

    Of each provider the last `keep` complete generations stay; generations that are not complete expire.
    """
    from pyspark.sql import Window

    whole = manifests.where("complete").select("provider", "generation").distinct()
    kept = whole.withColumn("r", F.row_number().over(Window.partitionBy("provider").orderBy(F.desc("generation")))).where(F.col("r") <= keep)
    held = manifests.join(kept.select("provider", "generation"), ["provider", "generation"], "left_semi").select("hash").distinct()
    return manifests.select("hash").distinct().join(held, "hash", "left_anti")


def collapse_repeated(found: DataFrame, keys: list[str], message: str = "message") -> DataFrame:
    """Equal findings as one, whose message says how often it came."""
    g = found.groupBy(*keys, message).agg(F.count("*").alias("n"))
    return g.withColumn(message, F.when(F.col("n") > 1, F.concat(F.col(message), F.lit(" Repeated "), F.col("n").cast("string"), F.lit(" times."))).otherwise(F.col(message))).drop("n")
