"""Fact algebra: statements of sources to facts in five states, and their audit.

statements: seq long, provider, model_id, fact_name, value (null: not stated), value_type, source_id, rank int, verified_at.
A fact is known, unknown, not_applicable, not_verified or conflict; states never collapse into nulls or booleans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("provider", "model_id", "fact_name")
# Ranks of source types by provider.
SOURCE_RANKS = {
    "openai": {"deprecations": 3, "model_page": 2, "index": 1},
    "anthropic": {"deprecations": 3, "model_page": 2, "index": 1},
    "google": {"deprecations": 3, "model_page": 2, "gemini_3": 2, "index": 1},
    "fireworks": {"changelog": 3, "embeddings": 2, "serving_paths": 2, "model_page": 2, "text": 1, "vision": 1, "tool": 1},
    "together": {"deprecations": 3, "serverless": 2, "model_page": 2, "changelog": 1},
}


def source_ranks(spark) -> DataFrame:
    return spark.createDataFrame([(p, t, r) for p, own in SOURCE_RANKS.items() for t, r in own.items()], "provider string, source_type string, rank int")


def merge_by_rank(statements: DataFrame) -> DataFrame:
    """One row per stated fact: status, value and first provenance if the winning rank agrees, else the claims in first-seen order.

    Only stated values of the highest rank count; equal values count once, by the smallest seq. Lower ranks that
    disagree are not kept. Equality of values is by their text.
    """
    stated = statements.where("value IS NOT NULL")
    top = stated.withColumn("top", F.max("rank").over(Window.partitionBy(*KEY))).where("rank = top")
    first = top.groupBy(*KEY, "value").agg(F.min_by(F.struct("source_id", "verified_at"), "seq").alias("p"), F.min("seq").alias("seq"))
    claims = first.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("seq", "value", "p.source_id", "p.verified_at"))).alias("claims"))
    one = F.size("claims") == 1
    pick = lambda f: F.when(one, F.get("claims", F.lit(0))[f])
    return claims.select(*KEY, F.when(one, "known").otherwise("conflict").alias("status"), pick("value").alias("value"), pick("source_id").alias("source_id"), pick("verified_at").alias("verified_at"), F.when(~one, F.col("claims")).alias("claims"))


def fact_grid(statements: DataFrame, fact_names: DataFrame, evaluated: DataFrame) -> DataFrame:
    """A row for every model and fact name: merged facts, else not_verified where the model's page was not evaluated for
    it, else unknown with the provenance of the model's highest-ranked, first-seen statement.

    fact_names: fact_name, needs (a source type that must be there to evaluate it; null: none). evaluated: provider,
    model_id, source_type.
    """
    models = statements.groupBy("provider", "model_id").agg(F.max_by(F.struct("source_id", "verified_at"), F.struct("rank", -F.col("seq"))).alias("fallback"))
    grid = models.join(F.broadcast(fact_names))
    seen = evaluated.select("provider", "model_id", F.col("source_type").alias("needs")).distinct().withColumn("seen", F.lit(True))
    merged = merge_by_rank(statements)
    out = grid.join(merged, list(KEY), "left").join(seen, ["provider", "model_id", "needs"], "left")
    open_ = F.col("needs").isNull() | F.coalesce("seen", F.lit(False))
    status = F.when(F.col("status").isNotNull(), F.col("status")).when(open_, "unknown").otherwise("not_verified")
    return out.select(*KEY, status.alias("status"), "value", F.when(F.col("status").isNotNull(), F.col("source_id")).when(open_, F.col("fallback.source_id")).alias("source_id"), "claims")


def current_events(events: DataFrame) -> DataFrame:
    """Deprecation events that decide a model's lifecycle. events: seq, model_id, listing (null, upcoming, current, past), announced, retires, replacements.

    Events alike in all but seq are one. Any without listing: all stay. Else upcoming and current ones beat past ones.
    Else the one past event with the latest announcement stays, if all have one, or with the latest retirement, if none
    is announced and all have one; where that is open or tied, all stay.
    """
    same = Window.partitionBy("model_id", "listing", "announced", "retires", "replacements").orderBy("seq")
    e = events.withColumn("_r", F.row_number().over(same)).where("_r = 1")
    w = Window.partitionBy("model_id")
    flag = lambda c: F.max(c.cast("int")).over(w)
    live = F.coalesce(F.col("listing").isin("upcoming", "current"), F.lit(False))
    every = F.count("*").over(w)
    by = F.when(F.count("announced").over(w) == every, F.col("announced")).when((F.count("announced").over(w) == 0) & (F.count("retires").over(w) == every), F.col("retires"))
    e = e.withColumns({"_live": live, "_any_open": flag(F.col("listing").isNull()), "_any_live": flag(live), "_by": by})
    e = e.withColumn("_top", F.max("_by").over(w)).withColumn("_ties", F.sum((F.col("_by") == F.col("_top")).cast("int")).over(w))
    latest = F.when(F.coalesce(F.col("_ties"), F.lit(0)) == 1, F.col("_by") == F.col("_top")).otherwise(True)
    keep = (F.col("_any_open") == 1) | F.when(F.col("_any_live") == 1, F.col("_live")).otherwise(latest)
    return e.where(keep).drop("_r", "_live", "_any_open", "_any_live", "_by", "_top", "_ties")


def lifecycle_value(stated: Column, retires: Column, verified_at: Column) -> Column:
    """A stated state, retired once the retirement date is not after the day of verification."""
    due = F.try_to_date(retires) <= F.try_to_date(F.substring(verified_at, 1, 10))
    return F.when(stated.isNotNull() & F.coalesce(due, F.lit(False)), "retired").otherwise(stated)


def with_aliases(stated: DataFrame, resolves: DataFrame) -> DataFrame:
    """model_id, aliases: those stated (array) and the models that resolve to it, distinct, stated ones first, others by seq."""
    back = resolves.groupBy(F.col("target").alias("model_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "alias"))), lambda x: x["alias"]).alias("_b"))
    none = F.array().cast("array<string>")
    return stated.join(back, "model_id", "full_outer").select("model_id", F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("_b", none))).alias("aliases"))


def classify_statements(statements: DataFrame) -> DataFrame:
    """The audit's findings of each group: kind, selected (the value of the highest rank, null: none), other (the value
    of the statement that a finding is about, null: of several), seq (of that statement) and n_values.

    incomparable: values of several types, which is then all. winning_rank_conflict: the highest rank states several
    values. Else the first statement of the highest rank is selected, and every other one is supporting, if its value
    is the same, or an override, if it is of a lower rank and differs. lower_rank_disagreement, besides: the lower
    ranks alone state several values.
    """
    w = Window.partitionBy(*KEY)
    s = statements.where("value IS NOT NULL").withColumn("top", F.max("rank").over(w))
    win = F.col("rank") == F.col("top")
    g = s.groupBy(*KEY).agg(F.count_distinct("value_type").alias("types"), F.count_distinct(F.when(win, F.col("value"))).alias("winners"), F.count_distinct(F.when(~win, F.col("value"))).alias("lower"), F.count_distinct("value_type", "value").alias("values"), F.min(F.when(win, F.struct("seq", "value"))).alias("first"))
    one = F.when(F.col("winners") == 1, F.col("first.value"))
    row = lambda when, kind, selected, n: F.when(when, F.struct(F.lit(kind).alias("kind"), selected.alias("selected"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("seq"), n.cast("long").alias("n_values")))
    none, apart = F.lit(None).cast("string"), F.col("types") > 1
    whole = F.array_compact(F.array(row(apart, "incomparable", none, F.col("values")), row(~apart & (F.col("winners") > 1), "winning_rank_conflict", none, F.col("winners")), row(~apart & (F.col("lower") > 1), "lower_rank_disagreement", one, F.col("lower"))))
    groups = g.select(*KEY, F.explode(whole).alias("f")).select(*KEY, "f.*")
    picked = g.where("types = 1 AND winners = 1").select(*KEY, "first")
    pair = s.join(picked, list(KEY)).where(F.col("seq") != F.col("first.seq"))
    kind = F.when(F.col("value") == F.col("first.value"), "supporting").when(~win, "override")
    pairs = pair.withColumn("kind", kind).where("kind IS NOT NULL").select(*KEY, "kind", F.col("first.value").alias("selected"), F.col("value").alias("other"), F.col("seq").cast("long").alias("seq"), F.lit(None).cast("long").alias("n_values"))
    return groups.union(pairs)


def invalid_facts(facts: DataFrame) -> DataFrame:
    """Rows that break a fact's invariants, with the rule. facts: status, value, source_id, claims (array of structs with value)."""
    n = F.coalesce(F.size("claims"), F.lit(0))
    kinds = F.size(F.array_distinct(F.transform("claims", lambda c: c["value"])))
    rule = (
        F.when(~F.col("status").isin("known", "unknown", "not_applicable", "not_verified", "conflict"), "status")
        .when((F.col("status") == "known") & (F.col("value").isNull() | F.col("source_id").isNull() | (n > 0)), "known")
        .when((F.col("status") != "known") & F.col("value").isNotNull(), "value_without_known")
        .when((F.col("status") == "conflict") & ((n < 2) | (kinds < 2) | F.col("source_id").isNotNull()), "conflict")
        .when((F.col("status") == "not_verified") & (F.col("source_id").isNotNull() | (n > 0)), "not_verified")
        .when(F.col("status").isin("unknown", "not_applicable") & (F.col("source_id").isNull() | (n > 0)), "provenance")
    )
    return facts.withColumn("rule", rule).where("rule IS NOT NULL")


def combined_context(facts: DataFrame) -> DataFrame:
    """Context windows derived for text models: provider, model_id, status, value, claims.

    facts: merged facts of one provider. Input and output limits add up where text is among the inputs and the only
    output. An explicit window that is equal wins; one that differs makes a conflict; without limits it stays as it is.
    """
    pick = lambda n: F.max(F.when((F.col("fact_name") == n) & (F.col("status") == "known"), F.col("value"))).alias(n)
    wide = facts.groupBy("provider", "model_id").agg(*map(pick, ("max_input", "max_output", "input_modalities", "output_modalities", "context_window")))
    text = F.array_contains(F.split("input_modalities", ","), "text") & (F.col("output_modalities") == "text")
    total = F.when(text, F.col("max_input").cast("long") + F.col("max_output").cast("long")).cast("string")
    explicit = F.col("context_window")
    differs = explicit.isNotNull() & total.isNotNull() & (explicit != total)
    value = F.when(~differs | differs.isNull(), F.coalesce(explicit, total))
    return wide.select("provider", "model_id", F.when(differs, "conflict").when(value.isNotNull(), "known").otherwise("unknown").alias("status"), value.alias("value"), F.when(differs, F.array(explicit, total)).alias("claims"))


def closed_access(facts: DataFrame) -> DataFrame:
    """Facts with api_access false, under the lifecycle's source, for models that are retired but state open access (google, fireworks, together)."""
    w = Window.partitionBy("provider", "model_id")
    life = F.max(F.when((F.col("fact_name") == "lifecycle") & (F.col("status") == "known") & (F.col("value") == "retired"), F.struct("source_id", "verified_at"))).over(w)
    f = facts.withColumn("_life", life)
    hit = F.col("provider").isin("google", "fireworks", "together") & F.col("_life").isNotNull() & (F.col("fact_name") == "api_access") & (F.col("status") == "known") & (F.col("value") == "true")
    hit = F.coalesce(hit, F.lit(False))
    return f.withColumns({"value": F.when(hit, "false").otherwise(F.col("value")), "source_id": F.when(hit, F.col("_life.source_id")).otherwise(F.col("source_id")), "verified_at": F.when(hit, F.col("_life.verified_at")).otherwise(F.col("verified_at"))}).drop("_life")
