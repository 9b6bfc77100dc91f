"""Catalog queries over literal rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, catalog, facts

# seq, provider, model_id, fact_name, value, value_type, source_id, rank, verified_at
STATEMENTS = [
    (1, "openai", "m-one", "lifecycle", "active", "str", "oa-index", 1, "2026-01-02T00:00:00Z"),
    (2, "openai", "m-one", "lifecycle", "deprecated", "str", "oa-dep", 3, "2026-01-02T00:00:00Z"),
    (3, "openai", "m-one", "context_window", "128000", "int", "oa-page", 2, "2026-01-02T00:00:00Z"),
    (4, "openai", "m-one", "context_window", "200000", "int", "oa-page-b", 2, "2026-01-02T00:00:00Z"),
    (5, "openai", "m-one", "display_name", "One", "str", "oa-index", 1, "2026-01-02T00:00:00Z"),
    (6, "openai", "m-one", "display_name", "One", "str", "oa-page", 2, "2026-01-02T00:00:00Z"),
    (7, "openai", "m-two", "lifecycle", None, "str", "oa-index", 1, "2026-01-02T00:00:00Z"),
    (8, "openai", "m-two", "display_name", "Two", "str", "oa-index", 1, "2026-01-02T00:00:00Z"),
    (9, "google", "g-one", "max_output", "8192", "int", "g-page", 2, "2026-01-03T00:00:00Z"),
    (10, "google", "g-one", "max_output", "8192", "int", "g-guide", 2, "2026-01-03T00:00:00Z"),
    (11, "google", "g-one", "max_output", "4096", "int", "g-index", 1, "2026-01-03T00:00:00Z"),
    (12, "google", "g-one", "family", "a", "str", "g-page", 2, "2026-01-03T00:00:00Z"),
    (13, "google", "g-one", "family", "b", "str", "g-index", 1, "2026-01-03T00:00:00Z"),
    (14, "google", "g-one", "family", "c", "str", "g-index", 1, "2026-01-03T00:00:00Z"),
    (15, "google", "g-one", "api_access", "true", "bool", "g-page", 2, "2026-01-03T00:00:00Z"),
    (16, "google", "g-one", "api_access", "yes", "str", "g-index", 1, "2026-01-03T00:00:00Z"),
    (17, "together", "t/one", "lifecycle", "retired", "str", "t-dep", 3, "2026-01-04T00:00:00Z"),
]
_ST = "seq long, provider string, model_id string, fact_name string, value string, value_type string, source_id string, rank int, verified_at string"
# model_key, provider, disposition, fact_name, status, value, source_id, verified_at
BEFORE = [
    ("openai:m-one", "openai", "currently_documented", "lifecycle", "known", "active", "oa-index", "2026-01-01"),
    ("openai:m-one", "openai", "currently_documented", "context_window", "known", "combined:128000", "oa-page", "2026-01-01"),
    ("openai:m-one", "openai", "currently_documented", "api_access", "known", "true", "oa-page", "2026-01-01"),
    ("openai:m-one", "openai", "currently_documented", "input_modalities", "known", "text,image", "oa-page", "2026-01-01"),
    ("openai:m-two", "openai", None, "lifecycle", "unknown", None, "oa-index", "2026-01-01"),
    ("openai:m-two", "openai", None, "api_access", "not_verified", None, None, None),
    ("openai:m-two", "openai", None, "input_modalities", "known", "text", "oa-page", "2026-01-01"),
    ("openai:m-old", "openai", "historical_reference_only", "lifecycle", "known", "retired", "oa-dep", "2026-01-01"),
    ("google:g-one", "google", "currently_documented", "lifecycle", "conflict", "active|deprecated", None, None),
    ("google:g-one", "google", "currently_documented", "context_window", "known", "unknown:64000", "g-page", "2026-01-01"),
    ("google:m-two", "google", "currently_documented", "lifecycle", "known", "active", "g-model-page:m-two", "2026-01-01"),
    ("google:m-al", "google", "currently_documented", "resolves_to", "known", "google:g-one", "g-page", "2026-01-01"),
    ("google:m-al2", "google", "currently_documented", "resolves_to", "known", "google:m-al", "g-page", "2026-01-01"),
    ("google:m-al3", "google", "currently_documented", "resolves_to", "known", "google:gone", "g-page", "2026-01-01"),
]
AFTER = [
    ("openai:m-one", "openai", "currently_documented", "lifecycle", "known", "deprecated", "oa-dep", "2026-02-01"),
    ("openai:m-one", "openai", "currently_documented", "retirement_at", "known", "2026-06-01", "oa-dep", "2026-02-01"),
    ("openai:m-one", "openai", "currently_documented", "api_access", "known", "true", "oa-page", "2026-01-31"),
    ("openai:m-two", "openai", "currently_documented", "lifecycle", "not_verified", None, None, None),
    ("openai:m-new", "openai", "currently_documented", "lifecycle", "known", "active", "oa-index", "2026-02-01"),
    ("google:g-one", "google", "currently_documented", "lifecycle", "conflict", "deprecated|active", None, None),
    ("together:t-one", "together", "currently_documented", "lifecycle", "known", "active", "t-list", "2026-02-01"),
]
_RE = "model_key string, provider string, disposition string, fact_name string, status string, value string, source_id string, verified_at string"
NOTICES = [("google", "PARTIAL_MODEL_PAGES"), ("openai", "DOCUMENTED_SUBSET"), ("together", "HISTORY_WRITE_FAILED")]
REFERENCES = [("a.py", 3, "openai", "m-one"), ("a.py", 9, "openai", "m-zzz"), ("b.py", 1, None, "m-two"), ("b.py", 2, None, "g-one"), ("c.json", None, "mistral", "x"), ("c.json", 4, None, "nope"), ("d.toml", 1, "openai", ""), ("d.toml", 2, "openai", "m-old")]
MANIFESTS = [("openai", "g1", True, "h1"), ("openai", "g1", True, "h2"), ("openai", "g2", True, "h2"), ("openai", "g3", False, "h3"), ("openai", "g4", True, "h4"), ("google", "g1", True, "h5"), ("google", "g0", True, "h1")]
EVENTS = [(1, "a", "past", "2025-01-01", "2025-06-01", "x"), (2, "a", "past", "2025-03-01", "2025-09-01", "x"), (3, "b", "past", None, "2025-01-01", None), (4, "b", "upcoming", "2025-02-01", "2026-01-01", "x"), (5, "c", None, None, "2025-01-01", None), (6, "c", "past", "2025-01-01", None, None), (7, "d", "past", "2025-01-01", None, None), (8, "d", "past", None, "2025-02-01", None), (9, "e", "past", None, "2025-02-01", None), (10, "e", "past", None, "2025-03-01", None), (11, "e", "past", None, "2025-03-01", None), (12, "f", "upcoming", "2025-02-01", "2026-01-01", "x"), (13, "f", "upcoming", "2025-02-01", "2026-01-01", "y"), (14, "f", "past", "2025-03-01", None, "z"), (15, "g", "past", None, "2025-01-01", None), (16, "g", "past", None, "2025-06-01", None), (17, "g", "past", None, None, None), (18, "h", "past", "2025-04-01", "2025-06-01", "x"), (19, "h", "past", "2025-04-01", "2025-06-01", "y"), (20, "h", "past", "2025-01-01", "2025-06-01", "y")]


def _values(rows, names: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


def _names(schema: str) -> str:
    return ", ".join(x.split()[0] for x in schema.split(", "))


def statements(spark) -> DataFrame:
    return spark.createDataFrame(STATEMENTS, _ST)


def before(spark) -> DataFrame:
    return spark.createDataFrame(BEFORE, _RE)


def after(spark) -> DataFrame:
    return spark.createDataFrame(AFTER, _RE)


def merged(spark, sf_dir: str) -> DataFrame:
    out = facts.merge_by_rank(statements(spark))
    return out.withColumn("claims", F.array_join(F.transform("claims", lambda c: F.concat(c["value"], F.lit("@"), c["source_id"])), "|"))


QUERY = catalog.ModelQuery(lifecycle="active", api_access=True, input_modalities=("text", "image"), min_context=100_000, context_kind="combined")


def evaluated(spark, sf_dir: str) -> DataFrame:
    return catalog.evaluate(before(spark), QUERY).withColumn("reasons", F.array_join("reasons", ","))


def references(spark) -> DataFrame:
    return spark.createDataFrame(REFERENCES, "path string, line int, provider string, model_id string")


_S = f"WITH s AS (SELECT * FROM {_values(STATEMENTS, _names(_ST))} WHERE value IS NOT NULL)"
_B, _A = (f"{n} AS (SELECT * FROM {_values(r, _names(_RE))})" for n, r in (("b", BEFORE), ("a", AFTER)))
_KEYED = "CASE WHEN status = 'known' THEN '=' || value WHEN status = 'conflict' THEN '!' || array_to_string(list_sort(list_distinct(string_split(value, '|'))), '|') WHEN status = 'not_applicable' THEN 'n/a' ELSE '?' END"
_RESOLVED = f"""r AS (SELECT path, line::INT AS line, provider, model_id FROM {_values(REFERENCES, 'path, line, provider, model_id')}),
k AS (SELECT DISTINCT provider, model_key, substr(model_key, instr(model_key, ':') + 1) AS model_id FROM b),
u AS (SELECT model_id, count(*) AS n, min(model_key) AS only_key FROM k GROUP BY 1),
m AS (SELECT r.*, k.model_key AS exact_key, u.only_key, CASE WHEN r.model_id = '' THEN 'unresolved' WHEN r.provider IS NOT NULL THEN CASE WHEN k.model_key IS NOT NULL THEN 'exact' WHEN r.provider IN (SELECT provider FROM k) THEN 'not_in_catalog' ELSE 'provider_not_in_catalog' END
 WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'not_in_catalog' END AS match FROM r LEFT JOIN k ON r.provider = k.provider AND r.model_id = k.model_id LEFT JOIN u ON r.model_id = u.model_id),
res AS (SELECT path, line, provider, model_id, match, CASE match WHEN 'exact' THEN exact_key WHEN 'unique' THEN only_key END AS model_key FROM m)"""

# provider, model_key, fact_name, status, value, verified_at, content_hash
STORED = [
    ("openai", "openai:a", "lifecycle", "known", "active", "2026-01-02T00:00:00Z", "h1"),
    ("openai", "openai:a", "context_window", "known", "10", "2026-01-02T00:00:00Z", "h9"),
    ("openai", "openai:a", "family", "unknown", None, "2026-01-02T00:00:00Z", "h1"),
    ("openai", "openai:a", "api_access", "not_verified", None, None, None),
    ("openai", "openai:b", "lifecycle", "known", "retired", "2026-01-02T00:00:00Z", "h2"),
    ("openai", "openai:b", "replacement", "known", "a", "2025-12-01T00:00:00Z", "h2"),
    ("openai", "openai:b", "max_output", "known", "5", None, "h2"),
    ("openai", "openai:b", "max_input", "known", "5", "yesterday", "h2"),
    ("openai", "openai:gone", "lifecycle", "known", "active", "2026-01-02T00:00:00Z", "h1"),
    ("google", "google:g", "lifecycle", "known", "active", "2026-01-03T00:00:00+00:00", "h3"),
    ("together", "together:t", "lifecycle", "known", "active", "2025-01-01T00:00:00Z", "h5"),
]
_STO = "provider string, model_key string, fact_name string, status string, value string, verified_at string, content_hash string"
REBUILT = [("openai:a", "lifecycle", "known", "active"), ("openai:a", "context_window", "known", "10"), ("openai:b", "lifecycle", "known", "deprecated"), ("google:g", "lifecycle", "known", "active")]
GENERATIONS = [("openai", "2026-01-02T00-00-00Z"), ("google", "2026-01-03T00-00-00Z"), ("together", "2026-01-04T00-00-00Z"), ("fireworks", "2026-01-04T00-00-00Z")]
HASHES = [("openai", "h1"), ("openai", "h2"), ("google", "h3")]
CODES = ["PARTIAL_MODEL_PAGES", "PARTIAL_MODEL_PAGES:google", "HISTORY_WRITE_FAILED:openai", "fetch_failed together-docs-changelog", "OTHER:elsewhere", "OTHER"]
SOURCES_SEEN = [("openai", "oa-index", "body one", "sha256:" + "0" * 64, 8), ("openai", "oa-dep", None, "sha256:1", 3), ("google", "g-index", "text", "sha256:982d9e3eb996f559e633f4d194def3761d909f5a3b647d1a851fead67c32c9d1", 4), ("google", "g-page", "text", "sha256:982d9e3eb996f559e633f4d194def3761d909f5a3b647d1a851fead67c32c9d1", 5)]


def checked(spark, sf_dir: str) -> DataFrame:
    return audit.reproducibility(spark.createDataFrame(STORED, _STO), spark.createDataFrame(REBUILT, "model_key string, fact_name string, status string, value string"), spark.createDataFrame(GENERATIONS, "provider string, generation string"), spark.createDataFrame(HASHES, "provider string, content_hash string"))


_AUDIT = f"""WITH s AS (SELECT * FROM {_values(STORED, _names(_STO))}), n AS (SELECT * FROM {_values(REBUILT, 'model_key, fact_name, n_status, n_value')}), g AS (SELECT * FROM {_values(GENERATIONS, 'provider, generation')}), h AS (SELECT * FROM {_values(HASHES, 'provider, content_hash')}),
q AS (SELECT s.*, g.generation, n.n_status, n.n_value, replace(replace(verified_at, '+00:00', 'Z'), ':', '-') AS own, regexp_full_match(coalesce(verified_at, ''), '\\d{{4}}-\\d\\d-\\d\\dT.*(Z|[+-]\\d\\d:\\d\\d)') AS valid, (s.provider, s.content_hash) IN (SELECT (provider, content_hash) FROM h) AS tied FROM s JOIN g USING (provider) LEFT JOIN n USING (model_key, fact_name)),
r AS (SELECT *, CASE WHEN status = 'not_verified' THEN 'not_verified' WHEN status IN ('unknown', 'not_applicable') THEN 'unknown_global_fact' WHEN verified_at IS NULL THEN 'missing_generation_metadata' WHEN NOT valid THEN 'ambiguous_generation_provenance' WHEN own <> generation THEN 'retained_older_generation' WHEN NOT tied OR n_status IS NULL THEN 'required_archive_evidence_absent' END AS reason FROM q)
SELECT provider, model_key, fact_name, generation, CASE WHEN reason IS NOT NULL THEN 'not_comparable' WHEN n_status = status AND n_value = value THEN 'comparable' ELSE 'mismatching' END AS status, reason FROM r"""

QUERIES = {
    "audit_reproducibility": checked,
    "audit_check_summary": lambda s, d: audit.check_summary(checked(s, d)),
    "audit_provider_clocks": lambda s, d: audit.provider_clocks(s.createDataFrame(STORED, _STO), s.createDataFrame(GENERATIONS, "provider string, generation string")),
    "archive_verified_sources": lambda s, d: audit.verified_sources(s.createDataFrame(SOURCES_SEEN, "provider string, source_id string, body string, content_hash string, n_bytes long")),
    "notice_providers": lambda s, d: audit.notice_providers(s.createDataFrame([(c,) for c in CODES], "code string")),
    "catalog_absent_kept": lambda s, d: audit.keep_absent(before(s), after(s), "google", complete=True),
    "catalog_explanations": lambda s, d: audit.explanations(catalog.evaluate(before(s), QUERY)),
    "catalog_filtered": lambda s, d: audit.filter_models(before(s), text=" M-", lifecycle="uncertain", provider="openai"),
    "catalog_history_events": lambda s, d: audit.history_events(before(s), after(s), "2026-02-01"),
    "fact_merge_by_rank": merged,
    "fact_statement_kinds": lambda s, d: facts.classify_statements(statements(s)),
    "fact_current_events": lambda s, d: facts.current_events(s.createDataFrame(EVENTS, "seq long, model_id string, listing string, announced string, retires string, replacements string")),
    "catalog_query": evaluated,
    "catalog_query_reasons": lambda s, d: catalog.reason_counts(catalog.evaluate(before(s), QUERY)),
    "catalog_lifecycle_diff": lambda s, d: catalog.lifecycle_diff(before(s), after(s)),
    "catalog_merge_provider": lambda s, d: catalog.merge_provider(before(s), after(s), "openai"),
    "catalog_retained": lambda s, d: catalog.retained(before(s), after(s), ["g-page", "oa-dep"]),
    "catalog_export_coverage": lambda s, d: catalog.export_coverage(after(s), "2026-02-01", s.createDataFrame(NOTICES, "provider string, code string")),
    "catalog_dangling": lambda s, d: catalog.dangling(before(s)),
    "catalog_lifecycle_counts": lambda s, d: catalog.lifecycle_counts(before(s)),
    "catalog_context_audit": lambda s, d: catalog.context_audit(before(s)),
    "archive_expired_blobs": lambda s, d: catalog.expired_blobs(s.createDataFrame(MANIFESTS, "provider string, generation string, complete boolean, hash string"), 1),
    "audit_collapse_repeated": lambda s, d: catalog.collapse_repeated(s.createDataFrame([*NOTICES, NOTICES[0]], "provider string, message string"), ["provider"]),
    "app_resolve": lambda s, d: catalog.resolve(references(s), before(s)),
    "app_lifecycle_findings": lambda s, d: catalog.lifecycle_findings(catalog.resolve(references(s), before(s)), before(s)),
}
ORACLE_SQL = {
    "audit_reproducibility": _AUDIT,
    "audit_check_summary": f"SELECT provider, count(*) FILTER (status = 'comparable') AS comparable, count(*) FILTER (status = 'mismatching') AS mismatching, count(*) FILTER (status = 'not_comparable') AS not_comparable FROM ({_AUDIT}) GROUP BY 1",
    "audit_provider_clocks": f"""WITH s AS (SELECT * FROM {_values(STORED, _names(_STO))}), g AS (SELECT * FROM {_values(GENERATIONS, 'provider, generation')}),
e AS (SELECT g.provider, generation, count(verified_at) AS n, count(DISTINCT verified_at) AS k, min(verified_at) AS one, coalesce(bool_or(NOT regexp_full_match(verified_at, '\\d{{4}}-\\d\\d-\\d\\dT.*(Z|[+-]\\d\\d:\\d\\d)')), false) AS bad FROM g LEFT JOIN s ON s.provider = g.provider GROUP BY 1, 2)
SELECT provider, generation, CASE WHEN bad THEN 'invalid' WHEN n = 0 THEN 'missing' WHEN k > 1 THEN 'conflict' WHEN replace(replace(one, '+00:00', 'Z'), ':', '-') <> generation THEN 'historical' ELSE 'resolved' END AS status, n AS evidence_count, k AS n_timestamps FROM e""",
    "archive_verified_sources": f"SELECT provider, source_id, CASE WHEN body IS NULL THEN 'blob_missing' WHEN 'sha256:' || sha256(body) <> content_hash THEN 'hash_mismatch' WHEN strlen(body) <> n_bytes THEN 'length_mismatch' ELSE 'verified' END AS state FROM {_values(SOURCES_SEEN, 'provider, source_id, body, content_hash, n_bytes')}",
    "notice_providers": "SELECT code, CASE WHEN starts_with(code, 'HISTORY_WRITE_FAILED') THEN NULL WHEN code = 'PARTIAL_MODEL_PAGES' THEN 'openai' WHEN string_split(code, ':')[2] IN ('openai', 'anthropic', 'google', 'fireworks', 'together') THEN string_split(code, ':')[2] ELSE nullif(regexp_extract(code, '(openai|anthropic|google|fireworks|together)-docs-', 1), '') END AS provider FROM (VALUES " + ", ".join(f"('{c}')" for c in CODES) + ") v(code)",
    "catalog_absent_kept": f"WITH {_B}, {_A} SELECT * FROM a UNION ALL SELECT model_key, provider, 'not_observed_in_current_capture', fact_name, status, value, source_id, verified_at FROM b WHERE provider = 'google' AND model_key NOT IN (SELECT model_key FROM a WHERE provider = 'google')",
    "catalog_filtered": f"WITH {_B} SELECT DISTINCT model_key, provider FROM b WHERE provider = 'openai' AND contains(lower(model_key), 'm-') AND model_key NOT IN (SELECT model_key FROM b WHERE fact_name = 'lifecycle' AND status = 'known')",
    "fact_merge_by_rank": _S + """, w AS (SELECT *, max(rank) OVER (PARTITION BY provider, model_id, fact_name) AS top FROM s),
f AS (SELECT provider, model_id, fact_name, value, min(seq) AS seq, arg_min(source_id, seq) AS source_id, arg_min(verified_at, seq) AS verified_at FROM w WHERE rank = top GROUP BY 1, 2, 3, 4)
SELECT provider, model_id, fact_name, CASE WHEN count(*) = 1 THEN 'known' ELSE 'conflict' END AS status, CASE WHEN count(*) = 1 THEN min(value) END AS value, CASE WHEN count(*) = 1 THEN min(source_id) END AS source_id,
CASE WHEN count(*) = 1 THEN min(verified_at) END AS verified_at, CASE WHEN count(*) > 1 THEN string_agg(value || '@' || source_id, '|' ORDER BY seq) END AS claims FROM f GROUP BY 1, 2, 3""",
    "fact_statement_kinds": _S + """, w AS (SELECT *, max(rank) OVER k AS top FROM s WHERE value IS NOT NULL WINDOW k AS (PARTITION BY provider, model_id, fact_name)),
g AS (SELECT provider, model_id, fact_name, count(DISTINCT value_type) AS types, count(DISTINCT value) FILTER (rank = top) AS winners, count(DISTINCT value) FILTER (rank < top) AS lower, count(DISTINCT (value_type, value)) AS vals, min(seq) FILTER (rank = top) AS first FROM w GROUP BY ALL)
SELECT provider, model_id, fact_name, 'incomparable' AS kind, NULL::VARCHAR AS selected, NULL::VARCHAR AS other, NULL::BIGINT AS seq, vals::BIGINT AS n_values FROM g WHERE types > 1
UNION ALL SELECT provider, model_id, fact_name, 'winning_rank_conflict', NULL, NULL, NULL, winners FROM g WHERE types = 1 AND winners > 1
UNION ALL SELECT provider, model_id, fact_name, 'lower_rank_disagreement', (SELECT value FROM w WHERE w.seq = g.first AND winners = 1), NULL, NULL, lower FROM g WHERE types = 1 AND lower > 1
UNION ALL SELECT w.provider, w.model_id, w.fact_name, CASE WHEN w.value = f.value THEN 'supporting' ELSE 'override' END, f.value, w.value, w.seq, NULL FROM w JOIN g ON (w.provider, w.model_id, w.fact_name) = (g.provider, g.model_id, g.fact_name) JOIN w AS f ON f.seq = g.first WHERE types = 1 AND winners = 1 AND w.seq <> g.first""",
    "fact_current_events": f"""WITH e AS (SELECT min(seq) AS seq, model_id, listing, announced, retires, replacements FROM {_values(EVENTS, 'seq, model_id, listing, announced, retires, replacements')} GROUP BY ALL),
k AS (SELECT *, CASE WHEN bool_or(listing IS NULL) OVER w THEN 'all' WHEN bool_or(listing IN ('upcoming', 'current')) OVER w THEN 'live' WHEN bool_and(announced IS NOT NULL) OVER w THEN 'announced' WHEN bool_and(announced IS NULL AND retires IS NOT NULL) OVER w THEN 'retires' ELSE 'all' END AS rule FROM e WINDOW w AS (PARTITION BY model_id)),
d AS (SELECT *, CASE rule WHEN 'announced' THEN announced WHEN 'retires' THEN retires END AS day FROM k), m AS (SELECT *, max(day) OVER (PARTITION BY model_id) AS latest FROM d),
t AS (SELECT *, count(*) FILTER (day = latest) OVER (PARTITION BY model_id) AS ties FROM m)
SELECT seq::BIGINT AS seq, model_id, listing, announced, retires, replacements FROM t WHERE rule = 'all' OR rule = 'live' AND listing <> 'past' OR day IS NOT NULL AND (ties > 1 OR day = latest)""",
    "catalog_query": f"""WITH {_B}, p AS (SELECT model_key, provider, coalesce(disposition, 'legacy_uncertified') AS disposition, {', '.join(f"max(status) FILTER (fact_name = '{n}') AS {n}_s, max(value) FILTER (fact_name = '{n}' AND status = 'known') AS {n}_v" for n in ('lifecycle', 'api_access', 'input_modalities', 'context_window'))} FROM b GROUP BY 1, 2, 3),
r AS (SELECT *, CASE WHEN disposition NOT IN ('currently_documented', 'legacy_uncertified') THEN 'documentation_not_eligible' ELSE concat_ws(',', CASE WHEN lifecycle_v IS NULL THEN 'lifecycle_not_verified' WHEN lifecycle_v <> 'active' THEN 'lifecycle_mismatch' END,
CASE WHEN api_access_v IS NULL THEN 'api_access_not_verified' WHEN api_access_v <> 'true' THEN 'api_access_mismatch' END,
CASE WHEN input_modalities_v IS NULL THEN 'input_modalities_not_verified' WHEN NOT list_has_all(string_split(input_modalities_v, ','), ['text', 'image']) THEN 'input_modalities_mismatch' END,
CASE WHEN context_window_v IS NULL THEN 'missing_compatible_context_limit' WHEN string_split(context_window_v, ':')[1] <> 'combined' THEN 'context_window_kind_mismatch' WHEN string_split(context_window_v, ':')[2]::BIGINT < 100000 THEN 'context_window_below_minimum' END) END AS reasons FROM p)
SELECT model_key, provider, disposition, reasons = '' AS matched, reasons FROM r""",
    "catalog_lifecycle_diff": f"""WITH {_B}, {_A}, kb AS (SELECT DISTINCT model_key, provider FROM b), ka AS (SELECT DISTINCT model_key, provider FROM a), k AS (SELECT coalesce(kb.model_key, ka.model_key) AS model_key, coalesce(kb.provider, ka.provider) AS provider, kb.model_key AS ob, ka.model_key AS oa FROM kb FULL JOIN ka USING (model_key, provider)),
kk AS (SELECT * FROM k WHERE provider IN (SELECT provider FROM b)), names(fact_name, change, o) AS (VALUES ('documentation', 'documentation_changed', 2), ('lifecycle', 'lifecycle_changed', 3), ('deprecated_at', 'deprecation_date_changed', 4), ('retirement_at', 'retirement_date_changed', 5), ('replacement', 'replacement_changed', 6)),
fb AS (SELECT model_key, fact_name, {_KEYED} AS v FROM b UNION SELECT model_key, 'documentation', coalesce(disposition, 'legacy_uncertified') FROM b), fa AS (SELECT model_key, fact_name, {_KEYED} AS v FROM a UNION SELECT model_key, 'documentation', coalesce(disposition, 'legacy_uncertified') FROM a)
SELECT model_key, CASE WHEN ob IS NULL THEN 'added' ELSE 'removed' END AS change, CASE WHEN ob IS NULL THEN 0 ELSE 1 END::INT AS change_order, NULL::VARCHAR AS before_value, NULL::VARCHAR AS after_value FROM kk WHERE ob IS NULL OR oa IS NULL
UNION ALL SELECT kk.model_key, names.change, o::INT, coalesce(fb.v, '?'), coalesce(fa.v, '?') FROM kk, names LEFT JOIN fb ON fb.model_key = kk.model_key AND fb.fact_name = names.fact_name LEFT JOIN fa ON fa.model_key = kk.model_key AND fa.fact_name = names.fact_name
WHERE ob IS NOT NULL AND oa IS NOT NULL AND coalesce(fb.v, '?') <> coalesce(fa.v, '?')""",
    "catalog_merge_provider": f"WITH {_B}, {_A} SELECT * FROM b WHERE provider <> 'openai' UNION ALL SELECT * FROM a WHERE provider = 'openai'",
    "catalog_export_coverage": f"""WITH {_A}, n AS (SELECT * FROM {_values(NOTICES, 'provider, code')}), p AS (SELECT * FROM {_values([(x, i) for i, x in enumerate(catalog.PROVIDERS)], 'provider, position')}),
h AS (SELECT provider, count(DISTINCT model_key) AS n_models, bool_or(source_id IS NOT NULL AND verified_at IS DISTINCT FROM '2026-02-01') AS stale FROM a GROUP BY 1), t AS (SELECT provider, bool_or(starts_with(code, 'PARTIAL')) AS partial, bool_or(starts_with(code, 'HISTORY_WRITE_FAILED')) AS history FROM n GROUP BY 1),
j AS (SELECT provider, position::INT AS position, coalesce(n_models, 0)::BIGINT AS n_models, concat_ws(',', CASE WHEN n_models IS NULL THEN 'provider_missing' END, CASE WHEN stale THEN 'facts_not_from_this_snapshot' END, CASE WHEN partial THEN 'optional_source_failed' END, CASE WHEN history THEN 'history_write_failed' END) AS reasons FROM p LEFT JOIN h USING (provider) LEFT JOIN t USING (provider))
SELECT *, reasons = '' AS complete FROM j""",
    "catalog_dangling": f"WITH {_B}, e AS (SELECT model_key, value AS target FROM b WHERE fact_name = 'resolves_to') SELECT model_key, target, CASE WHEN target NOT IN (SELECT model_key FROM b) THEN 'target_missing' ELSE 'alias_of_alias' END AS problem FROM e WHERE target NOT IN (SELECT model_key FROM b) OR target IN (SELECT model_key FROM e)",
    "catalog_lifecycle_counts": f"WITH {_B}, p AS (SELECT model_key, coalesce(disposition, 'legacy_uncertified') AS disposition, max(status) FILTER (fact_name = 'lifecycle') AS st, max(value) FILTER (fact_name = 'lifecycle') AS v FROM b GROUP BY 1, 2) SELECT CASE WHEN coalesce(st, '') <> 'known' OR (v = 'active' AND disposition <> 'currently_documented') THEN 'uncertain' ELSE v END AS shown, count(*) AS n FROM p GROUP BY 1",
    "catalog_context_audit": f"WITH {_B}, p AS (SELECT model_key, provider, max(status) FILTER (fact_name = 'context_window') AS st, max(value) FILTER (fact_name = 'context_window') AS v FROM b GROUP BY 1, 2) SELECT provider, count(*) FILTER (st = 'known' AND v NOT LIKE 'unknown:%') AS kind_stated, count(*) FILTER (st = 'known' AND v LIKE 'unknown:%') AS kind_unknown, count(*) FILTER (st = 'conflict') AS conflict, count(*) FILTER (coalesce(st, '') NOT IN ('known', 'conflict')) AS not_known FROM p GROUP BY 1",
    "archive_expired_blobs": f"WITH m AS (SELECT * FROM {_values([(p, g, int(c), h) for p, g, c, h in MANIFESTS], 'provider, generation, complete, hash')}), k AS (SELECT provider, max(generation) AS generation FROM m WHERE complete = 1 GROUP BY 1) SELECT DISTINCT hash FROM m WHERE hash NOT IN (SELECT hash FROM m JOIN k USING (provider, generation))",
    "audit_collapse_repeated": f"SELECT provider, CASE WHEN count(*) > 1 THEN message || ' Repeated ' || count(*) || ' times.' ELSE message END AS message FROM {_values([*NOTICES, NOTICES[0]], 'provider, message')} GROUP BY provider, v.message",
    "app_resolve": f"WITH {_B}, {_RESOLVED} SELECT * FROM res",
    "app_lifecycle_findings": f"""WITH {_B}, {_RESOLVED}, c AS (SELECT res.*, CASE WHEN match = 'exact' AND status = 'known' AND value IN ('deprecated', 'retired') THEN 'MODEL_' || upper(value) WHEN match = 'not_in_catalog' THEN 'MODEL_UNKNOWN' WHEN match = 'ambiguous' THEN 'MODEL_AMBIGUOUS' END AS code
FROM res LEFT JOIN (SELECT * FROM b WHERE fact_name = 'lifecycle') l ON l.model_key = res.model_key) SELECT path, line, model_id, code, CASE code WHEN 'MODEL_RETIRED' THEN 'high' WHEN 'MODEL_DEPRECATED' THEN 'medium' ELSE 'info' END AS severity FROM c WHERE code IS NOT NULL""",
}
