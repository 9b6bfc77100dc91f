from lodestrata.operators import audit, catalog
from lodestrata.plans import catalog_queries as q


def test_history_events(spark):
    got = {(r["model_key"], r["change"]): r for r in audit.history_events(q.before(spark), q.after(spark), "2026-02-01").collect()}
    assert got["openai:m-one", "lifecycle_changed"]["previous_lifecycle"] == "=active" and got["openai:m-one", "lifecycle_changed"]["current_retirement_at"] == "=2026-06-01"
    assert got["openai:m-two", "documentation_changed"]["previous_disposition"] == "legacy_uncertified" and got["openai:m-two", "documentation_changed"]["current_lifecycle"] is None
    assert got["openai:m-new", "added"]["current_lifecycle"] == "=active" and got["openai:m-old", "removed"]["previous_lifecycle"] == "=retired"
    assert not [k for k in got if k[0].startswith("together") or k[0] == "google:g-one"]


def test_explanations_and_filters(spark):
    said = {(r["model_key"], r["predicate"]): r["code"] for r in audit.explanations(catalog.evaluate(q.before(spark), q.QUERY)).collect()}
    assert said["openai:m-old", "documentation"] == "excluded_documentation" and said["openai:m-two", "input_modalities"] == "verified_opposite"
    assert said["openai:m-two", "api_access"] == "missing_verified_evidence" and said["google:g-one", "context_window"] == "incompatible_context_kind"
    keys = lambda **k: {r["model_key"] for r in audit.filter_models(q.before(spark), **k).collect()}
    assert keys(lifecycle="active") == {"openai:m-one", "google:m-two"} and keys(lifecycle="retired") == {"openai:m-old"} and keys(text="nothing") == set()
