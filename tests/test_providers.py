import pytest

from lodestrata.plans.provider_queries import AT, SCHEMA, SOURCES
from lodestrata.sources.providers import content_hashes, contradictions, dispositions, kind_of, mentions, reduce_statements, statements


@pytest.fixture(scope="module")
def said(spark):
    rows = [(i, k, v, AT) for i, (k, v) in enumerate(SOURCES.items())] + [(90, "openai-docs-model-page:null", None, AT), (91, "elsewhere-docs-models-index", "[a](/models/a)", AT)]
    return statements(spark.createDataFrame(rows, SCHEMA))


def test_source_kinds():
    assert kind_of("google-docs-gemini-3") == ("google", "gemini_3") and kind_of("openai-docs-model-page:a") == ("openai", "model_page")
    assert [kind_of(x) for x in ("openai-docs-model-page", "openai-docs-serverless-models", "x-docs-changelog", "", None)] == [None] * 5


def test_facts_of_captured_sources(spark, said):
    got = {(r["model_id"], r["fact_name"]): (r["status"], r["value"] if r["status"] == "known" else [c["value"] for c in r["claims"]]) for r in reduce_statements(said).collect()}
    want = {
        ("alpha", "context_window"): ("conflict", ["1000", "2000"]), ("alpha", "lifecycle"): ("known", "active"), ("alpha", "api_access"): ("known", "true"), ("al", "resolves_to"): ("known", "alpha"),
        ("alpha", "input_modalities"): ("known", "text,image"), ("alpha", "max_output"): ("known", "10000"), ("alpha", "tool_calling"): ("known", "true"),
        ("beta", "lifecycle"): ("known", "retired"), ("beta", "replacement"): ("known", "alpha,alpha-mini"), ("beta", "aliases"): ("known", "beta-0101"), ("beta", "retirement_at"): ("known", "2026-06-01"),
        ("c-tiny-01", "context_window"): ("known", "1000000"), ("c-tiny", "resolves_to"): ("known", "c-tiny-01"), ("c-big", "lifecycle"): ("known", "active"), ("c-big", "input_modalities"): ("known", "text,image"),
        ("c-old", "replacement"): ("known", "c-big"), ("c-ancient", "lifecycle"): ("known", "retired"), ("c-ancient", "api_access"): ("known", "false"),
        ("g-one", "max_input"): ("known", "1000"), ("g-one", "input_modalities"): ("known", "text,image"), ("g-one", "structured_output"): ("known", "false"), ("g-one-000", "lifecycle"): ("known", "retired"), ("g-one-live", "lifecycle"): ("known", "active"),
        ("g-zero", "api_access"): ("known", "false"), ("g-half", "display_name"): ("known", "G Half"),
        ("fireworks/e-one", "lifecycle"): ("known", "active"), ("fireworks/e-two", "context_window"): ("known", "40000"), ("a/b", "replacement"): ("known", "c/d"),
        ("accounts/fireworks/models/x", "lifecycle"): ("known", "retired"), ("accounts/fireworks/models/x", "replacement"): ("known", "accounts/fireworks/models/y"),
        ("o/q", "input_modalities"): ("known", "text,image"), ("o/q", "context_window"): ("known", "128000"), ("o/w", "lifecycle"): ("known", "active"), ("o/v", "replacement"): ("known", "o/q"), ("o/v", "api_access"): ("known", "false"),
    }
    assert {k: got.get(k) for k in want} == want
    assert not {k for k in got if k[0] in ("no", "way", "/v1/old", "elsewhere") or k == ("accounts/fireworks/models/z", "lifecycle")}
    assert ("g-half", "lifecycle") not in got and ("fireworks/e-two", "lifecycle") not in got


def test_dispositions_hashes_and_contradictions(spark, said):
    assert {r["model_id"] for r in dispositions(said).where("disposition = 'historical_reference_only'").collect()} == {"accounts/fireworks/models/x", "accounts/fireworks/models/z"}
    assert contradictions(said).isEmpty()
    bad = "## Upcoming\n### 2026-12-11: x\n| Shutdown date | Model / system |\n|---|---|\n| 2026-06-11 | `m` |\n"
    one = spark.createDataFrame([(0, "openai-docs-deprecations", bad, AT)], SCHEMA)
    assert [r["model_id"] for r in contradictions(statements(one)).collect()] == ["m"]
    assert content_hashes(one).first()["content_hash"].startswith("sha256:")


def test_pages_and_changelog_dates():
    text = "## Model deprecations\n\nThe following models will be removed on July 1, 2026:\n\n* `o/a`. Recommended replacement: `o/b`, or else.\n\n**May 2, 2026**\n## Model deprecations\n\nThese are no longer available:\n* `o/c`\n## New models\n* `o/d`\n"
    assert [(m["model"], m["lifecycle"], m["retirement_at"], m["replacement"]) for m in mentions("together-docs-changelog", text)] == [("o/a", "deprecated", "2026-07-01", "o/b"), ("o/c", "retired", None, None)]
    page = "# P\nThe model ID is `o/p`. It has a 512K-token context window and up to 8K output tokens.\n```\nmodel ID is `o/x`\n```\n"
    assert list(mentions("together-docs-model-page:p", page)) == [{"model": "o/p", "api_access": "true", "context_window": 512000, "max_output": 8000}]
    guide = 'client(model="accounts/fireworks/models/t", x)\nclient(model="accounts/<ID>/deployments/<D>")\n'
    assert [m["model"] for m in mentions("fireworks-docs-tool-calling", guide)] == ["accounts/fireworks/models/t"]
    assert mentions("openai-docs-model-page:x", "<html>no</html>") == [] and mentions("google-docs-model-page:x", "") == []
