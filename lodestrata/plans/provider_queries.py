"""Queries over captured provider documentation, given here as short literal texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import providers

SCHEMA = "source_no long, source_id string, body string, retrieved_at string"
AT = "2026-07-01T00:00:00Z"
SOURCES = {
    "openai-docs-models-index": "# Models\n- [Alpha](/api/docs/models/alpha.md): one\n- [Beta](/api/docs/models/beta.md): two\n- [Policy](/api/docs/deprecations.md)\n",
    "openai-docs-deprecations": "# D\n## Upcoming deprecations\n### 2026-02-01: Beta\n| Shutdown date | Model / system | Recommended replacement |\n|---|---|---|\n| Jun 1, 2026 | `beta` \\| `beta-0101` | `alpha` or `alpha-mini` |\n| Jun 1, 2026 | `/v1/old` | `/v1/new` |\n## Past deprecations\n### 2020-01-01: Beta\n| Shutdown date | Model / system | Recommended replacement |\n|---|---|---|\n| 2020-06-01 | `beta` | `gamma` |\n",
    "openai-docs-model-page:alpha": "# Alpha\n\nModel ID: `alpha`\n\nThe `al` alias routes requests to `alpha`.\n## Model details\n- Input modalities: text, image\n- Output modalities: text\n- 1,000 context window\n- 10K max output tokens\n## Endpoints\n| Endpoint | Route | Support |\n|---|---|---|\n| Chat | `x` | Supported |\n| Speech | `y` | Not supported |\n## Supported features\n- function_calling\n## Quick comparison\n`no` is an alias for `way`.\n",
    "openai-docs-model-page:alpha2": "# Alpha\nModel ID: `alpha`\n## Model details\n- 2,000 context window\n",
    "anthropic-docs-models-index": "## Compare models\nAll current models support text and image input, text output, and tool use. More.\n| Feature | Claude Tiny 1 | Claude Big 1 |\n|---|---|---|\n| Claude API ID | `c-tiny-01` | `c-big` |\n| Claude API alias | `c-tiny` | `c-big` |\n| Context window | 1M tokens | 200K tokens |\n| Max output | 64K tokens | 8K tokens |\n",
    "anthropic-docs-deprecations": "## Model status\n| API model name | Current state | Deprecated | Tentative retirement date |\n|---|---|---|---|\n| c-big | Active | N/A | Not sooner than May 1, 2030 |\n| c-old | Retired | January 5, 2025 | June 5, 2025 |\n## Deprecation history\n### 2025-01-05: Old\n| Retirement date | Deprecated model | Recommended replacement |\n|---|---|---|\n| June 5, 2025 | `c-old` | `c-big` |\n### 2020-01-05: Older\n| Retirement date | Deprecated model | Recommended replacement |\n|---|---|---|\n| June 5, 2020 | `c-ancient` | `c-old` |\n",
    "google-docs-models-index": "## Now\n| Model | Endpoint |\n|---|---|\n| [G One](https://x/y) | `g-one` `g-one-live` |\n## Previous models\n| Model | Endpoint |\n|---|---|\n| G Zero (Shut down) | `g-zero` |\n| G Half | `g-half` |\n",
    "google-docs-model-page:g-one": "# G One\n| Property | Description |\n|---|---|\n| Model code | **API** `g-one` |\n| Supported data types | **Inputs** Text, images (up to 3 videos) **Output** Text |\n| Token limits^[\\[\\*\\]](https://x)^ | **Input token limit** 1,000 **Output token limit** 24 |\n| Capabilities | **[Function calling](https://x)** Supported **[Structured outputs](https://x)** Not supported |\n| Versions | - *Shut down* : `g-one-000` |\n",
    "fireworks-docs-embeddings": "> [tab] One\n>\n> | Model | Model ID | Context | Availability |\n> | - | - | - | - |\n> | E | `fireworks/e-one` | 40k | Serverless and dedicated |\n> | E2 | `fireworks/e-two` | 40k | Dedicated |\n\nRetired. `a/b` is no longer enabled here. Use `c/d` instead.\n",
    "fireworks-docs-changelog": "## News\n\n`accounts/fireworks/models/x` is deprecated and will be decommissioned on January 1, 2026.\n\nMigrate to `accounts/fireworks/models/y`.\n\nSome Name is deprecated.\n\n`accounts/fireworks/models/z` is no longer available for fine-tuning.\n",
    "together-docs-serverless-models": "## Chat models\n| Model name | API model string | Context length | Function calling |\n|---|---|---|---|\n| Q | `o/q` | 128K | Yes |\n| W | `o/w` | - | - |\n## Vision models\n| Model name | API model string |\n|---|---|\n| Q | `o/q` |\n",
    "together-docs-deprecations": "## Redirects\n| Original model | Redirects to |\n|---|---|\n| `o/v` | `o/q` |\n## Deprecation history\n### Inference\n| Removal date | Model |\n|---|---|\n| 2025-01-01 | `o/w` |\n| 2025-01-02 | `o/v` |\n",
}


def captured(spark):
    return spark.createDataFrame([(i, k, v, AT) for i, (k, v) in enumerate(SOURCES.items())], SCHEMA)


def _facts(spark, sf_dir: str):
    facts = providers.reduce_statements(providers.statements(captured(spark)))
    return facts.withColumn("claims", F.array_join(F.transform("claims", lambda c: F.concat_ws("@", c["value"], c["source_id"])), "|"))


#: Parsing Markdown is not in reach of SQL; tests compare these with facts written by hand.
QUERIES = {
    "provider_statements": lambda s, d: providers.statements(captured(s)),
    "provider_facts": _facts,
    "provider_dispositions": lambda s, d: providers.dispositions(providers.statements(captured(s))),
    "provider_source_hashes": lambda s, d: providers.content_hashes(captured(s)),
}
ORACLE_SQL = {
    "provider_source_hashes": "SELECT source_id, 'sha256:' || sha256(body) AS content_hash FROM (VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in SOURCES.items()) + ") v(source_id, body)",
}
