import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import markdown
from lodestrata.functions.text import WS_CHARS, doc_stats
from lodestrata.operators import appscan, compare, corpus, facts
from lodestrata.operators.catalog import ModelQuery
from lodestrata.operators.config import AnalysisConfig
from lodestrata.sources import files, runs
from lodestrata.sources.html import extract
from lodestrata.streaming.flags import flag_stream

TEXTS = ["", " \n\t ", None, "é　ü\n\nab | cd\n", "x" * 6000, "a  b  c  d\n" * 70, "#$%\r\n#$%", "﻿one\n" * 9, "\x1c\x85 q"]


def test_text_stats_equal_plain_python(spark):
    got = {r["i"]: r for r in doc_stats(spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")).collect()}
    for i, t in enumerate(TEXTS):
        t = t or ""
        nws = [c for c in t if c not in WS_CHARS]
        lines = [x for x in (y.strip() for y in t.split("\n")) if x]
        r = got[i]
        assert r["total_chars"] == len(t) and r["meaningful_length"] == len(t.strip()) and r["non_ws_chars"] == len(nws)
        assert r["symbol_chars"] == sum(not c.isalnum() for c in nws) and r["line_count"] == len(lines)
        assert r["max_repeated_line_count"] == max(Counter(lines).values(), default=0)
        assert r["max_paragraph_length"] == max(len(p.strip()) for p in t.split("\n\n"))
        assert r["table_like_line_count"] == sum(" | " in x or ("  " in x and len(x.split()) >= 4) for x in lines)


def test_folder_analysis_and_runs(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("same text here\n" * 20)
    (root / "sub/b.md").write_text("same text here\n" * 20)
    (root / "c.txt").write_bytes(b"caf\xe9\r\nx")
    (root / "d.html").write_text("<html><head><title>T</title></head><body><nav>n</nav><p>one <b>two</p><ul><li>x</li></ul></body></html>")
    (root / "e.pdf").write_bytes(b"broken")
    (root / "f.bin").write_bytes(b"?")
    parts = files.analyze(spark, str(root))
    found = {r["code"]: r for r in parts["findings"].collect()}
    assert found["EXACT_DUPLICATES"]["count"] == 2 and found["LOAD_ERRORS"]["count"] == 1 and found["UNSUPPORTED_FILES"]["count"] == 1
    assert found["REPEATED_LINE_CONTENT"]["count"] == 2 and "Findings" in files.text_report(parts)
    store = str(tmp_path / "store")
    one = runs.save_run(spark, store, parts["findings"], parts["inventory"], str(root))
    two = runs.save_run(spark, store, parts["findings"], parts["inventory"], str(root))
    assert [r["run_id"] for r in runs.list_runs(spark, store).collect()] == [two, one]
    diff = compare.finding_diff(runs.load_findings(spark, store, one), runs.load_findings(spark, store, two))
    assert {r["status"] for r in diff.collect()} == {"unchanged"}
    with pytest.raises(NotADirectoryError):
        files.discover(spark, str(root / "missing"))


def test_html():
    title, text, content, boiler, code = extract("<title>A</title><body><header><nav>x y</nav></header><!-- c --><div>one<a>two</a></div><pre><code>k</code></pre><table><tr><td>1<td></tr></table>")
    assert title == "A" and text.startswith("A\n\nc\none\ntwo\nk") and boiler == len("x y\nx y") and code == 2 and content


def test_markdown():
    body = "# A\n| h | k |\n|---|:-:|\n| a \\| b | `c` |\n## B\nContext: 200K tokens\n"
    assert [s[:2] for s in markdown.sections(body)] == [(1, "A"), (2, "B")]
    assert markdown.tables(body) == [[{"h": "a \\| b", "k": "`c`"}]]
    assert markdown.tokens("1,050,000") == 1050000 and markdown.tokens("1M") == 1000000 and markdown.tokens("none") is None
    assert markdown.iso_date("Dec 11th, 2026") == "2026-12-11" and markdown.iso_date("not sooner than 2026-01-01") is None
    assert markdown.tristate("Yes") is True and markdown.tristate("Not supported") is False and markdown.tristate("?") is None
    assert markdown.labelled("**Context:** 5", "Context") == "5" and markdown.links("[a](b)") == [("a", "b")]


def test_app_scan(spark):
    py = "import openai\nM = 'm-one'\nN = 'x'\nN = 'y'\nc(model=M)\nc(model=N)\nc(model='z', model_name='no')\nd = {'model_name': 'q'}\ne = dict(model=os.environ['K'])\n"
    src = [("a.py", py), ("b.json", '{"x": [{"model": "j"}]}'), ("c.toml", '[t]\nmodel_id = "k"'), ("d.py", "def ("), ("e.py", "import openai, anthropic\nf(model='w')")]
    obs = appscan.observations(spark.createDataFrame(src, "path string, content string"))
    rows = {(r["path"], r["key"], r["value"], r["provider"], r["reason"]) for r in obs.collect()}
    assert {("a.py", "model", "m-one", "openai", None), ("a.py", "model", None, "openai", "name_not_bound"), ("a.py", "model", "z", "openai", None), ("a.py", "model_name", "q", "openai", None), ("a.py", "model", None, "openai", "dynamic_expression"), ("b.json", "x[0].model", "j", None, None), ("c.toml", "t.model_id", "k", None, None), ("d.py", None, None, None, "SyntaxError"), ("e.py", "model", "w", None, None)} == rows
    assert appscan.inventory(obs).where("state = 'established'").count() == 3 and appscan.unresolved(obs).count() == 2


def test_config_and_query_validation():
    for bad in ({"small_document_chars": -1}, {"symbol_ratio": 1.5}, {"small_document_chars": True}, {"large_document_chars": 1}):
        with pytest.raises(ValueError):
            AnalysisConfig(**bad)
    with pytest.raises(ValueError):
        ModelQuery(min_context=5)


def test_fact_invariants(spark):
    schema = "status string, value string, source_id string, claims array<struct<value:string>>"
    rows = [("known", "x", "s", None), ("known", None, "s", None), ("unknown", None, None, None), ("conflict", None, None, [("a",), ("b",)]), ("conflict", None, None, [("a",), ("a",)]), ("odd", None, None, None)]
    assert sorted(r["rule"] for r in facts.invalid_facts(spark.createDataFrame(rows, schema)).collect()) == ["conflict", "known", "provenance", "status"]


def test_derived_facts(spark):
    schema = "provider string, model_id string, fact_name string, status string, value string, source_id string, verified_at string"
    own = lambda m, **f: [("google", m, k, "known", v, f"s-{k}", "t") for k, v in f.items()]
    rows = own("a", max_input="10", max_output="5", input_modalities="text,image", output_modalities="text") + own("b", max_input="10", max_output="5", input_modalities="text", output_modalities="text", context_window="15")
    rows += own("c", max_input="10", max_output="5", input_modalities="text", output_modalities="text", context_window="20") + own("d", max_input="10", max_output="5", input_modalities="text", output_modalities="image") + own("e", lifecycle="retired", api_access="true")
    df = spark.createDataFrame(rows, schema)
    got = {r["model_id"]: (r["status"], r["value"], r["claims"]) for r in facts.combined_context(df).collect()}
    assert got == {"a": ("known", "15", None), "b": ("known", "15", None), "c": ("conflict", None, ["20", "15"]), "d": ("unknown", None, None), "e": ("unknown", None, None)}
    assert [(r["value"], r["source_id"]) for r in facts.closed_access(df).where("fact_name = 'api_access'").collect()] == [("false", "s-lifecycle")]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "path string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = flag_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("flagged").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = corpus.flags(doc_stats(docs), corpus.text_predicates()).select("path", "code")
    assert sorted(map(tuple, spark.table("flagged").select("path", "code").collect())) == sorted(map(tuple, want.collect()))


def test_order_of_rows_does_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text")
    one, two = (corpus.findings(corpus.flags(doc_stats(d), corpus.text_predicates())).collect() for d in (df, df.orderBy(F.xxhash64("path")).repartition(5)))
    assert one == two and re.match("[A-Z_]+", one[0]["code"])


def test_ratios_divide(spark):
    """A share that equals its limit counts, also where the limit times the size is not a whole number in binary."""
    rows = [(f"{a}/{b}", False, a, b) for a, b in ((55, 100), (99, 180), (110, 200), (54, 100), (109, 200))]
    stats = spark.createDataFrame(rows, "path string, is_empty boolean, short_line_count long, line_count long")
    named = corpus.text_predicates(AnalysisConfig(fragmented_ratio=0.55, fragmented_min_lines=30))["OVERLY_FRAGMENTED_LINES"][0]
    assert {r["path"] for r in stats.where(named).collect()} == {"55/100", "99/180", "110/200"}


def test_html_blocks():
    page = "<html><head><title>T</title><code>head</code></head><body><pre><code>a</code><span>b</span>\n</pre><table><tr><td><b>x</b></td><th>y</th></tr><tr><td>p<table><tr><td>q</td></tr></table></td></tr></table></body></html>"
    title, text, content, boilerplate, code = extract(page)
    assert title == "T" and text == "T\n\na\nb\n\nx | y\np q | q\nq\n" and content == len(text) - 1 and (boilerplate, code) == (0, 4)
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000)[1] == "deep\n" and extract(None)[1] == ""


def test_unbound_reasons():
    """Reasons by the kind of expression; only real lookups in the environment count as such."""
    said = {"name": "name_not_bound", "a.b": "unresolved_attribute", "f()": "dynamic_call", "d['k']": "dynamic_subscript", "os.environ['K']": "dynamic_expression", "os.getenv('K')": "dynamic_expression", "environ.get('K')": "dynamic_expression", "my_environment.x": "unresolved_attribute", "f'{x}'": "dynamic_expression", "a or b": "dynamic_expression", "[1]": "unresolved_expression", "my_environ('K')": "dynamic_call"}
    for text, reason in said.items():
        assert [r[5] for r in appscan.python_references(f"c(model={text})")] == [reason], text
    long = appscan.python_references(f"c(model=f({'x' * 300}))")[0][6]
    assert len(long) == 160 and long.endswith("...")


def test_app_project_below_a_skipped_name(spark, tmp_path):
    root = tmp_path / "build" / "app"
    for name in ("a.py", "vendor/b.py", "src/c.json", "site-packages/d.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("{}")
    assert {r["path"].rsplit("/", 1)[1] for r in appscan.project(spark, str(root)).collect()} == {"a.py", "c.json"}
