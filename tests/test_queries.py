import os

import pytest

from lodestrata.plans import registry
from lodestrata.sources.html import extract
from tests.oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_titles_cut_within_a_reference(spark, tmp_path):
    titles = ["a &amp;&amp", "b &lt", "c &#x27", "d &#x2", "e &quot;&quot", "&amp;lt; f", "g &ampx; &", "h \ue000 &amp"]
    pages = [(k, "u", f"<html><title>{t}</title><body><!-- {t} --><p>{t}</p><code>{t}</code></body></html>") for k, t in enumerate(titles)]
    for t in TABLES:
        if t != "pages":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    compare(spark, registry.QUERIES["html_titles"], registry.ORACLE_SQL["html_titles"], str(tmp_path))
    assert extract(pages[0][2])[0] == "a &&" and extract(pages[7][2], closed=True)[1].split("\n")[:2] == ["h \ue000 &amp"] * 2
