"""The HTML queries on a small page, with rows read off the page by hand."""

import duckdb
import pyarrow as pa
import pytest

from harrow.operators import pages
from harrow.queries import ORACLES, QUERIES
from scripts.compare import compare

HTML = (
    '<html><body><div id="main" class="box active"><p>the</p><p> The </p><a href="/item?id=1">one</a><a href="">none</a></div>'
    '<div data-testid="foot"><a href="https://other.org/x">the end</a></div></body></html>'
)
MAIN, FOOT = "/html[1]/body[1]/div[1]", "/html[1]/body[1]/div[2]"
WANT = {
    "html_links": [(1, 5, f"{MAIN}/a[1]", "https://example.com/item?id=1", "one"), (1, 8, f"{FOOT}/a[1]", "https://other.org/x", "the end")],
    "html_text_search": [(1, 3, "p", f"{MAIN}/p[1]"), (1, 4, "p", f"{MAIN}/p[2]"), (1, 8, "a", f"{FOOT}/a[1]")],
    "html_url_search": [(1, 5, "href", "/item?id=1")],
    "xpath_eval": [
        (1, 3, f"{MAIN}/p[1]", "the"),
        (1, 4, f"{MAIN}/p[2]", "The"),
        (1, 5, f"{MAIN}/a[1]", "/item?id=1"),
        (1, 6, f"{MAIN}/a[2]", ""),
        (1, 8, f"{FOOT}/a[1]", "https://other.org/x"),
        (2, 0, "/p[1]", "x"),
    ],
    "xpath_candidates": [
        (1, 2, 0, "id", "//*[@id='main']"),
        (1, 2, 2, "class-anchor", "//div[contains(@class,'box')]"),
        (1, 2, 5, "absolute", MAIN),
        *[(1, pos, *rest) for pos, leaf in ((3, "p[1]"), (4, "p[2]"), (5, "a[1]"), (6, "a[2]")) for rest in ((3, "id-relative", f"//*[@id='main']/{leaf}"), (5, "absolute", f"{MAIN}/{leaf}"))],
        (1, 7, 1, "testid", "//*[@data-testid='foot']"),
        (1, 7, 5, "absolute", FOOT),
        (1, 8, 5, "absolute", f"{FOOT}/a[1]"),
        (2, 0, 2, "class-anchor", "//p[contains(@class,'lead')]"),
        (2, 0, 5, "absolute", "/p[1]"),
    ],
}


@pytest.mark.parametrize("name", WANT)
def test_html_query(spark, tmp_path, name):
    pages = [(1, "https://example.com/list", HTML), (2, "https://example.com/b", "<p class='lead'>x</p>"), (3, "https://example.com/c", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    if name == "html_url_search":
        assert all(0.7 <= r[4] <= 1 for r in got)
        got = [r[:4] for r in got]
    assert got == WANT[name]


def test_references_without_semicolon(spark):
    html = "<title>a &amp;&amp; b&amp</title><p>&lt;x&gt &notit; &quot; &#65; &#66 & c</p>"
    df = spark.createDataFrame([(1, html)], "page long, html string")
    text = lambda *names: {r.tag: r.text for r in pages.nodes(df, "page", "html", *names).collect()}
    assert text(("amp",)) == {"title": "a && b&amp", "p": "&lt;x&gt &notit; &quot; &#65; &#66 & c"}
    assert text(("amp", "lt")) == {"title": "a && b&amp", "p": "<x&gt &notit; &quot; &#65; &#66 & c"}
    assert text() == {"title": "a && b&", "p": '<x> ¬it; " A B & c'}


def test_cut_reference_in_a_title(spark, tmp_path):
    html = '<html><head><title>Fish &amp; chips &quot;x&quot; &amp</title></head><body><nav><ul></ul></nav><div class="ad">x</div><article><h1>Fish &amp; chips &quot;x&quot; &amp</h1></article></body></html>'
    spark.createDataFrame([(1, "https://example.com", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("path_values", "path_verification"):
        said = compare(spark, db, name, QUERIES[name], ORACLES[name], str(tmp_path))
        assert f"{name}: equal" in said, said


def test_batches_of_nodes_are_bounded():
    html = "<ul>" + "<li class='x'><a href='/u'>t</a></li>" * 300 + "</ul>"
    given = pa.RecordBatch.from_pydict({"k": list(range(100)), "html": [html] * 99 + [None]})
    made = list(pages._parser(pages._ARROW, None)(iter([given])))
    assert sum(b.num_rows for b in made) == 99 * 601 and max(b.num_rows for b in made) <= pages.MOST_NODES
    assert [made[-1].column(0)[-1].as_py(), made[-1].column(1)[-1].as_py()] == [98, 600]
    deep = pa.RecordBatch.from_pydict({"k": [1], "html": ["<div>" * 2000]})  # paths of 12 kB: 24 MB in all
    assert len(list(pages._parser(pages._ARROW, None)(iter([deep])))) >= 5
