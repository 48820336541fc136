"""What concerns one page is done where the page is."""

import pytest
from pyspark.sql import functions as F

from quillspark.catalog import documents as catalog
from quillspark.functions import css, html
from quillspark.operators import documents as d

ODD = [
    "<style>p.a,#x b{color:red;margin:1px} * {padding:2px} b{font-size:2em;color:blue}</style><div style='color:green;width:3px'>a<p class='a c'>x<b id=x>bold<!-- c --><i style='color:'>i</i></b> y</p><zz>q</zz></div>",
    "<article>a<article>b<p>c</p></article>d<style>p{}x,y{color:red;margin:0}</style></article><script>e</script><article></article>",
    "<html><p>plain <b>text</b></p>",
    "",
    None,
    "<a><a>",
    "<base><base href=' /deep/ '><base href='/no/'><link rel=stylesheet href='s.css'><link rel=stylesheet href='s.css'><script src=\"../t.js\"></script><title> t </title><p>x",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, h, "http://h/a/b") for i, h in enumerate(ODD)], "page_id long, html string, url string").repartition(3)


def rows(df):
    return sorted(map(repr, df.collect()))


def shuffles(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_the_agents_rules_are_not_matched_again(monkeypatch):
    """All of them were tried for each element before."""
    tried = []
    matches = css.Selector.matches
    monkeypatch.setattr(css.Selector, "matches", lambda s, e: tried.append(s) or matches(s, e))
    document = html.parse(ODD[2])
    css.style(document, css.author_sheets(document))
    assert not tried
    for text in filter(None, ODD):  # and come out as by trying them
        document = html.parse(text)
        for e in document.by_tag("*"):
            want = []
            for order, rule in enumerate(css.parse(css.USER_AGENT)):
                best = max((s.specificity() for s in rule.selectors if matches(s, e)), default=None)
                want += [(0, best, order, p, v) for p, v in rule.declarations] if best is not None else []
            assert [x for x in css.candidates(e, css.author_sheets(document)) if x[0] == 0] == sorted(want, key=lambda x: x[:3])


def test_painting_a_deep_page_visits_a_box_once():
    """A word went up through a generator for each box around it before, and deep pages ended at Python's limit."""
    from quillspark.functions import layout

    box = layout.Box(None, children=[])
    for _ in range(5000):
        box = layout.Box(None, children=[box])
    assert list(layout.display_list(box)) == []


def test_resources_are_found_without_a_tree(spark, odd, monkeypatch):
    """Pages were parsed to trees twice before; references go by the first base element that has an address."""
    given = spark.createDataFrame([("http://h/deep/s.css", "p{margin:4px}"), ("http://h/t.js", "document.title = 'made';"), ("http://h/no/s.css", "p{margin:90px}")], "uri string, content string")
    got = {r.page_id: (r.title, r.n_sheets) for r in d.load_pages(odd, given).collect()}
    assert got == {0: ("", 1), 1: ("", 1), 2: ("", 0), 3: ("", 0), 5: ("", 0), 6: ("made", 2)}


def test_html_text_moves_nothing(spark, sf, odd):
    """All paths of all texts were shuffled before."""
    nodes = d.html_nodes(odd)
    assert rows(d.element_texts(odd, "article")) == rows(d.text_content(nodes, nodes.where("tag = 'article'")))
    assert not shuffles(catalog.html_text(spark, sf))


def test_css_rules_move_nothing(spark, sf, odd):
    """All paths of all texts were shuffled before."""
    nodes = d.html_nodes(odd)
    assert rows(d.page_rules(odd)) == rows(d.css_rules(d.text_content(nodes, nodes.where("tag = 'style'")), "page_id", "text"))
    assert not shuffles(catalog.css_rules(spark, sf))


def test_css_cascade_moves_nothing(spark, sf, odd):
    """Each node was joined with all above it before."""
    assert rows(d.computed_values(odd)) == rows(d.computed(d.html_nodes(odd), d.cascade(d.declared(odd))))
    assert d.computed_values(odd).where(F.col("property") == "color").count() > 10
    assert not shuffles(catalog.css_cascade(spark, sf))
