"""Small cases with known answers: stems, queries, trees, styles, boxes, display lists, scripts."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import css, html, layout, script, varint
from quillspark.functions.analysis import Analyzer
from quillspark.functions.stemmer import stem, stemmed
from quillspark.operators import documents as d
from quillspark.operators.index import FieldType, IndexSpec, build_index, numbered
from quillspark.operators.search import MAX_K, Searcher, SearchService
from quillspark.plans.parser import QueryParseError, QueryParser
from quillspark.plans.query import BooleanQuery, PhraseQuery, TermQuery
from quillspark.sources import store, synthetic
from quillspark.sources.folders import scratch

STEMS = """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat
troubled:troubl sized:size hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit valenci:valenc digitizer:digit
conformabli:conform radicalli:radic differentli:differ analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis
hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr
electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit
replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ effective:effect probate:probat rate:rate cease:ceas
controll:control roll:roll connect:connect connected:connect connecting:connect connection:connect connections:connect a:a is:is be:be""".split()


@pytest.mark.parametrize("pair", STEMS)
def test_stem(pair):
    word, want = pair.split(":")
    assert stem(word) == want


def test_stems_of_arrays(spark):
    rows = spark.createDataFrame([(1, ["running", "running", "cats"]), (2, []), (3, None), (4, [None, "ponies"])], "id int, t array<string>")
    got = {r.id: r.s for r in rows.select("id", stemmed(F.col("t")).alias("s")).collect()}
    assert got == {1: ["run", "run", "cat"], 2: [], 3: None, 4: [None, "poni"]}


# ---- queries over three short texts

TEXTS = [("d0", "distributed systems", "fault tolerant storage"), ("d1", "distributed databases", "scalable query engine"), ("d2", "operating systems", "fault isolation kernel")]


@pytest.fixture(scope="module")
def small(spark):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS)], "doc_id long, id string, title string, body string")
    return build_index(df, IndexSpec({"id": FieldType.KEYWORD, "title": FieldType.TEXT, "body": FieldType.TEXT}, Analyzer(stemming=True)))


QUERIES = {
    "fault": "d0 d2", "title:distributed": "d0 d1", "title:systems": "d0 d2", "title:Distributed": "d0 d1", "title:distributed AND body:fault": "d0", "title:operating OR body:scalable": "d1 d2",
    "fault -title:operating": "d0", "+fault title:systems": "d0 d2", 'body:"fault tolerant"': "d0", 'body:"fault kernel"': "", "title:distr*": "d0 d1", "title:(distributed OR operating)": "d0 d1 d2",
    "fault kernel": "d0 d2", "   ": "", "the fault": "d0 d2", "id:d1": "d1",
}


def test_queries(small):
    names = {i: t[0] for i, t in enumerate(TEXTS)}
    parser = QueryParser("body", Analyzer(stemming=True))
    for text, want in QUERIES.items():
        got = {names[r.doc_id] for r in Searcher(small).matches(parser.parse(text)).collect()}
        assert got == set(want.split()), text
    both = QueryParser("body", Analyzer(stemming=True), default_and=True).parse("fault kernel")
    assert [names[r.doc_id] for r in Searcher(small).matches(both).collect()] == ["d2"]


def test_batches_equal_single_searches(spark):
    docs = synthetic.corpus(spark, 600, vocabulary=40)
    searcher = Searcher(store.build_segment(docs, IndexSpec({"body": FieldType.TEXT}), scratch(spark)))
    asked = synthetic.queries(spark, 9, vocabulary=40).withColumn("field", F.lit("body"))
    got = {}
    for r in searcher.batch_pairs(asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    for r in asked.collect():
        a, b = TermQuery("body", r.a), TermQuery("body", r.b)
        query = {"term": a, "and": BooleanQuery.builder().must(a).must(b).build(), "phrase": PhraseQuery("body", [r.a, r.b])}[r.kind]
        assert got.get(r.query_id, []) == [(x.doc_id, round(x.score, 6)) for x in searcher.search(query, 5).collect()], r.kind


@pytest.mark.parametrize("text", ['body:"fault tolerant', "(fault", "title:(a OR (b)", '"'])
def test_broken_queries(text):
    with pytest.raises(QueryParseError):
        QueryParser("body").parse(text)


def test_service_limits(small):
    service = SearchService(small, "body")
    with pytest.raises(ValueError, match="at most"):
        service.query("x" * 2049)
    canonical, total, hits = service.search("", k=MAX_K + 500)
    assert (total.first()[0], hits.count()) == (3, 3)
    assert service.search("fault", k=0)[2].count() == 1
    assert str(service.query(None)) == canonical


def test_changes_of_an_index(small, spark):
    more = small.add(spark.createDataFrame([(7, "d7", "new systems", "fault")], "doc_id long, id string, title string, body string"))
    assert (more.stats().first().max_doc, small.stats().first().max_doc) == (4, 3)  # a snapshot stays as it was
    less = more.delete_by_term("id", "d7")
    assert [more.is_deleted(7), less.is_deleted(7), less.is_deleted(0)] == [False, True, False]
    assert {r.doc_id for r in Searcher(more).matches(QueryParser("body").parse("fault")).collect()} == {0, 2, 7}
    with pytest.raises(IndexError):
        small.delete_document(99)


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    got = numbered(df, ["v"]).collect()
    assert {r.v: r.doc_id for r in got} == {k: k for k in range(1000)}


def test_custom_analysis_stands_alone(spark):
    a = Analyzer(stemming=True, custom=lambda t: F.split(t, "-"))
    assert spark.createDataFrame([("the-Running-x",)], "t string").select(a.terms(F.col("t")).alias("x")).first().x == ["the", "Running", "x"]


def test_varints(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**31 - 1, -1]
    assert list(varint.decode(varint.encode(values))) == values
    wide = [0, 1, 1 << 35, 2**63 - 1, -1]
    assert list(varint.decode(varint.encode(wide, 64), 64)) == wide
    sizes = spark.createDataFrame([(v,) for v in values], "v int").select("v", varint.size(F.col("v")).alias("n")).collect()
    assert {r.v: r.n for r in sizes} == {v: len(varint.encode([v])) for v in values}
    with pytest.raises(EOFError):
        list(varint.decode(b"\x80"))
    with pytest.raises(ValueError, match="too long"):
        list(varint.decode(b"\x80\x80\x80\x80\x80\x01"))


# ---- HTML


def first(text, tag):
    return html.parse(text).by_tag(tag)[0]


def test_html_trees():
    a = first("<a href=\"/p\" class='one two' data-n=5>label</a>", "a")
    assert (a.attrs["href"], a.classes(), a.attrs["data-n"], a.text()) == ("/p", ["one", "two"], "5", "label")
    box = first('<div><br><img src="i.png">behind</div>', "div")
    assert [e.tag for e in box.elements()] == ["br", "img"]
    assert box.text() == "behind"
    assert html.parse("<!doctype html><!-- no --><p>yes</p>").text() == "yes"
    assert html.parse("<div><i id=t>here</i></div>").by_id("t").text() == "here"
    assert first("<p>x &amp; y &lt; z &gt; w</p>", "p").text() == "x & y < z > w"
    odd = html.parse("<input type=text /><div/>rest</span>")
    assert (odd.by_tag("input")[0].attrs["type"], len(odd.by_tag("div")), odd.text()) == ("text", 1, "rest")
    assert len(html.parse("<ol class=x><li>first <li>second <li>third").by_tag("li")) == 3
    assert html.parse("<p>a<b>c</b></p>").inner_html() == "<p>a<b>c</b></p>"


def test_html_operators(spark):
    pages = spark.createDataFrame([(1, '<div id=x>a<b id="x">b</b></div><p>c</p>'), (2, "<p id=y>z</p>"), (3, None)], "page_id long, html string")
    nodes = d.html_nodes(pages)
    assert [(r.page_id, r.node_id) for r in d.by_id(nodes, "x").collect()] == [(1, 1)]
    assert [(r.kind, r.name or r.data) for r in d.html_tokens(pages.where("page_id = 2")).orderBy("seq").collect()] == [("start", "p"), ("text", "z"), ("end", "p")]
    texts = d.text_content(nodes, nodes.where("tag = 'div'")).collect()
    assert [(r.page_id, r.text) for r in texts] == [(1, "ab")]


# ---- CSS


def styled(text, tag):
    document = html.parse(text)
    todo = [css.style(document, css.author_sheets(document))]
    while todo:
        s = todo.pop(0)
        if s.node.kind == "element" and s.node.tag == tag:
            return s
        todo += s.children
    return None


def test_css_parsing():
    (rule,) = css.parse("h2{margin : 3px ;  width:7em}")
    assert ([str(s) for s in rule.selectors], rule.declarations) == (["h2"], (("margin", "3px"), ("width", "7em")))
    assert len(css.parse("h1, .t, #m { color: blue }")[0].selectors) == 3
    assert [str(r.selectors[0]) for r in css.parse("/* a */ p { margin: 0 } /* b */")] == ["p"]
    assert len(css.parse("u{top:1px}b{left:2px}i{right:3px}q{bottom:4px}")) == 4
    assert css.selector("div.note#main").specificity() == (1, 1, 1)
    assert css.selector("#m").specificity() > css.selector(".n").specificity() > css.selector("div").specificity()


def test_css_matching():
    tree = html.parse("<div><section>before<p id=in class=note>A<b>!</b></p>behind</section></div>between<p id=out>B</p>")
    inside, outside = tree.by_id("in"), tree.by_id("out")
    for text, a, b in (("p", 1, 1), (".note", 1, 0), ("#in", 1, 0), ("p.note", 1, 0), (".gone", 0, 0), ("span", 0, 0), ("div p", 1, 0), ("div section p", 1, 0), ("section div p", 0, 0), ("*", 1, 1)):
        assert (css.selector(text).matches(inside), css.selector(text).matches(outside)) == (bool(a), bool(b)), text


def test_styles():
    assert [styled("<div><span>x</span></div>", t).keyword("display", "?") for t in ("div", "span")] == ["block", "inline"]
    page = "<head><style>%s</style><title>name</title></head><body><div>y<p class=c id=i>x</p></div></body>"
    assert [styled(page % "", t).keyword("display", "?") for t in ("head", "title")] == ["none", "none"]
    colour = lambda rules, page=page: styled(page % rules, "p").color("color")
    assert colour("p { color: red }") == (255, 0, 0, 255)
    assert colour("#i { color: blue } .c { color: green }") == (0, 0, 255, 255)
    assert colour("body { color: #112233 }") == (0x11, 0x22, 0x33, 255)
    assert styled('<style>p { color: red }</style><p style="color: #00ff00">x</p>', "p").color("color") == (0, 255, 0, 255)
    big = styled("<h1>large</h1>", "h1")
    assert big.length("font-size", -1.0) == 32


def test_values():
    v = css.value("12px")
    assert (v.kind, v.amount, v.unit) == ("length", 12.0, "px")
    assert (css.value("#0f0").kind, css.value("#0f0").rgba) == ("color", (0, 255, 0, 255))
    assert css.value("sans-serif").kind == "keyword"
    for raw, want in (("red", (255, 0, 0, 255)), ("#0f8", (0, 255, 136, 255)), ("#10203040", (16, 32, 48, 64)), ("rgb(10%, 300, -5)", (26, 255, 0, 255)), ("rgba(1,2,3,0.5)", (1, 2, 3, 128)), ("#12", None), ("nope", None)):
        assert css.color(raw) == want, raw


def test_cascade_as_aggregation_equals_the_tree(spark, sf):
    """Two implementations of the cascade and of inheritance, over the pages of the table."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").limit(12)
    got = {}
    for r in d.computed(d.html_nodes(pages), d.cascade(d.declared(pages))).collect():
        got.setdefault((r.page_id, r.node_id), {})[r.property] = r.value
    checked = 0
    for page in pages.collect():
        document = html.parse(page.html)
        number = {id(n): i for i, n in enumerate(document.walk())}
        todo = [css.style(document, css.author_sheets(document))]
        while todo:
            s = todo.pop()
            todo += s.children
            mine = got.get((page.page_id, number[id(s.node)]), {})
            assert {k: css.value(v) for k, v in mine.items()} == s.values, (page.page_id, s.node.tag)
            checked += len(mine)
    assert checked > 1000


# ---- layout and paint


def laid_out(text, width=800):
    document = html.parse(text)
    return layout.layout_document(css.style(document, css.author_sheets(document)), width)


def of_tag(box, tag):
    return [b for _, b in layout.walk_boxes(box) if b.style is not None and b.style.node.tag == tag]


def page(body):
    return f"<html><body>{body}</body></html>"


def test_block_boxes():
    (div,) = of_tag(laid_out(page("<div></div>")), "div")
    assert (div.x, div.width) == (8.0, 784.0)  # the body's margin is 8
    a, b = of_tag(laid_out(page('<div style="height:50px"></div><div style="height:30px"></div>')), "div")
    assert (a.y, b.y, a.height, b.height) == (8.0, 58.0, 50.0, 30.0)
    (body,) = of_tag(laid_out(page('<div style="height:40px"></div><div style="height:20px"></div>')), "body")
    assert body.height == 60.0
    for margins, x in (("margin-left:auto;margin-right:auto", 8 + (784 - 200 - 14) / 2 + 7), ("margin-left:auto", 8 + 784 - 200 - 7), ("margin:auto", 300), ("margin:0 auto", 15)):  # in a list auto is 0
        (div,) = of_tag(laid_out(page(f'<div style="width:200px;{margins};padding:5px;border-width:2px"></div>')), "div")
        assert (div.width, div.x) == (200.0, x)
    (div,) = of_tag(laid_out(page('<div style="margin:1px 2px 3px 4px;width:50%"></div>')), "div")
    assert (div.x, div.y, div.width, div.margin_box()[3]) == (12.0, 9.0, 392.0, 4.0)
    assert of_tag(laid_out(page('<div></div><p style="display:none">x</p>')), "p") == []


def test_lines():
    (p,) = of_tag(laid_out(page("<p>Hello world</p>")), "p")
    assert [[w[0] for w in words] for _, _, words in p.lines] == [["Hello", "world"]]
    (p,) = of_tag(laid_out(page("<p>" + "word " * 100 + "</p>"), 200), "p")
    # 184 wide, a word 4 x 8 and a space 8: four words and three spaces are 152, a fifth doesn't fit
    assert len(p.lines) == 25
    assert {len(words) for _, _, words in p.lines} == {4}
    assert p.height == pytest.approx(25 * 16 * 1.2)
    (body,) = of_tag(laid_out(page("loose text<div></div>")), "body")
    assert (body.children[0].anonymous, len(body.children[0].lines), len(body.children)) == (True, 1, 2)


def test_display_lists():
    shown = list(layout.display_list(laid_out(page('<p style="background-color:#00ff00">Hi</p>'))))
    assert [x[-1] for x in shown if x[0] == "rect"] == [(0, 255, 0, 255)]
    assert [x[5] for x in shown if x[0] == "glyphs"] == ["Hi"]
    (rect,) = layout.display_list(laid_out(page('<div style="background-color:#ff0000;height:50px"></div>')))
    assert rect == ("rect", 8.0, 8.0, 784.0, 50.0, None, None, None, (255, 0, 0, 255))
    edges = list(layout.display_list(laid_out(page('<div style="height:20px;border-color:#00f;border-width:5px"></div>'))))
    assert [x[-1] for x in edges] == [(0, 0, 255, 255)] * 4
    assert sorted(x[1:5] for x in edges) == [(8.0, 8.0, 5.0, 30.0), (8.0, 8.0, 784.0, 5.0), (8.0, 33.0, 784.0, 5.0), (787.0, 8.0, 5.0, 30.0)]
    (link,) = layout.display_list(laid_out(page('<a href="/x">link</a>')))
    assert link[-1] == (0, 0, 0xEE, 255)


# ---- scripts


def run(source, steps=script.MAX_STEPS):
    m = script.Machine(steps)
    m.run(source)
    return m.console


SCRIPTS = {
    "console.log(1 + 2);": ["3"],
    "var t = 'x'; t += 'y'; console.log(t + 7 + null);": ["xy7null"],
    "function fib(k) { if (k < 2) return k; return fib(k - 1) + fib(k - 2); } console.log(fib(12));": ["144"],
    "function from(k) { var at = k; return function (by) { at += by; return at; }; } var p = from(5), q = from(50); console.log(p(1), p(2), q(3));": ["6 8 53"],
    "var third = function (v, i) { return v + i / 2; }; console.log([10, 20, 30].map(third).join(' / '));": ["10 / 20.5 / 31"],
    "var cat = { lives: 9, less: function (k) { this.lives -= k; return this; } }; console.log(cat.less(2).less(3).lives);": ["4"],
    "var sum = 0; for (let k = 9; k >= 0; k--) { if (k === 5) continue; sum += k; } console.log(sum);": ["40"],
    "for (const v of [7, [8]]) console.log(v); for (var k in { p: 1, q: 2 }) console.log(k);": ["7", "8", "p", "q"],
    "var left = 3; while (left) { if (left < 2) break; console.log('left', left--); }": ["left 3", "left 2"],
    "console.log(typeof 5, typeof missing, typeof console.log, typeof 'x', typeof {}, typeof null, typeof true);": ["number undefined function string object object boolean"],
    "console.log(Math.floor(3.9), Math.round(2.5), Math.round(-2.5), Math.max(1, 7, 3), Math.abs(-4), Math.pow(2, 10), Math.sqrt(81));": ["3 3 -2 7 4 1024 9"],
    "console.log(parseInt('10px'), parseInt('ff', 16), parseFloat('2.5em'), isNaN('x'), Number('7'), String(1.5), (1.005).toFixed(1));": ["10 255 2.5 true 7 1.5 1.0"],
    "const s = 'hello'; console.log(s.toUpperCase(), s.length, s.substring(1, 4), s.slice(-3), s.charAt(1), s.indexOf('l'), s.lastIndexOf('l'), s.includes('ell'), s.split('l').length, s.replace('l', 'L'), 'ab'.repeat(3));": ["HELLO 5 ell llo e 2 3 true 3 heLlo ababab"],
    "var a = [1, 2, 3, 4]; a.push(5); a.shift(); a.unshift(0); var even = function (v) { return !(v % 2); }; console.log(a.filter(even).length, a.pop(), a.indexOf(3), a.slice(1, 3).join('-'), a.concat([9]).length, a.reverse().join(''));": ["3 5 2 2-3 5 4320"],
    "console.log(1 / 0, 0 / 0, '3' * '4', '3' + 4, null + 1, 1 == '1', 1 === '1', null == undefined, 5 % 3, -5 % 3, !'' && 'yes', 0 || 'no');": ["Infinity NaN 12 34 1 true false true 2 -2 yes no"],
    "var p = new (function Pt(x) { this.x = x; })(4); console.log(p.x);": ["4"],
}


@pytest.mark.parametrize("source", SCRIPTS)
def test_script(source):
    assert run(source) == SCRIPTS[source]


@pytest.mark.parametrize(("source", "error"), [("while (true) {}", "budget"), ("var down = function () { return 1 + down(); }; down();", "call stack"), ("x.y.z", "x"), ("var a = 'x'; a.repeat(1e9)", "length"), ("null.p", "null"), ("1(2)", "function")])
def test_script_errors(source, error):
    with pytest.raises(script.ScriptError, match=error):
        run(source, 200_000)


def test_copies_count_against_the_budget():
    for source in ("var s = 'x'.repeat(10000000); while (true) { s.toUpperCase(); }", "var s = 'abcdefgh'; while (true) { s += s; }", "var a = [1]; while (true) { a = a.concat(a); }"):
        with pytest.raises(script.ScriptError):
            run(source, 1_000_000)


def dom(text, source):
    p = script.Page(html.parse(text))
    p.machine.run(source)
    return p.document, p.machine.console


def test_scripts_change_the_page():
    tree, _ = dom("<p id=x>then</p>", "var p = document.getElementById('x'); p.textContent = 'now ' + p.textContent.length;")
    assert tree.by_id("x").text() == "now 4"
    tree, _ = dom("<div id=r></div>", "var made = document.createElement('em'); document.getElementById('r').appendChild(made); made.textContent = 'so';")
    assert tree.by_id("r").inner_html() == "<em>so</em>"
    _, said = dom("<i class=a>1</i><p class=a>2</p><p class='b a'>3</p>", "var all = document.querySelectorAll('p.a'); console.log(all.length, document.querySelector('.b').textContent, all[0].textContent);")
    assert said == ["2 3 2"]
    tree, _ = dom("<div id=b></div>", "var look = document.getElementById('b').style; look.borderTopWidth = '4px'; look.color = 'navy';")
    assert "border-top-width: 4px" in tree.by_id("b").attrs["style"]
    tree, _ = dom("<div id=c>old</div>", "var c = document.getElementById('c'); c.innerHTML = 'x<u>y</u><q>z</q>' + c.innerHTML;")
    assert ([e.tag for e in tree.by_id("c").elements()], tree.by_id("c").text()) == (["u", "q"], "xyzold")
    tree, _ = dom("<ul id=l></ul>", "var l = document.getElementById('l'); for (var i = 1; i < 4; i++) { var e = document.createElement('li'); e.textContent = 'no ' + i; l.appendChild(e); } l.removeChild(l.children[0]);")
    assert [e.text() for e in tree.by_id("l").elements()] == ["no 2", "no 3"]
    _, said = dom('<a id=k href="/x" class="nav main">go</a>', "var a = document.getElementById('k'); console.log(a.getAttribute('href'), a.className, a.tagName); a.setAttribute('rel', 'me'); console.log(a.hasAttribute('rel'));")
    assert said == ["/x nav main A", "true"]


def test_page_scripts_share_globals_and_survive_errors(spark):
    pages = spark.createDataFrame([(1, "<title>t</title><script>var n = 1;</script><script>oops(</script><script>n++; console.log(n, document.title); document.title = 'u';</script><script type='text/template'>console.log(0)</script>")], "page_id long, html string")
    r = d.run_scripts(pages).first()
    assert r.console == ["2 t"]
    assert "<title>u</title>" in r.html


def test_pages_with_resources(spark):
    """References are joined with the page's base; a sheet and a script come from the table of resources."""
    text = "<html><head><base href='/b/'><title>t</title><link rel=stylesheet href=s.css><script src=x.js></script></head><body><div class=c></div></body></html>"
    pages = spark.createDataFrame([(1, "http://h/a/", text), (2, "http://h/a/", "<p>x</p>")], "page_id long, url string, html string")
    resources = spark.createDataFrame([("http://h/b/s.css", ".c { height: 70px }"), ("http://h/b/x.js", "document.title = 'set';"), ("http://h/other.css", "p { height: 9px }")], "uri string, content string")
    got = {r.page_id: r for r in d.load_pages(pages, resources).collect()}
    assert (got[1].title, got[1].n_sheets, got[1].page_height) == ("set", 1, 86.0)
    assert (got[2].title, got[2].n_sheets) == ("", 0)
