"""Document operators: HTML columns to node tables, selections, cascades, boxes and display lists.

What walks one page (parsing, layout, scripts) runs in Python over Arrow batches, a page at a time, with nothing but the
page in memory; what relates rows (cascade, inheritance, text, histograms) are DataFrame operations on its output.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillspark.functions import css, html, layout, script

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Pages whose rows go together, unless they are many rows; new objects between two looks for cycles, of which trees consist.
PAGES_AT_ONCE, ROWS_AT_ONCE, OBJECTS = 256, 1 << 15, 200_000


def prepare(spark: SparkSession) -> SparkSession:
    """Python workers must be able to import this package."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def per_row(df: DataFrame, key: str, columns: list[str], f: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """A row (key, *schema) for each tuple that ``f`` yields for the row's columns; nothing for a null first column."""
    prepare(df.sparkSession)
    made = StructType.fromDDL(schema)
    out = StructType([df.schema[key], *made.fields])
    arrow = to_arrow_schema(out)

    def made(keys: list, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((keys, *zip(*rows, strict=True)), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = gc.get_threshold()
        gc.set_threshold(OBJECTS, *before[1:])
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                    b = batch.slice(at, PAGES_AT_ONCE)
                    keys, rows = [], []
                    for k, *v in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                        if v[0] is None:
                            continue
                        rows.extend(f(*v))
                        keys.extend([k] * (len(rows) - len(keys)))
                        if len(rows) >= ROWS_AT_ONCE:
                            yield made(keys, rows)
                            keys, rows = [], []
                    if rows:
                        yield made(keys, rows)
        finally:
            gc.set_threshold(*before)

    return df.select(key, *columns).mapInArrow(run, out)


# ---- HTML

TOKENS = "seq int, kind string, name string, data string, attrs map<string,string>, self_closing boolean"
NODES = "node_id int, parent_id int, ord int, depth int, kind string, tag string, attrs map<string,string>, data string, path array<int>"


def _token_rows(text: str) -> Iterator[tuple]:
    for i, t in enumerate(html.tokenize(text)):
        yield i, t.kind, t.name or None, t.data or None, list(t.attrs.items()), t.closed


def _node_rows(text: str) -> Iterator[tuple]:
    for row in html.node_rows(html.parse(text)):
        yield (*row[:6], list(row[6].items()), *row[7:])


def html_tokens(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    return per_row(pages, key, [column], _token_rows, TOKENS)


def html_nodes(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """The tree as a table in document order; the document itself is node 0."""
    return per_row(pages, key, [column], _node_rows, NODES)


def register_table_functions(spark: SparkSession) -> None:
    """SQL table functions html_tokens(html) and html_nodes(html), for LATERAL joins."""
    prepare(spark)

    @F.udtf(returnType=TOKENS)
    class HtmlTokens:
        def eval(self, text: str) -> Iterator[tuple]:
            for *a, attrs, closed in _token_rows(text):
                yield (*a, dict(attrs), closed)

    @F.udtf(returnType=NODES)
    class HtmlNodes:
        def eval(self, text: str) -> Iterator[tuple]:
            yield from html.node_rows(html.parse(text))

    spark.udtf.register("html_tokens", HtmlTokens)
    spark.udtf.register("html_nodes", HtmlNodes)


def text_content(nodes: DataFrame, of: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, text) of the nodes in ``of`` (key, node_id): the text below each, in document order."""
    texts = nodes.where("kind = 'text'").select(key, F.col("node_id").alias("t"), "data", F.explode("path").alias("node_id"))
    joined = of.select(key, "node_id").join(texts, [key, "node_id"], "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "data"))))
    return joined.groupBy(key, "node_id").agg(F.array_join(F.transform(parts, lambda x: x["data"]), "").alias("text"))


def element_texts(pages: DataFrame, tag: str, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, node_id, text) of the elements with the tag: ``text_content`` where the page is."""

    def rows(text: str) -> Iterator[tuple]:
        for i, n in enumerate(html.parse(text).walk()):
            if n.kind == "element" and n.tag == tag:
                yield i, n.text()

    return per_row(pages, key, [column], rows, "node_id int, text string")


def by_id(nodes: DataFrame, value: str, key: str = "page_id") -> DataFrame:
    """(key, node_id) of each page's first element with the id."""
    return nodes.where((F.col("kind") == "element") & (F.col("attrs")["id"] == value)).groupBy(key).agg(F.min("node_id").alias("node_id"))


def class_list(attrs: Column) -> Column:
    value = F.trim(F.regexp_replace(F.coalesce(attrs["class"], F.lit("")), r"\s+", " "))
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, " "))


def titles(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    return per_row(pages, key, [column], lambda t: [(html.title(html.parse(t)),)], "title string")


def serialize(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    return per_row(pages, key, [column], lambda t: [(html.parse(t).inner_html(),)], "html string")


# ---- CSS


RULES = "rule int, selector string, specificity struct<ids:int,classes:int,types:int>, decl int, property string, value string"


def _rule_rows(sheet: str) -> Iterator[tuple]:
    for i, rule in enumerate(css.parse(sheet)):
        for s in rule.selectors:
            for j, (p, v) in enumerate(rule.declarations):
                yield i, str(s), s.specificity(), j, p, v


def css_rules(sheets: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each selector and declaration."""
    return per_row(sheets, key, [column], _rule_rows, RULES)


def page_rules(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """The rules of each page's style elements, where the page is."""

    def rows(text: str) -> Iterator[tuple]:
        for n in html.parse(text).by_tag("style"):
            yield from _rule_rows(n.text())

    return per_row(pages, key, [column], rows, RULES)


def css_select(pages: DataFrame, selector: str, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, node_id, tag, text): elements that match, in document order."""
    wanted = css.selectors(selector)

    def rows(text: str) -> Iterator[tuple]:
        for i, n in enumerate(html.parse(text).walk()):
            if n.kind == "element" and any(s.matches(n) for s in wanted):
                yield i, n.tag, n.text()

    return per_row(pages, key, [column], rows, "node_id int, tag string, text string")


CANDIDATES = "node_id int, parent_path array<int>, origin int, ids int, classes int, types int, rule int, decl int, property string, value string"


def declared(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """Every declaration that reaches an element, with what decides between them; UA sheet, author sheets, inline."""

    def rows(text: str) -> Iterator[tuple]:
        document = html.parse(text)
        sheets = css.author_sheets(document)
        path: dict[int, list[int]] = {}
        for i, n in enumerate(document.walk()):
            path[id(n)] = [*(path[id(n.parent)] if i else []), i]
            if n.kind == "element":
                for d, (origin, sp, order, p, v) in enumerate(css.candidates(n, sheets)):
                    yield i, path[id(n)], origin, *sp, order, d, p, v

    return per_row(pages, key, [column], rows, CANDIDATES)


def cascade(candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, property, value): the strongest declaration of each property, as one arg-max aggregation."""
    order = F.struct("origin", "ids", "classes", "types", "rule", "decl")
    return candidates.groupBy(key, "node_id", "property").agg(F.max_by("value", order).alias("value"))


def computed(nodes: DataFrame, specified: DataFrame, key: str = "page_id") -> DataFrame:
    """Specified values, and for inherited properties the value of the nearest element that has one."""
    element_or_text = nodes.where("kind IN ('element', 'text')").select(key, "node_id", "path")
    down = element_or_text.select(key, "node_id", F.posexplode("path").alias("depth", "from"))
    inherited = specified.where(F.col("property").isin(sorted(css.INHERITED))).withColumnRenamed("node_id", "from")
    reached = down.join(inherited, [key, "from"]).groupBy(key, "node_id", "property").agg(F.max_by("value", "depth").alias("value"))
    own = specified.where(~F.col("property").isin(sorted(css.INHERITED))).select(key, "node_id", "property", "value")
    return reached.select(key, "node_id", "property", "value").unionByName(own)


def computed_values(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, node_id, property, value): ``computed`` of all that reaches a page's nodes, where the page is."""

    def rows(text: str) -> Iterator[tuple]:
        document = html.parse(text)
        return css.computed(document, css.author_sheets(document))

    return per_row(pages, key, [column], rows, "node_id int, property string, value string")


def length_px(raw: Column, em: Column | float = 16.0) -> Column:
    """Pixels of a CSS length; percentages and bare numbers keep their amount, anything else is null."""
    s = F.trim(raw)
    pattern = r"^([+-]?[0-9]*\.?[0-9]+)(px|em|rem|ex|pt|%)?$"
    amount, unit = F.regexp_extract(s, pattern, 1).try_cast("double"), F.regexp_extract(s, pattern, 2)
    em = em if isinstance(em, Column) else F.lit(em)
    return F.when(unit == "pt", amount * 96.0 / 72.0).when(unit.isin("em", "rem", "ex"), amount * em).otherwise(amount)


def color_rgba(raw: Column) -> Column:
    """struct<r, g, b, a> of a CSS colour, or null."""
    s = F.lower(F.trim(raw))
    hexed = F.regexp_extract(s, r"^#([0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{8})$", 1)
    full = F.when(F.length(hexed) == 3, F.regexp_replace(hexed, "(.)", "$1$1")).otherwise(hexed)
    byte = lambda i: F.conv(F.substring(full, 2 * i + 1, 2), 16, 10).cast("int")
    inside = F.split(F.regexp_extract(s, r"^rgba?\(([^)]*)\)", 1), ",")
    part = lambda i: F.trim(F.get(inside, F.lit(i)))
    clamp = lambda x: F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(255)).cast("int")
    channel = lambda i: clamp(F.when(part(i).endswith("%"), F.regexp_replace(part(i), "%$", "").try_cast("double") * 255 / 100).otherwise(part(i).try_cast("double")))
    alpha = clamp(part(3).try_cast("double") * 255)
    n = F.size(inside)
    named = F.create_map(*[x for k, v in css.NAMED.items() for x in (F.lit(k), F.struct(*(F.lit(c).alias(a) for c, a in zip(v, "rgba", strict=True))))])
    from_hex = F.struct(byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"), F.when(F.length(full) == 8, byte(3)).otherwise(255).alias("a"))
    from_call = F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), F.when(n == 4, alpha).otherwise(255).alias("a"))
    good = channel(0).isNotNull() & channel(1).isNotNull() & channel(2).isNotNull() & ((n == 3) | ((n == 4) & alpha.isNotNull()))
    return F.when(hexed != "", from_hex).when(s.startswith("rgb(") | s.startswith("rgba("), F.when(good, from_call)).otherwise(F.try_element_at(named, s))


# ---- layout and paint

BOXES = "box int, depth int, tag string, anonymous boolean, x double, y double, width double, height double, border_x double, border_y double, border_width double, border_height double, margin_height double, n_lines int"
COMMANDS = "seq int, kind string, x double, y double, width double, height double, text string, font_size double, bold boolean, color string"


def _page(text: str, scripts: bool, resources: dict[str, str] | None = None, url: str | None = None) -> html.Node:
    document = html.parse(text)
    if scripts:
        script.Page(document).run_scripts(_fetch(document, url, resources))
    return document


def _base(document: html.Node, url: str | None) -> str:
    """A page's address, joined with the first base element that has one."""
    for b in document.by_tag("base"):
        if b.attrs.get("href", "").strip():
            return urljoin(url or "", b.attrs["href"].strip())
    return url or ""


def _fetch(document: html.Node, url: str | None, resources: dict[str, str] | None) -> Callable[[str], str | None] | None:
    """Resolve against the page's address (and its base element) and look in the given resources."""
    if not resources:
        return None
    base = _base(document, url)
    return lambda ref: resources.get(urljoin(base, ref))


def _laid_out(document: html.Node, width: float, fetch: Callable[[str], str | None] | None = None) -> layout.Box:
    return layout.layout_document(css.style(document, css.author_sheets(document, fetch)), width)


def layout_boxes(pages: DataFrame, width: float = 800.0, scripts: bool = False, key: str = "page_id", column: str = "html") -> DataFrame:
    def rows(text: str) -> Iterator[tuple]:
        for i, (depth, b) in enumerate(layout.walk_boxes(_laid_out(_page(text, scripts), width))):
            yield i, depth, b.style.node.tag if b.style else None, b.anonymous, b.x, b.y, b.width, b.height, *b.border_box(), b.margin_box()[3], len(b.lines)

    return per_row(pages, key, [column], rows, BOXES)


@lru_cache(maxsize=1 << 12)
def _hexed(c: tuple[int, int, int, int]) -> str:
    return "#%02x%02x%02x%02x" % c


def display_lists(pages: DataFrame, width: float = 800.0, scripts: bool = False, key: str = "page_id", column: str = "html") -> DataFrame:
    def rows(text: str) -> Iterator[tuple]:
        for i, (kind, *geometry, word, size, bold, c) in enumerate(layout.display_list(_laid_out(_page(text, scripts), width))):
            yield i, kind, *geometry, word, size, bold, _hexed(c)

    return per_row(pages, key, [column], rows, COMMANDS)


def page_heights(pages: DataFrame, width: float = 800.0, least: int = 600, key: str = "page_id", column: str = "html") -> DataFrame:
    """The height of a rendering: the content's, but at least ``least``."""
    import math

    return per_row(pages, key, [column], lambda t: [(max(least, math.ceil(_laid_out(html.parse(t), width).margin_box()[3])),)], "page_height int")


# ---- scripts and whole pages


def run_scripts(pages: DataFrame, key: str = "page_id", column: str = "html", max_steps: int = script.MAX_STEPS) -> DataFrame:
    """(key, html, console): each page after its scripts."""

    def rows(text: str) -> Iterator[tuple]:
        page = script.Page(html.parse(text), max_steps)
        page.run_scripts()
        yield page.document.inner_html(), page.machine.console

    return per_row(pages, key, [column], rows, "html string, console array<string>")


def load_pages(pages: DataFrame, resources: DataFrame, key: str = "page_id", scripts: bool = True) -> DataFrame:
    """(key, title, n_sheets, n_elements, page_height) with external sheets and scripts from ``resources`` (uri, content).

    References are resolved from each page's own elements and joined, so a page carries only what it asks for.
    """

    def asked(text: str, url: str | None) -> Iterator[tuple]:
        """Every start tag makes an element, so no tree is needed to find those that refer to something."""
        tags = [t for t in html.tokenize(text) if t.kind == "start" and t.name in ("base", "link", "script")]
        base = next((urljoin(url or "", h) for t in tags if t.name == "base" and (h := t.attrs.get("href", "").strip())), url or "")
        refs = (t.attrs.get({"link": "href", "script": "src"}.get(t.name, ""), "").strip() for t in tags)
        yield from dict.fromkeys((urljoin(base, ref),) for ref in refs if ref)

    wanted = per_row(pages, key, ["html", "url"], asked, "uri string").distinct()
    given = wanted.join(resources.select("uri", "content"), "uri").groupBy(key).agg(F.collect_list(F.struct("uri", "content")).alias("given"))

    def rows(text: str, url: str | None, given: list | None) -> Iterator[tuple]:
        found = {g["uri"]: g["content"] for g in given or []}
        document = _page(text, scripts, found, url)
        fetch = _fetch(document, url, found)
        sheets = css.author_sheets(document, fetch)
        box = layout.layout_document(css.style(document, sheets), 800.0)
        yield html.title(document), len(sheets), len(document.by_tag("*")), box.margin_box()[3]

    return per_row(pages.join(given, key, "left"), key, ["html", "url", "given"], rows, "title string, n_sheets int, n_elements int, page_height double")


def loadable(url: Column) -> Column:
    """Only http and https addresses are fetched."""
    return F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
