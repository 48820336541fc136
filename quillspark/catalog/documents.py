"""Queries over ``pages``: HTML, CSS, layout, scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import documents as d

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.prepare(spark).read.parquet(f"{sf_dir}/pages.parquet")


def _unescaped(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_BARE = r"regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis'), '<!--.*?-->', '', 'gs')"


_TITLE = "regexp_extract(html, '<title>([^<]*)', 1)"


@register("html_tokens")
def html_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.html_tokens(pages(spark, sf_dir))


@register("html_nodes")
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.html_nodes(pages(spark, sf_dir))


@register("html_nodes_lateral", f"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all({_BARE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY ALL UNION ALL SELECT page_id, t.tag, 1 FROM pages, (VALUES ('script'), ('style')) t(tag)")
def html_nodes_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function in SQL."""
    d.register_table_functions(spark)
    pages(spark, sf_dir).createOrReplaceTempView("quill_pages")
    return spark.sql("SELECT page_id, tag, count(*) AS n FROM quill_pages, LATERAL html_nodes(html) WHERE kind = 'element' GROUP BY page_id, tag")


@register("page_titles", f"SELECT page_id, trim({_unescaped(_TITLE)}) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.titles(pages(spark, sf_dir))


_ARTICLE = f"regexp_replace(regexp_extract({_BARE}, '<article>(.*)</article>', 1, 's'), '<[^>]*>', '', 'g')"


@register("html_text", f"SELECT page_id, {_unescaped(_ARTICLE)} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text below every article element."""
    return d.element_texts(pages(spark, sf_dir), "article").select("page_id", "text")


@register("html_links", r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.html_nodes(pages(spark, sf_dir)).where("tag = 'a' AND attrs['href'] IS NOT NULL").select("page_id", F.col("attrs")["href"].alias("href"))


@register("tag_histogram", f"SELECT tag, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all({_BARE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages UNION ALL SELECT t.tag FROM pages, (VALUES ('script'), ('style')) t(tag)) GROUP BY tag")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.html_nodes(pages(spark, sf_dir)).where("kind = 'element'").groupBy("tag").agg(F.count("*").alias("n"))


@register("html_serialize")
def html_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.serialize(pages(spark, sf_dir))


@register("element_classes", f"""SELECT page_id, unnest(string_split(trim(c), ' ')) AS class FROM (SELECT page_id, unnest(regexp_extract_all({_BARE}, '<[a-zA-Z][^>]* class="([^"]*)"', 1)) AS c FROM pages)""")
def element_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = d.html_nodes(pages(spark, sf_dir)).where("kind = 'element'")
    return n.select("page_id", F.explode(d.class_list(F.col("attrs"))).alias("class"))


@register("css_select", r"""SELECT page_id, len(regexp_extract_all(html, '<nav>.*</nav>', 0)) * len(regexp_extract_all(regexp_extract(html, '<nav>(.*)</nav>', 1), '<a ')) AS n FROM pages""")
def css_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.css_select(pages(spark, sf_dir), "nav ul a").groupBy("page_id").agg(F.count("*").alias("n"))


@register("css_rules", "SELECT page_id, 'p' AS selector, 'margin' AS property, '0' AS value FROM pages")
def css_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.page_rules(pages(spark, sf_dir)).select("page_id", "selector", "property", "value")


@register("css_specificity", "SELECT * FROM (VALUES ('p', 0, 0, 1), ('#a', 1, 0, 0), ('ul li.x.y', 0, 2, 2), ('*', 0, 0, 0), ('div#a .b', 1, 1, 1)) t(selector, ids, classes, types)")
def css_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = d.prepare(spark).createDataFrame([(0, "p, #a, ul li.x.y, *, div#a .b { color: red }")], "id int, css string")
    return d.css_rules(sheet, "id", "css").select("selector", "specificity.ids", "specificity.classes", "specificity.types")


@register("css_cascade")
def css_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed values of all nodes."""
    return d.computed_values(pages(spark, sf_dir))


@register("css_paragraph_margins", f"SELECT page_id, len(regexp_extract_all({_BARE}, '<p>')) AS n, '0' AS value FROM pages")
def css_paragraph_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author's rule for paragraphs beats the built-in one."""
    c = d.cascade(d.declared(pages(spark, sf_dir)).where("property = 'margin'"))
    p = d.html_nodes(pages(spark, sf_dir)).where("tag = 'p'").select("page_id", "node_id")
    return c.join(p, ["page_id", "node_id"]).groupBy("page_id", "value").agg(F.count("*").alias("n"))


_COLORS = [("red", 255, 0, 0, 255), ("#0f8", 0, 255, 136, 255), ("#102030", 16, 32, 48, 255), ("#10203040", 16, 32, 48, 64), ("rgb(10%, 300, -5)", 26, 255, 0, 255), ("rgba(1,2,3,0.5)", 1, 2, 3, 128), (" Transparent ", 0, 0, 0, 0), ("grey", 128, 128, 128, 255), ("#12", None, None, None, None), ("nope", None, None, None, None)]


@register("color_parse", "SELECT * FROM (VALUES " + ", ".join(f"('{c[0]}', " + ", ".join("NULL" if x is None else str(x) for x in c[1:]) + ")" for c in _COLORS) + ") t(raw, r, g, b, a)")
def color_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(c[0],) for c in _COLORS], "raw string").withColumn("c", d.color_rgba(F.col("raw")))
    return df.select("raw", "c.r", "c.g", "c.b", "c.a")


@register("length_px", "SELECT * FROM (VALUES ('12px', 12.0::double), ('1.5em', 24.0), ('9pt', 12.0), ('50%', 50.0), ('-.5rem', -8.0), ('7', 7.0), ('auto', NULL)) t(raw, px)")
def length_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(x,) for x in ("12px", "1.5em", "9pt", "50%", "-.5rem", "7", "auto")], "raw string")
    return df.select("raw", d.length_px(F.col("raw")).alias("px"))


@register("layout_boxes")
def layout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.layout_boxes(pages(spark, sf_dir))


@register("display_list")
def display_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.display_lists(pages(spark, sf_dir))


@register("page_height")
def page_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.page_heights(pages(spark, sf_dir))


@register("js_console", f"SELECT page_id, [len(regexp_extract_all({_BARE}, '<p>')) || CASE WHEN trim({_unescaped(_TITLE)}) <> '' THEN ' true' ELSE ' false' END] AS console FROM pages")
def js_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a script that reports on the page itself."""
    s = "<script>var ps = document.getElementsByTagName('p'); console.log(ps.length, document.title.length > 0); document.title = 'n' + ps.length;</script>"
    p = pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", "</article>", "</article>" + s))
    return d.run_scripts(p).select("page_id", "console")


@register("load_pages")
def load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", "</head>", '<link rel="stylesheet" href="/site.css"></head>'))
    uris = p.select(F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/site.css")).alias("uri")).distinct()
    return d.load_pages(p, uris.withColumn("content", F.lit("p { margin: 4px }")))


@register("loadable_urls", "SELECT page_id, regexp_matches(lower(url), '^https?:') AS ok FROM pages")
def loadable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", d.loadable(F.col("url")).alias("ok"))


@register("js_string_fns", """SELECT page_id, url[1] AS char_at, ascii(url)::int AS code, upper(url) AS up, instr(url, 'example') - 1 AS index_of, contains(url, '/en') AS includes, starts_with(url, 'https') AS starts, suffix(url, '/') AS ends,
substr(url, 5, 5) AS sliced, length(url) AS length, string_split(url, '/') AS parts, regexp_replace(url, 'e', 'E') AS replaced FROM pages""")
def js_string_fns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string functions of scripts as columns: positions count from 0."""
    u = F.col("url")
    return pages(spark, sf_dir).select(
        "page_id", F.substring(u, 1, 1).alias("char_at"), F.ascii(u).alias("code"), F.upper(u).alias("up"), (F.instr(u, "example") - 1).cast("long").alias("index_of"), u.contains("/en").alias("includes"), u.startswith("https").alias("starts"), u.endswith("/").alias("ends"),
        F.substring(u, 5, 5).alias("sliced"), F.length(u).cast("long").alias("length"), F.split(u, "/").alias("parts"), F.regexp_replace(u, "^([^e]*)e", "$1E").alias("replaced"),
    )


@register("js_array_fns", """SELECT vec_id, list_concat(v, [9.0]) AS pushed, v[-1] AS popped, v[2:] AS shifted, list_concat([9.0], v) AS unshifted, array_to_string(list_transform(v, lambda x: floor(x)::int::varchar), ',') AS joined,
coalesce(list_position(v, v[3]), 0)::int - 1 AS index_of, list_contains(v, 5.0) AS includes, v[2:3] AS sliced, list_reverse(v) AS reversed, list_transform(v, lambda x: x * 2) AS mapped, list_filter(v, lambda x: x > 0) AS filtered
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings)""")
def js_array_fns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array functions of scripts as columns."""
    v = F.col("v")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select(
        "vec_id", F.array_append(v, F.lit(9.0)).alias("pushed"), F.element_at(v, -1).alias("popped"), F.slice(v, F.lit(2), F.size(v) - 1).alias("shifted"), F.array_prepend(v, F.lit(9.0)).alias("unshifted"), F.array_join(F.transform(v, lambda x: F.floor(x).cast("string")), ",").alias("joined"),
        (F.array_position(v, v[2]) - 1).cast("int").alias("index_of"), F.array_contains(v, 5.0).alias("includes"), F.slice(v, 2, 2).alias("sliced"), F.reverse(v).alias("reversed"), F.transform(v, lambda x: x * 2).alias("mapped"), F.filter(v, lambda x: x > 0).alias("filtered"),
    )


@register("js_math_fns", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::bigint AS floored, ceil(l_extendedprice)::bigint AS ceiled, floor(l_extendedprice + 0.5)::bigint AS rounded, abs(l_discount - 0.05::double) AS absolute, round(sqrt(l_quantity), 9) AS root, greatest(l_quantity, 20::double) AS most, least(l_quantity, 20::double) AS least, printf('%.2f', l_quantity) AS fixed FROM lineitem")
def js_math_fns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Math and number functions as columns; rounding is floor(x + 0.5)."""
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.floor(p).alias("floored"), F.ceil(p).alias("ceiled"), F.floor(p + 0.5).alias("rounded"), F.abs(F.col("l_discount") - 0.05).alias("absolute"), F.round(F.sqrt(q), 9).alias("root"), F.greatest(q, F.lit(20.0)).alias("most"), F.least(q, F.lit(20.0)).alias("least"), F.printf(F.lit("%.2f"), q).alias("fixed"))
