"""Search queries: ``documents`` is the corpus, its text the field ``body``, lang and source keyword fields."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.analysis import STOP_WORDS, Analyzer, KeywordAnalyzer, field_terms, tokens, words
from quillspark.functions.similarity import BM25, Similarity, TfIdf
from quillspark.functions.stemmer import stemmed
from quillspark.operators.documents import prepare
from quillspark.operators.index import FieldType, Index, IndexSpec, build_index
from quillspark.operators.search import Searcher, SearchService
from quillspark.plans.parser import QueryParser
from quillspark.plans.query import BooleanQuery, MatchAllQuery, PhraseQuery, PrefixQuery, Query, TermQuery
from quillspark.sources import store

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}
SPEC = IndexSpec({"body": FieldType.TEXT, "lang": FieldType.KEYWORD, "source": FieldType.KEYWORD})


def register(name: str, oracle: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("body",)) -> Index:
    """The index of documents, built once for a session and opened by every query."""
    source = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    docs = source.select("doc_id", F.col("text").alias("body"), "lang", "source")
    return store.stored_index(source, SPEC, docs).only(list(fields))


# ---- SQL building blocks

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RE = r"'[\p{L}\p{Nd}]+'"
_TOK = f"""tok AS (SELECT doc_id, lower(unnest(m)) AS term, unnest(range(len(m))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, {_RE}) AS m FROM documents)),
kept AS (SELECT * FROM tok WHERE term NOT IN ({_STOP})),
post AS (SELECT doc_id, term, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM kept GROUP BY doc_id, term),
len AS (SELECT doc_id, count(*) AS len FROM kept GROUP BY doc_id)"""


def _scored(n: str = "(SELECT count(*) FROM documents)", score: str | None = None, live: str = "") -> str:
    s = score or "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgl))"
    return f"""{_TOK},
st AS (SELECT (SELECT avg(len) FROM len) AS avgl, {n} AS n),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT doc_id, term, {s} AS s FROM post JOIN len USING (doc_id) JOIN df USING (term), st {live})"""


BM25_CTE = _scored()


def _phrase(name: str, terms: list[str]) -> str:
    """CTE name(doc_id, s) of a phrase."""
    froms = " JOIN ".join(f"post p{i}" + (f" ON p{i}.doc_id = p0.doc_id AND p{i}.term = '{t}'" if i else "") for i, t in enumerate(terms))
    inner = "p0.positions"
    for i in range(1, len(terms)):
        inner = f"list_intersect({inner}, list_transform(p{i}.positions, lambda x: x - {i}))"
    idf = " + ".join(f"(SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM df, st WHERE term = '{t}')" for t in terms)
    return f"""{name} AS (SELECT doc_id, ({idf}) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgl)) AS s FROM (SELECT p0.doc_id, len({inner}) AS f FROM {froms} WHERE p0.term = '{terms[0]}') JOIN len USING (doc_id), st WHERE f > 0)"""


def _out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


# ---- analysis


@register("tokenize_counts", f"WITH {_TOK} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM tok GROUP BY doc_id")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.transform(words(F.col("text")), F.lower)
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms")).where("n_tokens > 0")


@register("token_positions", f"WITH {_TOK} SELECT doc_id, term, pos FROM tok")
def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(words(F.col("text")), F.lower)).alias("pos", "term")).select("doc_id", "term", F.col("pos").cast("long").alias("pos"))


@register("token_offsets", f"""WITH o AS (SELECT item_id, m, regexp_split_to_array(text, {_RE}) AS g FROM (SELECT item_id, text, regexp_extract_all(text, {_RE}) AS m FROM benchmark)),
e AS (SELECT item_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM o)
SELECT item_id, lower(m[i]) AS term, (len(array_to_string(g[1:i], '')) + len(array_to_string(m[1:i-1], '')))::bigint AS start, (len(array_to_string(g[1:i], '')) + len(array_to_string(m[1:i], '')))::bigint AS "end" FROM e""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.explode(tokens(F.col("text"))).alias("t")).select("item_id", "t.term", F.col("t.start").cast("long").alias("start"), F.col("t.end").cast("long").alias("end"))


@register("analyze_stopgap", f"WITH {_TOK} SELECT doc_id, term, pos FROM kept")
def analyze_stopgap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(Analyzer().kept(F.col("text"))).alias("x")).select("doc_id", "x.term", F.col("x.r").cast("long").alias("pos"))


@register("keyword_tokens", "SELECT doc_id, lang AS term FROM documents WHERE lang <> '' UNION ALL SELECT doc_id, source FROM documents WHERE source <> ''")
def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(KeywordAnalyzer().terms(F.col("lang")), KeywordAnalyzer().terms(F.col("source")))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(both).alias("term"))


@register("stem_terms")
def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the distinct terms: one row for each, stemmed after the aggregation."""
    distinct = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(Analyzer().terms(F.col("text"))).alias("term")).distinct()
    return distinct.select("term", stemmed(F.array("term"))[0].alias("stem"))


@register("analyze_stemmed")
def analyze_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", Analyzer(stemming=True).terms(F.col("text")).alias("terms"))


# ---- index


@register("postings", f"WITH {_TOK} SELECT doc_id, term, tf, positions FROM post")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).postings.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("positions").cast("array<long>").alias("positions"))


@register("doc_freq", f"WITH {_TOK} SELECT term, count(*) AS df FROM post GROUP BY term")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).dictionary().select("term", "df")


@register("total_term_freq", f"WITH {_TOK} SELECT term, sum(tf)::bigint AS ttf FROM post GROUP BY term")
def total_term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).dictionary().select("term", "ttf")


@register("term_dictionary", f"WITH {_TOK} SELECT 'body' AS field, term, count(*) AS df, sum(tf)::bigint AS ttf FROM post GROUP BY term UNION ALL SELECT 'lang', lang, count(*), count(*) FROM documents WHERE lang <> '' GROUP BY lang UNION ALL SELECT 'source', source, count(*), count(*) FROM documents WHERE source <> '' GROUP BY source")
def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, ("body", "lang", "source")).dictionary()


@register("fields_list", "SELECT unnest(['body', 'lang', 'source']) AS field")
def fields_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, ("body", "lang", "source")).field_names()


@register("terms_list", "SELECT DISTINCT lang AS term FROM documents WHERE lang <> ''")
def terms_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, ("lang",)).terms("lang")


@register("field_lengths", f"WITH {_TOK} SELECT d.doc_id, coalesce(len, 0) AS len FROM documents d LEFT JOIN len USING (doc_id)")
def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).lengths.select("doc_id", F.col("len").cast("long").alias("len"))


@register("avg_field_length", f"WITH {_TOK} SELECT 'body' AS field, sum(len)::bigint AS total_len, count(*) AS doc_count, round(avg(len), 6) AS avg_len FROM len")
def avg_field_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).field_stats().select("field", "total_len", "doc_count", F.round("avg_len", 6).alias("avg_len"))


@register("index_stats", "SELECT count(*) FILTER (lang <> 'de') AS num_docs, count(*) AS max_doc, count(*) FILTER (lang = 'de') AS num_deleted FROM documents")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, ("lang",)).delete_by_term("lang", "de").stats()


@register("posting_lookup", f"WITH {_TOK} SELECT doc_id, tf, positions FROM post WHERE term = 'thin'")
def posting_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).posting_list("body", "thin").select("doc_id", F.col("tf").cast("long").alias("tf"), F.col("positions").cast("array<long>").alias("positions"))


@register("stored_document", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 7")
def stored_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).document(7).select("doc_id", "lang", "source")


@register("multi_value_positions", f"""WITH v AS (SELECT conv_id, turn, regexp_extract_all(text, {_RE}) AS m FROM conversations),
t AS (SELECT conv_id, turn, lower(unnest(m)) AS term, unnest(range(len(m))) AS r FROM v),
k AS (SELECT * FROM t WHERE term NOT IN ({_STOP})),
reach AS (SELECT v.conv_id, v.turn, coalesce(max(r) + 1, 0) + 100 AS reach FROM v LEFT JOIN k USING (conv_id, turn) GROUP BY v.conv_id, v.turn),
base AS (SELECT conv_id, turn, coalesce(sum(reach) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM reach)
SELECT conv_id, term, (base + r)::bigint AS pos FROM k JOIN base USING (conv_id, turn)""")
def multi_value_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a document whose turns are the values of one field."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("values"))
    return c.select("conv_id", F.explode(field_terms(F.col("values"), Analyzer())).alias("x")).select("conv_id", "x.term", F.col("x.pos").cast("long").alias("pos"))


# ---- deletes

_DEAD = f"WITH {_TOK}, dead AS (SELECT doc_id FROM post WHERE term = 'thin')"


@register("delete_by_term", f"{_DEAD} SELECT doc_id FROM dead")
def delete_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).newly_deleted("body", "thin")


@register("df_with_deletes", f"WITH {_TOK} SELECT count(*) AS df FROM post WHERE term = 'thin'")
def df_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).delete_by_term("body", "thin").doc_frequency("body", "thin")


@register("bm25_after_delete", f"WITH {_scored("(SELECT count(*) FROM documents) - (SELECT count(*) FROM post WHERE term = 'thin')")} SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'erin' AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'thin')")
def bm25_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(Searcher(corpus(spark, sf_dir).delete_by_term("body", "thin")).matches(TermQuery("body", "erin")))


# ---- queries over body


def _matches(query: Query, spark: SparkSession, sf_dir: str, similarity: Similarity | None = None, fields: tuple[str, ...] = ("body",)) -> DataFrame:
    return _out(Searcher(corpus(spark, sf_dir, fields), similarity or BM25()).matches(query))


def _t(term: str) -> TermQuery:
    return TermQuery("body", term)


def _add(name: str, query: Query, oracle: str | None, similarity: Similarity | None = None, fields: tuple[str, ...] = ("body",)) -> None:
    register(name, oracle)(partial(_matches, query, similarity=similarity, fields=fields))


B = BooleanQuery.builder
_add("term_bm25", _t("thin"), f"WITH {BM25_CTE} SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'thin'")
_add("term_tfidf", _t("thin"), f"WITH {_scored(score='sqrt(tf) * pow(1 + ln(n / (df + 1)), 2) / sqrt(len)')} SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'thin'", TfIdf())
_add("term_bm25_params", _t("erin"), f"WITH {_scored(score='ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 3.0 / (tf + 2.0 * (0.6 + 0.4 * len / avgl))')} SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'erin'", BM25(2.0, 0.4))
_add("term_missing", _t("nosuchword"), f"WITH {BM25_CTE} SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'nosuchword'")
_add("bool_and", B().must(_t("thin")).must(_t("erin")).build(), f"WITH {BM25_CTE} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE term IN ('thin', 'erin') GROUP BY doc_id HAVING count(*) = 2")
_add("bool_or", B().should(_t("thin")).should(_t("erin")).build(), f"WITH {BM25_CTE} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE term IN ('thin', 'erin') GROUP BY doc_id")
_add("bool_not", B().must(_t("thin")).must_not(_t("erin")).build(), f"WITH {BM25_CTE} SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'thin' AND doc_id NOT IN (SELECT doc_id FROM sc WHERE term = 'erin')")
_add("bool_must_should", B().must(_t("thin")).should(_t("erin")).minimum_should_match(5).build(), f"WITH {BM25_CTE} SELECT a.doc_id, round(a.s + coalesce(b.s, 0), 6) AS score FROM (SELECT * FROM sc WHERE term = 'thin') a LEFT JOIN (SELECT * FROM sc WHERE term = 'erin') b USING (doc_id)")
_add("bool_msm", B().should(_t("thin")).should(_t("erin")).should(_t("than")).minimum_should_match(2).build(), f"WITH {BM25_CTE} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE term IN ('thin', 'erin', 'than') GROUP BY doc_id HAVING count(*) >= 2")
_add("bool_msm_too_many", B().should(_t("thin")).should(_t("erin")).minimum_should_match(3).build(), "SELECT doc_id, 0::double AS score FROM documents WHERE false")
_add("bool_duplicate", B().should(_t("thin")).should(_t("thin")).should(_t("erin")).minimum_should_match(2).build(), f"WITH {BM25_CTE}, c AS (SELECT doc_id, s, CASE WHEN term = 'thin' THEN 2 ELSE 1 END AS n FROM sc WHERE term IN ('thin', 'erin')) SELECT doc_id, round(sum(s * n), 6) AS score FROM c GROUP BY doc_id HAVING sum(n) >= 2")
_add("bool_nested", B().must(B().should(_t("thin")).should(_t("erin")).build()).must(_t("than")).must_not(_t("thor")).build(), f"""WITH {BM25_CTE}, o AS (SELECT doc_id, sum(s) AS s FROM sc WHERE term IN ('thin', 'erin') GROUP BY doc_id)
SELECT o.doc_id, round(o.s + a.s, 6) AS score FROM o JOIN sc a ON a.doc_id = o.doc_id AND a.term = 'than' WHERE o.doc_id NOT IN (SELECT doc_id FROM sc WHERE term = 'thor')""")
_add("bool_only_not", B().must_not(_t("thin")).build(), "SELECT doc_id, 0::double AS score FROM documents WHERE false")
_add("phrase_match", PhraseQuery("body", ["eriner", "thanea"]), f"WITH {BM25_CTE}, {_phrase('p', ['eriner', 'thanea'])} SELECT doc_id, round(s, 6) AS score FROM p")
_add("phrase_repeat_terms", PhraseQuery("body", ["der", "der"]), f"WITH {BM25_CTE}, {_phrase('p', ['der', 'der'])} SELECT doc_id, round(s, 6) AS score FROM p")
_add("phrase_three", PhraseQuery("body", ["anea", "eriner", "thanea"]), f"WITH {BM25_CTE}, {_phrase('p', ['anea', 'eriner', 'thanea'])} SELECT doc_id, round(s, 6) AS score FROM p")
_add("prefix_search", PrefixQuery("body", "thin"), f"WITH {BM25_CTE} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE starts_with(term, 'thin') GROUP BY doc_id")
_add("match_all", MatchAllQuery(2.5), "SELECT doc_id, 2.5::double AS score FROM documents")
_add("keyword_term", TermQuery("lang", "fr"), "SELECT doc_id, round(ln(1 + ((SELECT count(*) FROM documents) - (SELECT count(*) FROM documents WHERE lang = 'fr') + 0.5) / ((SELECT count(*) FROM documents WHERE lang = 'fr') + 0.5)) * 2.2 / (1 + 1.2), 6) AS score FROM documents WHERE lang = 'fr'", fields=("lang",))
_add("match_all_clause", B().must(MatchAllQuery()).should(_t("thin")).build(), f"WITH {BM25_CTE} SELECT d.doc_id, round(1 + coalesce(s, 0), 6) AS score FROM documents d LEFT JOIN (SELECT * FROM sc WHERE term = 'thin') USING (doc_id)")


@register("prefix_expand", f"WITH {_TOK} SELECT term, count(*) AS df FROM post WHERE starts_with(term, 'thin') GROUP BY term")
def prefix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).dictionary().where(F.col("term").startswith("thin")).select("term", "df")


@register("phrase_stopword_gap", f"WITH {BM25_CTE}, {_phrase('p', ['thin', 'erin'])} SELECT doc_id, round(s, 6) AS score FROM p")
def phrase_stopword_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap of a stop word counts in documents, not in the query."""
    return _matches(QueryParser("body").parse('"thin the erin"'), spark, sf_dir)


@register("match_all_topk", "SELECT doc_id, 1::double AS score FROM documents ORDER BY doc_id LIMIT 25")
def match_all_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(corpus(spark, sf_dir)).search(MatchAllQuery(), 25)


@register("topk_ties", f"WITH {BM25_CTE} SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'thin' ORDER BY round(s, 9) DESC, doc_id LIMIT 20")
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(Searcher(corpus(spark, sf_dir)).search(_t("thin"), 20))


@register("total_hits", f"WITH {_TOK} SELECT count(DISTINCT doc_id) AS total_hits FROM post WHERE term IN ('thin', 'erin')")
def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Searcher(corpus(spark, sf_dir)).total_hits(B().should(_t("thin")).should(_t("erin")).build())


# ---- query language


def _dsl(text: str, spark: SparkSession, sf_dir: str, default_and: bool = False, fields: tuple[str, ...] = ("body",)) -> DataFrame:
    return _matches(QueryParser("body", default_and=default_and).parse(text), spark, sf_dir, fields=fields)


def _add_dsl(name: str, text: str, oracle: str, **more: object) -> None:
    register(f"dsl_{name}", oracle)(partial(_dsl, text, **more))


_EMPTY = "SELECT doc_id, 0::double AS score FROM documents WHERE false"
_ONE = f"WITH {BM25_CTE} SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = '%s'"
_AND = f"WITH {BM25_CTE} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE term IN ('thin', 'erin') GROUP BY doc_id HAVING count(*) = 2"
_OR = f"WITH {BM25_CTE} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE term IN ('thin', 'erin') GROUP BY doc_id"
_NOT = f"WITH {BM25_CTE} SELECT doc_id, round(s, 6) AS score FROM sc WHERE term = 'thin' AND doc_id NOT IN (SELECT doc_id FROM sc WHERE term = 'erin')"
_LANG = "(ln(1 + ((SELECT count(*) FROM documents) - (SELECT count(*) FROM documents WHERE lang = 'fr') + 0.5) / ((SELECT count(*) FROM documents WHERE lang = 'fr') + 0.5)) * 2.2 / 2.2)"
_add_dsl("term", "Thin", _ONE % "thin")
_add_dsl("field", "lang:fr", f"SELECT doc_id, round({_LANG}, 6) AS score FROM documents WHERE lang = 'fr'", fields=("lang",))
_add_dsl("group", "(thin OR erin)", _OR)
_add_dsl("group_field", "body:(thin erin) AND lang:fr", f"WITH {BM25_CTE}, o AS (SELECT doc_id, sum(s) AS s FROM sc WHERE term IN ('thin', 'erin') GROUP BY doc_id) SELECT doc_id, round(s + {_LANG}, 6) AS score FROM o JOIN documents USING (doc_id) WHERE lang = 'fr'", fields=("body", "lang"))
_add_dsl("and", "thin AND erin", _AND)
_add_dsl("and_symbol", "thin && erin", _AND)
_add_dsl("or", "thin OR erin", _OR)
_add_dsl("or_symbol", "thin || erin", _OR)
_add_dsl("default_or", "thin erin", _OR)
_add_dsl("default_and", "thin erin", _AND, default_and=True)
_add_dsl("no_precedence", "than OR thin AND erin", f"WITH {BM25_CTE}, a AS (SELECT doc_id, sum(s) AS s FROM sc WHERE term IN ('thin', 'erin') GROUP BY doc_id HAVING count(*) = 2) SELECT a.doc_id, round(a.s + coalesce(b.s, 0), 6) AS score FROM a LEFT JOIN (SELECT * FROM sc WHERE term = 'than') b USING (doc_id)")
_add_dsl("plus_minus", "+thin -erin", _NOT)
_add_dsl("not", "thin NOT erin", _NOT)
_add_dsl("bang", "thin !erin", _NOT)
_add_dsl("hyphen", "thin-erin", _NOT)
_add_dsl("underscore", "thin_erin", _OR)
_add_dsl("star", "Thin*", f"WITH {BM25_CTE} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE starts_with(term, 'thin') GROUP BY doc_id")
_add_dsl("star_inside", "eriner*thanea", f"WITH {BM25_CTE}, {_phrase('p', ['eriner', 'thanea'])} SELECT doc_id, round(s, 6) AS score FROM p")
_add_dsl("lone_star", "* thin", _ONE % "thin")
_add_dsl("phrase", '"Eriner thanea"', f"WITH {BM25_CTE}, {_phrase('p', ['eriner', 'thanea'])} SELECT doc_id, round(s, 6) AS score FROM p")
_add_dsl("stop_word", "the thin", _ONE % "thin")
_add_dsl("stop_and", "thin AND the", _ONE % "thin")
_add_dsl("stop_group", "thin AND (the)", _EMPTY)
_add_dsl("blank", "   ", _EMPTY)
_add_dsl("keyword_boundary", "ANDthin ORerin", f"WITH {BM25_CTE} SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE term IN ('andthin', 'orerin') GROUP BY doc_id")
_add_dsl("nested_groups", "(thin AND (erin OR than)) -thor", f"""WITH {BM25_CTE}, o AS (SELECT doc_id, sum(s) AS s FROM sc WHERE term IN ('erin', 'than') GROUP BY doc_id)
SELECT o.doc_id, round(o.s + a.s, 6) AS score FROM o JOIN sc a ON a.doc_id = o.doc_id AND a.term = 'thin' WHERE o.doc_id NOT IN (SELECT doc_id FROM sc WHERE term = 'thor')""")


@register("dsl_canonical", "SELECT * FROM (VALUES ('((body:thin) -(body:erin))', 0), ('(+(body:\"thin erin\") +(lang:fr))', 1), ('body:thi*', 2), ('()', 3)) t(query, id)")
def dsl_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = QueryParser("body")
    return spark.createDataFrame([(str(p.parse(q)), i) for i, q in enumerate(["thin -erin", '"thin erin" AND lang:fr', "thi*", ""])], "query string, id int")


# ---- batches and service

_BATCH = f"""WITH {BM25_CTE}, q AS (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, {_RE}))) AS term FROM benchmark),
a AS (SELECT query_id, term, count(*) AS times FROM q WHERE term NOT IN ({_STOP}) GROUP BY ALL),
h AS (SELECT query_id, doc_id, sum(s * times) AS score FROM a JOIN sc USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10"""


@register("batch_search", _BATCH)
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("body").alias("field"), F.explode(Analyzer().terms(F.col("text"))).alias("term"))
    return Searcher(corpus(spark, sf_dir)).batch(q, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@register("hits_json", f"""WITH {BM25_CTE}, t AS (SELECT doc_id, s, row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS rank FROM sc WHERE term = 'thin')
SELECT rank, doc_id, round(s, 6) AS score, '{{"lang":"' || lang || '","source":"' || source || '"}}' AS fields FROM t JOIN documents USING (doc_id) WHERE rank <= 10""")
def hits_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Searcher(corpus(spark, sf_dir)).hits(_t("thin"), 10, ["lang", "source"])
    return h.select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"), "fields")


@register("service_blank_query", "SELECT doc_id, 1::double AS score FROM documents ORDER BY doc_id LIMIT 10")
def service_blank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SearchService(corpus(spark, sf_dir), "body")
    return Searcher(s.index).search(s.query("  "), 10)


@register("short_text_search", f"""WITH t AS (SELECT p_partkey AS doc_id, lower(unnest(regexp_extract_all(p_name, {_RE}))) AS term FROM part), k AS (SELECT * FROM t WHERE term NOT IN ({_STOP})),
l AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1), w AS (SELECT term FROM k GROUP BY term ORDER BY count(DISTINCT doc_id) DESC, term LIMIT 1),
p AS (SELECT doc_id, count(*) AS tf FROM k WHERE term = (SELECT term FROM w) GROUP BY 1)
SELECT doc_id, round(ln(1 + ((SELECT count(*) FROM part) - (SELECT count(*) FROM p) + 0.5) / ((SELECT count(*) FROM p) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(n) FROM l))), 6) AS score FROM p JOIN l USING (doc_id)""")
def short_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent word of the part names."""
    ix = build_index(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("name")), IndexSpec({"name": FieldType.TEXT}))
    top = ix.dictionary().orderBy(F.desc("df"), "term").first()
    return _out(Searcher(ix).matches(TermQuery("name", top.term)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over documents: an optional pair and an exclusion, best ten with rank."""
    q = QueryParser("body").parse("thin erin -thor")
    top = Searcher(corpus(spark, sf_dir)).search(q, 10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "doc_id")))
