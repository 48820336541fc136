"""Queries for durability, streams, JSON, vectors and numeric optimization."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.catalog.search import _TOK, SPEC, corpus
from quillspark.functions import optimize as o
from quillspark.functions import text_json, varint, vectors
from quillspark.functions.analysis import Analyzer
from quillspark.operators import batches
from quillspark.operators.documents import prepare
from quillspark.operators.index import FieldType, IndexSpec
from quillspark.operators.search import Searcher
from quillspark.plans.query import TermQuery
from quillspark.sources import store, synthetic
from quillspark.sources.folders import Folder, scratch
from quillspark.sources.service import LiveService
from quillspark.streaming import events as ev

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


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# ---- durability


@register("segment_roundtrip", f"WITH {_TOK} SELECT doc_id, term, tf, positions FROM post")
def segment_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to a new segment on disk, and its postings back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), "lang", "source")
    p = store.build_segment(docs, IndexSpec({"body": FieldType.TEXT}), scratch(spark)).postings
    return p.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("positions").cast("array<long>").alias("positions"))


@register("segment_checksums", "SELECT * FROM (VALUES ('as written', 0, true), ('one file changed', 1, false)) t(state, damaged, opens)")
def segment_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment of all fields, verified on opening, before and after a file of it is overwritten."""
    docs, path, rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), "lang", "source"), scratch(spark), []
    store.build_segment(docs, SPEC, path)
    folder = Folder(spark, path)

    def note(state: str) -> None:
        try:
            opens = store.read_segment(spark, path, SPEC, verify=True) is not None
        except OSError:
            opens = False
        rows.append((state, store.damaged(spark, path).count(), opens))

    note("as written")
    name = next(n for n in folder.names("lengths") if n.endswith(".parquet"))
    folder.write(f"lengths/{name}", folder.read(f"lengths/{name}") + b"!")
    note("one file changed")
    return spark.createDataFrame(rows, "state string, damaged int, opens boolean")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mutations: an error deletes what its user has added so far."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "DELETE").otherwise("ADD").alias("op"), F.lit(None).cast("string").alias("doc"), F.lit("user").alias("field"), F.col("user_id").cast("string").alias("term"))


@register("wal_replay_order", "SELECT a.event_id AS seq, EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.user_id = a.user_id AND d.event_id > a.event_id) AS deleted FROM events a WHERE a.event_type <> 'error'")
def wal_replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.surviving(_log(spark, sf_dir))


@register("wal_torn_tail", "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'ADD' END AS op FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id % 997 = 500)")
def wal_torn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = _log(spark, sf_dir).withColumn("crc", store.record_crc() + F.when(F.col("seq") % 997 == 500, 1).otherwise(0))
    return store.sound(damaged).select("seq", "op")


@register("wal_torn_json", "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'ADD' END AS op FROM events WHERE event_id < 700")
def wal_torn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as files of a hundred lines each, one line of which is cut in half: replay ends before it."""
    made = _log(spark, sf_dir).withColumn("crc", store.record_crc())
    line = F.to_json(F.struct(*made.columns))
    lines = made.select("seq", F.when(F.col("seq") == 700, F.substring(line, 1, 20)).otherwise(line).alias("line"))
    files = lines.groupBy((F.floor(F.col("seq") / 100) * 100).alias("file")).agg(F.min("seq").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return store.sound(store.log_records(files.select("first", F.concat("text", F.lit("\n")).alias("text")))).select("seq", "op")


@register("live_service", "SELECT * FROM (VALUES ('added', 'body:fox', 3, 1), ('asked again', 'body:fox', 3, 1), ('deleted', 'body:fox', 2, 2), ('committed', 'body:fox', 2, 3)) t(step, query, hits, snapshots)")
def live_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service that adds, deletes and commits, and makes a snapshot only when a search needs one."""
    spec = IndexSpec({"id": FieldType.KEYWORD, "body": FieldType.TEXT})
    service = LiveService(store.DurableIndex(prepare(spark), scratch(spark), spec, "id string, body string"), "body")
    rows = []

    def note(step: str) -> None:
        query, total, _ = service.search("Fox")
        rows.append((step, query, total.first()[0], service.snapshots))

    service.add([{"id": f"d{i}", "body": "quick brown fox"} for i in range(3)])
    note("added")
    note("asked again")
    service.delete("id", "d1")
    note("deleted")
    service.commit()
    note("committed")
    return spark.createDataFrame(rows, "step string, query string, hits long, snapshots int")


@register("commit_generations", "SELECT * FROM (VALUES ('before commit', 0, 2, 3, 1), ('committed', 1, 2, 3, 1), ('reopened', 1, 3, 4, 1), ('second commit', 2, 3, 4, 1)) t(step, generation, num_docs, max_doc, num_deleted)")
def commit_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds, a delete, a commit, a reopening with a later add, and another commit."""
    spec = IndexSpec({"id": FieldType.KEYWORD, "body": FieldType.TEXT})
    make = lambda: store.DurableIndex(prepare(spark), path, spec, "id string, body string")
    path, rows = scratch(spark), []

    def note(step: str, ix: store.DurableIndex) -> None:
        s = ix.current().stats().first()
        rows.append((step, ix.generation, s.num_docs, s.max_doc, s.num_deleted))

    ix = make()
    ix.add_documents([{"id": f"d{i}", "body": "quick brown fox"} for i in range(3)])
    ix.delete_by_term("id", "d0")
    note("before commit", ix)
    ix.commit()
    note("committed", ix)
    ix.add_documents([{"id": "d0", "body": "again"}])
    ix = make()
    note("reopened", ix)
    ix.commit()
    note("second commit", ix)
    return spark.createDataFrame(rows, "step string, generation int, num_docs long, max_doc long, num_deleted long")


# ---- JSON


@register("json_parse_props", "SELECT event_id, (props->>'$.k')::bigint AS k, json_keys(props)::varchar[] AS keys FROM events")
def json_parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k long")
    return read(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.json_object_keys("props").alias("keys"))


_JSON = [("1", "long"), ("-2.5", "double"), ("1e3", "double"), ("true", "boolean"), ("null", "null"), ('"a\\u0041"', "string"), ("[1, [2]]", "array"), ('{"a": {"b": 1}}', "object"), ("{} x", None), ("[1,", None), ("", None)]


@register("json_types", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', " + (f"'{b}'" if b else "NULL") + ")" for a, b in _JSON) + ") t(json, kind)")
def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a, _ in _JSON], "json string").select("json", text_json.kind(F.col("json")).alias("kind"))


@register("json_write", """SELECT vec_id, '{"id":' || vec_id || ',"label":' || label || '}' AS json FROM embeddings""")
def json_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    nan = text_json.finite(F.lit(float("nan")))
    return read(spark, sf_dir, "embeddings").select("vec_id", text_json.written(F.struct(F.col("vec_id").alias("id"), F.col("label").alias("label"), nan.alias("lost"))).alias("json"))


# ---- events


_LIMIT = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, t AS begin, 1 AS n, i FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, CASE WHEN e.t - f.begin >= 86400000000 THEN e.t ELSE f.begin END, CASE WHEN e.t - f.begin >= 86400000000 THEN 1 ELSE f.n + 1 END, e.i FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, n <= 3 AS allowed FROM f"""


@register("rate_limit_fixed", _LIMIT)
def rate_limit_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a day and user, the day starting with the first one."""
    return ev.rate_limited(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 86_400_000_000)


@register("events_tumbling", """SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.windowed(read(spark, sf_dir, "events"), "ts", "1 hour", keys=("event_type",)).withColumn("total", F.round("total", 4))


@register("events_sliding", """SELECT s AS start, s + INTERVAL 1 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY s""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.windowed(read(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes").withColumn("total", F.round("total", 4))


@register("events_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(read(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@register("latency_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, p, value FROM r, (VALUES (0.5::double), (0.95), (0.99)) t(p) WHERE i = floor(p * (n - 1) + 0.5::double)""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.nearest_ranks(read(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.95, 0.99])


@register("varint_sizes", "SELECT event_id, CASE WHEN event_id < 128 THEN 1 WHEN event_id < 16384 THEN 2 WHEN event_id < 2097152 THEN 3 ELSE 4 END AS size, 5 AS negative FROM events")
def varint_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", varint.size(n).alias("size"), varint.size(-n - 1).alias("negative"))


# ---- vectors

_VEC = "(SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings) a, (SELECT list_transform(embedding, lambda x: x::double) AS u FROM embeddings WHERE vec_id = 0) b"


def _vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("v").alias("u"))))  # one row


@register("vector_dot", f"SELECT vec_id, round(list_dot_product(v, u), 6) AS dot FROM {_VEC}")
def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(spark, sf_dir).select("vec_id", F.round(vectors.dot(F.col("v"), F.col("u")), 6).alias("dot"))


@register("vector_norm", f"SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM {_VEC}")
def vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vec(spark, sf_dir).select("vec_id", F.round(vectors.norm(F.col("v")), 6).alias("norm"))


@register("vector_axpy", f"SELECT vec_id, list_transform(v, lambda x, i: round(0.5::double * x + u[i], 9)) AS sum, list_transform(v, lambda x, i: round(x - u[i], 9)) AS difference, list_transform(v, lambda x: 2 * x) AS doubled, list_transform(v, lambda x: -x) AS negated FROM {_VEC}")
def vector_axpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.transform(c, lambda x: F.round(x, 9))
    v, u = F.col("v"), F.col("u")
    return _vec(spark, sf_dir).select("vec_id", r(vectors.axpy(0.5, v, u)).alias("sum"), r(vectors.subtract(v, u)).alias("difference"), vectors.scale(2, v).alias("doubled"), vectors.negate(v).alias("negated"))


# ---- optimization


@register("simplex_solve", "SELECT * FROM (VALUES (1, 'OPTIMAL', 36.0::double), (2, 'OPTIMAL', 20.0), (3, 'INFEASIBLE', NULL), (4, 'UNBOUNDED', NULL), (5, 'OPTIMAL', 45.0)) t(lp, status, value)")
def simplex_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small programs, each solved where its row is."""
    programs = [(1, "max", [3.0, 5.0], [([1.0, 0.0], "<=", 4.0), ([0.0, 2.0], "<=", 12.0), ([3.0, 2.0], "<=", 18.0)]), (2, "min", [2.0, 3.0], [([1.0, 1.0], ">=", 10.0), ([1.0, 0.0], ">=", 8.0)]), (3, "max", [1.0], [([1.0], "<=", 1.0), ([1.0], ">=", 2.0)]), (4, "max", [1.0, 0.0], [([0.0, 1.0], "<=", 1.0)]), (5, "max", [5.0, 4.0, 4.0], [([1.0, 1.0, 1.0], "<=", 10.0), ([1.0, 0.0, 0.0], "<=", 5.0)])]
    schema = "lp int, sense string, c array<double>, rows array<struct<a:array<double>,rel:string,b:double>>"

    def solve(pdf):  # noqa: ANN001, ANN202
        out = []
        for r in pdf.itertuples():
            lp = o.LinearProgram(len(r.c))
            (lp.maximize if r.sense == "max" else lp.minimize)(r.c)
            for x in r.rows:
                lp.subject_to(x["a"], x["rel"], x["b"])
            s = o.simplex(lp)
            out.append((r.lp, s.status, round(s.value, 9) if s.status == "OPTIMAL" else None))
        return pdf.__class__(out, columns=["lp", "status", "value"])

    return prepare(spark).createDataFrame(programs, schema).groupBy("lp").applyInPandas(solve, "lp int, status string, value double")


def _moments(spark: SparkSession, sf_dir: str) -> tuple[float, ...]:
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return tuple(read(spark, sf_dir, "lineitem").agg(F.count("*").cast("double"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y), F.sum(y * y)).first())


def _least_squares(m: tuple[float, ...]) -> tuple[o.Value, o.Gradient]:
    n, sx, sy, sxx, sxy, syy = m
    a, b = np.array([[1, sx / n], [sx / n, sxx / n]]), np.array([sy / n, sxy / n])
    return lambda w: float(w @ a @ w - 2 * b @ w + syy / n), lambda w: 2 * (a @ w - b)


_FIT = "SELECT round(regr_intercept(l_extendedprice / 1000, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice / 1000, l_quantity), 3) AS slope FROM lineitem"


@register("lbfgs_minimize", _FIT)
def lbfgs_minimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of price against quantity: the objective's moments are one aggregation over the whole table."""
    r = o.lbfgs(*_least_squares(_moments(spark, sf_dir)), [0.0, 0.0])
    return spark.createDataFrame([(round(float(r.point[0]), 2), round(float(r.point[1]), 3))], "intercept double, slope double")


@register("gd_minimize", "SELECT 'quadratic' AS f, 3.0::double AS x, -1.0::double AS y")
def gd_minimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = o.gradient_descent(lambda w: float((w[0] - 3) ** 2 + 2 * (w[1] + 1) ** 2), lambda w: np.array([2 * (w[0] - 3), 4 * (w[1] + 1)]), [0.0, 0.0])
    return spark.createDataFrame([("quadratic", round(float(r.point[0]), 3), round(float(r.point[1]), 3))], "f string, x double, y double")


@register("coordinate_ascent", "SELECT 2.0::double AS x, 5.0::double AS y")
def coordinate_ascent(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = o.coordinate_ascent(lambda w: -((w[0] - 2) ** 2) - (w[1] - 5) ** 2, [0.0, 0.0])
    return spark.createDataFrame([(round(float(r.point[0]), 4), round(float(r.point[1]), 4))], "x double, y double")


def ndcg(scored: DataFrame, labels: DataFrame, ideal: DataFrame, k: int = 10) -> float:
    """Mean NDCG of (query_id, doc_id, score) with the labels' (doc_id, gain) over the queries of ``ideal`` (query_id, best), 0 for one without gain."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
    top = scored.withColumn("r", rank).where(F.col("r") <= k)  # k for each query
    known = labels.join(F.broadcast(top), "doc_id").dropDuplicates(["query_id", "r"])
    got = known.groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("r") + 1)).alias("got"))
    each = ideal.join(got, ideal["query_id"].eqNullSafe(got["query_id"]), "left").select(F.try_divide("got", "best").alias("ndcg"))
    return each.agg(F.avg(F.coalesce("ndcg", F.lit(0.0)))).first()[0] or 0.0


_PACKED = {"doc": np.int64, "gain": np.float64, "slot": np.int64, "owner": np.int64, "tf": np.float64, "len": np.float64, "idf": np.float64, "avg_len": np.float64}


def _pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of documents, arrays as bytes; a document's gain is that of its first posting."""
    for c in batches.chunks(rows):
        gain = np.empty(len(c.doc))
        gain[c.owner[::-1]] = c.values["gain"][::-1]
        parts = {"doc": c.doc, "gain": gain, "slot": c.slot, "owner": c.owner} | {n: c.values[n] for n in ("tf", "len", "idf", "avg_len")}
        yield pa.RecordBatch.from_arrays([pa.array([parts[n].astype(t).tobytes()], pa.binary()) for n, t in _PACKED.items()], list(_PACKED))


def _unpacked(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[batches.Chunk, np.ndarray]]:
    for b in rows:
        for i in range(b.num_rows):
            p = {n: np.frombuffer(b.column(n)[i].as_buffer(), t) for n, t in _PACKED.items()}
            yield batches.Chunk(p["doc"], p["slot"], p["owner"], p), p["gain"]


@register("tune_bm25")
def tune_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k1, b) by coordinate ascent on NDCG over all benchmark texts as queries, the gain being a document's quality label.

    The labelled documents' postings that the queries ask for are brought together once, in chunks of documents, and written; a
    trial of (k1, b) scores them where they are, and only the best of each chunk are ranked.  What the labels allow at best
    doesn't depend on the trial.
    """
    ix, k = corpus(spark, sf_dir), 10
    terms = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("body").alias("field"), F.explode(F.array_distinct(Analyzer().terms(F.col("text")))).alias("term"))
    asked = batches.Asked.of(terms.groupBy("query_id", "field", "term").agg(F.count("*").alias("times")).toArrow())
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("gain"))
    path = scratch(spark, "tuning")
    rows = Searcher(ix).slotted(asked).join(labels, "doc_id").select("doc_id", "slot", "tf", "len", "idf", "avg_len", "gain")
    batches.by_document(rows).mapInArrow(_pack, ", ".join(f"{n} binary" for n in _PACKED)).write.parquet(path)
    prepared = spark.read.parquet(path)
    seen: dict[tuple[float, float], float] = {}

    def gains(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for chunk, gain in _unpacked(rows):
            yield chunk, None, np.nan_to_num(gain, nan=-np.inf)

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    most = batches.best(prepared, asked, k, gains).withColumn("r", place)
    won = F.sum(F.when((F.col("r") <= k) & (F.col("score") > float("-inf")), F.col("score") / F.log2(F.col("r") + 1)))
    ideal = spark.createDataFrame(most.groupBy("query_id").agg(won.alias("best")).toArrow())  # a row for each query

    def value(x: np.ndarray) -> float:
        k1, b = float(x[0]), float(x[1])
        if k1 < 0 or not 0 <= b <= 1:
            return float("-inf")

        def scored(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for c, _ in _unpacked(rows):
                v = c.values
                known = v["avg_len"] > 0
                norm = np.where(known, 1 - b + b * v["len"] / np.where(known, v["avg_len"], 1.0), 1.0)
                yield c, v["idf"] * v["tf"] * (k1 + 1) / (v["tf"] + k1 * norm), None

        if (k1, b) not in seen:
            top = batches.best(prepared, asked, k, scored)
            seen[k1, b] = ndcg(top, labels, ideal, k)
        return seen[k1, b]

    r = o.coordinate_ascent(value, [1.2, 0.75], sweeps=2, tolerance=0.1, step=0.4)
    return spark.createDataFrame([(float(r.point[0]), float(r.point[1]), float(r.value), len(seen))], "k1 double, b double, ndcg double, evaluations int")


# ---- synthetic corpus


@register("synthetic_corpus")
def synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.corpus(spark, synthetic.DOCUMENTS)


@register("synthetic_batch")
def synthetic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harness's queries of all three kinds over its whole corpus, in one plan."""
    path = scratch(spark)
    store.build_segment(synthetic.corpus(spark, synthetic.DOCUMENTS), IndexSpec({"body": FieldType.TEXT}), path)
    q = synthetic.queries(spark).withColumn("field", F.lit("body"))
    return Searcher(store.read_segment(spark, path)).batch_pairs(q)


@register("delete_by_id", "SELECT count(*) - 1 AS num_docs, count(*) AS max_doc, 1 AS num_deleted FROM documents")
def delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = corpus(spark, sf_dir, ("lang",)).delete_document(3).delete_document(3)
    return ix.stats()


@register("delete_then_search", "SELECT doc_id FROM documents WHERE lang = 'fr' AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def delete_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = corpus(spark, sf_dir, ("lang", "source")).delete_by_term("source", "src3")
    return Searcher(ix).matches(TermQuery("lang", "fr")).select("doc_id")
