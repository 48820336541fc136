"""Stateful and windowed operators, each as a batch and as a stream.

The rate limiter's windows start at a key's first request, not on a grid: a request at or after the window's end starts
the next one.  Streams carry (start, count) for each key; the batch form walks sorted requests.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(df: DataFrame, key: str, ts: str, request: str, most: int, window_us: int) -> DataFrame:
    """(key, request, allowed): at most ``most`` requests in each window of a key; ``most`` <= 0 allows everything.

    Tasks walk their keys' requests in order and hold one window's start and count, however long a history is.
    """
    if most <= 0:
        return df.select(key, request, F.lit(True).alias("allowed"))
    src = df.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(request).alias("request"))
    out = T.StructType([src.schema["key"], src.schema["request"], T.StructField("allowed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begin, n = object(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, t = batch.column("key"), batch.column("t").to_numpy(zero_copy_only=False)
            same = np.r_[False, np.asarray(pc.fill_null(pc.equal(keys[1:], keys[:-1]), False)) | (np.asarray(keys[1:].is_null()) & np.asarray(keys[:-1].is_null()))]
            edges = [*np.flatnonzero(~same).tolist(), batch.num_rows]
            rank = np.empty(batch.num_rows, np.int64)  # a request's number in its window
            for a, z in itertools.pairwise(edges):
                k = keys[a].as_py()
                if k != last:
                    last, begin, n = k, int(t[a]), 0
                while a < z:
                    end = a + int(np.searchsorted(t[a:z], begin + window_us))
                    rank[a:end] = n + 1 + np.arange(end - a)
                    n, a = n + end - a, end
                    if a < z:
                        begin, n = int(t[a]), 0
            yield pa.RecordBatch.from_arrays([keys, batch.column("request"), pa.array(rank <= most)], ["key", "request", "allowed"])

    return src.repartition("key").sortWithinPartitions("key", "t", "request").mapInArrow(run, out).select(F.col("key").alias(key), F.col("request").alias(request), "allowed")


def rate_limited_stream(stream: DataFrame, key: str, ts: str, request: str, most: int, window_us: int) -> DataFrame:
    """The same over a stream, in the order in which a trigger sees a key's requests by time."""
    schema = f"{key} long, {request} long, allowed boolean"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([ts, request])
        out = []
        for t, r in zip(rows[ts].astype("int64") // (1000 if rows[ts].dtype == "datetime64[ns]" else 1), rows[request], strict=True):
            if begin is None or t - begin >= window_us:
                begin, n = int(t), 0
            n += 1
            out.append((k[0], r, most <= 0 or n <= most))
        state.update((begin, n))
        yield pd.DataFrame(out, columns=[key, request, "allowed"])

    return stream.select(key, ts, request).groupBy(key).applyInPandasWithState(run, schema, "begin long, n long", "append", GroupStateTimeout.NoTimeout)


def windowed(df: DataFrame, ts: str, length: str, slide: str | None = None, keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding windows; with ``late`` also over streams."""
    src = df.withWatermark(ts, late) if late else df
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return src.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    src = df.withWatermark(ts, late) if late else df
    return src.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(stream: DataFrame, ids: list[str], ts: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def nearest_ranks(df: DataFrame, key: str, value: str, ps: list[float], accuracy: int = 10_000) -> DataFrame:
    """(key, p, value): exact nearest-rank percentiles, the value at place floor(p (n - 1) + 0.5) of a key's sorted ones.

    Sketches bracket each percentile to 8 / ``accuracy`` of the key's rows (a key of up to ``accuracy`` rows is taken whole).  One more pass counts what lies below a bracket,
    and values within it, so what is sorted is a small share of a key.  Rows without a value don't count.
    """
    src = df.select(F.col(key).alias("k"), F.col(value).alias("v")).where("v IS NOT NULL")
    low, high = ([min(1.0, max(0.0, p + d)) for p in ps] for d in (-4 / accuracy, 4 / accuracy))
    sketch = F.percentile_approx("v", low + high, accuracy)
    q = src.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), sketch.alias("q"))
    bound = lambda end, i: F.when(F.col("n") <= accuracy, F.col(end)).otherwise(F.col("q")[i])  # noqa: E731 - ranks are coarser than the sketch in a small key
    each = F.array(*(F.struct(F.lit(p).alias("p"), bound("least", i).alias("low"), bound("most", len(ps) + i).alias("high")) for i, p in enumerate(ps)))
    brackets = q.select(F.col("k").alias("key_"), "n", F.explode(each).alias("b")).select("key_", "n", "b.*")
    met = src.join(brackets, F.col("k").eqNullSafe(F.col("key_")) & (F.col("v") <= F.col("high")))
    counted = met.groupBy("k", "p", "n", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("k", "p").orderBy(F.asc_nulls_first("v")))
    at = counted.withColumn("upto", upto).withColumn("i", F.floor(F.col("p") * (F.col("n") - 1) + 0.5))
    return at.where("i < upto AND i >= upto - c AND v IS NOT NULL").select(F.col("k").alias(key), "p", F.col("v").alias(value))
