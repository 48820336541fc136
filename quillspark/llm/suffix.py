"""Repeated passages by a distributed, common-prefix-aware merge sort of suffixes.

A window is ``PASSAGE`` consecutive words of one row (words as in ``common.Texts``, whatever stands between
them).  It is repeated if the same words stand at another place of the corpus.  The result has the union of
the repeated windows: spans (doc_id, start_word, end_word), the end exclusive.

*Which suffixes.*  Sorting a suffix for every word would sort far more than can decide anything.  Every
window chooses one of its ``GRAM``-word sequences, the one with the smallest hash, and equal windows choose
at the same place.  Only suffixes that start at a chosen place are sorted (about 2 of 27 words); for each of
them the windows that chose it are known.  A repeated window's suffix shares its first ``GRAM`` words with
another, so suffixes whose first ``GRAM`` words are unique drop out before any text moves, by the count of
their hashes.  Both reductions lose no repeated window.

*The sort.*  Tasks sort the suffixes that are left, as far as the last of their windows reaches, into runs
and front-code these (length of the prefix shared with the predecessor, then the rest).  What a run proves
repeated by itself it decides, and sends one representative on, so that a passage with very many copies
doesn't meet in one place.  Splitters from a sample of the runs cut each run into ranges, the pieces of a
range move to one task, and a loser tree merges them: a node keeps the length of the prefix that the loser
shares with the winner, two entries with different lengths are ordered without looking at their bytes, and
equal ones are compared from there on; the front code gives the length for the next entry of the winning run.
Neighbours in the merged order that share ``GRAM`` words form a group, and within the groups a window is
repeated if its hash occurs twice.

Cases: null texts and texts under ``PASSAGE`` words have no window.  Rows with a null ``doc_id`` are left out.
Repeated rows of one ``doc_id`` are copies of each other.  A passage that repeats within one text counts.
Only ``doc_id`` and ``text`` are read.  There is no cap on the copies of a passage.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Ranges, Texts, mix, prepare, steps, table, written

PASSAGE = 50
GRAM = 25
RUN = 40_000
SAMPLE_BYTES = 48
#: Bytes of text within which a task finds repeated sequences by itself.
GROUP = 8 << 20
#: Suffixes that one range has on average.
RANGE = 40_000
#: Sampled keys that come to the driver for the splitters, about.
DRAWN = 1_000_000


class Words:
    """Word hashes of some texts, their sequences and the places that windows choose."""

    def __init__(self, texts: pa.Array, passage: int, gram: int) -> None:
        self.t = t = Texts(texts)
        self.passage, self.gram = passage, gram
        self.edge = t.words_of()
        n = len(t.start)
        self.h = t.hashes(t.start, t.end) if n else np.zeros(0, np.uint64)
        self.ranges = Ranges(self.h, wide=True)

    def sequences(self, start: np.ndarray, words: int) -> np.ndarray:
        return self.ranges.of(start, start + words)

    def chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, first window, last window, hash of the sequence at the place), as word offsets of all texts."""
        n, t = len(self.h), self.t
        none = np.zeros(0, np.int64)
        windows = n - self.passage + 1
        if windows <= 0:
            return none, none, none, np.zeros(0, np.uint64)
        g = self.sequences(np.arange(n - self.gram + 1), self.gram)
        span = self.passage - self.gram + 1  # sequences in a window
        # the leftmost smallest of span neighbours by doubling
        at, width = np.arange(len(g)), 1
        while width * 2 <= span:
            a, b = at[:-width], at[width:]
            at = np.where(g[b] < g[a], b, a)
            width *= 2
        if width < span:
            a, b = at[: len(at) - (span - width)], at[span - width :]
            at = np.where(g[b] < g[a], b, a)
        at = at[:windows]
        i = np.flatnonzero(t.doc[:windows] == t.doc[self.passage - 1 :])
        at = at[i]
        if not len(i):
            return none, none, none, np.zeros(0, np.uint64)
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (i[1:] != i[:-1] + 1)])
        last = np.r_[new[1:], len(i)] - 1
        return at[new], i[new], i[last], g[at[new]]


def _pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def _unpack(b: bytes):  # noqa: ANN202
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))  # noqa: S301 - written by this job


def shared(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, of which h bytes are known."""
    m = min(len(a), len(b))
    step = 32
    while h < m:
        if a[h : h + step] == b[h : h + step]:
            h = min(m, h + step)
            step *= 2
        elif step == 1:
            return h
        else:
            step //= 2
    return h


def front_code(sorted_suffixes: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    lcp, rest, prev = np.zeros(len(sorted_suffixes), np.int32), [], b""
    for k, x in enumerate(sorted_suffixes):
        n = shared(prev, x, 0)
        lcp[k] = n
        rest.append(x[n:])
        prev = x
    return lcp, rest


def front_decode(lcp: np.ndarray, rest: list[bytes]) -> Iterator[bytes]:
    prev = b""
    for n, x in zip(lcp.tolist(), rest, strict=True):
        prev = prev[:n] + x
        yield prev


def merge(runs: list[tuple[np.ndarray, list[bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, position in it, bytes shared with the predecessor, suffix) in sorted order, by a loser tree."""
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    lcps = [r[0].tolist() for r in runs]
    rests = [r[1] for r in runs]
    cur: list[bytes | None] = [None] * size
    have = [-1] * size  # bytes shared with the last output; -1: the run is at its end
    pos = [0] * size
    for s in range(k):
        if rests[s]:
            cur[s], have[s] = rests[s][0], 0
    loser = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        w, loser[node] = play(a, b)
        return w

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = have[a], have[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = cur[a], cur[b]
        h = shared(p, q, x)
        if p[h : h + 1] <= q[h : h + 1]:
            have[b] = h
            return a, b
        have[a] = h
        return b, a

    win = build(1) if size > 1 else 0
    while have[win] >= 0:
        s = win
        yield s, pos[s], have[s], cur[s]
        pos[s] += 1
        n = pos[s]
        if n < len(rests[s]):
            h = lcps[s][n]
            cur[s] = cur[s][:h] + rests[s][n]
            have[s] = h
        else:
            have[s] = -1
        node = (s + size) >> 1
        while node:
            o = loser[node]
            x, y = have[win], have[o]
            if x == y:
                w, loser[node] = play(win, o)
                win = w
            elif y > x:
                loser[node], win = win, o
            node >>= 1


def _ranges(doc: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flagged windows as (doc, first, last) of neighbours."""
    if not len(doc):
        return doc, window, window
    o = np.lexsort((window, doc))
    d, w = doc[o], window[o]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] > w[:-1] + 1)])
    return d[new], w[new], w[np.r_[new[1:], len(d)] - 1]


def _twice(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: does it occur again, and is this its first place?"""
    _, first, inv, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    lead = np.zeros(len(h), bool)
    lead[first] = True
    return n[inv] > 1, lead


def places(docs: DataFrame, passage: int, gram: int) -> DataFrame:
    """(h, doc_id, place, first, last) of the suffixes whose first words occur at least twice.

    A group of ``GROUP`` bytes of text sends one place of each hash to the count, keyed by the hash; the others of the
    group are known to be repeated and are spread by themselves, so no boilerplate gathers in one task.
    """

    def group(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, ids, at, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
        again, lead = _twice(h)
        key = np.where(lead, h, mix(h ^ np.arange(len(h), dtype=np.uint64) ^ ids.astype(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(lead), pa.array(again), pa.array(h.view(np.int64)), pa.array(ids), *(pa.array(x.astype(np.int32)) for x in (at, lo, hi))], ["key", "lead", "again", "h", "doc_id", "place", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for b in steps(batch, "text"):
                w = Words(b.column("text"), passage, gram)
                at, lo, hi, h = w.chosen()
                doc = w.t.doc[at]
                base = w.edge[doc]
                held.append((h, b.column("doc_id").to_numpy(zero_copy_only=False)[doc], at - base, lo - base, hi - base))
                size += len(w.t.raw)
                if size >= GROUP:
                    yield group(held)
                    held, size = [], 0
        if held:
            yield group(held)

    found = docs.mapInArrow(run, "key long, lead boolean, again boolean, h long, doc_id long, place int, first int, last int")
    n = F.count(F.when(F.col("lead"), 1)).over(Window.partitionBy("key"))
    return found.withColumn("n", n).where("again or n > 1").select("h", "doc_id", "place", "first", "last")


def runs_of(docs: DataFrame, kept: DataFrame, passage: int, gram: int) -> DataFrame:
    """Sorted front-coded runs, one row each, and what each run proves by itself."""
    by_doc = kept.groupBy("doc_id").agg(F.collect_set(F.struct("place", "first", "last", "h")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffix: list[bytes] = []
        head: list[int] = []
        meta: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # doc_id, first window, windows
        hashes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            doc, lo, n = (np.concatenate(x) for x in zip(*meta, strict=True))
            h = np.concatenate(hashes)
            edge = np.r_[0, np.cumsum(n)]
            again, lead = _twice(h)
            owner = np.repeat(np.arange(len(n)), n)
            window = lo[owner] + np.arange(len(h)) - edge[owner]
            d, a, z = _ranges(doc[owner[again]], window[again])
            needed = np.zeros(len(n), bool)
            needed[owner[~again | lead]] = True
            order = [k for k in sorted(np.flatnonzero(needed).tolist(), key=suffix.__getitem__)]
            lcp, rest = front_code([suffix[k] for k in order])
            o = np.array(order, np.int64)
            block = (lcp, rest, np.array(head, np.int32)[o], doc[o], lo[o], n[o], [h[edge[k] : edge[k + 1]] for k in order])
            sample = [suffix[k][:SAMPLE_BYTES] for k in order[:: max(1, RANGE // 400)]]
            suffix.clear(), head.clear(), meta.clear(), hashes.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int64()), pa.array([_pack(block)], pa.binary()), pa.array([sample], pa.list_(pa.binary())), pa.array([d], pa.list_(pa.int64())), pa.array([a], pa.list_(pa.int32())), pa.array([z], pa.list_(pa.int32()))], ["n", "block", "sample", "doc", "lo", "hi"])

        for batch in batches:
            for b in steps(batch, "text"):
                w = Words(b.column("text"), passage, gram)
                p = b.column("places")
                rows = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(p)))
                flat = p.flatten()
                at, lo, hi, h = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                size = w.edge[rows + 1] - w.edge[rows]
                ok = (hi + passage <= size) & (at >= 0)  # rows of one doc_id may have different texts
                rows, at, lo, hi, h = rows[ok], at[ok] + w.edge[rows[ok]], lo[ok] + w.edge[rows[ok]], hi[ok] + w.edge[rows[ok]], h[ok]
                ok = w.sequences(at, gram) == h.view(np.uint64)
                rows, at, lo, hi = rows[ok], at[ok], lo[ok], hi[ok]
                if not len(at):
                    continue
                # the texts with one space between words
                length = w.t.end - w.t.start
                pos = np.r_[0, np.cumsum(length + 1)]
                clean = np.full(pos[-1], 32, np.uint8)
                inside = np.repeat(w.t.start - pos[:-1], length) + (np.arange(length.sum()) + np.repeat(np.arange(len(length)), length))
                clean[np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)] = w.t.folded[inside]
                data = clean.tobytes()
                n = hi - lo + 1
                win = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                hashes.append(w.sequences(win, passage))
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)[rows]
                meta.append((ids, (lo - w.edge[rows]).astype(np.int32), n.astype(np.int32)))
                suffix += [data[x:y] for x, y in zip(pos[at].tolist(), (pos[hi + passage] - 1).tolist(), strict=True)]
                head += (pos[at + gram] - 1 - pos[at]).tolist()
                if len(suffix) >= RUN:
                    yield flush()
        if suffix:
            yield flush()

    return docs.join(by_doc, "doc_id").mapInArrow(run, "n long, block binary, sample array<binary>, doc array<long>, lo array<int>, hi array<int>")


def _merged(runs: DataFrame, splitters: list[bytes]) -> DataFrame:
    """(doc_id, lo, hi): windows that the runs together prove repeated."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                lcp, rest, head, doc, lo, n, hashes = _unpack(block.as_py())
                suffixes = list(front_decode(lcp, rest))
                cut = [0, *(bisect.bisect_left(suffixes, s) for s in splitters), len(suffixes)]
                for r, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if a < z:
                        part = lcp[a:z].copy()
                        part[0] = 0
                        piece = (part, [suffixes[a], *rest[a + 1 : z]], head[a:z], doc[a:z], lo[a:z], n[a:z], np.concatenate(hashes[a:z]))
                        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([_pack(piece)], pa.binary())], ["range", "piece"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [_unpack(x.as_py()) for batch in batches for x in batch.column("piece")]
        if not pieces:
            return
        edges = [np.r_[0, np.cumsum(p[5])] for p in pieces]
        held: list[tuple[int, int]] = []
        last = 0
        windows = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([pieces[s][6][edges[s][k] : edges[s][k + 1]] for s, k in held])
            n = np.array([pieces[s][5][k] for s, k in held])
            owner = np.repeat(np.arange(len(n)), n)
            window = np.array([pieces[s][4][k] for s, k in held])[owner] + np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            again, _ = _twice(h)
            doc = np.array([pieces[s][3][k] for s, k in held], np.int64)
            d, a, z = _ranges(doc[owner[again]], window[again])
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], ["doc_id", "lo", "hi"])

        for s, k, same, _ in merge([(p[0], p[1]) for p in pieces]):
            head = int(pieces[s][2][k])
            if (same < head or same < last) and windows > 1 << 18:  # a new group
                yield flush()
                held, windows = [], 0
            held.append((s, k))
            windows += int(pieces[s][5][k])
            last = head
        if held:
            yield flush()

    parts = len(splitters) + 1
    moved = runs.select("block").mapInArrow(split, "range int, piece binary")
    return moved.repartitionById(parts, F.col("range")).mapInArrow(reduce, "doc_id long, lo int, hi int")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of the spans that repeated windows cover."""
    gram = min(gram, passage)
    spark = prepare(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    kept = written(places(src, passage, gram), "places")
    runs = written(runs_of(src, kept, passage, gram), "runs")
    n = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, n // RANGE)
    taken = runs.select(F.explode("sample").alias("s"))
    every = max(1, n // max(1, RANGE // 400) // min(parts * 200, DRAWN))
    drawn = sorted(bytes(r.s) for r in taken.where(F.pmod(F.xxhash64("s"), F.lit(every)) == 0).collect()) if parts > 1 else []
    splitters = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []
    alone = runs.select(F.explode(F.arrays_zip("doc", "lo", "hi")).alias("z")).select(F.col("z.doc").alias("doc_id"), F.col("z.lo").alias("lo"), F.col("z.hi").alias("hi"))
    flagged = alone.unionByName(_merged(runs, splitters))
    w = Window.partitionBy("doc_id").orderBy("lo", "hi")
    seen = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("lo") <= F.col("seen") + passage, 0).otherwise(1)).over(w)
    spans = flagged.withColumn("seen", seen).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("lo").cast("long").alias("start_word"), (F.max("hi") + passage).cast("long").alias("end_word"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, words, unnest(range(len(words) - {PASSAGE - 1})) AS i FROM w WHERE len(words) >= {PASSAGE}),
h AS (SELECT doc_id, i, md5(array_to_string(words[i + 1 : i + {PASSAGE}], ' ')) AS m FROM p),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {PASSAGE} THEN 0 ELSE 1 END AS new FROM f),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT doc_id, min(i) AS start_word, max(i) + {PASSAGE} AS end_word, max(i) + {PASSAGE} - min(i) AS n_words FROM s GROUP BY doc_id, island
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
