"""Language of every word by a linear-chain conditional random field, and of documents by its marginals.

Words of a document form one chain.  The score of a label at a word is a sum of learned weights of the
word's features: affixes (the first and last one to three bytes), n-grams (all pairs and triples of bytes,
the edges marked) and the lexicon (the word itself, if training saw it ``LEXICON`` times).  Learned
transitions tie neighbours, so that short and ambiguous words follow their surroundings, and a switch of
language within a text costs once.  Marginals come from forward-backward over whole documents, which runs
over blocks of ``BLOCK`` words at once: the product of a block's transfer matrices carries the messages from
block to block, so that a text of any length takes ``BLOCK`` vectorised steps and one step for each block.

The model is fitted on the driver by AdaGrad, on code-switched chains made of words of labelled documents:
at most ``TRAIN`` rows for each language, those whose ids hash lowest (a bounded sample of labelled rows; everything
else covers all rows).

A document's language has the largest sum of marginals; ``confidence`` is its share.  A document is rejected
if it has no word with a letter, or if that share is under ``LEAST_SHARE``.

Cases: null and empty texts are rejected with a null language.  Without a single labelled row no language is
known: the language is null everywhere and nothing is rejected.  Ties go to the language that sorts first.
Repeated rows each give a row.  Rows with a null ``doc_id`` are judged too.  ``doc_id``, ``text`` and (for
training) ``lang`` are read; other columns may have any name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Texts, mix, prepare, steps, table

TRAIN = 150
BLOCK = 32
LEXICON = 3
BUCKETS = 1 << 16
LEAST_SHARE = 0.5


# ---------------------------------------------------------------- features


def features(t: Texts, start: np.ndarray, end: np.ndarray, h: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, owning word), sorted by word.  Words without a letter have none."""
    raw, n = t.folded, len(start)
    size = end - start
    letter = np.r_[0, np.cumsum((raw >= 97))]
    lettered = letter[end] > letter[start]
    out, own = [], []

    def add(kind: int, code: np.ndarray, who: np.ndarray) -> None:
        code = code.astype(np.uint64) * np.uint64(16) + np.uint64(kind)
        out.append((mix(code) % np.uint64(BUCKETS)).astype(np.int32))
        own.append(who)

    every = np.flatnonzero(lettered)
    b = raw.astype(np.uint32)
    for k in (1, 2, 3):
        has = every[size[every] >= k]
        s, e = start[has], end[has]
        first, last = b[s].copy(), b[e - k].copy()
        for j in range(1, k):
            first = first * 256 + b[s + j]
            last = last * 256 + b[e - k + j]
        add(k, first, has)
        add(3 + k, last, has)
    # edge-marked pairs and triples: positions -1..size, where the edges count as byte 1
    span = np.where(lettered, size + 1, 0)
    who = np.repeat(np.arange(n), span)
    at = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)  # 0: edge and first byte
    s, m = start[who], size[who]
    top = max(len(raw) - 1, 0)
    left = np.where(at == 0, 1, b[np.maximum(s + at - 1, 0)])
    right = np.where(at == m, 1, b[np.minimum(s + at, top)])
    add(7, left * 256 + right, who)
    third = np.where(at + 1 >= m, 1, b[np.minimum(s + at + 1, top)])
    ok = at < m
    add(8, ((left * 256 + right) * 256 + third)[ok], who[ok])
    if len(lexicon):
        k = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        known = np.flatnonzero((lexicon[k] == h) & lettered)
        add(9, h[known] >> np.uint64(8), known)
    out, own = np.concatenate(out), np.concatenate(own)
    o = np.argsort(own, kind="stable")
    return out[o], own[o]


def sums(weights: np.ndarray, f: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Sum of the weights of each word's features."""
    got = np.zeros((n, weights.shape[1]), np.float32)
    if len(f):
        lead = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        got[own[lead]] = np.add.reduceat(weights[f], lead, axis=0)
    return got


# ---------------------------------------------------------------- inference


def marginals(score: np.ndarray, trans: np.ndarray, edge: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior of each label at each word, for chains [edge[i], edge[i + 1]) of words.

    The message before a chain's first word is uniform.
    """
    n, k = score.shape
    if not n:
        return np.zeros((0, k))
    e = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(trans - trans.max()).astype(np.float64)
    size = np.diff(edge)
    blocks = -(-size // block)
    total = int(blocks.sum())
    chain = np.repeat(np.arange(len(size)), blocks)
    order = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = edge[:-1][chain] + order * block
    length = np.minimum(block, edge[1:][chain] - begin)
    slot = begin[:, None] + np.arange(block)[None, :]
    live = np.arange(block)[None, :] < length[:, None]
    em = e[np.minimum(slot, n - 1)]  # (blocks, block, k)
    # transfer matrix of each block
    p = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(block):
        step = (p @ a) * em[:, t, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        p = np.where(live[:, t, None, None], step, p)
    # messages into each block: all chains at once, block by block
    into = np.full((total, k), 1.0 / k)
    outof = np.ones((total, k))
    first = np.cumsum(blocks) - blocks
    for o in range(1, int(blocks.max()) if len(blocks) else 0):
        now = first[blocks > o] + o
        v = np.einsum("bi,bij->bj", into[now - 1], p[now - 1])
        into[now] = v / v.sum(axis=1, keepdims=True)
    for o in range(int(blocks.max()) - 2 if len(blocks) else -1, -1, -1):
        now = first[blocks > o + 1] + o
        v = np.einsum("bij,bj->bi", p[now + 1], outof[now + 1])
        outof[now] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((total, block, k))
    v = into
    for t in range(block):
        step = (v @ a) * em[:, t]
        step /= step.sum(axis=1, keepdims=True)
        v = np.where(live[:, t, None], step, v)
        alpha[:, t] = v
    v = outof
    for t in range(block - 1, -1, -1):
        alpha[:, t] *= v
        step = (em[:, t] * v) @ a.T
        step /= step.sum(axis=1, keepdims=True)
        v = np.where(live[:, t, None], step, v)
    g = alpha[live]
    return g / g.sum(axis=1, keepdims=True)


# ---------------------------------------------------------------- training


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, lexicon: np.ndarray) -> None:
        self.labels, self.weights, self.trans, self.lexicon = labels, weights, trans, lexicon

    def words(self, t: Texts) -> np.ndarray:
        """Marginals of all words of ``t``; scores are summed once for each distinct word."""
        h = t.hashes(t.start, t.end)
        _, first, inv = np.unique(h, return_index=True, return_inverse=True)
        f, own = features(t, t.start[first], t.end[first], h[first], self.lexicon)
        return marginals(sums(self.weights, f, own, len(first))[inv], self.trans, t.words_of())


def train(rows: list[tuple[str, str]], seed: int = 7, chains: int = 4000, length: int = 48, epochs: int = 3) -> Model | None:
    """Fit on (text, language) rows; ``None`` if there are none."""
    rows = [(x, y) for x, y in rows if x and y]
    labels = sorted({y for _, y in rows})
    t = Texts(pa.array([x for x, _ in rows], pa.string()))
    if not labels or not len(t.start):
        return None
    k = len(labels)
    rng = np.random.default_rng(seed)
    h = t.hashes(t.start, t.end)
    u, first, inv, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    lexicon = u[n >= LEXICON]
    f, own = features(t, t.start[first], t.end[first], u, lexicon)
    edge = np.searchsorted(own, np.arange(len(u) + 1))
    label = np.array([labels.index(y) for _, y in rows])[t.doc]
    by = [np.flatnonzero(label == c) for c in range(k)]
    # code-switched chains: runs of neighbouring words of one language, then of another
    word = np.zeros((chains, length), np.int64)
    gold = np.zeros((chains, length), np.int64)
    for c in range(chains):
        at = 0
        while at < length:
            y = int(rng.integers(k))
            run = min(length - at, int(rng.geometric(1 / 16)))
            if len(by[y]) == 0:
                continue
            s = int(rng.integers(len(by[y])))
            take = by[y][np.arange(s, s + run) % len(by[y])]
            word[c, at : at + run], gold[c, at : at + run] = inv[take], y
            at += run
    w, trans = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))
    gw, gt = np.full((BUCKETS, k), 1e-3, np.float32), np.full((k, k), 1e-3)
    size = 200
    for _ in range(epochs):
        for at in range(0, chains, size):
            x, y = word[at : at + size], gold[at : at + size]
            b = len(x)
            some, back = np.unique(x, return_inverse=True)
            lens = edge[some + 1] - edge[some]
            ff = f[np.repeat(edge[some] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
            oo = np.repeat(np.arange(len(some)), lens)
            score = sums(w, ff, oo, len(some))[back.reshape(x.shape)]
            e, a = np.exp(score - score.max(axis=2, keepdims=True)).astype(float), np.exp(trans)
            alpha, beta, v = np.empty((b, length, k)), np.ones((b, length, k)), np.full((b, k), 1 / k)
            for i in range(length):
                v = (v @ a) * e[:, i]
                v /= v.sum(axis=1, keepdims=True)
                alpha[:, i] = v
            for i in range(length - 2, -1, -1):
                v = (e[:, i + 1] * beta[:, i + 1]) @ a.T
                beta[:, i] = v / v.sum(axis=1, keepdims=True)
            g = alpha * beta
            g /= g.sum(axis=2, keepdims=True)
            pair = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            dt = pair.sum(axis=(0, 1))
            np.subtract.at(dt, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            g[np.arange(b)[:, None], np.arange(length)[None, :], y] -= 1
            per = np.zeros((len(some), k))
            np.add.at(per, back.ravel(), g.reshape(-1, k))
            used, where = np.unique(ff, return_inverse=True)
            d = np.zeros((len(used), k))
            np.add.at(d, where, per[oo])
            d = d / b + 1e-4 * w[used]
            gw[used] += d * d
            w[used] -= 0.3 * d / np.sqrt(gw[used])
            dt = dt / (b * 4)
            gt += dt * dt
            trans -= 0.3 * dt / np.sqrt(gt)
    return Model(labels, w, trans, lexicon)


def sample(docs: DataFrame, most: int = TRAIN) -> list[tuple[str, str]]:
    """At most ``most`` labelled rows for each language: those whose ids hash lowest, whatever the partitioning.

    Two passes: the hashes that count are found without the texts, then the texts of these rows are read.
    """
    if "lang" not in docs.columns:
        return []
    lang = F.col("lang").cast("string")
    src = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), lang.alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null and lang is not null and lang <> ''")
    place = lambda *by: F.row_number().over(Window.partitionBy("lang").orderBy(*by))  # noqa: E731 - limited in each group before the shuffle
    top = src.select("h", "lang").withColumn("n", place("h")).where(F.col("n") <= most).groupBy("lang").agg(F.max("h").alias("last")).collect()
    if not top:
        return []
    wanted = functools.reduce(lambda a, b: a | b, ((F.col("lang") == r.lang) & (F.col("h") <= r["last"]) for r in top))
    rows = src.where(wanted).withColumn("n", place("h", "text")).where(F.col("n") <= most).orderBy("lang", "n").collect()
    return [(r.text, r.lang) for r in rows]


# ---------------------------------------------------------------- operators


def languages(docs: DataFrame, model: Model | None = None, least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, lang, confidence, n_words, n_switches, kept) for every row.

    ``n_words`` counts words with a letter, ``n_switches`` neighbouring words whose likeliest labels differ.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model or train(sample(docs)))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                lang, share, words, switches, kept = judge(b.column("text"), shared.value, least)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lang, share, words, switches, kept], ["doc_id", "lang", "confidence", "n_words", "n_switches", "kept"])

    return src.mapInArrow(run, "doc_id long, lang string, confidence double, n_words long, n_switches long, kept boolean")


def judge(texts: pa.Array, model: Model | None, least: float) -> tuple[pa.Array, ...]:
    t = Texts(texts.fill_null(""))
    n = len(texts)
    letter = np.r_[0, np.cumsum(t.folded >= 97)]
    lettered = letter[t.end] > letter[t.start]
    words = np.bincount(t.doc[lettered], minlength=n)
    if model is None:
        return pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.array(words), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, bool))
    g = model.words(t)
    k = len(model.labels)
    mass = np.zeros((n, k))
    for c in range(k):
        mass[:, c] = np.bincount(t.doc[lettered], weights=g[lettered, c], minlength=n)
    best = mass.argmax(axis=1)
    none = words == 0
    share = mass[np.arange(n), best] / np.maximum(words, 1)
    label = g.argmax(axis=1)
    change = (label[1:] != label[:-1]) & (t.doc[1:] == t.doc[:-1]) if len(label) else np.zeros(0, bool)
    switches = np.bincount(t.doc[1:][change], minlength=n) if len(label) else np.zeros(n, np.int64)
    lang = pa.array(np.array(model.labels, object)[best], pa.string(), mask=none)
    return lang, pa.array(share, mask=none), pa.array(words), pa.array(switches.astype(np.int64)), pa.array(~none & (share >= least))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rejected documents, judged where they are read: no join, no shuffle."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(train(sample(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                yield b.filter(judge(b.column("text").cast(pa.string()), shared.value, LEAST_SHARE)[-1])

    return docs.mapInArrow(run, docs.schema)
