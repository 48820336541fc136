"""SimHash near-duplicates by a Gray-order hierarchical index.

Each document gets a 256-bit SimHash of its set of words.  Two documents are near copies if their
fingerprints differ in at most ``RADIUS`` bits; groups are the connected components of that relation,
and the smallest ``doc_id`` of a group stays.

*Search.*  Every pair within the radius is found, whatever the corpus.  Equal fingerprints collapse first.  The rest falls
into groups of about ``BLOCK`` by a hash of the id, and every two groups meet in some task.  There the bits are
cut into chunks, each with a threshold of its own; the thresholds and ones sum to more than the radius, so a pair
within it is within the threshold of some chunk (were it above in all, its differences would add up to more).  So
fingerprints with one chunk are a node, a node is compared with those nodes whose chunk differs by at most
the threshold, and what is below them is compared bit by bit.  ``chunks`` picks the cut that costs least for the size of a task,
down to all pairs for small ones.  A node of more than ``CROWD`` fingerprints, a cluster, goes down a hierarchy of Gray ranks
instead: runs of ``FANOUT`` become nodes, level by level, which keep a mask of the bits shared by everything below
and the pattern of these bits.  The join descends from (root, root): the differences between the shared bits of two nodes
are a lower bound for every pair below them, so one comparison discards whole groups; with all bits that
aren't shared they are an upper bound, so one comparison also accepts whole groups, without their pairs.

*Groups.*  Every task sends only a spanning forest of its pairs (at most one edge for each
fingerprint), and large-star/small-star rounds, each written to the checkpoint folder, join these.

Cases: a null or empty text, or one of white space only, has no fingerprint and is in no group.  A text
without any word has its trimmed characters as its only feature.  Repeated rows of one ``doc_id`` are one
document (the smallest fingerprint of its rows counts).  Rows with a null ``doc_id`` are left out.
Ties can't occur: ids order everything.  Only ``doc_id`` and ``text`` are read, so other columns may
have any name.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Texts, keep_rows, mix, prepare, steps, table, written

BITS = 256
RADIUS = 46
FANOUT = 8
#: Fingerprints of a group, tasks at least where there are several chunks, and fingerprints of a node that make it a cluster.
BLOCK, TASKS, CROWD = 1 << 20, 48, 1 << 11
#: Seconds, about, of comparing a pair bit by bit and of visiting a node; only the choice of a cut depends on them.
PAIR_S, NODE_S = 6e-9, 60e-6
_LANES = BITS // 64
_SALT = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    """(n, 4) uint64 lanes; all zero for texts without features."""
    texts = pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    t = Texts(texts)
    words = t.words_of()
    h = t.hashes(t.start, t.end) if len(t.start) else np.zeros(0, np.uint64)
    out = np.zeros((len(texts), _LANES), np.uint64)
    rows, parts = [], []
    for i in range(len(texts)):
        if words[i] < words[i + 1]:
            u = np.unique(h[words[i] : words[i + 1]])
        elif t.off[i] < t.off[i + 1]:
            u = t.hashes(t.off[i : i + 1], t.off[i + 1 : i + 2])
        else:
            continue
        rows.append(i)
        parts.append(u)
    # documents in small groups: the unpacked bits of a group stay in the processor's cache
    at = 0
    while at < len(rows):
        upto, n = at, 0
        while upto < len(rows) and (n == 0 or n + len(parts[upto]) <= 8192):
            n += len(parts[upto])
            upto += 1
        u = np.concatenate(parts[at:upto])
        sizes = np.array([len(p) for p in parts[at:upto]])
        bits = np.unpackbits(mix(u[:, None] ^ _SALT[None, :]).view(np.uint8), axis=1)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.stack([bits[a:b].sum(axis=0, dtype=np.uint32) for a, b in zip(edge[:-1], edge[1:], strict=True)])
        on = counts * 2 > sizes[:, None]
        out[rows[at:upto]] = np.packbits(on, axis=1).view(np.uint64)
        at = upto
    none = [i for i in rows if not out[i].any()]
    out[none] = 1  # zero means none
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Positions in the Gray sequence: each bit is the parity of the code's bits down to it, lane 0 highest."""
    r = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    carry = np.zeros(len(r), np.uint64)
    for k in range(r.shape[1]):
        r[:, k] ^= carry
        carry = np.where(r[:, k] & np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return r


def gray_code(rank: np.ndarray) -> np.ndarray:
    """The inverse of ``gray_rank``."""
    g = rank ^ (rank >> np.uint64(1))
    g[:, 1:] ^= rank[:, :-1] << np.uint64(63)
    return g


def _to_bytes(rank: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(rank), [None, pa.py_buffer(rank.astype(">u8").tobytes())]).cast(pa.binary())


def _from_bytes(col: pa.Array) -> np.ndarray:
    data = col.cast(pa.large_binary())
    off = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1 + data.offset)[data.offset :]
    return np.frombuffer(data.buffers()[2], np.uint8)[off[0] : off[-1]].view(">u8").reshape(-1, _LANES).astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, rank): the Gray rank of each document's fingerprint, 32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                f = fingerprints_of(b.column("text"))
                has = f.any(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(has)), _to_bytes(gray_rank(f[has]))], ["doc_id", "rank"])

    prepare(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return src.mapInArrow(run, "doc_id long, rank binary")


def plan(n: int) -> tuple[int, int]:
    """Groups of n fingerprints, and among how many tasks the chunks of each two groups are shared out."""
    groups = max(1, -(-n // BLOCK))
    return groups, max(1, min(16, -(-TASKS // (groups * (groups + 1) // 2))))


def chunks(rows: int, pairs: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(first bit, bits, threshold) of the chunks for a task of so many rows on its left and so many pairs; none: all pairs.

    A pair that is above the threshold in every chunk differs in at least sum(threshold + 1) > radius bits.
    """
    best: list[tuple[int, int, int]] = []
    least = pairs * PAIR_S
    for m in range(10, 29):  # chunks of 25 to 9 bits
        edge = [BITS * k // m for k in range(m + 1)]
        cut = [(a, z - a, (radius + 1) // m - 1 + (k < (radius + 1) % m)) for k, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True))]
        cut = [c for c in cut if c[2] >= 0]  # a chunk below 0 holds no pair
        balls = [sum(math.comb(w, d) for d in range(most + 1)) for _, w, most in cut]
        cost = sum(min(rows, 2**w) * (NODE_S + ball * 5e-9) + 1.5 * ball / 2**w * pairs * PAIR_S for (_, w, _), ball in zip(cut, balls, strict=True))
        if cost < least:
            best, least = cut, cost
    return best


def _close(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of x (4, n) and y (4, m) within ``radius``: half of the bits of all, the others of what is left."""
    d = np.bitwise_count(x[0][:, None] ^ y[0])
    d += np.bitwise_count(x[1][:, None] ^ y[1])
    at = np.flatnonzero(d <= radius)
    i, j = np.divmod(at, y.shape[1])
    d = d.ravel()[at].astype(np.int16)
    for k in range(2, _LANES):
        d += np.bitwise_count(x[k][i] ^ y[k][j])
    ok = d <= radius
    return i[ok], j[ok]


class _Forest:
    """Groups of n rows that grow by pairs; pairs of one group are dropped at once, so pairs of a cluster aren't kept."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        x, y = self.root[i], self.root[j]
        new = x != y
        if new.any():
            self.held.append((x[new], y[new]))
            self.count += int(new.sum())
            if self.count > 1 << 16:
                self.settle()

    def settle(self) -> np.ndarray:
        if self.held:
            x, y = map(np.concatenate, zip(*self.held, strict=True))
            low, member = forest(np.minimum(x, y), np.maximum(x, y))
            to = np.arange(len(self.root))
            to[member] = low
            self.root = to[self.root]
            self.held, self.count = [], 0
        return self.root


def _compare(found: _Forest, x: np.ndarray, xi: np.ndarray, y: np.ndarray, yi: np.ndarray, radius: int, most: int = 1 << 17) -> None:
    """All pairs of x (4, n) and y (4, m), rows xi and yi, in tiles of at most ``most``."""
    for c in range(0, y.shape[1], most):
        part, at = y[:, c : c + most], yi[c : c + most]
        step = max(1, most // part.shape[1])
        for r in range(0, x.shape[1], step):
            i, j = _close(x[:, r : r + step], part, radius)
            if len(i):
                found.add(xi[r + i], at[j])


def _chunk(lanes: np.ndarray, first: int, width: int) -> np.ndarray:
    """Bits first .. first + width of the lanes (4, n)."""
    lane, shift = divmod(first, 64)
    key = lanes[lane] >> np.uint64(shift)
    if shift + width > 64:
        key = key | lanes[lane + 1] << np.uint64(64 - shift)
    return (key & np.uint64((1 << width) - 1)).astype(np.int64)


def _nodes(lanes: np.ndarray, rows: np.ndarray, chunk: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints and their rows in the order of their chunk, and where each node (a value of it) begins."""
    key = _chunk(lanes, *chunk[:2])
    order = np.argsort(key, kind="stable")
    begin = np.zeros((1 << chunk[1]) + 1, np.int64)
    np.cumsum(np.bincount(key, minlength=1 << chunk[1]), out=begin[1:])
    return np.ascontiguousarray(lanes[:, order]), rows[order], begin


def near_rows(code: np.ndarray, right: np.ndarray | None = None, radius: int = RADIUS, part: int = 0, parts: int = 1) -> np.ndarray:
    """The smallest row of each row's component, by the pairs within ``radius`` of all rows of ``code``, or between the rows that
    aren't ``right`` and those that are.  Of several parts each takes its share of the chunks; together they find all pairs."""
    found = _Forest(len(code))
    every = np.arange(len(code))
    a = every if right is None else every[~right]
    b = a if right is None else every[right]
    if not len(a) or not len(b):
        return found.root
    x = np.ascontiguousarray(code[a].T)
    y = x if right is None else np.ascontiguousarray(code[b].T)
    cut = chunks(len(a), len(a) * len(b) // (1 + (right is None)), radius)
    if not cut:  # all pairs: the rows on the left are shared out
        step = 256
        for r in range(part * step, len(a), parts * step):
            some, upto = slice(r, r + step), 0 if right is not None else r
            _compare(found, x[:, some], a[some], y[:, upto:], b[upto:], radius)
        return found.settle()
    for chunk in cut[part::parts]:
        _, width, most = chunk
        xs, xi, xb = _nodes(x, a, chunk)
        ys, yi, yb = (xs, xi, xb) if right is None else _nodes(y, b, chunk)
        ball = np.array([sum(1 << k for k in on) for d in range(most + 1) for on in itertools.combinations(range(width), d)])
        for node in np.flatnonzero(np.diff(xb)).tolist():
            lo, hi = int(xb[node]), int(xb[node + 1])
            near = ball ^ node
            if right is None:
                near = near[near >= node]  # the other way round is the other node's
                if hi - lo > CROWD:
                    near = near[near != node]
                    _crowd(found, xs[:, lo:hi], xi[lo:hi], radius)
            begin = yb[near]
            size = yb[near + 1] - begin
            some = size > 0
            begin, size = begin[some], size[some]
            ends = np.cumsum(size)
            if not len(ends):
                continue
            per = np.flatnonzero(np.diff(ends // (1 << 20), prepend=-1))  # neighbours are gathered about a million at a time
            for f, t in zip(per.tolist(), [*per[1:].tolist(), len(ends)], strict=True):
                n = size[f:t]
                at = np.repeat(begin[f:t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                _compare(found, xs[:, lo:hi], xi[lo:hi], ys[:, at], yi[at], radius)
    return found.settle()


def _crowd(found: _Forest, lanes: np.ndarray, rows: np.ndarray, radius: int) -> None:
    code = np.ascontiguousarray(lanes.T)
    order = np.lexsort(gray_rank(code).T[::-1])
    i, j = join_codes(np.zeros(len(code), np.int64), code[order], radius)
    found.add(rows[order[i]], rows[order[j]])


def join_codes(bucket: np.ndarray, code: np.ndarray, radius: int = RADIUS, fanout: int = FANOUT, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) between rows of one bucket, which connect what the pairs within ``radius`` connect.

    Rows are in the order of bucket and Gray rank.  Two nodes whose shared bits differ in more than ``radius`` are dropped;
    where even all bits that aren't shared can't bring the difference above it, one edge stands for all pairs
    between them, and a star for those within a node.  So a cluster of many close fingerprints isn't expanded.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    every = np.arange(len(code))
    levels = [(every, every + 1, np.full_like(code, full), code, bucket, every, every + 1)]
    while True:
        _, _, mask, pattern, owner, low, high = levels[-1]
        n = len(owner)
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if n else np.zeros(0, int)
        if len(start) == n:
            break
        size = np.diff(np.r_[start, n])
        inside = np.arange(n) - np.repeat(start, size)
        lead = np.flatnonzero(inside % fanout == 0)  # the first child of each node
        tail = np.r_[lead[1:], n]
        up_or = np.bitwise_or.reduceat(pattern, lead, axis=0)
        up_and = np.bitwise_and.reduceat(pattern, lead, axis=0)
        shared = np.bitwise_and.reduceat(mask, lead, axis=0) & ~(up_or ^ up_and)
        levels.append((lead, tail, shared, up_and & shared, owner[lead], low[lead], high[tail - 1]))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    todo = [(top, roots, roots)]
    while todo:
        level, a, b = todo.pop()
        few = max(1, most // fanout**2) if level else most  # what a step makes stays within ``most`` pairs
        if len(a) > few:
            todo += [(level, a[k : k + few], b[k : k + few]) for k in range(0, len(a), few)]
            continue
        lead, tail, mask, pattern, _, low, high = levels[level]
        both = mask[a] & mask[b]
        diff = np.bitwise_count((pattern[a] ^ pattern[b]) & both).sum(axis=1, dtype=np.int64)
        near = diff <= radius
        a, b, both, diff = a[near], b[near], both[near], diff[near]
        sure = diff + BITS - np.bitwise_count(both).sum(axis=1, dtype=np.int64) <= radius
        apart = sure & (a != b)
        found.append((low[a[apart]], low[b[apart]]))
        one = a[sure & (a == b)]
        rest = high[one] - low[one] - 1
        found.append((np.repeat(low[one], rest), np.repeat(low[one] + 1 - np.cumsum(rest) + rest, rest) + np.arange(rest.sum())))
        held += len(found[-1][0]) + len(found[-2][0])
        if held > most:
            found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
            held = 0
        if level == 0:
            continue
        a, b = a[~sure], b[~sure]
        # children: pairs (x, y) with x under a, y under b, and x <= y under the same node
        na, nb = tail[a] - lead[a], tail[b] - lead[b]
        size = na * nb
        k = np.repeat(np.arange(len(a)), size)
        r = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        x, y = lead[a[k]] + r // nb[k], lead[b[k]] + r % nb[k]
        ok = (a[k] != b[k]) | (x <= y)
        todo.append((level - 1, x[ok], y[ok]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    i, j = map(np.concatenate, zip(*found, strict=True))
    return i, j


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest of the component, member) that connect what the pairs (a, b) connect."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.r_[a, b], return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[member]], nodes[member]


def near_pairs(codes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b), a < b, that connect what the pairs of fingerprints within ``radius`` connect: all of these pairs, for any n.
    codes: (id, rank), about n rows; ids don't repeat."""
    groups, parts = plan(n)
    couples = [(g, h) for g in range(groups) for h in range(g, groups)]
    meets = [np.array([k for k, c in enumerate(couples) if g in c]) for g in range(groups)]
    tasks = len(couples) * parts

    def group_of(ids: np.ndarray) -> np.ndarray:
        return (mix(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = group_of(batch.column("id").to_numpy())
            for g in np.unique(group).tolist():
                rows = batch.filter(pa.array(group == g))
                for task in (meets[g][:, None] * parts + np.arange(parts)).ravel().tolist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, task, np.int32)), rows.column("id"), rows.column("rank")], ["task", "id", "rank"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("id").to_numpy(), _from_bytes(b.column("rank")), b.column("task")[0].as_py()) for b in batches if b.num_rows]
        if not held:
            return
        (g, h), part = couples[held[0][2] // parts], held[0][2] % parts
        ids, rank = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        held.clear()
        root = near_rows(gray_code(rank), None if g == h else group_of(ids) == h, radius, part, parts)
        on = np.flatnonzero(root != np.arange(len(ids)))
        lo, hi = ids[root[on]], ids[on]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(lo, hi)), pa.array(np.maximum(lo, hi))], ["a", "b"])

    keyed = codes.mapInArrow(spread, "task int, id long, rank binary")
    return keyed.repartitionById(tasks, "task").mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each node's component, for the nodes of ``edges`` (a, b) except the roots."""
    e, seen = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"), None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return e.select(F.col("b").alias("id"), F.col("a").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, kept_doc_id) for every document that has a near copy with a smaller id in its group."""
    by_doc = written(fingerprints(docs).groupBy("doc_id").agg(F.min("rank").alias("rank")), "fingerprints")
    codes = written(by_doc.groupBy("rank").agg(F.min("doc_id").alias("id")).select("id", "rank"), "codes")
    groups = components(near_pairs(codes, codes.count(), radius))
    # by rank again: every document of a collapsed fingerprint follows its smallest id
    ids = codes.join(groups, "id", "left").select("rank", F.coalesce("root", "id").alias("kept_doc_id"))
    return by_doc.join(ids, "rank").where("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the near copies of a document that stays."""
    prepare(spark)
    copies = written(near_duplicates(docs), "copies")
    return keep_rows(docs, copies, "doc_id", copies.count())

