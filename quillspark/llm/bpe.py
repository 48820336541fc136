"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over ``WINDOW`` characters cuts every document where the hash has a given value, so texts
that share a passage share its chunks wherever it stands.  Each distinct chunk is encoded once for a worker
(its cache is bounded by characters, and emptied when full) and reused in all documents.  What is wrong
are only the joins: the pre-tokens at a chunk's end were found without the characters that follow, and the
first ones of the next chunk without those before.  A join is repaired by re-encoding from the last
pre-token that is certain, through a window that widens until one of its pre-token starts agrees with a
start that the next chunk has itself; from there on the chunk's tokens are exact, since the pattern reads
from left to right and looks ahead at most ``AHEAD`` characters.  The ids equal those of encoding the
whole text at once, whatever the cuts.

Cases: a null text has null ids, an empty one an empty list.  Repeated rows each give a row.  An empty table gives
no rows.  ``doc_id`` and ``text`` are read; other columns may have any name and aren't returned.  Texts of any length are encoded whole; memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import _powers, eights, equal_ranges, mix, prepare, steps, table
from quillspark.llm.pretokens import VOCABULARY, codepoints, encoding, ranks_of, starts
from quillspark.llm.token_counts import hash_ranges

WINDOW = 24
AVERAGE = 1024
LEAST = 64
AHEAD = 2
CHUNK_CACHE_CHARS = 6_000_000
PIECE_CACHE = 150_000
_worker: dict = {}


def cuts(cp: np.ndarray, average: int = AVERAGE, window: int = WINDOW) -> np.ndarray:
    """Content-defined cut positions of one or many joined texts: they depend on the window's characters alone."""
    if len(cp) <= window:
        return np.zeros(0, np.int64)
    p, inv = _powers(len(cp) + 1)
    s = np.empty(len(cp) + 1, np.uint64)
    s[0] = 0
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * inv[: len(cp)], out=s[1:])
    h = mix((s[window:] - s[:-window]) * p[: len(cp) + 1 - window])
    return np.flatnonzero(h < np.uint64((1 << 64) // average)) + window


class Encoder:
    """Encodes texts by reuse of chunks.  A chunk is (ids, starts, index): its token ids, where its own
    pre-tokens start, and where the tokens of each begin."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.enc = encoding(ranks)
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, k in ranks.items():
            self.bytes_of[k] = token
        self.clear_pieces()
        self.chunks: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.held = self.reused = self.encoded = 0

    def clear_pieces(self) -> None:
        self.known: dict[int, int] = {}
        self.pieces = 0
        self.flat, self.chars = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint32)
        self.edge, self.char_edge = (np.zeros(PIECE_CACHE * 2 + 1, np.int64) for _ in range(2))

    def keep(self, piece: np.ndarray) -> int:
        """Encode a pre-token and keep its ids and its characters; returns its number."""
        got = self.enc.encode_ordinary(piece.tobytes().decode("utf-32-le", "surrogatepass"))
        n = self.pieces
        if n + 1 >= len(self.edge):
            self.edge, self.char_edge = (np.r_[x, np.zeros_like(x)] for x in (self.edge, self.char_edge))
        lo, at = int(self.edge[n]), int(self.char_edge[n])
        while lo + len(got) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while at + len(piece) + 8 > len(self.chars):
            self.chars = np.r_[self.chars, np.zeros_like(self.chars)]
        self.flat[lo : lo + len(got)], self.chars[at : at + len(piece)] = got, piece
        self.edge[n + 1], self.char_edge[n + 1] = lo + len(got), at + len(piece)
        self.pieces += 1
        return n

    def plain(self, cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, index) of the pre-tokens that start at ``at``; each distinct one is merged once.

        A hash finds the kept pre-token, whose characters are compared; one that only shares the hash is merged for itself.
        """
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        size = np.diff(np.r_[at, len(cp)])
        u, first, inv = np.unique(hash_ranges(cp, at, at + size), return_index=True, return_inverse=True)
        if self.pieces > PIECE_CACHE:
            self.clear_pieces()
        known = self.known
        found = np.fromiter((known.get(x, -1) for x in u.tolist()), np.int64, len(u))
        for k in np.flatnonzero(found < 0).tolist():
            lo = at[first[k]]
            found[k] = known[int(u[k])] = self.keep(cp[lo : lo + size[first[k]]])
        which = found[inv]
        odd = self.char_edge[which + 1] - self.char_edge[which] != size
        padded = np.concatenate([cp, np.zeros(8, np.uint32)])
        odd[~odd] = ~equal_ranges(eights(padded), at[~odd], eights(self.chars), self.char_edge[which[~odd]], size[~odd])
        for k in np.flatnonzero(odd).tolist():
            which[k] = self.keep(cp[at[k] : at[k] + size[k]])
        lo = self.edge[which]
        size = self.edge[which + 1] - lo
        index = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=index[1:])
        return self.flat[np.repeat(lo - index[:-1], size) + np.arange(index[-1])], index

    def load(self, chunks: list[str]) -> None:
        """Encode the chunks that the cache lacks, each once."""
        if self.held > CHUNK_CACHE_CHARS:
            self.chunks.clear()
            self.held = 0
        new = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        self.reused += len(chunks) - len(new)
        self.encoded += len(new)
        cp, off = codepoints(new)
        s = starts(cp, off)
        ids, index = self.plain(cp, s)
        edge = np.searchsorted(s, off).tolist()
        for i, c in enumerate(new):
            a, b = edge[i], edge[i + 1]
            self.chunks[c] = (ids[index[a] : index[b]].copy(), (s[a:b] - off[i]).astype(np.int32), (index[a : b + 1] - index[a]).astype(np.int32))
            self.held += len(c)

    def join(self, text: str, edges: list[int]) -> np.ndarray:
        """Ids of ``text``, whose chunks lie between the edges and are loaded."""
        ids, at, index = self.chunks[text[edges[0] : edges[1]]]
        parts: list[np.ndarray] = []  # what precedes ``window``
        window = np.zeros(0, np.int32)  # re-encoded, from the text's position ``begin``
        begin = base = j = 0  # then the chunk at ``base`` from its pre-token j on
        for lo, hi in zip(edges[1:-1], edges[2:], strict=True):
            # the last start that is certain lies at least AHEAD characters before the join
            k = int(np.searchsorted(at, lo - base - AHEAD, side="right")) - 1
            if k >= j:
                parts += [window, ids[index[j] : index[k]]]
                begin = base + int(at[k])
            ids, at, index = self.chunks[text[lo:hi]]
            reach = 32
            while True:
                end = min(lo + reach, hi)
                cp = np.frombuffer(text[begin:end].encode("utf-32-le", "surrogatepass"), np.uint32)
                new = starts(cp, np.array([0, len(cp)]))
                sure = new[(new >= lo - begin) & ((new + AHEAD <= len(cp)) | (end == len(text)))] + (begin - lo)
                agree = sure[np.isin(sure, at)]
                if len(agree) or end == hi:
                    break
                reach *= 4
            stop = lo + int(agree[0]) if len(agree) else end
            window = self.plain(cp[: stop - begin], new[new < stop - begin])[0]
            base, j = lo, int(np.searchsorted(at, stop - lo)) if len(agree) else len(at)
        parts += [window, ids[index[j] :]]
        return np.concatenate(parts)

    def encode(self, texts: list[str], average: int = AVERAGE) -> list[np.ndarray]:
        cp, off = codepoints(texts)
        cut = cuts(cp, average)
        doc = np.searchsorted(off, cut, side="right") - 1
        cut = cut[(cut - off[doc] >= WINDOW)]  # the window lies in one text
        edge, cut, base = np.searchsorted(cut, off).tolist(), cut.tolist(), off.tolist()
        plans = []
        for i, text in enumerate(texts):
            edges = [0]
            for x in cut[edge[i] : edge[i + 1]]:
                if LEAST <= x - base[i] - edges[-1] and x < base[i + 1]:
                    edges.append(x - base[i])
            plans.append([*edges, len(text)])
        self.load([t[a:b] for t, p in zip(texts, plans, strict=True) for a, b in zip(p[:-1], p[1:], strict=True)])
        return [self.join(t, p) for t, p in zip(texts, plans, strict=True)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _encoder(vocabulary: str, ranks: dict[bytes, int]) -> Encoder:
    if _worker.get("vocabulary") != vocabulary:
        _worker.update(vocabulary=vocabulary, encoder=Encoder(ranks))
    return _worker["encoder"]


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    """An Arrow list array without a Python object for each id."""
    off = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([0 if r is None else len(r) for r in rows], out=off[1:])
    valid = np.array([r is not None for r in rows], bool)
    values = np.concatenate([np.zeros(0, np.int32), *(r for r in rows if r is not None)]).astype(np.int32)
    return pa.ListArray.from_buffers(pa.list_(pa.int32()), len(rows), [pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()), pa.py_buffer(off)], children=[pa.array(values)])


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, place: list[str] | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, exact) for every row; ``exact`` says that decoding gave the text again.

    ``place``: names of columns of ``docs`` to return as well, longs.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(ranks_of(vocabulary))
    place = place or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, shared.value)
        for batch in batches:
            for b in steps(batch, "text"):
                texts = b.column("text").to_pylist()
                got = iter(encoder.encode([t for t in texts if t is not None]))
                ids = [None if t is None else next(got) for t in texts]
                exact = [None if t is None else encoder.decode_bytes(x) == t.encode() for t, x in zip(texts, ids, strict=True)]
                n = [None if x is None else len(x) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids), pa.array(n, pa.int64()), pa.array(exact, pa.bool_()), *(b.column(c) for c in place)], ["doc_id", "ids", "n_tokens", "exact", *place])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *place)
    return src.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, exact boolean" + "".join(f", {c} long" for c in place))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text, unknown ids nothing."""
    spark = prepare(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(ranks_of(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = [None if x is None else encoder.decode(np.array([k for k in x if k is not None and 0 <= k < encoder.size], np.int64)) for x in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


#: Rows of a file that its number leaves room for in ``place``.
_FILE_ROWS = 1 << 40


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place) of a written table: ``place`` orders rows as its writer did, by file and row.

    Tasks number their files in the order of partitions (``part-00012-...``).  Where ``docs`` isn't read from such files
    ``place`` is null.
    """
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
        return docs.select(*cols, (number * _FILE_ROWS + F.col("_metadata.row_index")).alias("place"))
    except AnalysisException:  # no file source below
        return docs.select(*cols, F.lit(None).cast("long").alias("place"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what the pipeline kept: the training rows.

    Files are read in splits of any order; ``place`` keeps the order in which the mix was written, and sorting by it gives
    the mix again.
    """
    prepare(spark)
    return encode(placed(docs), place=["place"])
