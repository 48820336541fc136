"""Token counts of whole documents without moving any pre-token.

Two tiers, both on the map side.  A compact hash table (open addressing in flat arrays) has the token
counts and the characters of frequent pre-tokens: those that are tokens of the vocabulary themselves, and the
frequent ones of a bounded sample of documents (``SAMPLE`` rows, the first that are read).  A hash only finds
the place; the characters are compared, so a count never hangs on a hash.  The table's size is bounded by ``SLOTS``
and ``LONGEST``, so the broadcast doesn't grow with the corpus.  A pre-token that it lacks is encoded once for each
worker and kept, by its characters, in the worker's cache, which is emptied at ``CACHE`` entries.

Cases: a null text has a null count, an empty one 0.  Repeated rows each give a row.  Rows with a null
``doc_id`` are counted too.  Only ``doc_id`` and ``text`` are read.  No text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import _powers, eights, equal_ranges, mix, prepare, steps, table
from quillspark.llm.pretokens import VOCABULARY, codepoints, encoding, ranks_of, starts

SAMPLE = 400
SLOTS = 1 << 18
CACHE = 400_000
LONGEST = 64
_worker: dict = {}


def hash_ranges(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes that find places; different ranges may share one."""
    p, inv = _powers(len(cp) + 1)
    s = np.empty(len(cp) + 1, np.uint64)
    s[0] = 0
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * inv[: len(cp)], out=s[1:])
    h = mix((s[end] - s[start]) * p[start] + (end - start).astype(np.uint64))
    h[h == 0] = 1  # zero marks an empty slot
    return h


class Table:
    """Counts by pre-token: linear probing over at most two slots; what finds no slot is left out."""

    def __init__(self, pieces: dict[str, int], slots: int = SLOTS) -> None:
        kept = {p: k for p, k in pieces.items() if 0 < k < 65536 and len(p) <= LONGEST}
        n = np.fromiter(kept.values(), np.int64, len(kept))
        chars, off = codepoints(list(kept))
        self.chars = np.concatenate([chars, np.zeros(8, np.uint32)])
        self.keys, self.counts = np.zeros(slots, np.uint64), np.zeros(slots, np.uint16)
        self.at, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.uint8)
        h, left = hash_ranges(chars, off[:-1], off[1:]), np.arange(len(kept))
        for probe in range(2):
            slot = ((h[left] + np.uint64(probe)) & np.uint64(slots - 1)).astype(np.int64)
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[first]
            slot, which = slot[took], left[took]
            self.keys[slot], self.counts[slot] = h[which], n[which]
            self.at[slot], self.size[slot] = off[which], off[which + 1] - off[which]
            left = np.delete(left, took)

    def look_up(self, h: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Counts of the ranges of ``text`` (``eights``) with these hashes, 0 where the table has none."""
        low = np.uint64(len(self.keys) - 1)
        out = np.zeros(len(h), np.int64)
        left = np.arange(len(h))
        for probe in range(2):
            slot = ((h[left] + np.uint64(probe)) & low).astype(np.int64)
            hit = np.flatnonzero((self.keys[slot] == h[left]) & (self.size[slot] == size[left]))
            i, slot = left[hit], slot[hit]
            same = equal_ranges(text, start[i], eights(self.chars), self.at[slot], size[i])
            out[i[same]] = self.counts[slot[same]]
            left = np.delete(left, hit[same])
        return out


def count_tokens(texts: list[str], tab: Table, enc, cache: dict[str, int]) -> np.ndarray:  # noqa: ANN001
    cp, off = codepoints(texts)
    s = starts(cp, off)
    if not len(s):
        return np.zeros(len(texts), np.int64)
    size = np.diff(np.r_[s, len(cp)])
    h = hash_ranges(cp, s, s + size)
    text = eights(np.concatenate([cp, np.zeros(8, np.uint32)]))
    n = tab.look_up(h, text, s, size)
    miss = np.flatnonzero(n == 0)
    if len(miss):
        _, first, inv = np.unique(h[miss], return_index=True, return_inverse=True)
        lead = miss[first[inv]]
        odd = size[lead] != size[miss]
        odd[~odd] = ~equal_ranges(text, s[miss[~odd]], text, s[lead[~odd]], size[miss[~odd]])
        which = np.r_[miss[first], miss[odd]]  # one of each hash, and all that differ from it
        pieces = [cp[a:z].tobytes().decode("utf-32-le", "surrogatepass") for a, z in zip(s[which].tolist(), (s + size)[which].tolist(), strict=True)]
        if len(cache) + len(pieces) > CACHE:
            cache.clear()
        got = np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            c = cache.get(piece)
            if c is None:
                c = cache[piece] = len(enc.encode_ordinary(piece))
            got[k] = c
        n[miss] = got[: len(first)][inv]
        n[miss[odd]] = got[len(first) :]
    total = np.r_[0, np.cumsum(n)]
    return np.diff(total[np.searchsorted(s, off)])


def frequent(docs: DataFrame, ranks: dict[bytes, int], sample: int = SAMPLE, slots: int = SLOTS) -> dict[str, int]:
    """Pre-tokens and their counts of tokens for the table, at most half of its slots."""
    enc = encoding(ranks)
    pieces: dict[str, int] = {}
    for r in docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").limit(sample).collect():
        cp, off = codepoints([r.text])
        s = starts(cp, off).tolist()
        for a, b in zip(s, [*s[1:], len(r.text)], strict=True):
            if b - a <= LONGEST:
                pieces[r.text[a:b]] = pieces.get(r.text[a:b], 0) + 1
    most = sorted(pieces, key=lambda x: (-pieces[x], x))[: slots // 4]
    found = dict.fromkeys(most, 0)
    for token in ranks:
        try:
            piece = token.decode()
        except UnicodeDecodeError:
            continue
        if len(found) >= slots // 2:
            break
        cp, off = codepoints([piece])
        if piece and len(starts(cp, off)) == 1:
            found.setdefault(piece, 0)
    return {p: len(enc.encode_ordinary(p)) for p in found}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``."""
    spark = prepare(docs.sparkSession)
    ranks = ranks_of(vocabulary)
    shared = spark.sparkContext.broadcast((ranks, Table(frequent(docs, ranks, sample))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, tab = shared.value
        if _worker.get("vocabulary") != vocabulary:
            _worker.update(vocabulary=vocabulary, enc=encoding(ranks), cache={})
        for batch in batches:
            for b in steps(batch, "text"):
                text = b.column("text")
                n = count_tokens(pc.fill_null(text, "").to_pylist(), tab, _worker["enc"], _worker["cache"])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, mask=np.asarray(text.is_null()))], ["doc_id", "n_tokens"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
