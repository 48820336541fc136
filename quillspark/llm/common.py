"""What the operators of this package share: sessions, folders and byte-level text primitives.

The text primitives work on the UTF-8 bytes of many documents at once.  A *word* is a maximal run of
ASCII letters, ASCII digits and non-ASCII bytes; ASCII capitals and the Latin-1 capitals are folded.
Hashes of arbitrary byte ranges come from one cumulative sum, so no Python string is made per word.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Text that one vectorised step handles; longer documents form a step of their own.
STEP_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure that a checkpoint folder is set.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a session on one machine gets a folder
    of its own; on a cluster that is an error, since a machine's own folder isn't shared.
    """
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillspark-"))
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder, which all executors share."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder: lineage ends there, and its size is known to the planner."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keep_rows(docs: DataFrame, drop: DataFrame, key: str, n_drop: int, limit: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``drop``.

    ``n_drop`` is the counted size of ``drop``: up to ``limit`` keys (about 16 MB) are broadcast, so
    the texts don't move; beyond that the join shuffles.  Rows with a null key stay.
    """
    drop = drop.select(F.col(key).alias("drop")).distinct()
    rows = packed(docs, key=F.col(key))
    return rows.join(F.broadcast(drop) if n_drop <= limit else drop, F.col("key") == F.col("drop"), "left_anti").select("row.*")


def packed(docs: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """The columns ``keep`` (all) as one column ``row``, and ``columns`` beside it: no name of ``docs`` can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


# ---------------------------------------------------------------- bytes of many documents

_B = np.uint64(0x9E3779B97F4A7C15)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64; kept for the largest n so far."""
    if not _POW or len(_POW[0]) < n:
        m = max(n, 1 << 16)
        inv = pow(int(_B), -1, 1 << 64)
        for k, base in enumerate((int(_B), inv)):
            a = np.empty(m, np.uint64)
            a[0] = 1
            have = 1
            while have < m:
                step = np.uint64(pow(base, have, 1 << 64))
                take = min(have, m - have)
                np.multiply(a[:take], step, out=a[have : have + take])
                have += take
            _POW[k : k + 1] = [a]
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Primes below 2^31 and bases for hashes of ranges.
_FIELDS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_013))
_FIELD_POW: list[np.ndarray] = []


def _field_powers(n: int) -> list[np.ndarray]:
    """For each prime the powers of its base and of the base's inverse."""
    if not _FIELD_POW or len(_FIELD_POW[0]) < n:
        m, made = max(n, 1 << 16), []
        for p, base in _FIELDS:
            for b in (base, pow(base, -1, p)):
                a = np.ones(m, np.uint64)
                have = 1
                while have < m:
                    take = min(have, m - have)
                    a[have : have + take] = a[:take] * np.uint64(pow(b, have, p)) % np.uint64(p)
                    have += take
                made.append(a)
        _FIELD_POW[:] = made
    return _FIELD_POW


class Ranges:
    """64-bit hashes of ranges of a sequence of numbers, by prefix sums of polynomials modulo two primes.

    Unlike polynomials modulo 2^64 they don't collide for sequences as regular as Thue-Morse words.  Of the numbers
    each prime takes 32 bits, the low and the high ones, or both the low ones where there are no others.
    """

    def __init__(self, numbers: np.ndarray, wide: bool = False) -> None:
        n = len(numbers)
        self.pow, self.sums = _field_powers(n + 1), []
        for k, (p, _) in enumerate(_FIELDS):
            s = np.zeros(n + 1, np.uint64)
            values = (numbers >> np.uint64(32) if k else numbers & np.uint64(0xFFFFFFFF)) if wide else numbers
            np.cumsum(values * self.pow[2 * k + 1][:n] % np.uint64(p), out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = ((s[end] - s[start]) % np.uint64(p) * self.pow[2 * k][start] % np.uint64(p) for k, (s, (p, _)) in enumerate(zip(self.sums, _FIELDS, strict=True)))
        return mix((a << np.uint64(32) | b) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Bits of the first n of eight characters of 32 bits, as four words.
_FIRST = np.array([[0xFFFFFFFFFFFFFFFF if n >= 2 * w + 2 else 0xFFFFFFFF if n == 2 * w + 1 else 0 for w in range(4)] for n in range(9)], np.uint64)


def eights(characters: np.ndarray) -> np.ndarray:
    """The eight characters (32 bits each) at every place; the last eight begin no more."""
    return np.ndarray((max(0, len(characters) - 7),), "V32", characters, strides=(4,))


def equal_ranges(a: np.ndarray, at: np.ndarray, b: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size[i]`` characters at at[i] equal those at other[i]; a and b are ``eights`` of characters with
    eight more behind the last range."""
    out = np.ones(len(size), bool)
    left, done = np.arange(len(size)), 0
    while len(left):
        x, y = (v[place[left] + done].view(np.uint64).reshape(-1, 4) for v, place in ((a, at), (b, other)))
        bad = ((x ^ y) & _FIRST[np.minimum(size[left] - done, 8)]).any(axis=1)
        out[left[bad]] = False
        done += 8
        left = left[~bad & (size[left] > done)]
    return out


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: U+2013..U+201D and the like are punctuation, but rare; treating them as letters keeps words local to bytes.


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for U+00C0..U+00DE, byte by byte."""
    out = _FOLD[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    if len(lead):
        b = raw[lead]
        out[lead] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 0x20, b)
    return out


class Texts:
    """The words of some documents: ``start``/``end`` are byte offsets into ``raw``, ``doc`` the row, sorted."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.raw = raw
        self.folded = fold(raw) if len(raw) else raw
        isw = _WORD[raw]
        cut = np.zeros(len(raw) + 1, bool)  # a document's start breaks words
        cut[self.off] = True
        prev = np.zeros(len(raw), bool)
        prev[1:] = isw[:-1]
        first = isw & (~prev | cut[:-1])
        nxt = np.zeros(len(raw), bool)
        nxt[:-1] = isw[1:]
        last = isw & (~nxt | cut[1:])
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.off, self.start, side="right") - 1
        self._ranges: Ranges | None = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the folded byte ranges."""
        if self._ranges is None:
            self._ranges = Ranges(self.folded.astype(np.uint64) + np.uint64(1))
        return self._ranges.of(start, end)

    def words_of(self) -> np.ndarray:
        """Offsets of each document's words: document i has the words [w[i], w[i + 1])."""
        return np.searchsorted(self.doc, np.arange(len(self.off)))


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of ``column``, so that memory doesn't follow the batch size."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto
