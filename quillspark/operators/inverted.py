"""Documents to sorted runs of postings, without moving a token between machines.

A task takes its documents in runs of about ``RUN`` bytes of text.  The terms of a run are found, numbered, counted and
sorted as arrays, so that a run's postings come out sorted by (field, term, doc_id); a term is in a few pages of each run,
which the pages' statistics tell.  Work and memory of a run don't depend on the size of the table.

Each run begins with a row for every document and field, with no term and ``tf`` 0, that has the field's length; documents
without a token have one too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.analysis import TOKEN, Analyzer
from quillspark.functions.stemmer import stem
from quillspark.operators.documents import prepare
from quillspark.operators.index import POSTINGS, FieldType, IndexSpec

#: Bytes of text of a run, and rows of a batch that a run is handed over in.
RUN, ROWS = 8 << 20, 1 << 16
_POINTS = 0x110000
_SCHEMA = pa.schema([("field", pa.string()), ("term", pa.string()), ("doc_id", pa.int64()), ("tf", pa.int32()), ("positions", pa.list_(pa.int32())), ("len", pa.int32())])
_MEMBERS: list[bytes] = []


def members(spark: SparkSession) -> bytes:
    """Which code points belong to terms, as Spark's own expression says, as compressed bits."""
    if not _MEMBERS:
        every = spark.range(_POINTS).where(f"id < {0xD800} OR id >= {0xE000}").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
        found = np.zeros(_POINTS, bool)
        found[every.where(F.col("c").rlike(TOKEN)).select("id").toArrow().column(0).to_numpy()] = True  # about 137 thousand numbers
        _MEMBERS.append(zlib.compress(np.packbits(found).tobytes()))
    return _MEMBERS[0]


def tokens_of(texts: pa.Array, member: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row of each token, token as written); ``member`` says by code point what belongs to tokens."""
    n = len(texts)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    ok = np.r_[member[:128], np.zeros(128, bool)][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        point = raw[lead].astype(np.int32)
        width = 2 + (point >= 0xE0) + (point >= 0xF0)
        point &= 0xFF >> (width + 1)
        for j in (1, 2, 3):
            more = width > j
            point[more] = point[more] << 6 | raw[lead[more] + j] & 0x3F
        good = member[point]
        lead, width = lead[good], width[good]
        for j in range(4):
            ok[lead[width > j] + j] = True
    joined = np.zeros(len(raw) + 1, bool)  # a byte and the one before it are of the same token
    joined[1:-1] = ok[1:] & ok[:-1]
    joined[off] = False
    start, end = np.flatnonzero(ok & ~joined[:-1]), np.flatnonzero(ok & ~joined[1:]) + 1
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    return np.repeat(np.arange(n), np.diff(np.searchsorted(start, off))), pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(raw[ok]))


def _lowered(terms: pa.Array) -> pa.Array:
    plain = pc.string_is_ascii(terms)
    low = pc.ascii_lower(terms)
    if pc.all(plain).as_py() is not False:
        return low
    return pc.replace_with_mask(low, pc.invert(plain), pa.array([t.lower() for t in terms.filter(pc.invert(plain)).to_pylist()], terms.type))


def _numbered(texts: pa.Array, analyzer: Analyzer | None, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, position, number of the term) of every surviving term, and the terms by number, sorted.  No analyzer: whole values."""
    if analyzer is None:
        row = np.flatnonzero(pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False))
        written, pos = texts.take(pa.array(row)), np.zeros(len(row), np.int64)
    else:
        row, written = tokens_of(texts, member)
        pos = np.arange(len(row)) - np.searchsorted(row, np.arange(len(texts)))[row] if len(row) else np.zeros(0, np.int64)
    coded = written.dictionary_encode()
    code, terms = coded.indices.to_numpy(), coded.dictionary
    if analyzer is not None:
        terms = _lowered(terms)
        kept = np.ones(len(terms), bool)
        if analyzer.stop:
            kept = ~pc.is_in(terms, pa.array(list(analyzer.stop), terms.type)).to_numpy(zero_copy_only=False)
        if analyzer.stemming:
            terms = pa.array([stem(t) for t in terms.to_pylist()], terms.type)
        survives = kept[code]
        row, pos, code = row[survives], pos[survives], code[survives]
    merged = terms.dictionary_encode()
    order = pc.sort_indices(merged.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return row, pos, place[merged.indices.to_numpy()][code] if len(code) else np.zeros(0, np.int64), merged.dictionary.take(pa.array(order))


def _run(table: pa.Table, fields: list[tuple[str, Analyzer | None]], member: np.ndarray) -> Iterator[pa.RecordBatch]:
    n, ids = table.num_rows, table.column(0).combine_chunks()
    by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    rank = np.empty(n, np.int64)
    rank[by_id] = np.arange(n)
    made = []
    for i, (name, analyzer) in sorted(enumerate(fields), key=lambda x: x[1][0]):
        row, pos, code, terms = _numbered(table.column(i + 1).combine_chunks(), analyzer, member)
        made.append((name, row, pos, code, terms, np.bincount(row, minlength=n)))
    for name, *_, length in made:
        rows = pa.RecordBatch.from_arrays([pa.array([name] * n), pa.nulls(n, pa.string()), ids.take(pa.array(by_id)), pa.array(np.zeros(n, np.int32)), pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32())), pa.array(length[by_id].astype(np.int32))], schema=_SCHEMA)
        yield from (rows.slice(at, ROWS) for at in range(0, n, ROWS))
    for name, row, pos, code, terms, length in made:
        key = code * n + rank[row]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        pos, off = pos[order].astype(np.int32), np.r_[first, len(order)]
        mine, term = row[order[first]], code[order[first]]
        for at in range(0, len(first), ROWS):
            z = min(at + ROWS, len(first))
            places = pa.ListArray.from_arrays(pa.array((off[at : z + 1] - off[at]).astype(np.int32)), pa.array(pos[off[at] : off[z]]))
            tf = np.diff(off[at : z + 1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (z - at)), terms.take(pa.array(term[at:z])).cast(pa.string()), ids.take(pa.array(mine[at:z])), pa.array(tf), places, pa.array(length[mine[at:z]].astype(np.int32))], schema=_SCHEMA)


def invertible(df: DataFrame, spec: IndexSpec) -> bool:
    """Whether runs can be made of these rows: one value a field, and no analyzer that is a column expression of its own."""
    names = [n for n, t in spec.fields.items() if t is not FieldType.STORED]
    return spec.analyzer.custom is None and not any(isinstance(df.schema[n].dataType, T.ArrayType) for n in names)


def inverted(df: DataFrame, spec: IndexSpec) -> DataFrame:
    """Postings (and lengths, where ``tf`` is 0) of rows whose ``doc_id`` is their own."""
    bits = members(prepare(df.sparkSession))
    fields = [(n, None if t is FieldType.KEYWORD else spec.analyzer) for n, t in spec.fields.items() if t is not FieldType.STORED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[:_POINTS].astype(bool)
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            upto = np.zeros(batch.num_rows, np.int64)
            for c in batch.columns[1:]:
                upto += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) + 8
            upto, at, used = np.cumsum(upto), 0, 0
            while at < batch.num_rows:
                z = max(at + 1, int(np.searchsorted(upto, used + RUN - size, side="right")))
                held.append(batch.slice(at, z - at))
                size, at, used = size + int(upto[z - 1]) - used, z, int(upto[z - 1])
                if size >= RUN or at < batch.num_rows:
                    yield from _run(pa.Table.from_batches(held), fields, member)
                    held, size = [], 0
        if held:
            yield from _run(pa.Table.from_batches(held), fields, member)

    columns = [F.col(f"`{n}`").cast("string").alias(f"f{i}") for i, (n, _) in enumerate(fields)]
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).mapInArrow(run, POSTINGS)
