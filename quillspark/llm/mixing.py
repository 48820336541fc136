"""Mixing sources to target weights by Pfair scheduling.

Every source's documents, in the order of a hash of their ids, are cut into blocks of ``BLOCK`` characters; a
document belongs to the block in which it starts.  Block j of a source with weight w has the release time
floor(j / w) and the deadline ceil((j + 1) / w), in slots of one block; in each slot the released block with
the earliest deadline is taken.  As the weights sum to 1 this meets every deadline, so after any number of
slots every source has had its share up to less than one block.  Weights are exact fractions and nothing is
rounded, so the driver computes the schedule of the whole mix: one number for each ``BLOCK`` characters of it.

The mix ends when every source has been used up once; a source that is used up earlier starts again (another
epoch), so no document is lost and the weights hold to the end.  Target weights are a parameter (any positive
numbers by source); by default they are the sources' shares to the power ``ALPHA``, limited so that no source
is repeated more than about ``EPOCHS`` times.

Block numbers need running sums over a source, which would put a large source on one task.  They are made in
two levels: sums of (source, bucket of the hash) first, whose prefix sums are few, then running sums inside the
buckets.

Cases: a null source counts as the source ''.  A null text counts as 0 characters.  Documents without
characters belong to the block at their place.  Rows with a null ``doc_id`` share one place in the order;
repeated rows are documents of their own.  Ties in the order go by ``doc_id``, then by the text's hash.  An empty
table gives no rows.  Sources without a given weight are an error; weights of absent sources are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import packed, prepare, table

BLOCK = 32_768
ALPHA = 0.85
EPOCHS = 4
CHUNK = 1024
#: Sizes up to which the schedule is broadcast: a row for each source, and 8 bytes for each slot (16 MB).
BROADCAST_SOURCES, BROADCAST_SLOTS = 100_000, 2_000_000


def shares_of(blocks: Mapping[str, int], weights: Mapping[str, float] | None = None) -> dict[str, int]:
    """Weights of the sources as whole numbers in exactly the proportions wanted."""
    if weights is None:
        top = max(blocks.values())
        want = {s: Fraction(min(top ** (1 - ALPHA) * n**ALPHA, float(EPOCHS * n))) for s, n in blocks.items()}
    else:
        want = {s: Fraction(weights[s]) for s in blocks}
        if min(want.values()) <= 0:
            raise ValueError("weights must be positive")
    unit = math.lcm(*(w.denominator for w in want.values()))
    whole = {s: int(w * unit) for s, w in want.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def schedule(shares: Mapping[str, int], blocks: Mapping[str, int] | None = None) -> dict[str, list[int]]:
    """The slots that each source gets, by earliest deadline first among released blocks, until each has had
    ``blocks``; by default as many as its share, which is one period."""
    total = sum(shares.values())
    names = sorted(shares)
    need = shares if blocks is None else blocks
    short = sum(need[s] > 0 for s in names)
    waiting = [(0, i, 0) for i in range(len(names))]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    got: dict[str, list[int]] = {s: [] for s in names}
    t = 0
    while short:
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // shares[names[i]]), i, j))
        _, i, j = heapq.heappop(ready)
        got[names[i]].append(t)
        short -= j + 1 == need[names[i]]
        heapq.heappush(waiting, ((j + 1) * total // shares[names[i]], i, j + 1))
        t += 1
    return got


def _blocks(docs: DataFrame, block: int, keep: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """The columns ``keep`` as ``row``, with source and block, and the number of blocks by source."""
    text = F.col("text").cast("string")
    src = packed(docs, keep, id=F.col("doc_id").cast("long"), source=F.coalesce(F.col("source").cast("string"), F.lit("")), order=F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), chars=F.length(F.coalesce(text, F.lit(""))).cast("long"), hash=F.xxhash64(text)).withColumn("bucket", F.substring("order", 1, 3))
    sums = src.groupBy("source", "bucket").agg(F.sum("chars").alias("sum"))
    total = {r[0]: r[1] for r in sums.groupBy("source").agg(F.sum("sum")).collect()}  # a row for each source
    n = {s: max(1, -(-c // block)) for s, c in total.items()}
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(F.col("source").alias("source_"), F.col("bucket").alias("bucket_"), before.alias("before"))
    inner = Window.partitionBy("source", "bucket").orderBy("order", "id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("chars").over(inner), F.lit(0))
    joined = src.join(base, (F.col("source") == F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    return joined.withColumn("start", start).withColumn("block", F.floor(F.col("start") / block)), n


def _slotted(docs: DataFrame, weights: Mapping[str, float] | None, block: int, keep: list[str]) -> tuple[DataFrame, int]:
    """Rows of the mix with slot and epoch, and the number of slots."""
    rows, n = _blocks(docs, block, keep)
    spark = docs.sparkSession
    at = schedule(shares_of(n, weights), n) if n else {}
    end = max((x[-1] for x in at.values()), default=-1) + 1
    # one row for each source, and one number for each slot in rows of CHUNK blocks
    p = spark.createDataFrame([(s, n[s], len(at[s])) for s in sorted(n)], "s string, n long, used long")
    q = spark.createDataFrame([(s, k // CHUNK, at[s][k : k + CHUNK]) for s in sorted(n) for k in range(0, len(at[s]), CHUNK)], "of string, chunk long, at array<long>")
    few = len(n) <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(p) if few else p, F.col("source") == F.col("s")).withColumn("block", F.least("block", F.col("n") - 1))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("used") - 1 - F.col("block")) / F.col("n")))))
    i = F.col("block") + F.col("epoch") * F.col("n")
    rows = rows.join(F.broadcast(q) if few and end <= BROADCAST_SLOTS else q, (F.col("source") == F.col("of")) & (F.floor(i / CHUNK) == F.col("chunk")))
    slot = F.get("at", F.pmod(i, F.lit(CHUNK)).cast("int"))
    return rows.withColumn("slot", slot), end


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """(slot, source, block, epoch, doc_id, start): the schedule; ``start`` is the place in the source's order."""
    prepare(docs.sparkSession)
    rows, _ = _slotted(docs, weights, block, ["doc_id"])  # the texts needn't move for the schedule alone
    return rows.select(F.col("slot").cast("long").alias("slot"), "source", F.col("block").cast("long").alias("block"), F.col("epoch").cast("long").alias("epoch"), F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start"))


#: Quotients within 1e-9 of a whole number count as that number: sums of doubles stand for the exact fractions here.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(doc_id::varchar, '')) AS o, length(coalesce(text, ''))::bigint AS chars FROM documents),
st AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM d),
n AS (SELECT source, greatest(1, (sum(chars)::bigint + {BLOCK - 1}) // {BLOCK}) AS n FROM d GROUP BY source),
w AS (SELECT source, n, row_number() OVER (ORDER BY source) AS i, least(pow((SELECT max(n) FROM n)::double, {1 - ALPHA}) * pow(n::double, {ALPHA}), {EPOCHS}.0::double * n) AS want FROM n),
l AS (SELECT list((SELECT sum(want ORDER BY i) FROM w) / want ORDER BY i) AS gap, list(n ORDER BY i) AS need, count(*)::bigint AS m FROM w),
e AS (SELECT -1::bigint AS t, list_transform(need, lambda x: 0::bigint) AS c, 0::bigint AS pick FROM l
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, j: CASE WHEN j = b THEN x + 1 ELSE x END), b FROM (
    SELECT t, c, list_min([ceil((c[j] + 1) * gap[j] - 1e-9)::bigint * 1000000 + j for j in range(1, m + 1) if floor(c[j] * gap[j] + 1e-9) <= t + 1]) % 1000000 AS b FROM e, l
    WHERE len([j for j in range(1, m + 1) if c[j] < need[j]]) > 0)),
a AS (SELECT source, n, t, row_number() OVER (PARTITION BY source ORDER BY t) - 1 AS j, count(*) OVER (PARTITION BY source) AS used FROM e JOIN w ON w.i = e.pick),
u AS (SELECT DISTINCT source, n, used FROM a),
b AS (SELECT doc_id, st.source, start, n, used, least(start // {BLOCK}, n - 1) AS block FROM st JOIN u USING (source)),
r AS (SELECT *, unnest(range((used - 1 - block) // n + 1)) AS epoch FROM b)
SELECT a.t AS slot, r.source, block, epoch, doc_id, start FROM r JOIN a ON a.source = r.source AND a.j = block + epoch * r.n
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` in the order of the mix; documents of sources that start again come once for each epoch."""
    prepare(spark)
    rows, end = _slotted(docs, None, BLOCK, docs.columns)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # whole slots in order: no sampling job, and partitions hold about as many blocks each
    rows = rows.withColumn("part", F.floor(F.col("slot") * parts / max(end, 1)).cast("int"))
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("slot", "start", "id").select("row.*")
