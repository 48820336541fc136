import math

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import simhash as s


def clusters(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def near(code, radius):
    d = np.bitwise_count(code[:, None, :] ^ code[None, :, :]).sum(axis=2, dtype=int)
    return [(i, j) for i, j in zip(*np.nonzero(d <= radius), strict=True) if i < j]


def test_gray_rank_is_a_bijection():
    code = np.random.default_rng(1).integers(0, 1 << 63, (500, 4)).astype(np.uint64)
    assert (s.gray_code(s.gray_rank(code)) == code).all()


def test_hierarchy_finds_exactly_the_near_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (40, 4)).astype(np.uint64)
    code = np.repeat(base, 5, axis=0)
    for _ in range(30):
        i = np.arange(len(code))
        code[i, rng.integers(0, 4, len(code))] ^= np.uint64(1) << rng.integers(0, 63, len(code)).astype(np.uint64)
    rank = s.gray_rank(code)
    code = code[np.lexsort(rank.T[::-1])]
    i, j = s.join_codes(np.zeros(len(code), np.int64), code)
    got = clusters(zip(i.tolist(), j.tolist(), strict=True), len(code))
    assert got == clusters(near(code, s.RADIUS), len(code))


def test_groups_against_all_pairs(docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    ids = [r.doc_id for r in rows]
    f = s.fingerprints_of(pa.array([r.text for r in rows], pa.string()))
    has = f.any(axis=1)
    pairs = [(i, j) for i, j in near(f, s.RADIUS) if has[i] and has[j]]
    want = clusters(pairs, len(ids))
    got = {r.doc_id: r.kept_doc_id for r in s.near_duplicates(docs).collect()}
    assert all(want[ids.index(a)] == want[ids.index(b)] for a, b in got.items())
    copies = {ids[i] for i, w in enumerate(want) if w != i}
    assert len(copies & set(got)) >= 0.9 * len(copies) > 0


def test_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.kept_doc_id) for r in s.near_duplicates(odd).collect()}
    assert got == {(9, 1)}
    kept = s.stage(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11]
    assert s.near_duplicates(none).count() == 0
    assert s.stage(spark, none, "").count() == 0


@pytest.mark.parametrize("n", [2, 10_000, 210_000, 1 << 20, 15_000_000, 1_000_000_000])
@pytest.mark.parametrize("radius", [3, 20, s.RADIUS, 70])
def test_no_pair_at_the_radius_passes_all_chunks(n, radius):
    """Differences that are above every chunk's threshold are more than the radius, and chunks take each bit at most once."""
    cut = s.chunks(n, n * n // 2, radius)
    assert not cut or sum(most + 1 for _, _, most in cut) > radius
    assert all(a + w <= b for (a, w, _), (b, _, _) in zip(cut, cut[1:], strict=False))
    assert all(a >= 0 and a + w <= s.BITS and 0 <= most < w for a, w, most in cut)


def close_pairs(pairs, distance, seed):
    rng = np.random.default_rng(seed)
    left = rng.integers(0, 2, (pairs, s.BITS), dtype=np.uint8)
    right = left.copy()
    for row, d in zip(right, distance, strict=True):
        row[rng.choice(s.BITS, d, replace=False)] ^= 1
    return np.packbits(np.concatenate([left, right]), axis=1).view(">u8").astype(np.uint64)


@pytest.mark.parametrize("seed", range(4))
def test_every_pair_at_the_radius_is_found(spark, seed, monkeypatch):
    """Sampled tables with a recall of 0.98 left some of these out."""
    pairs = 1500
    distance = np.tile([44, 45, 46, 47], pairs // 4)
    code = close_pairs(pairs, distance, seed)
    rank = s._to_bytes(s.gray_rank(code)).to_pylist()
    codes = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rank)], "id long, rank binary")
    want = {(i, i + pairs) for i in range(pairs) if distance[i] <= s.RADIUS}
    monkeypatch.setattr(s, "BLOCK", 1000 if seed % 2 else 1 << 20)
    monkeypatch.setattr(s, "TASKS", 6)
    assert {(r.a, r.b) for r in s.near_pairs(codes, len(code)).collect()} == want


@pytest.mark.parametrize("crowd", [20, 1 << 11])
@pytest.mark.parametrize("node_s", [1e-9, 1.0])
def test_chunks_and_parts_find_what_all_pairs_find(monkeypatch, node_s, crowd):
    monkeypatch.setattr(s, "NODE_S", node_s)  # cheap nodes: chunks; dear ones: all pairs
    monkeypatch.setattr(s, "PAIR_S", 1e-6 if node_s < 1 else 6e-9)
    monkeypatch.setattr(s, "CROWD", crowd)
    code = close_pairs(600, np.arange(600) % 60, 5)
    code = np.concatenate([code, code[:1] ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))[:, None]])
    assert bool(s.chunks(len(code), len(code) ** 2)) == (node_s < 1)
    pairs = near(code, s.RADIUS)
    for right in (None, np.random.default_rng(1).random(len(code)) < 0.4):
        want = clusters([(i, j) for i, j in pairs if right is None or right[i] != right[j]], len(code))
        roots = [s.near_rows(code, right, s.RADIUS, p, 3) for p in range(3)]
        assert clusters([(i, int(r)) for root in roots for i, r in enumerate(root)], len(code)) == want
        assert s.near_rows(code, right).tolist() == want


def test_recall_by_distance_with_the_tables_of_15_million(spark):
    rng = np.random.default_rng(3)
    pairs = 800
    distance = np.tile([29, 36, 40, 46], pairs // 4)
    left = rng.integers(0, 2, (pairs, s.BITS), dtype=np.uint8)
    right = left.copy()
    for row, d in zip(right, distance, strict=True):
        row[rng.choice(s.BITS, d, replace=False)] ^= 1
    code = np.packbits(np.concatenate([left, right]), axis=1).view(">u8").astype(np.uint64)
    rank = s._to_bytes(s.gray_rank(code)).to_pylist()
    codes = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rank)], "id long, rank binary")
    found = {(r.a, r.b) for r in s.near_pairs(codes, 15_000_000).collect()}
    hit = np.array([(i, i + pairs) in found for i in range(pairs)])
    assert len(found) == hit.sum()
    assert {int(d): hit[distance == d].mean() >= 0.95 for d in set(distance)} == dict.fromkeys((29, 36, 40, 46), True)


def test_a_cluster_of_many_isnt_expanded():
    """Thousands of close fingerprints: few edges come, and they connect all of them."""
    rng = np.random.default_rng(7)
    n = 20_000
    code = np.repeat(rng.integers(0, 1 << 63, (1, 4)).astype(np.uint64), n, axis=0)
    for _ in range(6):
        code[np.arange(n), rng.integers(0, 4, n)] ^= np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64)
    code = np.unique(code, axis=0)
    code = code[np.lexsort(s.gray_rank(code).T[::-1])]
    i, j = s.join_codes(np.zeros(len(code), np.int64), code)
    root, member = s.forest(np.minimum(i, j), np.maximum(i, j))
    assert set(root.tolist()) == {0}
    assert len(member) == len(code) - 1
    assert len(i) < 60 * len(code)


def test_one_bucket_is_exact_on_the_documents(docs):
    """With all fingerprints in one Gray-ordered hierarchy the groups are those of all pairs."""
    f = s.fingerprints_of(pa.array([r.text for r in docs.select("text").collect()], pa.string()))
    f = np.unique(f[f.any(axis=1)], axis=0)
    f = f[np.lexsort(s.gray_rank(f).T[::-1])]
    i, j = s.join_codes(np.zeros(len(f), np.int64), f)
    assert clusters(zip(i.tolist(), j.tolist(), strict=True), len(f)) == clusters(near(f, s.RADIUS), len(f))
