import math
from fractions import Fraction

import pytest

from quillspark.llm import mixing


def test_whole_table(spark, sf, same):
    same(mixing.op6_mixing(spark, sf), mixing.ORACLE)


@pytest.mark.parametrize("slots", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 991}, {"a": 500, "b": 499, "c": 1}])
def test_deviation_is_under_one_block(slots):
    period, got = sum(slots.values()), mixing.schedule(slots)
    assert sorted(t for ts in got.values() for t in ts) == list(range(period))
    for s, ts in got.items():
        assert len(ts) == slots[s]
        for j, t in enumerate(ts):
            assert j * period // slots[s] <= t < -(-(j + 1) * period // slots[s])


def test_odd_rows(spark, odd, none):
    rows = mixing.mix(odd, block=16).collect()
    assert sum(r.epoch == 0 for r in rows) == odd.count()
    kept = mixing.stage(spark, odd, "")
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd.collect()}
    assert mixing.mix(none).count() == mixing.stage(spark, none, "").count() == 0


def test_weights(docs):
    sources = [r.source for r in docs.select("source").distinct().collect()]
    rows = mixing.mix(docs, {s: 1.0 for s in sources}, block=2048).collect()
    slots = {s: len({(r.slot) for r in rows if r.source == s}) for s in sources}
    assert {(r.doc_id, r.epoch) for r in rows if r.epoch == 0} == {(r.doc_id, 0) for r in docs.collect()}
    assert max(slots.values()) > 0
    with pytest.raises(ValueError, match="positive"):
        mixing.mix(docs, {s: 0.0 for s in sources})


def under_one_block(got, weights):
    total = sum(map(Fraction, weights.values()))
    end = 1 + max(ts[-1] for ts in got.values())
    assert sorted(t for ts in got.values() for t in ts) == list(range(end))
    for s, ts in got.items():
        w = Fraction(weights[s]) / total
        # the share is furthest off just before and just after a block
        assert all(abs(j - w * t) < 1 and abs(j + 1 - w * (t + 1)) < 1 for j, t in enumerate(ts))
        assert abs(len(ts) - w * end) < 1


@pytest.mark.parametrize("weights", [None, {"a": math.pi, "b": 0.1, "c": 1 / 3, "d": 0.0007}])
def test_unrounded_weights_hold_over_many_periods(weights):
    blocks = {"a": 40_000, "b": 1234, "c": 5017, "d": 7}
    got = mixing.schedule(mixing.shares_of(blocks, weights), blocks)
    if weights is None:
        top = max(blocks.values())
        weights = {s: min(top ** (1 - mixing.ALPHA) * n**mixing.ALPHA, float(mixing.EPOCHS * n)) for s, n in blocks.items()}
    under_one_block(got, weights)
    assert all(len(got[s]) >= n for s, n in blocks.items())


def test_mix_holds_unrounded_weights(docs):
    sources = sorted(r.source for r in docs.select("source").distinct().collect())
    weights = {s: 1 + math.sqrt(i) for i, s in enumerate(sources)}
    rows = mixing.mix(docs, weights, block=16).collect()
    end = 1 + max(r.slot for r in rows)
    assert end > 20_000
    total = sum(map(Fraction, weights.values()))
    chars = {s: sum(len(r.text) for r in docs.where(docs.source == s).collect()) for s in sources}
    n = {s: -(-c // 16) for s, c in chars.items()}
    for r in rows:  # block number and slot of every row
        j, w = r.block + r.epoch * n[r.source], Fraction(weights[r.source]) / total
        assert math.floor(j / w) <= r.slot < math.ceil((j + 1) / w)


def test_one_block_of_the_targets_for_uneven_weights():
    for weights, blocks in (({"a": 0.3337, "b": 0.6663}, {"a": 33_000, "b": 67_000}), ({"a": 1.0, "b": 3_000_000.0}, {"a": 1, "b": 100_000})):
        under_one_block(mixing.schedule(mixing.shares_of(blocks, weights), blocks), weights)


def test_ties_of_the_order(spark):
    """Repeated rows and null ids share a place in the order: the text's hash decides, and each row is there once."""
    rows = [(None, "x" * 40, "s"), (None, "y" * 40, "s"), (1, "z" * 40, "s"), (1, "z" * 40, "s"), (2, "w" * 40, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = [tuple(r) for r in mixing.mix(df, block=16).collect() if r.epoch == 0]
    b = [tuple(r) for r in mixing.mix(df.repartition(4), block=16).collect() if r.epoch == 0]
    assert sorted(map(repr, a)) == sorted(map(repr, b))
    assert len(a) == len(rows)
