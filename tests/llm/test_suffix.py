import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import suffix


def brute(rows, passage):
    words = [(d, re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) for d, t in rows if d is not None]
    n = Counter(tuple(w[i : i + passage]) for _, w in words for i in range(len(w) - passage + 1))
    covered = {}
    for d, w in words:
        for i in range(len(w) - passage + 1):
            if n[tuple(w[i : i + passage])] > 1:
                covered.setdefault(d, set()).update(range(i, i + passage))
    return covered


def covered(df):
    out = {}
    for r in df.collect():
        assert r.n_words == r.end_word - r.start_word
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_whole_table(spark, sf, same):
    same(suffix.op8_suffix_dedup(spark, sf), suffix.ORACLE)


@pytest.mark.parametrize(("run", "spread"), [(40_000, 40_000), (50, 60)])
def test_small_runs_and_ranges(spark, monkeypatch, run, spread):
    monkeypatch.setattr(suffix, "RUN", run)
    monkeypatch.setattr(suffix, "RANGE", spread)
    rng = np.random.default_rng(4)
    rows = [(int(i), " ".join(rng.choice(list("abcdefghij"), rng.integers(1, 60)))) for i in range(60)] + [(100, "q w e r t y " * 40), (101, "q w e r t y " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert covered(suffix.repeated_passages(df, passage=4, gram=2)) == brute(rows, 4)


def test_merge_is_sorted():
    rng = np.random.default_rng(6)
    every = [bytes(rng.integers(97, 99, rng.integers(1, 12)).astype(np.uint8)) for _ in range(300)]
    runs = [suffix.front_code(sorted(every[k::7])) for k in range(7)]
    assert [x for *_, x in suffix.merge(runs)] == sorted(every)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert covered(suffix.repeated_passages(odd)) == brute(rows, suffix.PASSAGE)
    assert covered(suffix.repeated_passages(odd, passage=3, gram=2)) == brute(rows, 3)
    assert suffix.repeated_passages(none).count() == 0
