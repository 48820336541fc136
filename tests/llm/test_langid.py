import itertools

import numpy as np
import pyarrow as pa

from quillspark.llm import langid
from quillspark.llm.common import Texts


def test_marginals_against_all_labellings():
    """The message before a chain's first word is uniform and goes through the transitions."""
    rng = np.random.default_rng(3)
    k, edge = 3, np.array([0, 4, 4, 5, 11])
    score, trans = rng.normal(size=(11, k)), rng.normal(size=(k, k))
    got = langid.marginals(score, trans, edge, block=2)
    for a, z in itertools.pairwise(edge.tolist()):
        want = np.zeros((z - a, k))
        for y in itertools.product(range(k), repeat=z - a):
            w = np.exp(sum(score[a + i, c] for i, c in enumerate(y)) + sum(trans[p, q] for p, q in itertools.pairwise(y))) * (np.exp(trans[:, y[0]]).sum() if y else 1)
            want[np.arange(z - a), list(y)] += w
        np.testing.assert_allclose(got[a:z], want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_held_out_accuracy(docs):
    rows = [(r.text, r.lang) for r in docs.orderBy("doc_id").collect() if r.text and r.lang]
    model = langid.train(rows[::2])
    texts, langs = zip(*[(t, y) for t, y in rows[1::2] if len(t.split()) >= 5], strict=True)
    label = langid.judge(pa.array(texts), model, 0.5)[0].to_pylist()
    assert np.mean([a == b for a, b in zip(label, langs, strict=True)]) >= 0.9


def test_code_switched_words(docs):
    rows = [(r.text, r.lang) for r in docs.orderBy("doc_id").collect() if r.text and r.lang and len(r.text.split()) > 60]
    model = langid.train(rows[::2])
    by = {}
    for t, y in rows[1::2]:
        by.setdefault(y, " ".join(t.split()[:30]))
    mixed = " ".join(by[y] for y in sorted(by))
    t = Texts(pa.array([mixed]))
    gold = np.concatenate([np.full(len(Texts(pa.array([by[y]])).start), model.labels.index(y)) for y in sorted(by)])
    assert (model.words(t).argmax(axis=1) == gold).mean() >= 0.85


def test_odd_rows(spark, odd, none):
    got = langid.languages(odd).collect()
    assert len(got) == odd.count()
    assert all(r.lang is None and not r.kept for r in got if r.doc_id in (2, 3, 4, 6))
    assert all(r.kept for r in got if r.doc_id in (1, 5, 10))
    kept = langid.stage(spark, odd, "")
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 5, 10}
    assert langid.languages(none).count() == langid.stage(spark, none, "").count() == 0
    unlabelled = langid.languages(odd.drop("lang")).collect()
    assert all(r.lang is None and r.kept for r in unlabelled)


def test_the_sample_doesnt_depend_on_partitioning(docs):
    assert langid.sample(docs.repartition(5), 7) == langid.sample(docs.coalesce(1), 7)
    assert len(langid.sample(docs, 7)) == 7 * docs.where("lang <> ''").select("lang").distinct().count()


def test_ties_go_to_the_first_language(spark):
    model = langid.train([("aaa bbb ccc", "x"), ("aaa bbb ccc", "y")], chains=20)
    model.weights[:] = 0
    model.trans[:] = 0
    assert langid.judge(pa.array(["aaa zzz"]), model, 0.5)[0].to_pylist() == ["x"]
