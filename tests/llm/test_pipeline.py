import corpus_pipeline as p
from quillspark.llm import bpe, langid, mixing, pii, simhash
from quillspark.llm.common import written
from quillspark.llm.pretokens import VOCABULARY, encoding, ranks_of


def test_stages_one_by_one(spark, sf, docs):
    """Each stage against what its operator says about its own input."""
    assert [f for _, f in p.STAGES] == [langid.stage, simhash.stage, pii.stage, mixing.stage, bpe.stage]
    now = docs
    for name, stage in p.STAGES:
        after = spark.createDataFrame(stage(spark, now, sf).collect(), None if name == "tokens" else docs.schema) if name != "tokens" else stage(spark, now, sf)
        rows, left = now.collect(), after.collect()
        ids = {r.doc_id for r in left}
        if name != "tokens":
            assert after.columns == docs.columns
        if name == "language":
            assert ids == {r.doc_id for r in langid.languages(now).collect() if r.kept}
        elif name == "near_duplicates":
            assert ids == {r.doc_id for r in rows} - {r.doc_id for r in simhash.near_duplicates(now).collect()}
        elif name == "personal_data":
            assert sorted((r.doc_id, r.text) for r in left) == sorted((r.doc_id, t) for r, t in zip(rows, pii.mask([r.text for r in rows], pii.train()), strict=True))
        elif name == "mixing":
            assert sorted(r.doc_id for r in left) == sorted(r.doc_id for r in mixing.mix(now).collect())
        else:
            enc = encoding(ranks_of(VOCABULARY))
            want = {r.doc_id: enc.encode_ordinary(r.text) for r in rows}
            assert {r.doc_id: list(r.ids) for r in left} == want
            assert len(left) == len(rows)
        now = after


def test_odd_and_empty_tables(spark, odd, none, sf):
    for docs in (odd, none):
        now = docs
        for _, stage in p.STAGES:
            now = stage(spark, now, sf)
        assert now.columns == ["doc_id", "ids", "n_tokens", "exact", "place"]
        assert (now.count() > 0) == (docs is odd)


def test_rows_keep_the_order_of_the_mix(spark, sf, docs):
    """The whole run, from files to files: sorted by place, the tokens are the mix slot by slot."""
    now = docs
    for name, stage in p.STAGES[:3]:
        now = written(stage(spark, now, sf), name)
    mixed = mixing.mix(now).collect()
    want = [r.doc_id for r in sorted(mixed, key=lambda r: (r.slot, r.start, r.doc_id))]
    got = p.run(spark, sf).select("doc_id", "place").collect()
    assert len({r.place for r in got}) == len(got)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.place)] == want
    assert len({*want}) > 100
