import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe, token_counts
from quillspark.llm.common import eights, equal_ranges
from quillspark.llm.pretokens import VOCABULARY, codepoints, encoding, ranks_of, starts

RANKS = ranks_of(VOCABULARY)
ENC = encoding(RANKS)
ENCODER = bpe.Encoder(RANKS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 'srevlt1\n\t.é你 \U0001f600"), max_size=400), min_size=1, max_size=4))
def test_chunk_reuse_equals_whole_texts(texts):
    """Short chunks, so that nearly every pre-token is near a join."""
    least, bpe.LEAST = bpe.LEAST, 1
    try:
        got = ENCODER.encode(texts, average=6)
    finally:
        bpe.LEAST = least
    assert [g.tolist() for g in got] == [ENC.encode_ordinary(t) for t in texts]
    assert [ENCODER.decode(g) for g in got] == texts


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_pretokens_cover_the_text(text):
    cp, off = codepoints([text])
    s = starts(cp, off).tolist()
    pieces = [text[a:b] for a, b in zip(s, [*s[1:], len(text)][: len(s)], strict=True)]
    assert "".join(pieces) == text
    assert [k for p in pieces for k in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)


def test_whole_table(docs):
    want = {r.doc_id: ENC.encode_ordinary(r.text) for r in docs.collect()}
    got = bpe.encode(docs).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want
    assert all(r.exact and r.n_tokens == len(r.ids) for r in got)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {d: len(x) for d, x in want.items()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_odd_rows(odd, none):
    want = sorted((r.doc_id or 0, -1 if r.text is None else len(ENC.encode_ordinary(r.text))) for r in odd.collect())
    assert sorted((r.doc_id or 0, -1 if r.n_tokens is None else r.n_tokens) for r in bpe.encode(odd).collect()) == want
    assert sorted((r.doc_id or 0, -1 if r.n_tokens is None else r.n_tokens) for r in token_counts.token_counts(odd).collect()) == want
    assert bpe.encode(none).count() == token_counts.token_counts(none).count() == bpe.decode(bpe.encode(none)).count() == 0


def test_table_never_decides_a_count():
    texts = ["hello world, it's 2024", "zzz qqq hello"]
    empty = token_counts.Table({}, 4)
    assert token_counts.count_tokens(texts, empty, ENC, {}).tolist() == [len(ENC.encode_ordinary(t)) for t in texts]
    full = token_counts.Table({p: len(ENC.encode_ordinary(p)) for p in ("hello", " world", ",", " it", "'s", " 202", " 2024")}, 16)
    assert token_counts.count_tokens(texts, full, ENC, {}).tolist() == [len(ENC.encode_ordinary(t)) for t in texts]


def test_pretokens_that_share_a_hash():
    """Thue-Morse words and their complements collide for polynomials modulo 2^64."""
    texts = []
    for k in range(9, 13):
        w = "a"
        for _ in range(k):
            w += w.translate(str.maketrans("ab", "ba"))
        texts += [w, w.translate(str.maketrans("ab", "ba")), w + "ba", w.translate(str.maketrans("ab", "ba")) + "ba"]
    cp, off = codepoints(texts)
    assert len(set(token_counts.hash_ranges(cp, off[:-1], off[1:]).tolist())) < len(texts)
    want = [ENC.encode_ordinary(t) for t in texts]
    for batch in (texts, texts[::-1], [" ".join(texts)]):
        want = [ENC.encode_ordinary(t) for t in batch]
        assert [x.tolist() for x in bpe.Encoder(RANKS).encode(batch)] == want
        assert token_counts.count_tokens(batch, token_counts.Table({}, 4), ENC, {}).tolist() == [len(x) for x in want]
    one = bpe.Encoder(RANKS)
    assert [one.encode([t])[0].tolist() for t in texts] == [ENC.encode_ordinary(t) for t in texts]
    table = token_counts.Table({t: len(ENC.encode_ordinary(t)) for t in ("ab", " ab")}, 4)
    assert table.look_up(np.array(table.keys[table.keys > 0][:1]), eights(np.frombuffer(("xy" + "\0" * 8).encode("utf-32-le"), np.uint32)), np.array([0]), np.array([2])).tolist() == [0]


@given(st.lists(st.tuples(st.text("ab\U0001f600", max_size=30), st.text("ab\U0001f600", max_size=30)), min_size=1, max_size=20))
def test_ranges_that_are_equal(pairs):
    pairs = [(x, y[: len(x)].ljust(len(x), "a")) for x, y in pairs]
    texts = [eights(np.frombuffer(("".join(t) + "\0" * 8).encode("utf-32-le"), np.uint32)) for t in zip(*pairs, strict=True)]
    size = np.array([len(x) for x, _ in pairs])
    at = np.cumsum(size) - size
    assert equal_ranges(texts[0], at, texts[1], at, size).tolist() == [x == y for x, y in pairs]
