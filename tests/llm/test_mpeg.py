import pytest

from quillspark.llm import mpeg


def test_planted_features_are_found(docs):
    names = mpeg._ARROW.names
    for r in docs.collect():
        data, want = mpeg.synthesize(r.doc_id, r.source, (r.text or "").encode())
        got = dict(zip(names, mpeg.parse(data), strict=True))
        assert {k: got[k] for k in want} == want, r.doc_id


def test_query_equals_the_parser(spark, sf, docs):
    want = {r.doc_id: mpeg.parse(mpeg.synthesize(r.doc_id, r.source, r.text.encode())[0])[4] for r in docs.collect()}
    assert {r.doc_id: r.n_frames for r in mpeg.op7_mpeg(spark, sf).collect()} == want


def test_damage():
    for data in (b"", b"\xff", b"\xff" * 5000, b"ID3", b"ID3\4\0\0\x7f\x7f\x7f\x7f", b"TAG".ljust(128, b"\0"), bytes(range(256)) * 20):
        assert mpeg.parse(data)[4] == 0
    one = mpeg.frame(3, 3, 0, 9, False, True, b"payload")
    assert mpeg.parse(one)[4] == 1
    assert mpeg.parse(one[:-1])[4] == 0


def test_a_stream_in_parts_of_several_formats():
    """What is expected here is counted by hand: no part of the parser makes it."""
    one = [mpeg.frame(3, 3, 0, 9, False, False, b"a")] * 5  # MPEG-1 Layer III, 44.1 kHz, 128 kbit/s: 417 bytes, 1152 samples
    two = [mpeg.frame(2, 2, 1, 8, True, False, b"b")] * 3  # MPEG-2 Layer II, 24 kHz, 64 kbit/s: 384 bytes, 1152 samples
    data = b"".join([*one, *two, b"junk", *one])
    got = dict(zip(mpeg._ARROW.names, mpeg.parse(data), strict=True))
    assert [len(one[0]), len(two[0])] == [417, 384]
    assert (got["n_frames"], got["n_formats"], got["resyncs"], got["junk"]) == (13, 2, 2, 4)
    assert got["seek"] == [417 * k for k in range(5)] + [2085 + 384 * k for k in range(3)] + [3241 + 417 * k for k in range(5)]
    assert got["duration_us"] == 10 * 1152 * 1_000_000 // 44100 + 3 * 48_000  # 261224.49 and 144000
    false = b"\xff\xfa\x90\x04".ljust(417, b"\0") + b"\xff\xfa\x90\x04"
    got = dict(zip(mpeg._ARROW.names, mpeg.parse(false + b"".join(two)), strict=True))
    assert (got["n_frames"], got["layer"], got["junk"]) == (3, 2, len(false))


def test_tables_that_dont_fit_the_audio():
    head = lambda frames, size, points: mpeg.frame(3, 3, 0, 12, False, False, b"\0" * 32 + b"Xing" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + size.to_bytes(4, "big") + bytes(points))
    body = mpeg.frame(3, 3, 0, 9, False, False, b"x") * 4
    rising = list(range(0, 200, 2))
    for first, ok in ((head(4, len(body), rising), True), (head(5, len(body), rising), True), (head(3, len(body), rising), False), (head(4, 17, rising), False), (head(4, len(body), rising[::-1]), False)):
        got = dict(zip(mpeg._ARROW.names, mpeg.parse(first + body), strict=True))
        assert (got["table_kind"], got["n_frames"], got["table_ok"]) == ("Xing", 4, ok)
    assert got["table_seek"] == [k * len(body) // 256 for k in rising[::-1]]


def test_odd_rows(spark, odd, none):
    rows = mpeg.audio_columns(mpeg.synthetic_media(odd)).collect()
    assert len(rows) == odd.count()
    assert all(r.n_frames is None for r in rows if r.doc_id == 2)
    media = spark.createDataFrame([(1, b"", 5), (None, None, 6), (3, b"junk", 7)], "doc_id long, audio binary, n_frames int")
    assert sorted((r.doc_id or 0, r.n_frames) for r in mpeg.audio_columns(media).where("n_frames is not null").collect()) == [(1, 0), (3, 0)]
    assert mpeg.audio_columns(mpeg.synthetic_media(none)).count() == 0


def crc_bits(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ b else 0)) & 0xFFFF
    return c


# version, rate, bitrate index, byte with the mode, bits of the allocation, subbands: one for each table, mono and joint stereo
@pytest.mark.parametrize(
    ("version", "rate", "bit", "mode", "allocation", "scfsi"),
    [
        (3, 1, 8, 0x04, 2 * 88, 2 * 27 * 2),  # 48 kHz, 64 kbit/s a channel: B.2a
        (3, 0, 10, 0x04, 2 * 94, 2 * 30 * 2),  # 44.1 kHz, 96 kbit/s a channel: B.2b
        (3, 0, 10, 0xC4, 94, 30 * 2),  # mono
        (3, 0, 10, 0x44, 94 + 16, 2 * 30 * 2),  # joint stereo, bound 4
        (3, 0, 4, 0x04, 2 * 26, 2 * 8 * 2),  # 44.1 kHz, 32 kbit/s a channel: B.2c
        (3, 2, 4, 0x04, 2 * 38, 2 * 12 * 2),  # 32 kHz: B.2d
        (2, 0, 10, 0x04, 2 * 75, 2 * 30 * 2),  # MPEG-2
    ],
)
def test_layer_two_checksums(version, rate, bit, mode, allocation, scfsi):
    head = bytes([0xFF, 0xE0 | version << 3 | 4, bit << 4 | rate << 2, mode])
    n = mpeg._HEAD[head[1] << 8 | head[2]][0]
    names = mpeg._ARROW.names
    for fill, size in ((b"\0", allocation), (b"\xff", allocation + scfsi)):
        body = fill * (n - 6)
        bits = [b >> k & 1 for b in head[2:4] + body for k in range(7, -1, -1)][: 16 + size]
        good = head + crc_bits(bits).to_bytes(2, "big") + body
        inside, outside = bytearray(good), bytearray(good)
        inside[6 + (size - 1) // 8] ^= 128 >> (size - 1) % 8
        outside[6 + size // 8] ^= 128 >> size % 8
        for data, want in ((good, (2, 0, 0)), (bytes(outside), (2, 0, 0)), (bytes(inside), (1, 1, 0))):
            got = dict(zip(names, mpeg.parse(good + data), strict=True))
            assert (got["crc_good"], got["crc_bad"], got["crc_unverified"]) == want
