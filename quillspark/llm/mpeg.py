"""MPEG audio in a binary column: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

*Frames.*  A header counts once it is locked.  The first lock, and one of another format after lost synchronisation
(joined files), need two more headers exactly where frames end, the next one of the same version, layer and sampling
rate; a lock of the format so far needs that one alone.  The end of the audio counts as such a header.  A frame that follows on the
previous one needs only its own header, of that same format.  Bytes between are junk, and every search that ends in
a frame after the first counts as one resynchronisation.  A last frame that is cut off isn't a frame; its bytes are
``truncated``.  Free-format and reserved headers aren't frames.  Version, layer, rate and channels are those of the first
frame; ``n_formats`` counts the formats.

*Tags.*  ID3v2 (2.2 to 2.4, title and artist, with padding and footer) before the audio, repeated if so; ID3v1 and APEv2
after it.  *Tables.*  Xing/Info (frames, bytes, the 100 seek points, quality, and the delay and padding that encoders
write in the LAME manner) or VBRI (bytes, frames, quality and its seek entries) in the first frame; that frame has
no audio and isn't counted.  ``table_seek`` has the seek points as bytes from the table's frame on; ``table_ok`` says that
frames and bytes, where given, are those of the audio (with the table's frame or without) and that the points rise.
VBRI's delay has no settled unit and is left out.  *Checksums.*  CRC-16 over the two last header bytes and the protected
bits: of Layer III its side information, of Layer I its bit allocation, of Layer II its bit allocation and scale
factor selection, whose length follows from the allocation tables; one that runs out of its frame is bad.
*Durations* are exact: the samples of each frame with its own sampling rate, less delay and padding, rounded down once.

Cases: a null value gives nulls, an empty one (or one without frames) zero frames, a null rate and no offsets.
Repeated rows each give a row.  An empty table gives no rows.  Other columns may have any name.  Values of any
length are parsed whole.  Nothing can tie.

No table here has audio, so ``synthetic_media`` makes a stream of frames from each document (the text is the
payload), with every feature above and with damage, and the query parses these for the whole table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import prepare, steps, table

_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits
_KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SCHEMA = (
    "version string, layer int, sample_rate int, channels int, n_frames long, n_samples long, duration_us long, bitrate_mode string, table_kind string, "
    "table_frames long, table_bytes long, table_quality int, table_seek array<long>, table_ok boolean, n_formats int, crc_good long, crc_bad long, crc_unverified long, resyncs long, junk long, truncated long, title string, artist string, seek array<long>"
)


def _headers() -> list[tuple[int, int, int, int, int] | None]:
    """By the bits of the second and third byte that matter: (length, samples, rate, layer, generation)."""
    out: list[tuple[int, int, int, int, int] | None] = []
    for x in range(1 << 16):
        b1, b2 = x >> 8, x & 255
        version, layer, rate, bit, pad = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 2 & 3, b2 >> 4, b2 >> 1 & 1
        if b1 & 0xE0 != 0xE0 or version == 1 or layer == 4 or rate == 3 or bit in (0, 15):
            out.append(None)
            continue
        gen = 1 if version == 3 else 2
        hz, bps = _RATES[version][rate], _KBPS[gen, layer][bit] * 1000
        if layer == 1:
            out.append(((12 * bps // hz + pad) * 4, 384, hz, layer, gen))
        else:
            samples = 576 if layer == 3 and gen == 2 else 1152
            out.append((samples // 8 * bps // hz + pad, samples, hz, layer, gen))
    return out


_HEAD = _headers()
_KIND = [0 if h is None else (x >> 8 & 0x1E) << 8 | (x & 0x0C) | 1 for x, h in enumerate(_HEAD)]  # version, layer, rate


def _crc_table() -> np.ndarray:
    t = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        t[i] = c
    return t


_CRC = _crc_table()


def crc16(rows: np.ndarray, bits: int | None = None) -> np.ndarray:
    """CRC-16 (0x8005, from 0xFFFF) of the first ``bits`` of each row of bytes, by default of all."""
    bits = rows.shape[1] * 8 if bits is None else bits
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(bits // 8):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    for k in range(bits % 8):
        top = (c >> np.uint16(15)) ^ (rows[:, bits // 8] >> np.uint8(7 - k) & np.uint8(1))
        c = (c << np.uint16(1)) ^ top * np.uint16(0x8005)
    return c


def _side(gen: int, mono: bool) -> int:
    return (17 if mono else 32) if gen == 1 else (9 if mono else 17)


#: Bits of the allocation of each subband in Layer II: ISO 11172-3 B.2a to B.2d, and ISO 13818-3 B.1.
_NBAL = ([4] * 11 + [3] * 12 + [2] * 4, [4] * 11 + [3] * 12 + [2] * 7, [4] * 2 + [3] * 6, [4] * 2 + [3] * 10, [4] * 4 + [3] * 7 + [2] * 19)


def _allocation(gen: int, hz: int, kbps: int) -> list[int]:
    """The allocation table of Layer II; kbps for each channel."""
    if gen == 2:
        return _NBAL[4]
    if 56 <= kbps and (hz == 48000 or kbps <= 80):
        return _NBAL[0]
    if kbps >= 96:
        return _NBAL[1]
    return _NBAL[3 if hz == 32000 else 2]


def _protected(data: bytes, at: int, layer: int, gen: int) -> int:
    """Bits after the checksum that it covers."""
    mode = data[at + 3] >> 6
    bound = ((data[at + 3] >> 4 & 3) + 1) * 4 if mode == 1 else 32
    if layer == 3:
        return _side(gen, mode == 3) * 8
    if layer == 1:
        return 128 if mode == 3 else (bound + (32 - bound) // 2) * 8
    channels = 1 if mode == 3 else 2
    table = _allocation(gen, _HEAD[data[at + 1] << 8 | data[at + 2]][2], _KBPS[gen, 2][data[at + 2] >> 4] // channels)
    body = int.from_bytes(data[at + 6 : at + 30].ljust(24, b"\0"), "big")  # at most 188 bits
    left, select = 192, 0
    for sb, n in enumerate(table):
        own = channels if sb < bound else 1  # above the bound both channels share one allocation
        for _ in range(own):
            left -= n
            if body >> left & (1 << n) - 1:
                select += 2 * channels // own
    return 192 - left + select


def _safe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _text(b: bytes) -> str:
    if not b:
        return ""
    kind = ("latin-1", "utf-16", "utf-16-be", "utf-8")[b[0]] if b[0] < 4 else "latin-1"
    return b[1:].decode(kind, "replace").split("\0")[0]


def id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """(end of the tag, title and artist); the end is ``at`` without a tag."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at, {}
    major, flags = data[at + 3], data[at + 5]
    size = _safe(data[at + 6 : at + 10])
    body = data[at + 10 : at + 10 + size]
    end = min(len(data), at + 10 + size + (10 if flags & 16 else 0))
    if flags & 128:
        body = body.replace(b"\xff\x00", b"\xff")
    p = 0
    if flags & 64 and len(body) >= 4:
        p = _safe(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4
    names = {b"TIT2": "title", b"TT2": "title", b"TPE1": "artist", b"TP1": "artist"}
    found: dict[str, str] = {}
    name, head = (3, 6) if major == 2 else (4, 10)
    while p + head <= len(body) and body[p]:
        raw = body[p + name : p + name + (3 if major == 2 else 4)]
        n = _safe(raw) if major == 4 else int.from_bytes(raw, "big")
        key = names.get(body[p : p + name])
        if key and key not in found:
            found[key] = _text(body[p + head : p + head + n])
        p += head + n
    return end, found


def _confirmed(data: bytes, p: int, end: int, kind: int, more: int) -> bool:
    """Whether ``more`` headers follow on each other after the one at p, or the end does: the next one of its kind,
    the others of any."""
    for k in range(more):
        p += _HEAD[data[p + 1] << 8 | data[p + 2]][0]
        if p > end:
            return False
        if p + 4 > end:
            return True
        now = _KIND[data[p + 1] << 8 | data[p + 2]]
        if data[p] != 0xFF or not now or k == 0 and now != kind:
            return False
    return True


def vbr_table(data: bytes, first: int) -> tuple[dict | None, int]:
    """The variable-bitrate table in the frame at ``first``, and the samples of delay and padding."""
    length, _, _, layer, gen = _HEAD[data[first + 1] << 8 | data[first + 2]]
    end = first + length
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    found: dict = {"kind": None, "frames": None, "bytes": None, "quality": None, "seek": None}
    x = first + 4 + _side(gen, data[first + 3] >> 6 == 3)
    if layer == 3 and data[x : x + 4] in (b"Xing", b"Info") and x + 8 <= end:
        found["kind"], flags, y = data[x : x + 4].decode(), number(x + 4, 4), x + 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "seek", 100), (8, "quality", 4)):
            if flags & bit and y + size <= end:
                found[name] = list(data[y : y + 100]) if name == "seek" else number(y, size)
                y += size
        if found["seek"]:
            found["seek"] = [k * found["bytes"] // 256 for k in found["seek"]] if found["bytes"] else None
        v = number(y + 21, 3) if data[y : y + 4] in (b"LAME", b"Lavf", b"Lavc", b"L3.9") and y + 24 <= end else 0
        return found, (v >> 12) + (v & 0xFFF)
    x = first + 36
    if layer == 3 and data[x : x + 4] == b"VBRI" and x + 26 <= end:
        n, scale, size = number(x + 18, 2), number(x + 20, 2), number(x + 22, 2)
        found |= {"kind": "VBRI", "quality": number(x + 8, 2), "bytes": number(x + 10, 4), "frames": number(x + 14, 4)}
        if n and 1 <= size <= 4 and x + 26 + n * size <= end:
            found["seek"] = [scale * k for k in itertools.accumulate(number(x + 26 + size * i, size) for i in range(n))]
        return found, 0
    return None, 0


def parse(data: bytes) -> tuple:
    """One value, in the order of SCHEMA."""
    start, tags = 0, {}
    while True:
        at, more = id3v2(data, start)
        if at == start:
            break
        start, tags = at, more | tags
    end = len(data)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        for key, a in (("title", 3), ("artist", 33)):
            text = data[end - 128 + a : end - 128 + a + 30].split(b"\0")[0].decode("latin-1").rstrip()
            if text:
                tags.setdefault(key, text)
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = int.from_bytes(data[end - 20 : end - 16], "little"), int.from_bytes(data[end - 12 : end - 8], "little")
        size += 32 if flags >> 31 else 0
        if size <= end - start:
            end -= size
    seek: list[int] = []
    bits: set[int] = set()
    kinds: set[int] = set()
    at, kind, resyncs, junk, cut, locked = start, 0, 0, 0, 0, False
    while at + 4 <= end:
        if locked:
            x = data[at + 1] << 8 | data[at + 2]
            if data[at] == 0xFF and _KIND[x] == kind:
                n = _HEAD[x][0]
                if at + n > end:
                    cut = end - at
                    at = end
                    break
                seek.append(at)
                bits.add(x & 0xF0)
                at += n
                continue
            locked = False
        p = data.find(b"\xff", at, end - 3)
        while p >= 0:
            k = _KIND[data[p + 1] << 8 | data[p + 2]]
            if k and _confirmed(data, p, end, k, 1 if k == kind else 2):
                break
            p = data.find(b"\xff", p + 1, end - 3)
        if p < 0:
            break
        junk += p - at
        resyncs += bool(seek)
        kind, at, locked = k, p, True
        kinds.add(k)
    if at < end:
        junk += end - at
    title, artist = tags.get("title"), tags.get("artist")
    if not seek:
        return (None, None, None, None, 0, 0, 0, None, None, None, None, None, None, None, 0, 0, 0, 0, resyncs, junk, cut, title, artist, [])
    first = seek[0]
    _, _, hz, layer, _ = _HEAD[data[first + 1] << 8 | data[first + 2]]
    table, skip = vbr_table(data, first)
    audio = seek[1:] if table else seek
    if table:
        whole = sum(_HEAD[data[p + 1] << 8 | data[p + 2]][0] for p in seek)
        own = _HEAD[data[first + 1] << 8 | data[first + 2]][0]
        points = table["seek"] or []
        table["ok"] = table["frames"] in (None, len(audio), len(seek)) and table["bytes"] in (None, whole, whole - own) and points == sorted(points)
    good = bad = unknown = 0  # there is a rule for every layer
    by: dict[int, list[int]] = {}
    for p in audio:
        if not data[p + 1] & 1:
            h = _HEAD[data[p + 1] << 8 | data[p + 2]]
            by.setdefault(_protected(data, p, h[3], h[4]), []).append(p)
    raw = np.frombuffer(data, np.uint8)
    for n, places in by.items():
        size = 6 + -(-n // 8)
        p = np.array(places)
        fits = np.array([_HEAD[data[q + 1] << 8 | data[q + 2]][0] >= size for q in places])
        bad += int((~fits).sum())
        p = p[fits]
        cols = np.r_[2, 3, np.arange(6, size)]
        want = raw[p + 4].astype(np.uint16) << np.uint16(8) | raw[p + 5]
        ok = int((crc16(raw[p[:, None] + cols[None, :]], 16 + n) == want).sum())
        good, bad = good + ok, bad + len(p) - ok
    by_rate: dict[int, int] = {}
    for p in audio:
        h = _HEAD[data[p + 1] << 8 | data[p + 2]]
        by_rate[h[2]] = by_rate.get(h[2], 0) + h[1]
    by_rate[hz] = max(0, by_rate.get(hz, 0) - skip)
    duration = math.floor(sum(Fraction(n * 1_000_000, r) for r, n in by_rate.items()))
    mode = "VBR" if table and table["kind"] in ("Xing", "VBRI") or len(bits) > 1 else "CBR"
    version = {3: "1", 2: "2", 0: "2.5"}[data[first + 1] >> 3 & 3]
    t = [table[k] for k in ("kind", "frames", "bytes", "quality", "seek", "ok")] if table else [None] * 6
    return (version, layer, hz, 1 if data[first + 3] >> 6 == 3 else 2, len(audio), sum(by_rate.values()), duration, mode, *t, len(kinds), good, bad, unknown, resyncs, junk, cut, title, artist, audio)


_ARROW = pa.schema([("version", pa.string()), ("layer", pa.int32()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("n_frames", pa.int64()), ("n_samples", pa.int64()), ("duration_us", pa.int64()), ("bitrate_mode", pa.string()), ("table_kind", pa.string()), ("table_frames", pa.int64()), ("table_bytes", pa.int64()), ("table_quality", pa.int32()), ("table_seek", pa.list_(pa.int64())), ("table_ok", pa.bool_()), ("n_formats", pa.int32()), ("crc_good", pa.int64()), ("crc_bad", pa.int64()), ("crc_unverified", pa.int64()), ("resyncs", pa.int64()), ("junk", pa.int64()), ("truncated", pa.int64()), ("title", pa.string()), ("artist", pa.string()), ("seek", pa.list_(pa.int64()))])


def audio_columns(media: DataFrame, key: str = "doc_id", column: str = "audio") -> DataFrame:
    """(key, SCHEMA) of every row of ``media``."""
    prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "audio"):
                rows = [(None,) * len(_ARROW) if v is None else parse(v) for v in b.column("audio").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True))], ["key", *_ARROW.names])

    src = media.select(F.col(key).cast("long").alias("key"), F.col(column).cast("binary").alias("audio"))
    return src.mapInArrow(run, "key long, " + SCHEMA).withColumnRenamed("key", key)


# ---------------------------------------------------------------- synthetic media


def frame(version: int, layer: int, rate: int, bit: int, mono: bool, crc: bool, payload: bytes, damage: bool = False) -> bytes:
    """A frame whose body begins with ``payload``, cut or filled to its length."""
    b1, b2, b3 = 0xE0 | version << 3 | (4 - layer) << 1 | (not crc), bit << 4 | rate << 2, 0xC4 if mono else 0x04
    n = _HEAD[b1 << 8 | b2][0]
    head = bytes([0xFF, b1, b2, b3])
    if not crc:
        return head + payload[: n - 4].ljust(n - 4, b"\x55")
    body = payload[: n - 6].ljust(n - 6, b"\x55")
    gen = 1 if version == 3 else 2
    bits = _protected(head + b"\0\0" + body, 0, layer, gen)
    c = int(crc16(np.frombuffer(head[2:4] + body[: -(-bits // 8)], np.uint8)[None, :], 16 + bits)[0])
    return head + (c ^ damage).to_bytes(2, "big") + body


def synthesize(doc_id: int, source: str, text: bytes) -> tuple[bytes, dict]:
    """A stream made from a document, and what a parser must find."""
    r = (doc_id * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1
    r ^= r >> 29
    pick = lambda n, s: (r >> s) % n
    version, layer, rate = (3, 2, 0)[pick(3, 3)], (3, 3, 3, 1, 2)[pick(5, 7)], pick(3, 11)
    vbr, crc, mono, kind = layer == 3 and pick(2, 13), pick(2, 17), pick(2, 19), pick(3, 23)
    gen = 1 if version == 3 else 2
    spf, hz = _HEAD[(0xE0 | version << 3 | (4 - layer) << 1) << 8 | 9 << 4 | rate << 2][1:3]
    frames, at, k = [], 0, 0
    while at < len(text) or k < 2:
        bit = 9 + (k % 5 if vbr else 0)
        n = _HEAD[(0xE0 | version << 3 | (4 - layer) << 1) << 8 | bit << 4 | rate << 2][0]
        piece = text[at : at + n - 6]
        if k % 7 == 3:  # something like a header inside a frame
            piece = b"\xff\xfb\x90\x04" + piece[: n - 10]
            at += n - 10
        else:
            at += n - 6
        frames.append(frame(version, layer, rate, bit, bool(mono), bool(crc), piece, damage=k % 11 == 5))
        k += 1
    count, delay = len(frames), 0
    table, wants = None, {"table_bytes": None, "table_quality": None, "table_seek": None, "table_ok": None}
    head = b""
    if layer == 3 and vbr:
        if kind < 2:
            table, delay = "Xing", 576 + 1000
            whole = sum(map(len, frames))
            points = [256 * k // 100 for k in range(100)]
            body = b"\0" * _side(gen, bool(mono)) + b"Xing" + (15).to_bytes(4, "big") + count.to_bytes(4, "big") + whole.to_bytes(4, "big") + bytes(points) + (60 + kind).to_bytes(4, "big") + (b"LAME3.100", b"Lavc60.31")[kind] + b"\0" * 12 + (576 << 12 | 1000).to_bytes(3, "big")
            wants = {"table_bytes": whole, "table_quality": 60 + kind, "table_seek": [x * whole // 256 for x in points], "table_ok": True}
        else:
            table = "VBRI"
            each = [sum(map(len, frames[i * count // 8 : (i + 1) * count // 8])) for i in range(8)]
            scale = 1 + max(each) // 65536
            body = b"\0" * 32 + b"VBRI" + b"\0\1\0\0" + (75).to_bytes(2, "big") + sum(each).to_bytes(4, "big") + count.to_bytes(4, "big") + b"\0\x08" + scale.to_bytes(2, "big") + b"\0\2" + max(1, count // 8).to_bytes(2, "big") + b"".join((x // scale).to_bytes(2, "big") for x in each)
            wants = {"table_bytes": sum(each), "table_quality": 75, "table_seek": [scale * x for x in itertools.accumulate(y // scale for y in each)], "table_ok": True}
        head = frame(version, layer, rate, 12, bool(mono), False, body)
    junk = b""
    middle = len(frames) // 2
    if pick(4, 29) == 0 and count >= 6:
        junk = b"\xff\xff\x00junk between frames\xff\xe0"
    lead = (b"\0\0lead", b"\xff\xfa\x90\x04".ljust(417, b"\0") + b"\xff\xfa\x90\x04false lock", b"", b"", b"")[pick(5, 31)]
    # another file joined on, with another rate
    other = (rate + 1) % 3
    joined = [frame(version, layer, other, 9, bool(mono), False, b"joined")] * 4 if not table and pick(5, 47) == 0 else []
    tail = (joined or frames)[-1][: len((joined or frames)[-1]) // 2] if pick(4, 37) == 0 else b""
    name = f"{source or ''}-{doc_id}"
    tag = b""
    if pick(3, 41):
        value = b"\3" + name.encode()
        item = b"TIT2" + bytes([0, 0, len(value) >> 7, len(value) & 127]) + b"\0\0" + value
        body = item + b"\0" * 20
        tag = b"ID3\4\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body
    last = (b"TAG" + name.encode("latin-1", "replace")[:30].ljust(30, b"\0")).ljust(128, b"\0") if pick(3, 43) == 0 else b""
    base = len(tag) + len(lead) + len(head)
    offsets, p = [], base
    for i, f in enumerate(frames):
        p += len(junk) if i == middle else 0
        offsets.append(p)
        p += len(f)
    for f in joined:
        offsets.append(p)
        p += len(f)
    data = b"".join([tag, lead, head, *frames[:middle], junk, *frames[middle:], *joined, tail, last])
    other_hz = _RATES[version][other]
    samples = max(0, count * spf - delay)
    bad = sum(k % 11 == 5 for k in range(count)) if crc else 0
    want = {"n_frames": count + len(joined), "n_samples": samples + len(joined) * spf, "duration_us": math.floor(Fraction(samples * 1_000_000, hz) + Fraction(len(joined) * spf * 1_000_000, other_hz)), "n_formats": 1 + bool(joined), "sample_rate": hz, "layer": layer, "channels": 1 if mono else 2, "table_kind": table, "crc_bad": bad, "crc_good": count - bad if crc else 0, "crc_unverified": 0, "resyncs": int(bool(junk)) + bool(joined), "junk": len(junk) + len(lead), "truncated": len(tail), "seek": offsets}
    return data, want | wants


def synthetic_media(docs: DataFrame) -> DataFrame:
    """(doc_id, audio): a stream for each document; a null text gives a null value."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                made = [None if t is None else synthesize(d or 0, s, t)[0] for d, s, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "text")), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "audio"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, audio binary")


def op7_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_columns(synthetic_media(table(spark, sf_dir, "documents")))
