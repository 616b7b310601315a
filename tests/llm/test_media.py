import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import media
from tests.llm.conftest import documents


def test_round_trip_of_bytes():
    rng = np.random.default_rng(1)
    payloads = [media.padded(x) for x in (b"", b"x", bytes(range(256)) * 9, b"\xff" * 5000, b"\xff\x00" * 700, rng.integers(0, 256, 900_000, dtype=np.uint8).tobytes())]
    for payload, avi in zip(payloads, media.encode_many(payloads), strict=True):
        assert media.film(avi)[1].tobytes() == payload


def test_general_decoder_reads_stored_frames():
    payload = media.padded(bytes(range(192)))
    avi = media.encode_many([payload])[0]
    _, starts, sizes = media.parse_avi(avi)
    plane = media.decode_jpeg(avi[starts[0] : starts[0] + sizes[0]])
    assert plane.shape == (96, 128) and plane[::8, ::8].tobytes() == payload and plane[3::8, 5::8].tobytes() == payload


def _jpeg(plane: np.ndarray, quantiser: int = 1) -> bytes:
    """A baseline grey JPEG with full blocks, each coefficient in 16-bit code words of equal length."""
    h, w = plane.shape
    bits = []
    symbols = sorted({0x00, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 11)})
    code = {s: k for k, s in enumerate(symbols)}

    def put(v, n):
        bits.extend(v >> k & 1 for k in range(n - 1, -1, -1))

    def value(v):
        s = abs(v).bit_length()
        return s, v if v >= 0 else v + (1 << s) - 1

    before = 0
    for y in range(0, h, 8):
        for x in range(0, w, 8):
            c = media._COS.T @ (plane[y : y + 8, x : x + 8].astype(float) - 128) @ media._COS
            q = np.rint(c / quantiser).astype(int).ravel()[media.ZIGZAG].tolist()
            s, b = value(q[0] - before)
            before = q[0]
            put(s, 4)
            put(b, s)
            run = 0
            last = max((k for k in range(1, 64) if q[k]), default=0)
            for k in range(1, last + 1):
                if q[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    put(code[0xF0], 8)
                    run -= 16
                s, b = value(q[k])
                put(code[run << 4 | s], 8)
                put(b, s)
                run = 0
            if last < 63:
                put(code[0], 8)
    bits += [1] * (-len(bits) % 8)
    body = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    seg = media._segment
    dc = bytes([0, 0, 0, 0, 12] + [0] * 12 + list(range(12)))
    ac = bytes([0x10] + [0] * 7 + [len(symbols)] + [0] * 8 + symbols)
    return b"\xff\xd8" + seg(0xDB, bytes([0] + [quantiser] * 64)) + seg(0xC0, struct.pack(">BHHBBBB", 8, h, w, 1, 1, 0x11, 0)) + seg(0xC4, dc) + seg(0xC4, ac) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body + b"\xff\xd9"


def test_general_decoder_reads_full_blocks():
    rng = np.random.default_rng(4)
    plane = rng.integers(0, 256, (24, 40), dtype=np.uint8)
    assert np.abs(media.decode_jpeg(_jpeg(plane)).astype(int) - plane).max() <= 1


def _avi_of(frames: list[bytes], indexed: bool) -> bytes:
    sizes = np.array([len(f) for f in frames])
    body = b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2) for f in frames)
    avi = media._avi(body, sizes)
    return avi if indexed else avi[: avi.rindex(b"idx1")]


@pytest.mark.parametrize("indexed", [True, False])
def test_shots_of_ordinary_frames(spark, indexed):
    dark, light = (np.full((16, 16), v, np.uint8) for v in (20, 220))
    data = _avi_of([_jpeg(p) for p in [dark] * 4 + [light] * 3 + [dark] * 2], indexed)
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no film")), (3, None)], "doc_id long, media binary")
    found = [tuple(r) for r in media.clips(df).orderBy("doc_id", "clip").collect()]
    assert found[:3] == [(1, 0, 0, 160, 0, 4, None), (1, 1, 160, 280, 4, 3, None), (1, 2, 280, 360, 7, 2, None)]
    assert found[3:] == [(2, None, None, None, None, None, "ValueError: no AVI")]


def _standard_jpeg(level: int) -> bytes:
    """A grey 16 x 16 frame of one level in the standard tables, which it leaves out."""
    code = {s: (length, c) for (length, c), s in media.standard_tables()[0].items()}
    difference = 8 * (level - 128)
    size = abs(difference).bit_length()
    bits = []
    for unit in range(4):
        s, v = (size, difference if difference >= 0 else difference + (1 << size) - 1) if unit == 0 else (0, 0)
        for n, x in ((*code[s],), (s, v), (4, 0b1010)):  # 1010: end of block in the standard table of luma
            bits += [x >> k & 1 for k in range(n - 1, -1, -1)]
    bits += [1] * (-len(bits) % 8)
    body = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    seg = media._segment
    return b"\xff\xd8" + seg(0xDB, bytes([0] + [1] * 64)) + seg(0xC0, struct.pack(">BHHBBBB", 8, 16, 16, 1, 1, 0x11, 0)) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body + b"\xff\xd9"


def test_standard_tables():
    """Known codes of ITU-T T.81, tables K.3 to K.6; all tables are complete but for the code of ones."""
    tables = media.standard_tables()
    by_symbol = {n: {s: k for k, s in t.items()} for n, t in tables.items()}
    assert by_symbol[0][0] == (2, 0b00) and by_symbol[0][6] == (4, 0b1110) and by_symbol[0][11] == (9, 0b111111110)
    assert by_symbol[1][0] == (2, 0b00) and by_symbol[1][11] == (11, 0b11111111110)
    assert by_symbol[0x10][0x00] == (4, 0b1010) and by_symbol[0x10][0xF0] == (11, 0b11111111001) and by_symbol[0x10][0xFA] == (16, 0xFFFE) and by_symbol[0x10][0x11] == (4, 0b1100)
    assert by_symbol[0x11][0x00] == (2, 0b00) and by_symbol[0x11][0xF0] == (10, 0b1111111010) and by_symbol[0x11][0xFA] == (16, 0xFFFE)
    for name, t in tables.items():
        assert len(set(t.values())) == len(t) == (12 if name < 16 else 162)
        assert sum(2 ** (16 - length) for length, _ in t) < 1 << 16


def test_frames_without_tables_empty_frames_lists_and_segments(spark):
    dark, light = _standard_jpeg(20), _standard_jpeg(220)
    assert (media.decode_jpeg(dark) == 20).all() and (media.decode_jpeg(light) == 220).all()
    chunk = lambda f: b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2)
    listed = lambda kind, body: b"LIST" + struct.pack("<I", 4 + len(body)) + kind + body
    frames = [dark, b"", dark, light, b"", light]
    plain = _avi_of(frames, True)
    head = plain[12 : plain.index(b"LIST", plain.index(b"movi") - 8)]
    grouped = head + listed(b"movi", listed(b"rec ", b"".join(map(chunk, frames[:2]))) + listed(b"rec ", b"".join(map(chunk, frames[2:]))))
    grouped = b"RIFF" + struct.pack("<I", 4 + len(grouped)) + b"AVI " + grouped
    more = listed(b"movi", b"".join(map(chunk, [dark, dark])))
    segments = plain + b"RIFF" + struct.pack("<I", 4 + len(more)) + b"AVIX" + more
    rows = [(1, bytearray(plain)), (2, bytearray(grouped)), (3, bytearray(segments)), (4, bytearray(_avi_of([b"", dark], True))), (5, bytearray(plain[: len(plain) // 2]))]
    found = [tuple(r)[:1] + tuple(r)[4:] for r in media.clips(spark.createDataFrame(rows, "doc_id long, media binary")).orderBy("doc_id", "clip").collect()]
    assert found[:7] == [(1, 0, 3, None), (1, 3, 3, None), (2, 0, 3, None), (2, 3, 3, None), (3, 0, 3, None), (3, 3, 3, None), (3, 6, 2, None)]
    assert found[7] == (4, None, None, "ValueError: the first frame is empty") and found[8][0] == 5


def test_shots_of_texts_are_changes_of_content(spark):
    """A planted change of script gives one cut where it stands; the padding of the last frame gives none."""
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("etaoin shrdlu ") for _ in range(n))
    texts = [prose(192 * 9 + 5) + "x", prose(192 * 10) + "0123456789" * 192, prose(100), prose(192 * 6 + 150), "A" * 192 + prose(192 * 3)]
    rows = {r["doc_id"]: r for r in media.round_trip(documents(spark, texts)).collect()}
    assert [rows[i]["feature"].split(";mean")[0] for i in range(5)] == ["shots=1;cuts=", "shots=2;cuts=400", "shots=1;cuts=", "shots=1;cuts=", "shots=2;cuts=40"]
    clips = media.clips(media.store(documents(spark, texts)))
    assert sorted((r["doc_id"], r["first_frame"]) for r in clips.collect()) == [(0, 0), (1, 0), (1, 10), (2, 0), (3, 0), (4, 0), (4, 1)]


def test_documents(spark, awkward):
    rows = media.round_trip(documents(spark, awkward)).collect()
    assert len(rows) == len(awkward)
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.store(documents(spark, awkward)).where("doc_id in (0, 1, 3, 5)").collect()}
    for i in (0, 1, 3, 5):
        payload = media.padded((dict(awkward)[i] or "").encode())
        r = next(r for r in rows if r["doc_id"] == i)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((dict(awkward)[i] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert media.film(stored[i])[1].tobytes() == payload
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] == 9}) == 1
    assert media.round_trip(documents(spark, ["a"]).where("false")).count() == 0


def test_adaptive_threshold():
    rng = random.Random(2)
    shares = np.zeros((40, media.BINS))
    for i in range(40):
        k = 0 if i < 25 else 9
        shares[i, k], shares[i, k + 1] = 0.9 + rng.random() / 50, 0.1 - rng.random() / 50
    assert media.cuts(shares).tolist() == [0, 25]
