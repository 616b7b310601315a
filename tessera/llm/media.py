"""Operator 7: AVI motion-JPEG columns.

`store` writes each text as an AVI of grey baseline JPEG frames, `clips` reads AVI bytes: it parses
the RIFF index, decodes the intra frames and cuts shots where the histogram difference exceeds an
adaptive threshold.

Storage is lossless: a frame has 16 x 12 data units (8 x 8 samples each) and each payload byte is
the level of one unit. With a DC quantiser of 8 a unit of level b is the DC coefficient b - 128, so
any JPEG decoder returns b. The DC Huffman table gives category s a code of 9 - s bits; with its s
further bits every difference takes 9 bits, and with the one-bit end of block 10, so whole runs of
frames are packed and unpacked by array operations.

Read are baseline frames with or without Huffman tables of their own (else the standard ones hold), empty frames (the
frame before is shown again), `rec ` lists, films without an index and those of several RIFF segments (AVIX).
A last frame that is filled with padding for more than half is no evidence of a cut.

Defined results: a null or empty text is a payload of 192 spaces; every row gives one row, repeated rows each; equal
texts give equal values; texts are stored whole, however long, as one film; a doc_id may have any type; other columns are not
read; media that is null gives no clip rows, and media that can't be read one row with the reason in `error`;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_arrow, text_chunks

UNIT, ACROSS, DOWN, RATE, BINS = 192, 16, 12, 25, 16
#: Frames that one array step handles.
RUN = 4096
#: A cut needs a difference above FLOOR, and above the median of the last WINDOW differences by DEVIATIONS of their spread
#: (median absolute deviation), which single cuts don't move.
WINDOW, DEVIATIONS, FLOOR = 8, 3.0, 0.3

#: Fixed values of ITU-T T.81: the zigzag order of an 8 x 8 unit.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p % 8 if (p // 8 + p % 8) % 2 == 0 else p // 8)))


#: Fixed values of ITU-T T.81, annex K: symbols per code length, and the first symbols; the others follow in order.
STANDARD = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), bytes(range(12))),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), bytes(range(12))),
    0x10: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")),
    0x11: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1")),
}


def _codes(counts: tuple | bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a Huffman table."""
    code, k, out = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def standard_tables() -> dict[int, dict[tuple[int, int], int]]:
    every = sorted({0x00, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 11)})
    return {name: _codes(counts, first if name < 0x10 else first + bytes(x for x in every if x not in first)) for name, (counts, first) in STANDARD.items()}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * DOWN, 8 * ACROSS, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1))))
    + _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    code, value = np.zeros(511, np.uint16), np.full(512, 1000, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        bits = (((1 << (8 - s)) - 1) << (s + 1)) | (d if d >= 0 else d + (1 << s) - 1)
        code[d + 255], value[bits] = bits << 1, d
    return code, value


_CODE, _DIFFERENCE = _code_tables()


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


# ---------------------------------------------------------------- writing

def _frames(levels: np.ndarray) -> tuple[bytes, np.ndarray]:
    """AVI chunks of frames (n, UNIT) of levels, and the size of each frame."""
    chunks, all_sizes = [], []
    for at in range(0, len(levels), RUN):
        run = levels[at : at + RUN].astype(np.int16)
        run[:, 1:] -= run[:, :-1].copy()
        run[:, 0] -= 128
        c = _CODE[run + 255].reshape(len(run), -1, 4)
        packed = np.stack([c[..., 0] >> 2, (c[..., 0] & 3) << 6 | c[..., 1] >> 4, (c[..., 1] & 15) << 4 | c[..., 2] >> 6, (c[..., 2] & 63) << 2 | c[..., 3] >> 8, c[..., 3] & 255], -1).astype(np.uint8).reshape(len(run), -1)
        marks = packed == 255
        lengths = packed.shape[1] + marks.sum(1)
        flat = packed.ravel()
        stuffed = np.insert(flat, np.flatnonzero(marks.ravel()) + 1, 0)
        sizes = len(HEAD) + lengths + 2
        starts = np.concatenate([[0], np.cumsum(8 + sizes + sizes % 2)])
        out = np.zeros(starts[-1], np.uint8)
        lead = np.frombuffer(b"00dc\0\0\0\0" + HEAD, np.uint8)
        out[starts[:-1, None] + np.arange(len(lead))] = lead
        out[starts[:-1, None] + np.arange(4, 8)] = sizes.astype("<u4").view(np.uint8).reshape(-1, 4)
        body = starts[:-1] + len(lead)
        out[np.arange(len(stuffed)) + np.repeat(body - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)] = stuffed
        out[body + lengths], out[body + lengths + 1] = 0xFF, 0xD9
        chunks.append(out)
        all_sizes.append(sizes)
    return np.concatenate(chunks), np.concatenate(all_sizes)


def _avi(chunks: bytes, sizes: np.ndarray) -> bytes:
    n, w, h, most = len(sizes), 8 * ACROSS, 8 * DOWN, int(sizes.max())
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, w, h, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, w, h)
    form = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    index = np.zeros(n, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    steps = 8 + sizes + sizes % 2
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, 4 + np.cumsum(steps) - steps, sizes
    body = b"AVI " + header + b"LIST" + struct.pack("<I", 4 + len(chunks)) + b"movi" + chunks + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """An AVI for each payload, whose length is a positive multiple of UNIT."""
    levels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    chunks, sizes = _frames(levels)
    starts = np.concatenate([[0], np.cumsum(8 + sizes + sizes % 2)])
    out, at = [], 0
    for p in payloads:
        to = at + len(p) // UNIT
        out.append(_avi(chunks[starts[at] : starts[to]].tobytes(), sizes[at:to]))
        at = to
    return out


# ---------------------------------------------------------------- reading

def parse_avi(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(microseconds a frame, start and size of each video frame), by idx1, or by walking movi where it is missing."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI")
    micros, lists, index, at = 1_000_000 // RATE, [], None, 12
    while at + 8 <= len(data):
        name, size, kind = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0], data[at + 8 : at + 12]
        if name == b"RIFF" and kind == b"AVIX":
            at += 12
            continue
        if name == b"LIST" and kind == b"hdrl":
            if data[at + 12 : at + 16] == b"avih":
                micros = struct.unpack_from("<I", data, at + 20)[0] or micros
        elif name == b"LIST" and kind == b"movi":
            lists.append((at + 8, min(at + 8 + size, len(data))))
        elif name == b"idx1" and index is None:
            index = np.frombuffer(data, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], min(size, len(data) - at - 8) // 16, at + 8)
        at += 8 + size + size % 2
    if not lists:
        raise ValueError("no movi list")
    frames = []
    if index is not None and len(index):
        # an index covers the first segment
        index = index[np.isin(index["id"], [b"00dc", b"00db"])]
        base = lists[0][0] if len(index) and data[lists[0][0] + int(index["at"][0]) :][:2] == b"00" else 0
        frames.append(np.stack([base + index["at"].astype(np.int64) + 8, index["size"].astype(np.int64)], 1))
    for start, end in lists[len(frames) :]:
        found, at = [], start + 4
        while at + 8 <= end:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at : at + 4] == b"LIST" and data[at + 8 : at + 12] == b"rec ":
                at += 12
                continue
            if data[at : at + 4] in (b"00dc", b"00db"):
                found.append((at + 8, size))
            at += 8 + size + size % 2
        frames.append(np.array(found, np.int64).reshape(-1, 2))
    every = np.concatenate(frames)
    return micros, every[:, 0], every[:, 1]


def _unpack(flat: np.ndarray, n: int) -> np.ndarray:
    """Levels (n, UNIT) of n frames of the packed form."""
    b = flat.reshape(n, -1, 5).astype(np.uint16)
    codes = np.stack([b[..., 0] << 2 | b[..., 1] >> 6, (b[..., 1] & 63) << 4 | b[..., 2] >> 4, (b[..., 2] & 15) << 6 | b[..., 3] >> 2, (b[..., 3] & 3) << 8 | b[..., 4]], -1).reshape(n, -1)
    differences = _DIFFERENCE[codes >> 1]
    if (codes & 1).any() or (differences == 1000).any():
        raise ValueError("bad entropy data")
    return (np.cumsum(differences, 1, dtype=np.int16) + 128).astype(np.uint8)


def packed_levels(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """Levels (n, UNIT) if all frames have the header that `store` writes; else None."""
    if len(starts) == 0 or (sizes < len(HEAD) + 2).any() or (starts + sizes > len(data)).any():
        return None
    head, out = np.frombuffer(HEAD, np.uint8), []
    for at in range(0, len(starts), RUN):
        s, z = starts[at : at + RUN], sizes[at : at + RUN]
        if (data[s[:, None] + np.arange(len(head))] != head).any():
            return None
        lengths = z - len(head) - 2
        begins = np.cumsum(lengths) - lengths
        flat = data[np.arange(lengths.sum()) + np.repeat(s + len(head) - begins, lengths)]
        marks = np.flatnonzero(flat[:-1] == 255) + 1
        out.append(_unpack(np.delete(flat, marks[flat[marks] == 0]), len(s)))
    return np.concatenate(out)


_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def decode_jpeg(data: bytes) -> np.ndarray:
    """The luma plane (height, width) of a baseline JPEG with one interleaved scan."""
    quant, tables, parts, restart, at = {}, standard_tables(), [], 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                own = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + own])
                body = body[17 + own :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    bits = _bits(data[at:])
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    columns, rows = -(-width // (8 * wide)), -(-height // (8 * high))
    if len(parts) == 1:
        wide = high = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        columns, rows = -(-width // 8), -(-height // 8)
    first = parts[0]
    plane = np.zeros((rows * first[2] * 8, columns * first[1] * 8))
    before = [0] * len(parts)
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            bits.restart()
            before = [0] * len(parts)
        for i, (name, across, down, q) in enumerate(parts):
            dc, ac = tables[scan[name] >> 4], tables[0x10 | scan[name] & 15]
            for v in range(down):
                for u in range(across):
                    c = np.zeros(64)
                    before[i] += bits.value(bits.symbol(dc))
                    c[0], k = before[i], 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            c[k] = bits.value(s & 15)
                        k += 1
                    if i == 0:
                        grid = np.zeros(64)
                        grid[ZIGZAG] = c * quant[q]
                        y, x = (unit // columns * down + v) * 8, (unit % columns * across + u) * 8
                        plane[y : y + 8, x : x + 8] = _COS @ grid.reshape(8, 8) @ _COS.T
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[:height, :width]


class _bits:
    """Bits of an entropy-coded segment."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left, self.held = data, 0, 0, 0

    def take(self) -> int:
        if not self.left:
            if self.at >= len(self.data):
                raise ValueError("bad entropy data")
            self.held, self.left = self.data[self.at], 8
            self.at += 2 if self.held == 255 and self.data[self.at + 1 : self.at + 2] == b"\0" else 1
        self.left -= 1
        return self.held >> self.left & 1

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take()
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad entropy data")

    def value(self, s: int) -> int:
        v = 0
        for _ in range(s):
            v = v << 1 | self.take()
        return v if not s or v >> (s - 1) else v - (1 << s) + 1

    def restart(self) -> None:
        self.left = 0
        while not (self.data[self.at] == 255 and 0xD0 <= self.data[self.at + 1] <= 0xD7):
            self.at += 1
        self.at += 2


def histograms(levels: np.ndarray) -> np.ndarray:
    """Shares of BINS luma bins for each frame (n, samples)."""
    n = len(levels)
    keys = (levels >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(keys.ravel(), minlength=n * BINS).reshape(n, BINS) / max(levels.shape[1], 1)


def cuts(shares: np.ndarray, whole: bool = True) -> np.ndarray:
    """First frames of the shots of one film: 0, and each frame whose difference is above the adaptive threshold.

    whole: whether the last frame counts.
    """
    if len(shares) < 2:
        return np.zeros(min(len(shares), 1), np.int64)
    d = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    if not whole:
        d[-1] = 0
    high = np.flatnonzero(d > FLOOR)
    if not len(high):
        return np.zeros(1, np.int64)
    # the differences before each; missing ones at the start count as none
    before = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(WINDOW), d]), WINDOW)[high]
    middle = np.median(before, axis=1)
    spread = 1.4826 * np.median(np.abs(before - middle[:, None]), axis=1)
    return np.concatenate([[0], high[d[high] > middle + DEVIATIONS * spread] + 1])


def stored_histograms(levels: np.ndarray) -> np.ndarray:
    """Histograms of the frames of one stored text, that of the last one without the spaces at its end."""
    shares = histograms(levels)
    own = _content(levels)
    if 0 < own < UNIT:
        shares[-1] = np.bincount(levels[-1, :own] >> 4, minlength=BINS) / own
    return shares


def _content(levels: np.ndarray) -> int:
    """Units of the last frame up to the last that is no space."""
    return int(np.flatnonzero(np.append(True, levels[-1] != 32))[-1]) if len(levels) else 0


def film(data: bytes) -> tuple[int, list[np.ndarray], np.ndarray, bool]:
    """(microseconds a frame, frames' samples, histograms, whether the last frame counts for cuts) of any motion-JPEG AVI."""
    micros, starts, sizes = parse_avi(data)
    levels = packed_levels(np.frombuffer(data, np.uint8), starts, sizes)
    if levels is not None:
        return micros, levels, stored_histograms(levels), 2 * _content(levels) >= UNIT
    frames: list[np.ndarray] = []
    for s, z in zip(starts.tolist(), sizes.tolist(), strict=True):
        if z:
            frames.append(decode_jpeg(data[s : s + z]).ravel())
        elif frames:
            frames.append(frames[-1])
        else:
            raise ValueError("the first frame is empty")
    return micros, frames, np.concatenate([histograms(f[None]) for f in frames]) if frames else np.zeros((0, BINS)), True


def clip_rows(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(clip, start_ms, end_ms, first_frame, frames) of one AVI."""
    micros, _, shares, whole = film(data)
    first = cuts(shares, whole)
    ends = np.append(first[1:], len(shares))
    return [(i, int(a * micros // 1000), int(b * micros // 1000), int(a), int(b - a)) for i, (a, b) in enumerate(zip(first, ends, strict=True)) if b > a]


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Timed clip rows (key, clip, start_ms, end_ms, first_frame, frames, error) of an AVI column."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "clip", "start_ms", "end_ms", "first_frame", "frames", "error"]
        for b in batches:
            rows: list[tuple] = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not data.is_valid:
                    continue
                try:
                    rows += [(k, *r, None) for r in clip_rows(data.as_py())]
                except (ValueError, IndexError, KeyError, struct.error) as error:
                    rows.append((k, None, None, None, None, None, f"{type(error).__name__}: {error}"))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return map_arrow(media.select(key, column), run, f"`{key}` {kind}, clip int, start_ms long, end_ms long, first_frame long, frames long, error string")


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the AVI of each document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in text_chunks(b.column(1)):
                raw = data.tobytes()
                media = encode_many([padded(raw[offsets[i] : offsets[i + 1]]) for i in range(to - at)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(media, pa.binary())], ["doc_id", "media"])

    return map_arrow(docs.selectExpr("doc_id", "cast(text as string) text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """One row per document: sizes and digests of its payload as read back from the stored AVI, and its shots.

    feature: "shots=<n>;cuts=<ms,...>;mean=<level>", the mean with three decimals.
    """
    schema = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("n_shots", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in text_chunks(b.column(1)):
                raw = data.tobytes()
                media = encode_many([padded(raw[offsets[i] : offsets[i + 1]]) for i in range(to - at)])
                # read back: index of each film, then all frames of the run at once
                places, films = [], 0
                for m in media:
                    micros, starts, sizes = parse_avi(m)
                    places.append((micros, starts + films, sizes))
                    films += len(m)
                levels = packed_levels(np.frombuffer(b"".join(media), np.uint8), np.concatenate([p[1] for p in places]), np.concatenate([p[2] for p in places]))
                if levels is None:
                    raise ValueError("stored frames can't be read")
                frame, rows = 0, []
                for i, (m, (micros, starts, _)) in enumerate(zip(media, places, strict=True)):
                    own = levels[frame : frame + len(starts)]
                    payload = own.tobytes()
                    first = cuts(stored_histograms(own), 2 * _content(own) >= UNIT)
                    feature = f"shots={len(first)};cuts={','.join(str(int(x) * micros // 1000) for x in first[1:])};mean={own.mean():.3f}"
                    rows.append((int(offsets[i + 1] - offsets[i]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, len(starts), len(first)))
                    frame += len(starts)
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *arrays], ["doc_id", *schema.names])

    return map_arrow(docs.selectExpr("doc_id", "cast(text as string) text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long")
