"""Media columns: AVI files with motion-JPEG video.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, become samples: each
sample is the level of one 8 x 8 block of a grey baseline JPEG, 64 blocks to a row and up to ROWS
rows to a frame. A flat block is its DC coefficient alone, and with a quantiser of 8 that
coefficient is the level itself, so nothing is lost. The Huffman tables give every level change
9 bits and every block 10, which lets whole frames be coded and read without a loop over blocks.

Reading parses the RIFF tree and its idx1 index and decodes each intra frame; frames with other
tables go through a general baseline decoder, which yields their first component's block levels.
Shots end where the difference of neighbouring frames' histograms exceeds an adaptive bound, the
mean of the differences so far in the shot plus DEVIATIONS of their deviations and FLOOR at least.

Null text counts as empty. Equal texts give equal files. Nothing is shuffled."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import trimmed

WIDTH, ROWS, RATE, BINS, DEVIATIONS, FLOOR = 64, 32, 25, 16, 3.0, 0.25


# ---- JPEG -------------------------------------------------------------------------------------

@functools.cache
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits (511 x 10) of the changes -255 to 255, and the change for each 10-bit word."""
    bits, change = np.zeros((511, 10), np.uint8), np.full(1024, 9999, np.int32)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code = "1" * (8 - size) + "0"  # sizes 8 to 0 have codes of 1 to 9 bits
        tail = format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else ""
        word = code + tail + "0"  # the last bit ends the block
        bits[d + 255] = list(map(int, word))
        change[int(word, 2)] = d
    return bits, change


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


_DC = bytes([0, *([1] * 9), *([0] * 7), *range(8, -1, -1)])
_AC = bytes([0x10, 1, *([0] * 15), 0])


def encode_frame(levels: np.ndarray) -> bytes:
    """levels: rows x columns of 8-bit samples."""
    rows, columns = levels.shape
    change = np.diff(levels.ravel().astype(np.int32), prepend=128)
    bits = _codes()[0][change + 255].ravel()
    body = np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes().replace(b"\xff", b"\xff\x00")
    head = _segment(0xDB, bytes([0, *([8] * 64)])) + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + b"\1\x11\0")
    return b"\xff\xd8" + head + _segment(0xC4, _DC + _AC) + _segment(0xDA, b"\1\1\0\0\x3f\0") + body + b"\xff\xd9"


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Block levels of a baseline JPEG's first component, 8-bit."""
    at, tables, quant = 2, {}, {}
    restart, plain = 0, True
    while True:
        if jpeg[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        mark, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 64 * (1 + wide)
                quant[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(int)
                body = body[1 + n :]
        elif mark == 0xC4:
            plain &= body == _DC + _AC
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif mark == 0xDD:
            restart = int.from_bytes(body, "big")
        elif mark == 0xDA:
            scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            break
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8:
            raise ValueError("only baseline JPEG frames are read")
    coded = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    if plain and len(parts) == 1 and not restart and set(quant[parts[0][3]].tolist()) == {8}:
        rows, columns = height // 8, width // 8
        raw = np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8)
        words = np.unpackbits(raw)[: rows * columns * 10].reshape(-1, 10) @ (1 << np.arange(9, -1, -1))
        change = _codes()[1][words]
        if (change != 9999).all():
            return (np.cumsum(change) + 128).astype(np.uint8).reshape(rows, columns)
    return _general(coded, tables, quant, parts, scan, height, width, restart)


def _lookup(table) -> dict[tuple[int, int], int]:
    counts, values = table
    out, code, k = {}, 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            out[size, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _general(coded, tables, quant, parts, scan, height, width, restart) -> np.ndarray:
    look = {k: _lookup(t) for k, t in tables.items()}
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    _, h0, v0, q0 = parts[0]
    grid = np.zeros((down * v0, across * h0))
    segments = [b""]
    i = 0
    while i < len(coded):  # split at restart markers, undo stuffing
        j = coded.find(b"\xff", i)
        if j < 0 or j + 1 >= len(coded):
            segments[-1] += coded[i:]
            break
        segments[-1] += coded[i : j + 1] if coded[j + 1] == 0 else coded[i:j]
        if 0xD0 <= coded[j + 1] <= 0xD7:
            segments.append(b"")
        i = j + 2
    total, each = across * down, restart or across * down
    for s, segment in enumerate(segments):
        bits = np.unpackbits(np.frombuffer(segment, np.uint8)).tolist() + [1] * 64
        pos, last = 0, [0] * len(parts)

        def symbol(table):
            nonlocal pos
            code = 0
            for size in range(1, 17):
                code = code << 1 | bits[pos]
                pos += 1
                if (size, code) in table:
                    return table[size, code]
            raise ValueError("a Huffman code is unknown")

        def number(size):
            nonlocal pos
            v = 0
            for _ in range(size):
                v = v << 1 | bits[pos]
                pos += 1
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for mcu in range(s * each, min(total, (s + 1) * each)):
            y, x = divmod(mcu, across)
            for c, (name, h, v, _) in enumerate(parts):
                dc, ac = look[scan[name][0]], look[0x10 | scan[name][1]]
                for b in range(h * v):
                    last[c] += number(symbol(dc))
                    k = 1
                    while k < 64:
                        sym = symbol(ac)
                        if sym == 0:
                            break
                        k += (sym >> 4) + 1
                        number(sym & 15)
                    if c == 0:
                        grid[y * v + b // h, x * h + b % h] = last[0] * quant[q0][0] / 8 + 128
    return np.clip(np.rint(grid), 0, 255).astype(np.uint8)


# ---- AVI --------------------------------------------------------------------------------------

def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, *inner: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(inner))


def write_avi(frames: list[bytes], width: int, height: int, note: bytes = b"", rate: int = RATE) -> bytes:
    most = max(map(len, frames))
    head = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width & 0xFFFF, height & 0xFFFF)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    movie, index, at = [], [], 4
    for f in frames:
        movie.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movie[-1])
    parts = [_list(b"hdrl", _chunk(b"avih", head), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", form)))]
    if note:
        parts.append(_list(b"INFO", _chunk(b"ICMT", note)))
    return _chunk(b"RIFF", b"AVI " + b"".join([*parts, _list(b"movi", *movie), _chunk(b"idx1", b"".join(index))]))


def read_avi(avi: bytes) -> tuple[list[bytes], float, bytes]:
    """Video frames in the order of the index, frames a second, and the comment."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict[str, object] = {"rate": float(RATE), "note": b"", "index": [], "movie": 0, "video": 0, "streams": 0}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = avi[at : at + 4], int.from_bytes(avi[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST":
                if avi[body : body + 4] == b"movi":
                    found["movie"] = body
                else:
                    walk(body + 4, min(end, body + size))
            elif name == b"strh":
                if avi[body : body + 4] == b"vids":
                    scale, rate = struct.unpack("<II", avi[body + 20 : body + 28])
                    found["rate"], found["video"] = rate / max(scale, 1), found["streams"]
                found["streams"] += 1
            elif name == b"ICMT":
                found["note"] = avi[body : body + size]
            elif name == b"idx1":
                found["index"] = [struct.unpack("<4sIII", avi[i : i + 16]) for i in range(body, body + size, 16)]
            at = body + size + (size & 1)

    walk(12, len(avi))
    own = b"%02d" % found["video"]
    mine = [x for x in found["index"] if x[0][:2] == own and x[0][2:] in (b"dc", b"db")]
    base = found["movie"]
    if mine and avi[base + mine[0][2] : base + mine[0][2] + 4] != mine[0][0]:
        base = 0  # some files count from the file's start
    return [avi[base + at + 8 : base + at + 8 + size] for _, _, at, size in mine], found["rate"], found["note"]


# ---- payloads, shots, tables ------------------------------------------------------------------

def store(text: bytes) -> bytes:
    """The AVI file that holds a text's payload."""
    payload = text + b"\0" * (64 if not text else -len(text) % 64)
    rows = len(payload) // WIDTH
    high = min(rows, ROWS)
    count = -(-rows // high)
    levels = np.zeros((count * high, WIDTH), np.uint8)
    levels.ravel()[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames = [encode_frame(levels[i * high : (i + 1) * high]) for i in range(count)]
    return write_avi(frames, 8 * WIDTH, 8 * high, b"%d" % len(payload))


def load(avi: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """The payload that store() put in, the decoded frames, and frames a second."""
    frames, rate, note = read_avi(avi)
    levels = [decode_frame(f) for f in frames]
    return b"".join(x.tobytes() for x in levels)[: int(note or b"0")], levels, rate


def clips(levels: list[np.ndarray]) -> list[tuple[int, int]]:
    """Frames [first, last] of each shot."""
    out, first, past, before = [], 0, [], None
    for i, x in enumerate(levels):
        now = np.bincount(x.ravel() * BINS // 256 if x.dtype != np.uint8 else x.ravel() >> 4, minlength=BINS) / max(x.size, 1)
        if before is not None:
            d = float(np.abs(now - before).sum() / 2)
            if d > max(FLOOR, (np.mean(past) + DEVIATIONS * np.std(past)) if past else 0):
                out.append((first, i - 1))
                first, past = i, []
            else:
                past.append(d)
        before = now
    return [*out, (first, len(levels) - 1)] if levels else out


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media: each row's text as an AVI file."""

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([store((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())], ["doc_id", "media"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(scan), "doc_id long, media binary")


def clip_rows(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, clip, first_frame, last_frame, start_s, end_s, mean_level: a row for each shot of
    each AVI file; null, empty and malformed media have none."""

    def scan(batches):
        for batch in batches:
            at, cols = [], ([], [], [], [], [], [])
            for i, avi in enumerate(batch.column(1)):
                if avi.is_valid:
                    try:
                        frames, rate, _ = read_avi(avi.as_py())
                        levels = [decode_frame(f) for f in frames]
                    except (ValueError, IndexError, KeyError, struct.error, UnboundLocalError):
                        continue
                    for n, (a, b) in enumerate(clips(levels)):
                        at.append(i)
                        mean = float(np.mean([x.mean() for x in levels[a : b + 1]]))
                        for c, v in zip(cols, (n, a, b, a / rate, (b + 1) / rate, mean), strict=True):
                            c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s", "mean_level"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(trimmed(scan), "doc_id long, clip int, first_frame int, last_frame int, start_s double, end_s double, mean_level double")


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature:
    one row for each row of df, from the stored bytes as read back."""

    def scan(batches):
        for batch in batches:
            cols = ([], [], [], [], [], [], [])
            for t in batch.column(1):
                text = (t.as_py() or "").encode()
                avi = store(text)
                payload, levels, rate = load(avi)
                shots = clips(levels)
                feature = f"frames={len(levels)};shots={len(shots)};level={sum(int(x.sum()) for x in levels) // sum(x.size for x in levels)};clips=" + ",".join(f"{a / rate:.2f}-{(b + 1) / rate:.2f}" for a, b in shots)
                row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(scan), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
