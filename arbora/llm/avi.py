"""Media columns: motion-JPEG in AVI files.

store() writes bytes as a video: each 576 of them are the 9 x 64 quantised coefficients of one 24 x 24 grey frame, the format's
unit, each kept as 256 + byte.  Every frame is a baseline JPEG of its own (an intra frame) with a restart marker after each
block.  All coefficients are of one size class, so its Huffman table has a single code of seven bits, and a coefficient takes
two bytes: the code and the leading bit, then the byte.  What is read back is what was stored, bit by bit.

read() parses the RIFF chunks and the index and decodes the frames it lists: baseline JPEGs by the tables in them (quantisers,
Huffman codes, restarts, sampling of components), entropy coding to coefficients and these, by the inverse cosine transform, to
pixels.  Frames whose tables have one code of fixed width are decoded many at once, all others symbol by symbol.  Shots are
detected on the pixels: a frame begins a shot where its histogram's distance from the frame before exceeds the mean of the
WINDOW distances before it by FACTOR deviations.

Cases: null texts are empty; an empty one is one frame of padding; equal bytes give equal files; null media, and files that
aren't AVI files of baseline JPEGs of one size, give a row whose feature names the fault and whose other columns are null; other
columns pass through, but columns named like those added are replaced.  A value of Spark holds 2 GB, so texts over some 900 MB
can't be stored as one file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, slices, texts_of

FRAME, SIDE, FPS = 576, 24, 25
BINS, WINDOW, FACTOR, LEAST = 16, 12, 3.0, 0.05
BLOCK_BYTES = 2 << 20

_HEAD = (
    b"\xff\xd8"  # SOI
    + b"\xff\xdb\x00\x43\x00" + b"\x01" * 64  # DQT: steps of 1
    + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", SIDE, SIDE) + b"\x01\x01\x11\x00"  # SOF0: 8 bits, one component
    + b"\xff\xc4\x00\x14\x00" + bytes([0] * 6 + [1] + [0] * 9) + b"\x09"  # DHT for the first coefficient: class 9 only
    + b"\xff\xc4\x00\x14\x10" + bytes([0] * 6 + [1] + [0] * 9) + b"\x09"  # DHT for the others: no zeros, class 9
    + b"\xff\xdd\x00\x04\x00\x01"  # DRI: each block
    + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"  # SOS
)
_BLOCKS = FRAME // 64
_PLAIN = len(_HEAD) + FRAME * 2 + (_BLOCKS - 1) * 2 + 2


def _template() -> np.ndarray:
    out = bytearray(_HEAD)
    for k in range(_BLOCKS):
        out += b"\x01\x00" * 64
        out += bytes([0xFF, 0xD0 + k % 8]) if k + 1 < _BLOCKS else b"\xff\xd9"
    return np.frombuffer(bytes(out), np.uint8)


_FORM = _template()
#: Where a plain frame (no byte 255, so nothing is stuffed) has its coefficients.
_AT = np.concatenate([len(_HEAD) + k * 130 + 1 + 2 * np.arange(64) for k in range(_BLOCKS)])
_FIXED = np.ones(_PLAIN, bool)
_FIXED[_AT] = False


def _stuffed(values: np.ndarray) -> bytes:
    out = [_HEAD]
    for k in range(_BLOCKS):
        pair = np.full((64, 2), 1, np.uint8)
        pair[:, 1] = values[k * 64 : k * 64 + 64]
        out.append(pair.tobytes().replace(b"\xff", b"\xff\x00"))
        out.append(bytes([0xFF, 0xD0 + k % 8]) if k + 1 < _BLOCKS else b"\xff\xd9")
    return b"".join(out)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(body: bytes) -> bytes:
    """The bytes, filled up with 255 to a positive multiple of 576, as an AVI file."""
    n = max(1, -(-len(body) // FRAME))
    values = np.full(n * FRAME, 255, np.uint8)
    values[: len(body)] = np.frombuffer(body, np.uint8)
    values = values.reshape(n, FRAME)
    plain = (values != 255).all(1)
    step = 8 + _PLAIN + _PLAIN % 2
    parts, sizes = [], np.full(n, _PLAIN, np.int64)
    k = 0
    while k < n:
        if plain[k]:
            end = k + int(np.argmin(plain[k:])) if not plain[k:].all() else n
            block = np.zeros((end - k, step), np.uint8)
            block[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", _PLAIN), np.uint8)
            block[:, 8 : 8 + _PLAIN] = _FORM
            block[:, 8 + _AT] = values[k:end]
            parts.append(block.tobytes())
            k = end
        else:
            frame = _stuffed(values[k])
            sizes[k] = len(frame)
            parts.append(_chunk(b"00dc", frame))
            k += 1
    index = np.zeros(n, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["size"] = b"00dc", 0x10, sizes
    index["at"] = 4 + np.cumsum(8 + sizes + sizes % 2) - (8 + sizes + sizes % 2)
    avih = struct.pack("<14I", 1_000_000 // FPS, int(sizes.max()) * FPS, 0, 0x10, n, 0, 1, int(sizes.max()), SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, n, int(sizes.max()), -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    stream = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + stream)
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", index.tobytes()))


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _index(file: bytes) -> tuple[int, np.ndarray]:
    """Where the list of frames begins, and the entries of the index."""
    _need(file[:4] == b"RIFF" and file[8:12] == b"AVI ", "no AVI file")
    at, movi, entries = 12, None, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"LIST" and file[at + 8 : at + 12] == b"movi":
            movi = at + 8
        if name == b"idx1":
            _need(at + 8 + size // 16 * 16 <= len(file), "a cut index")
            entries = np.frombuffer(file, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], size // 16, at + 8)
        at += 8 + size + size % 2
    _need(movi is not None and entries is not None, "no frames or no index")
    return movi, entries[np.isin(entries["id"], (b"00dc", b"00db"))]


class _Code:
    """A Huffman table: for each 16 bits that follow, the symbol and its code's length."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        self.counts, self.symbols = counts, symbols
        code, k = 0, 0
        for length, many in enumerate(counts, 1):
            for _ in range(many):
                _need(code < 1 << length, "a code too many")
                self.symbol[code << (16 - length) : (code + 1) << (16 - length)] = symbols[k]
                self.length[code << (16 - length) : (code + 1) << (16 - length)] = length
                code, k = code + 1, k + 1
            code <<= 1

    def only(self) -> tuple[int, int] | None:
        """The length and the symbol of a table of one code."""
        return (int(np.flatnonzero(np.frombuffer(self.counts, np.uint8))[0]) + 1, self.symbols[0]) if sum(self.counts) == 1 else None


class _Layout:
    """What the segments before a frame's data say."""

    def __init__(self, head: bytes):
        self.quantisers, self.codes, self.restart, self.parts = {}, {}, 0, []
        at = 2
        while True:
            _need(at + 4 <= len(head) and head[at] == 0xFF, "a broken segment")
            mark, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
            body = head[at + 4 : at + 2 + size]
            if mark == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    self.quantisers[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float32)
                    k += 65 + 64 * (wide > 0)
            elif mark == 0xC4:
                k = 0
                while k < len(body):
                    many = sum(body[k + 1 : k + 17])
                    self.codes[body[k]] = _Code(body[k + 1 : k + 17], body[k + 17 : k + 17 + many])
                    k += 17 + many
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif mark == 0xC0:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                _need(bits == 8 and self.height > 0 and self.width > 0, "no baseline frame")
                frame = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif 0xC1 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                raise ValueError("no baseline frame")
            elif mark == 0xDA:
                for i in range(body[0]):
                    across, down, q = frame[body[1 + 2 * i]]
                    self.parts.append((across, down, self.quantisers[q], self.codes[body[2 + 2 * i] >> 4], self.codes[16 | body[2 + 2 * i] & 15]))
                break
            at += 2 + size
        if len(self.parts) == 1:  # blocks of a single component come row by row, whatever its sampling
            self.parts = [(1, 1, *self.parts[0][2:])]
        self.across, self.down = max(p[0] for p in self.parts), max(p[1] for p in self.parts)
        self.columns, self.rows = -(-self.width // (8 * self.across)), -(-self.height // (8 * self.down))

    def fixed(self) -> tuple[int, int] | None:
        """The length of its one code and its one class, where each coefficient takes the same whole number of bytes."""
        if len(self.parts) > 1 or self.restart != 1:
            return None
        one, other = self.parts[0][3].only(), self.parts[0][4].only()
        return one if one is not None and one == other and 0 < one[1] < 16 and (one[0] + one[1]) % 8 == 0 else None


_layouts: dict[bytes, _Layout] = {}


def _layout(frame: bytes) -> tuple[_Layout, int]:
    """The layout of a frame, and where its data begin; read once for frames that begin alike."""
    _need(frame[:2] == b"\xff\xd8", "no JPEG")
    at = 2
    while at + 4 <= len(frame) and frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    _need(at + 4 <= len(frame), "no data")
    end = at + 2 + struct.unpack_from(">H", frame, at + 2)[0]
    head = frame[:end]
    if head not in _layouts:
        if len(_layouts) > 16:
            _layouts.clear()
        _layouts[head] = _Layout(head)
    return _layouts[head], end


_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))


def _segments(data: bytes) -> list[bytes]:
    """The data between restart marks, without stuffing."""
    out, at, start = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:].replace(b"\xff\x00", b"\xff")]
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            start = at = at + 2
        else:
            return [*out, data[start:at].replace(b"\xff\x00", b"\xff")]


def _symbols(layout: _Layout, segments: list[bytes]) -> list[np.ndarray]:
    """The quantised coefficients (in the file's order) of each component's blocks, symbol by symbol."""
    units = layout.columns * layout.rows
    out = [np.zeros((units * across * down, 64), np.int32) for across, down, *_ in layout.parts]
    each, unit = layout.restart or units, 0
    for body in segments:
        bits, have, at, before = 0, 0, 0, [0] * len(out)

        def take(n: int) -> int:
            nonlocal bits, have, at
            while have < n:
                bits = bits << 8 | (body[at] if at < len(body) else 0xFF)
                at, have = at + 1, have + 8
            have -= n
            value = bits >> have
            bits &= (1 << have) - 1
            return value

        def symbol(code: _Code) -> int:
            nonlocal bits, have, at
            while have < 16:
                bits = bits << 8 | (body[at] if at < len(body) else 0xFF)
                at, have = at + 1, have + 8
            next_ = bits >> (have - 16)
            _need(code.length[next_] > 0 and at <= len(body) + 3, "a broken code")
            take(int(code.length[next_]))
            return int(code.symbol[next_])

        def number(n: int) -> int:
            value = take(n) if n else 0
            return value if not n or value >> (n - 1) else value - (1 << n) + 1

        for unit in range(unit, min(unit + each, units)):
            for c, (across, down, _, dc, ac) in enumerate(layout.parts):
                for block in range(across * down):
                    row = out[c][unit * across * down + block]
                    before[c] += number(symbol(dc))
                    row[0] = before[c]
                    k = 1
                    while k < 64:
                        run, size = divmod(symbol(ac), 16)
                        if size == 0 and run != 15:
                            break
                        k += run
                        if size:
                            _need(k < 64, "a run too long")
                            row[k] = number(size)
                        k += 1
        unit += 1
    _need(unit >= units, "blocks are missing")
    return out


def _grid() -> np.ndarray:
    """The basis of the cosine transform in the file's order: 64 coefficients x 64 pixels."""
    u, x = np.arange(8)[:, None], np.arange(8)
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[_ZIGZAG].astype(np.float32)


_BASIS = _grid()


def _bright(layout: _Layout, coefficients: np.ndarray) -> np.ndarray:
    """Pixels (0 to 255) of the first component: frames x height x width, from frames x blocks x 64."""
    across, down, quantiser = layout.parts[0][:3]
    n = len(coefficients)
    flat = (coefficients.reshape(-1, 64).astype(np.float32) * quantiser) @ _BASIS
    pixels = np.clip(np.rint(flat) + 128, 0, 255).astype(np.uint8)
    # Blocks come unit by unit, inside a unit row by row.
    tiles = pixels.reshape(n, layout.rows, layout.columns, down, across, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6)
    whole = tiles.reshape(n, layout.rows * down * 8, layout.columns * across * 8)
    return whole[:, : -(-layout.height * down // layout.down), : -(-layout.width * across // layout.across)]


def read_frames(file: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of the frames in the index: the first component's quantised coefficients (frames x blocks x 64, in the file's order) and
    its pixels (frames x height x width)."""
    movi, entries = _index(file)
    _need(len(entries) > 0, "no frames")
    at, size = entries["at"].astype(np.int64), entries["size"].astype(np.int64)
    # Places count from the list's name, or from the file's beginning.
    at = at + 8 + (movi if file[movi + at[0] : movi + at[0] + 4] in (b"00dc", b"00db") else 0)
    _need(bool((at + size <= len(file)).all()), "a cut file")
    layout, begin = _layout(file[at[0] : at[0] + size[0]])
    blocks = layout.columns * layout.rows * layout.parts[0][0] * layout.parts[0][1]
    out = np.empty((len(at), blocks, 64), np.int32)
    flat, head, fixed = np.frombuffer(file, np.uint8), file[at[0] : at[0] + begin], layout.fixed()
    same = np.zeros(len(at), bool)
    if fixed:
        # Frames of one size without stuffing: the same places hold data and marks.
        wide = (fixed[0] + fixed[1]) // 8 * 64
        plain = begin + blocks * wide + 2 * blocks
        same = size == plain
        for a in range(0, len(at), 1024):
            some = np.flatnonzero(same[a : a + 1024]) + a
            if not len(some):
                continue
            body = flat[at[some][:, None] + np.arange(plain)]
            data = body[:, begin:].reshape(len(some), blocks, wide + 2)
            marks = np.append(0xD0 + np.arange(blocks - 1) % 8, 0xD9)
            ok = (body[:, :begin] == np.frombuffer(head, np.uint8)).all(1) & (data[:, :, wide] == 0xFF).all(1) & (data[:, :, wide + 1] == marks).all(1) & (data[:, :, :wide] != 0xFF).all((1, 2))
            same[some[~ok]] = False
            out[some[ok]] = _fixed_width(data[ok, :, :wide], *fixed)
    for k in np.flatnonzero(~same):
        frame = file[at[k] : at[k] + size[k]]
        mine, begin_k = _layout(frame)
        _need((mine.width, mine.height, mine.parts[0][:2]) == (layout.width, layout.height, layout.parts[0][:2]) and bool((mine.parts[0][2] == layout.parts[0][2]).all()), "frames of several kinds")
        segments, narrow = _segments(frame[begin_k:]), mine.fixed()
        if narrow and len(segments) == blocks and all(len(x) == (narrow[0] + narrow[1]) * 8 for x in segments):
            out[k] = _fixed_width(np.frombuffer(b"".join(segments), np.uint8).reshape(1, blocks, -1), *narrow)[0]
        else:
            out[k] = _symbols(mine, segments)[0]
    pixels = np.concatenate([_bright(layout, out[a : a + 512]) for a in range(0, len(out), 512)])
    return out, pixels


def _fixed_width(data: np.ndarray, length: int, size: int) -> np.ndarray:
    """Coefficients from data in which each takes a code of `length` zeros (the first and only one) and `size` bits."""
    each = (length + size) // 8
    value = np.zeros((*data.shape[:2], 64), np.int32)
    for k in range(each):
        value = value << 8 | data.reshape(*data.shape[:2], 64, each)[..., k]
    _need(bool((value >> size == 0).all()), "a broken code")
    return np.where(value >> (size - 1), value, value - (1 << size) + 1)


def read_avi(file: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of a file that write_avi() made: the stored bytes, one row of 576 for each frame, and the frames' pixels."""
    coefficients, pixels = read_frames(file)
    stored = coefficients.reshape(len(coefficients), -1) - 256
    _need(stored.shape[1] == FRAME and bool(((stored >= 0) & (stored < 256)).all()), "a file of another kind")
    return stored.astype(np.uint8), pixels


def shots(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first frame of each shot, and every frame's histogram distance (0 to 1) from the one before."""
    n = len(pixels)
    frames = pixels.reshape(n, -1)
    hist = np.bincount((np.arange(n)[:, None] * BINS + frames // (256 // BINS)).ravel(), minlength=n * BINS).reshape(n, BINS)
    apart = np.append(0.0, np.abs(np.diff(hist, axis=0)).sum(1) / (2.0 * frames.shape[1]))
    one, two = np.append(0.0, np.cumsum(apart)), np.append(0.0, np.cumsum(apart * apart))
    k = np.arange(n)
    low = np.maximum(1, k - WINDOW)  # the first frame has no distance
    have = np.maximum(k - low, 1)
    mean = (one[k] - one[np.minimum(low, k)]) / have
    spread = np.sqrt(np.maximum((two[k] - two[np.minimum(low, k)]) / have - mean * mean, 0))
    cut = (k >= 3) & (apart > mean + FACTOR * spread + LEAST)
    return np.append(0, np.flatnonzero(cut)), apart


def store(docs: DataFrame, text: str = "text", column: str = "media") -> DataFrame:
    """docs with n_bytes (of the text) and the binary column `media`."""
    names = [c for c in docs.columns if c not in ("n_bytes", column, "__text")]
    body = text if text in names else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = texts_of(batch, body)
            raw = flat.tobytes()
            for a, b in slices(offsets, BLOCK_BYTES):
                made = pa.array([write_avi(raw[offsets[i] : offsets[i + 1]]) for i in range(a, b)], pa.binary())
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(np.diff(offsets[a : b + 1])), made], names=[*names, "n_bytes", column])

    schema = docs.select(*names).schema.add("n_bytes", "long").add(column, "binary")
    return docs.select(*names, *([] if body == text else [F.col(text).alias(body)])).mapInArrow(run, schema)


_ADDED = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
_CLIP = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_CLIP)]
_DDL = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip:int,first_frame:int,end_frame:int,start_s:double,end_s:double>>"


def description(file: bytes | None) -> tuple:
    """A file's values for _ADDED."""
    try:
        _need(file is not None, "null")
        frames, pixels = read_avi(file)
    except (ValueError, KeyError, IndexError, struct.error) as fault:
        return (None, None, None, None, None, f"unreadable: {fault}", None)
    body = frames.tobytes()
    first, apart = shots(pixels)
    ends = np.append(first[1:], len(frames))
    clips = [{"clip": i, "first_frame": int(x), "end_frame": int(y), "start_s": x / FPS, "end_s": y / FPS} for i, (x, y) in enumerate(zip(first, ends))]
    cuts = hashlib.sha256(",".join(map(str, first)).encode()).hexdigest()[:16]
    feature = f"frames={len(frames)};shots={len(first)};cuts={cuts};light={pixels.mean():.4f};motion={apart.mean():.6f};peak={apart.max():.6f}"
    return (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature, clips)


def describe(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and of each file: the payload's size, hash and tail checksum, the file's size and hash, a feature string, and its
    clips (shots) with frames and seconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [description(value.as_py()) for value in batch.column(column)]
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_ADDED), _KINDS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=[*keep, *_ADDED])

    schema = T.StructType([*media.select(*keep).schema.fields, *T.StructType.fromDDL(_DDL).fields])
    return media.select(*keep, column).mapInArrow(released(run), schema)


def clip_rows(described: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each clip."""
    return described.select(*keep, F.explode("clips").alias("c")).select(*keep, "c.*")


def media_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of every document's file, and its number of clips; files are written, read and dropped in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = texts_of(batch, "text")
            out = [description(write_avi(flat[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:])]
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_ADDED), _KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), *cols], names=["doc_id", "n_bytes", *_ADDED])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, " + _DDL).fields])
    return docs.select("doc_id", "text").mapInArrow(released(run), schema).select("doc_id", "n_bytes", *_ADDED[:-1], F.size("clips").alias("n_clips"))
