"""Image file formats: decoders to and encoders from numpy arrays (h x w or h x w x channels, uint8 unless said)."""

from __future__ import annotations

import struct
import zlib

import numpy as np


class FormatError(ValueError):
    """The bytes are not a readable image of the format."""


# Netpbm


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """The first n numbers after the magic, past comments, and where the pixels begin."""
    out, i = [], 2
    while len(out) < n:
        while i < len(data) and data[i : i + 1].isspace():
            i += 1
        if data[i : i + 1] == b"#":
            i = data.find(b"\n", i)
            if i < 0:
                raise FormatError("a comment doesn't end")
            continue
        j = i
        while j < len(data) and data[j : j + 1].isdigit():
            j += 1
        if j == i:
            raise FormatError("a number is missing in the header")
        out.append(int(data[i:j]))
        i = j
    return out, i + 1


def decode_pnm(data: bytes) -> np.ndarray:
    """P4 (1 is black), P5 or P6; 16-bit samples keep their high byte."""
    kind = data[:2]
    if kind == b"P4":
        (w, h), at = _header(data, 2)
        row = -(-w // 8)
        if len(data) < at + row * h:
            raise FormatError("too few bytes")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w]
        return np.where(bits, 0, 255).astype(np.uint8)
    if kind not in (b"P5", b"P6"):
        raise FormatError("not P4, P5 or P6")
    (w, h, top), at = _header(data, 3)
    if top not in (255, 65535):
        raise FormatError("the greatest value must be 255 or 65535")
    channels, wide = 3 if kind == b"P6" else 1, 1 + (top > 255)
    if len(data) < at + w * h * channels * wide:
        raise FormatError("too few bytes")
    a = np.frombuffer(data, np.uint8, w * h * channels * wide, at)[::wide]
    return a.reshape((h, w, 3) if channels == 3 else (h, w)).copy()


def encode_pnm(a: np.ndarray) -> bytes:
    """P5 for gray, P6 for three channels or the first three of four."""
    kind = b"P5" if a.ndim == 2 else b"P6"
    body = a if a.ndim == 2 else a[:, :, :3]
    return kind + b"\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(body, np.uint8).tobytes()


_DEPTH = {"GRAYSCALE": 1, "GRAYSCALE_ALPHA": 2, "RGB": 3, "RGB_ALPHA": 4}


def decode_pam(data: bytes) -> np.ndarray:
    """P7 with all five fields and a greatest value of 255."""
    end = data.find(b"ENDHDR\n")
    if data[:3] != b"P7\n" or end < 0:
        raise FormatError("not P7")
    fields = dict(line.split(None, 1) for line in data[3:end].decode("ascii").splitlines() if line and line[0] != "#")
    try:
        w, h, d, top, kind = int(fields["WIDTH"]), int(fields["HEIGHT"]), int(fields["DEPTH"]), int(fields["MAXVAL"]), fields["TUPLTYPE"].strip()
    except KeyError as e:
        raise FormatError(f"no {e.args[0]}") from None
    if top != 255 or _DEPTH.get(kind) != d or len(data) < end + 7 + w * h * d:
        raise FormatError("unsupported fields or too few bytes")
    a = np.frombuffer(data, np.uint8, w * h * d, end + 7)
    return a.reshape((h, w, d) if d > 1 else (h, w)).copy()


def encode_pam(a: np.ndarray) -> bytes:
    d = 1 if a.ndim == 2 else a.shape[2]
    kind = next(k for k, n in _DEPTH.items() if n == d)
    return f"P7\nWIDTH {a.shape[1]}\nHEIGHT {a.shape[0]}\nDEPTH {d}\nMAXVAL 255\nTUPLTYPE {kind}\nENDHDR\n".encode() + np.ascontiguousarray(a, np.uint8).tobytes()


def with_alpha(a: np.ndarray) -> np.ndarray:
    """Three channels or one as four, opaque."""
    rgb = np.repeat(a[:, :, None], 3, axis=2) if a.ndim == 2 else a[:, :, :3]
    return np.concatenate((rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)), axis=2)


# PNG


def decode_png(data: bytes) -> np.ndarray:
    """8-bit PNG of any colour type, not interlaced, with all five row filters; palettes become colours."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise FormatError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise FormatError("unsupported PNG")
    w, h, d = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error as e:
        raise FormatError(str(e)) from None
    if len(raw) < h * (w * d + 1):
        raise FormatError("too few bytes")
    raw = raw[: h * (w * d + 1)].reshape(h, w * d + 1)
    out = np.zeros((h, w * d), np.uint8)
    above = np.zeros(w * d, np.int64)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above & 255
        elif kind == 1:
            line = (np.cumsum(line.reshape(w, d), axis=0) & 255).ravel()
        elif kind in (3, 4):
            for i in range(w * d):
                left = int(line[i - d]) if i >= d else 0
                up, corner = int(above[i]), int(above[i - d]) if i >= d else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[i] = line[i] + guess & 255
        elif kind:
            raise FormatError("unknown row filter")
        out[y], above = line, line
    a = out.reshape(h, w, d)
    if head[3] == 3:
        if palette is None:
            raise FormatError("no palette")
        return palette[a[:, :, 0]]
    return a[:, :, 0] if d == 1 else a


def encode_png(a: np.ndarray) -> bytes:
    d = 1 if a.ndim == 2 else a.shape[2]
    rows = np.zeros((a.shape[0], a.shape[1] * d + 1), np.uint8)
    rows[:, 1:] = a.reshape(a.shape[0], -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, {1: 0, 2: 4, 3: 2, 4: 6}[d], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


# Arrays


def decode_npy(data: bytes) -> np.ndarray:
    import io

    try:
        return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)
    except (ValueError, EOFError) as e:
        raise FormatError(str(e)) from None


def encode_npy(a: np.ndarray) -> bytes:
    import io

    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return out.getvalue()


#: The type codes of raw array files.
TMP_TYPES = (np.float32, np.float64, np.uint8, np.int8, np.uint16, np.int16, np.uint32, np.int32, np.uint64, np.int64)


def decode_tmp(data: bytes) -> np.ndarray:
    """A raw array: four extents (width, height, planes, frames) and a type code as 32-bit integers, then the values."""
    if len(data) < 20:
        raise FormatError("too few bytes")
    w, h, c, n, kind = struct.unpack("<5i", data[:20])
    if not 0 <= kind < len(TMP_TYPES) or min(w, h, c, n) < 1 or len(data) < 20 + w * h * c * n * np.dtype(TMP_TYPES[kind]).itemsize:
        raise FormatError("unsupported fields or too few bytes")
    return np.frombuffer(data, TMP_TYPES[kind], w * h * c * n, 20).reshape(n, c, h, w)


def encode_tmp(a: np.ndarray) -> bytes:
    shape = (1,) * (4 - a.ndim) + a.shape
    return struct.pack("<5i", shape[3], shape[2], shape[1], shape[0], [np.dtype(t) for t in TMP_TYPES].index(a.dtype)) + np.ascontiguousarray(a).tobytes()


# JPEG (baseline)

_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


class _Bits:
    """Bits of entropy-coded data, most significant first; stuffed zero bytes are dropped."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.value, self.n, self.at = (self.value << 8 | byte) & 0xFFFFFFFF, self.n + 8, self.at + 1
        self.n -= k
        return self.value >> self.n & (1 << k) - 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise FormatError("a code is unknown")

    def signed(self, k: int) -> int:
        v = self.take(k) if k else 0
        return v if not k or v >> (k - 1) else v - (1 << k) + 1


def decode_jpeg(data: bytes) -> list[np.ndarray]:
    """The component planes of a baseline JPEG, each at full size (chroma repeated); the first is luma."""
    if data[:2] != b"\xff\xd8":
        raise FormatError("not a JPEG")
    at, quant, huff, frame, restart = 2, {}, {}, None, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise FormatError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        seg = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while seg:
                if seg[0] >> 4:
                    raise FormatError("16-bit quantisation is not baseline")
                quant[seg[0] & 15], seg = np.frombuffer(seg, np.uint8, 64, 1).astype(float), seg[65:]
        elif kind == 0xC4:
            while seg:
                counts, values, code, table = seg[1:17], iter(seg[17 : 17 + sum(seg[1:17])]), 0, {}
                for length, c in enumerate(counts, 1):
                    for _ in range(c):
                        table[length, code], code = next(values), code + 1
                    code <<= 1
                huff[seg[0]], seg = table, seg[17 + sum(counts) :]
        elif kind == 0xC0:
            h, w = struct.unpack(">HH", seg[1:5])
            frame = [(seg[6 + 3 * i], seg[7 + 3 * i] >> 4, seg[7 + 3 * i] & 15, seg[8 + 3 * i]) for i in range(seg[5])]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise FormatError("only baseline JPEG is supported")
        elif kind == 0xDD:
            restart = struct.unpack(">H", seg[:2])[0]
        elif kind == 0xDA:
            if frame is None:
                raise FormatError("no frame header")
            tables = {seg[1 + 2 * i]: (huff[seg[2 + 2 * i] >> 4], huff[16 | seg[2 + 2 * i] & 15]) for i in range(seg[0])}
            return _scan(data[at:], w, h, frame, tables, quant, restart)
        elif kind == 0xD9:
            break
    raise FormatError("no scan")


def _scan(body: bytes, w: int, h: int, frame, tables, quant, restart: int) -> list[np.ndarray]:
    parts, start, i = [], 0, 0
    while True:  # the entropy-coded parts between restart markers
        i = body.find(b"\xff", i)
        if i < 0 or i + 1 >= len(body):
            parts.append(body[start:])
            break
        if 0xD0 <= body[i + 1] <= 0xD7:
            parts.append(body[start:i])
            start = i + 2
        elif body[i + 1]:
            parts.append(body[start:i])
            break
        i += 2
    fx, fy = max(c[1] for c in frame), max(c[2] for c in frame)
    mx, my = -(-w // (8 * fx)), -(-h // (8 * fy))
    planes = [np.zeros((my * c[2] * 8, mx * c[1] * 8)) for c in frame]
    source, bits, dc = iter(parts), None, []
    for m in range(mx * my):
        if bits is None or restart and m % restart == 0:
            bits, dc = _Bits(next(source, b"")), [0] * len(frame)
        for k, (cid, sx, sy, q) in enumerate(frame):
            for v in range(sy):
                for u in range(sx):
                    block = np.zeros(64)
                    dc[k] += bits.signed(bits.symbol(tables[cid][0]))
                    block[0] = dc[k]
                    j = 1
                    while j < 64:
                        rs = bits.symbol(tables[cid][1])
                        if rs == 0:
                            break
                        j += rs >> 4
                        if rs & 15:
                            if j > 63:
                                raise FormatError("a block is too long")
                            block[j] = bits.signed(rs & 15)
                        j += 1
                    square = np.zeros(64)
                    square[_ZIGZAG] = block * quant[q]
                    y, x = (m // mx * sy + v) * 8, (m % mx * sx + u) * 8
                    planes[k][y : y + 8, x : x + 8] = _COS @ square.reshape(8, 8) @ _COS.T
    full = [np.repeat(np.repeat(p, fy // c[2], axis=0), fx // c[1], axis=1) for p, c in zip(planes, frame)]
    return [np.clip(np.round(p[:h, :w] + 128), 0, 255).astype(np.uint8) for p in full]


def jpeg_rgb(planes: list[np.ndarray]) -> np.ndarray:
    """Colours of a JPEG's planes (JFIF)."""
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = (p.astype(float) for p in planes)
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2)
    return np.clip(np.round(rgb), 0, 255).astype(np.uint8)


# To gray, as each format has it


def gray_from_rgb(a: np.ndarray, kind: str) -> np.ndarray:
    """Netpbm colours: (r + 2 g + b) / 4; PNG colours: 0.299 r + 0.587 g + 0.114 b; alpha is ignored."""
    if a.ndim == 2:
        return a
    if a.shape[2] < 3:
        return a[:, :, 0]
    r, g, b = (a[:, :, i].astype(np.int64) for i in range(3))
    return ((r + 2 * g + b) // 4 if kind == "pnm" else np.floor(0.299 * r + 0.587 * g + 0.114 * b)).astype(np.uint8)


def illumination_invariant(a: np.ndarray) -> np.ndarray:
    """0.5 + ln g - 0.42 ln b - 0.58 ln r, as a clamped gray image; zero samples count as one."""
    r, g, b = (np.log(np.maximum(a[:, :, i].astype(float), 1) / 255) for i in range(3))
    return np.clip(255 * (0.5 + g - 0.42 * b - 0.58 * r), 0, 255).astype(np.uint8)


def from_float(a: np.ndarray) -> np.ndarray:
    return np.clip(255 * a, 0, 255).astype(np.uint8)


def convert(a: np.ndarray, to) -> np.ndarray:
    """Between sample types by their ranges (unsigned integers full scale, floats 0 to 1), rounded and clamped."""
    to = np.dtype(to)
    top = lambda t: 1.0 if t.kind == "f" else float(np.iinfo(t).max)
    v = a.astype(np.float64) * (top(to) / top(a.dtype))
    return v.astype(to) if to.kind == "f" else np.clip(np.round(v), np.iinfo(to).min, top(to)).astype(to)


def decode_gray(data: bytes, suffix: str) -> np.ndarray:
    suffix = suffix.lower()
    if suffix in ("pnm", "pgm", "ppm", "pbm"):
        return gray_from_rgb(decode_pnm(data), "pnm")
    if suffix == "pam":
        return gray_from_rgb(decode_pam(data), "pnm")
    if suffix == "png":
        return gray_from_rgb(decode_png(data), "png")
    if suffix in ("jpg", "jpeg"):
        return decode_jpeg(data)[0]
    if suffix == "npy":
        a = decode_npy(data)
        if a.ndim != 2 or a.dtype != np.uint8:
            raise FormatError("the array must be two-dimensional uint8")
        return a
    if suffix == "tmp":
        a = decode_tmp(data)
        if a.shape[:2] != (1, 1) or a.dtype != np.uint8:
            raise FormatError("the array must be one plane of uint8")
        return a[0, 0]
    raise FormatError(f"no decoder for {suffix}")


def encode(a: np.ndarray, suffix: str) -> bytes:
    writers = {"pnm": encode_pnm, "pgm": encode_pnm, "ppm": encode_pnm, "pam": encode_pam, "png": encode_png, "npy": encode_npy, "tmp": encode_tmp}
    if suffix.lower() not in writers:
        raise FormatError(f"no encoder for {suffix}")
    return writers[suffix.lower()](a)
