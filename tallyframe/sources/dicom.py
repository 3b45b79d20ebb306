"""Reads uncompressed DICOM files (the public standard, parts 5 and 10): geometry from the head, pixels only on request."""

from __future__ import annotations

import struct
from typing import BinaryIO

import numpy as np

#: Elements by (group, element), and the transfer syntaxes of uncompressed little-endian files.
PIXELS, SYNTAX = (0x7FE0, 0x0010), (0x0002, 0x0010)
WANTED = {
    (0x0020, 0x0032): "pos",
    (0x0020, 0x0037): "orient",
    (0x0028, 0x0030): "spacing",
    (0x0020, 0x0062): "image_side",
    (0x0020, 0x0060): "series_side",
    (0x0028, 0x0002): "samples",
    (0x0028, 0x0008): "frames",
    (0x0028, 0x0010): "rows",
    (0x0028, 0x0011): "cols",
    (0x0028, 0x0100): "bits",
    (0x0028, 0x0103): "signed",
    (0x0028, 0x1052): "intercept",
    (0x0028, 0x1053): "slope",
}
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
_LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
_NUMBERS = {"samples", "rows", "cols", "bits", "signed"}
#: What is read of a file at a time: at most this much beyond the head.
BLOCK = 2048


class _Head:
    """A file read in blocks, so that skipping an element doesn't read it."""

    def __init__(self, file: BinaryIO):
        self.file, self.at, self.start, self.data = file, 0, 0, b""

    def take(self, n: int) -> bytes:
        if not self.start <= self.at <= self.at + n <= self.start + len(self.data):
            self.file.seek(self.at)
            self.start, self.data = self.at, self.file.read(max(n, BLOCK))
        out = self.data[self.at - self.start : self.at - self.start + n]
        if len(out) < n:
            raise ValueError("the file ends in an element")
        self.at += n
        return out


def _element(head: _Head, explicit: bool) -> tuple[tuple[int, int], int]:
    """The tag and length of the element that follows."""
    tag = struct.unpack("<HH", head.take(4))
    if explicit and tag[0] != 0xFFFE:
        kind = head.take(2)
        if kind in _LONG:
            head.take(2)
            return tag, struct.unpack("<I", head.take(4))[0]
        return tag, struct.unpack("<H", head.take(2))[0]
    return tag, struct.unpack("<I", head.take(4))[0]


def _skip(head: _Head, length: int, explicit: bool) -> None:
    """Past an element's value; one of undefined length ends with its delimiter, at the same depth."""
    if length != 0xFFFFFFFF:
        head.at += length
        return
    while True:
        tag, n = _element(head, explicit)
        if tag in ((0xFFFE, 0xE0DD), (0xFFFE, 0xE00D)):
            return
        _skip(head, n, explicit)


def _floats(text: bytes, count: int) -> list[float] | None:
    try:
        out = [float(x) for x in text.decode("ascii").strip("\0 ").split("\\")]
    except ValueError:
        return None
    return out if len(out) == count else None


def _number(text: bytes | None, default: float) -> float:
    """A number; none, or 0, is the default."""
    return (_floats(text, 1) or [default])[0] or default if text is not None else default


def read(file: BinaryIO, pixels: bool) -> dict:
    """rows, cols, pos, orient, spacing, side, slope, intercept and, on request, pixels (float32, rescaled) of one frame.

    Geometry that is missing or malformed takes defaults. A file that isn't readable, compressed, or not of one plane is
    a ValueError. Without pixels, nothing after the head is read but the rest of a block.
    """
    head = _Head(file)
    if len(start := head.take(132)) < 132 or start[128:] != b"DICM":
        raise ValueError("not a DICOM file")
    syntax, told, at_pixels = EXPLICIT, {}, None
    while True:
        before = head.at
        try:
            group = struct.unpack("<H", head.take(2))[0]
        except ValueError:
            break  # the end
        head.at = before
        explicit = group == 0x0002 or syntax != IMPLICIT
        if group > 0x0002 and syntax not in (IMPLICIT, EXPLICIT):
            raise ValueError(f"transfer syntax {syntax} isn't supported")
        tag, length = _element(head, explicit)
        if tag == PIXELS:
            at_pixels = (head.at, length)
            break
        if tag == SYNTAX:
            syntax = head.take(length).decode("ascii").strip("\0 ")
        elif tag in WANTED and length != 0xFFFFFFFF:
            told[WANTED[tag]] = head.take(length)
        else:
            _skip(head, length, explicit)
    for name in _NUMBERS & told.keys():
        told[name] = struct.unpack("<H", told[name][:2])[0]
    if at_pixels is None or not (told.get("rows") and told.get("cols")):
        raise ValueError("no pixels")
    rows, cols, frames = told["rows"], told["cols"], _number(told.get("frames"), 1)
    if told.get("samples", 1) != 1 or frames != 1:
        raise ValueError("not one plane of one sample a pixel")
    side = next((s for k in ("image_side", "series_side") if (s := told.get(k, b"").decode("ascii", "replace").strip("\0 "))), None)
    slope, intercept = _number(told.get("slope"), 1.0), _number(told.get("intercept"), 0.0)
    geometry = {k: _floats(told.get(k, b""), n) or d for k, n, d in (("pos", 3, [0.0, 0.0, 0.0]), ("orient", 6, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]), ("spacing", 2, [1.0, 1.0]))}
    out = {"rows": rows, "cols": cols, **geometry, "side": side, "slope": slope, "intercept": intercept}
    if pixels:
        bits = told.get("bits", 16)
        if bits not in (8, 16, 32):
            raise ValueError(f"{bits} bits a pixel aren't supported")
        size = rows * cols * bits // 8
        file.seek(at_pixels[0])
        data = file.read(size)
        if len(data) < size:
            raise ValueError("fewer pixels than rows x columns")
        raw = np.frombuffer(data, f"<{'i' if told.get('signed') else 'u'}{bits // 8}")
        out["pixels"] = raw.astype(np.float32) * np.float32(slope) + np.float32(intercept)
    return out


def write(rows: int, cols: int, values: np.ndarray, **fields: str) -> bytes:
    """A file of 16-bit values with the given elements (names of WANTED, as text), explicit and little-endian."""

    def element(tag: tuple[int, int], kind: bytes, value: bytes) -> bytes:
        value += (b"\0" if kind in (b"OW", b"UI") else b" ") * (len(value) % 2)
        size = struct.pack("<HI", 0, len(value)) if kind in _LONG else struct.pack("<H", len(value))
        return struct.pack("<HH", *tag) + kind + size + value

    tags = {v: k for k, v in WANTED.items()}
    numbers = {"samples": 1, "rows": rows, "cols": cols, "bits": 16, "signed": int(values.dtype.kind == "i")}
    body = [(tags[k], b"US", struct.pack("<H", v)) for k, v in numbers.items()]
    body += [(tags[k], b"CS" if k.endswith("side") else b"DS", v.encode("ascii")) for k, v in fields.items()]
    data = np.ascontiguousarray(values, f"<{'i' if numbers['signed'] else 'u'}2").tobytes()
    meta = element(SYNTAX, b"UI", EXPLICIT.encode())
    return b"\0" * 128 + b"DICM" + meta + b"".join(element(*e) for e in sorted(body)) + element(PIXELS, b"OW", data)
