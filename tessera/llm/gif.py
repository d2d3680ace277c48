"""GIF: reading and writing of code streams, frames, palettes, disposal and transparency.

``decode`` reads any GIF87a or GIF89a: global and local palettes, interlaced
rows, delays, disposal methods and transparent indices. ``composite`` plays
the frames on the screen. ``encode`` writes indexed frames with LZW.

Between two clear codes the width of a code depends only on how many codes
came before, so a whole stretch is unpacked or packed at once with numpy, and
only the dictionary itself is a loop.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

FULL = 4096


@dataclass
class Frame:
    left: int
    top: int
    pixels: np.ndarray  # rows x columns of palette indices
    palette: np.ndarray  # n x 3
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int = 0
    loops: int | None = None
    frames: list[Frame] = field(default_factory=list)


def _widths(low: int) -> np.ndarray:
    """Widths of the codes after a clear code: the k-th code is read when low+... entries exist."""
    # after the first code each code adds an entry; a code is as wide as the table before it asks for
    size = np.minimum((1 << low) + 2 + np.maximum(np.arange(FULL - (1 << low) - 1) - 1, 0), FULL - 1)
    return np.maximum(np.floor(np.log2(size)).astype(np.int64) + 1, low + 1)


_SCHEDULE = {low: _widths(low) for low in range(2, 9)}
_STARTS = {low: np.append(0, np.cumsum(w)) for low, w in _SCHEDULE.items()}


def lzw_encode(data: bytes, low: int = 8) -> bytes:
    """Codes of data (values below 2^low), from a first clear code to the end code."""
    clear = 1 << low
    # codes are kept times 256, so that a code and the byte after it make a key by one "or"
    first, full = clear + 2 << 8, FULL - 2 << 8
    stretches: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    get, put, free, prefix = table.get, codes.append, first, -1
    for b in data:
        if prefix < 0:
            prefix = b << 8
            continue
        key = prefix | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = b << 8
        if free < full:
            table[key] = free
            free += 256
        else:  # begin anew
            put(prefix)
            stretches.append(codes)
            codes, table = [], {}
            get, put, free, prefix = table.get, codes.append, first, -1
    if prefix >= 0:
        put(prefix)
    stretches.append(codes)
    stop = [clear << 8]
    every = np.array([*stop, *(c for s in stretches for c in (*s, *stop))]) >> 8
    every[-1] = clear + 1
    widths = np.concatenate([[low + 1], *(_SCHEDULE[low][: len(s) + 1] for s in stretches)])
    return _pack(every, widths)


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    end = np.cumsum(widths)
    begin = end - widths
    value = codes << (begin & 7)  # at most 12 + 7 bits: three bytes
    at = begin >> 3
    # no two codes share a bit, so sums of bytes are their unions
    out = np.bincount(np.concatenate([at, at + 1, at + 2]), np.concatenate([value & 255, value >> 8 & 255, value >> 16]))
    return out[: int(end[-1]) + 7 >> 3].astype(np.uint8).tobytes()


def _unpack(data: np.ndarray, begin: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Codes that begin at these bits; data has three bytes to spare."""
    at = begin >> 3
    return (data[at] | data[at + 1] << 8 | data[at + 2] << 16) >> (begin & 7) & ((1 << widths) - 1)


def lzw_decode(data: bytes, low: int, most: int) -> bytes:
    """The values of a code stream, at most ``most`` of them."""
    clear, end = 1 << low, (1 << low) + 1
    size = len(data) * 8
    octets = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    schedule, starts = _SCHEDULE[low], _STARTS[low]
    base = [bytes([v]) for v in range(clear)] + [b"", b""]
    out: list[bytes] = []
    have, at = 0, 0
    # long streams keep 12-bit codes once the table is full
    while at < size and have < most:
        room = size - at
        n = int(np.searchsorted(starts, room, "right")) - 1
        if n == len(schedule):
            extra = (room - int(starts[n])) // 12
            widths = np.concatenate([schedule, np.full(extra, 12)])
        else:
            widths = schedule[:n]
        if not len(widths):
            break
        begin = np.append(0, np.cumsum(widths))
        codes = _unpack(octets, at + begin[:-1], widths)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stop[0]) if len(stop) else len(codes)
        last = None
        table = base.copy()
        add, put = table.append, out.append
        for c in codes[:used].tolist():
            if last is None:
                entry = table[c]
            else:
                try:
                    entry = table[c]
                except IndexError:
                    if c != len(table) or c >= FULL:
                        raise ValueError("code beyond the table") from None
                    entry = last + last[:1]
                add(last + entry[:1])
            put(entry)
            last = entry
        have = sum(map(len, out))
        if not len(stop) or codes[used] == end:
            break
        at += int(begin[used + 1])
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode(gif: Gif) -> bytes:
    """A GIF89a; each frame has a palette of its own only if it differs from the first frame's."""
    shared = gif.frames[0].palette if gif.frames else np.zeros((2, 3), np.uint8)

    def depth(palette: np.ndarray) -> int:
        return max(1, int(np.ceil(np.log2(max(len(palette), 2)))))

    def colours(palette: np.ndarray) -> bytes:
        return palette.astype(np.uint8).tobytes().ljust(3 << depth(palette), b"\0")

    out = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, 0xF0 | depth(shared) - 1, gif.background, 0), colours(shared)]
    if gif.loops is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", gif.loops) + b"\0")
    for f in gif.frames:
        own = f.palette is not shared and not np.array_equal(f.palette, shared)
        low = max(2, depth(f.palette))
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", f.disposal << 2 | (f.transparent is not None), f.delay_ms // 10, f.transparent or 0, 0))
        rows, columns = f.pixels.shape
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, columns, rows, 0x80 | depth(f.palette) - 1 if own else 0))
        out += [colours(f.palette)] * own
        out += [bytes([low]), _blocks(lzw_encode(f.pixels.astype(np.uint8).tobytes(), low))]
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        out = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return out

    def blocks() -> bytes:
        nonlocal at
        out = []
        while data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(out)

    shared = palette(flags) if flags & 0x80 else np.zeros((2, 3), np.uint8)
    gif = Gif(width, height, background)
    control = (0, 0, None)
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                control = (delay * 10, bits >> 2 & 7, index if bits & 1 else None)
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                gif.loops = struct.unpack_from("<H", body, 12)[0]
        elif kind == 0x2C:
            left, top, columns, rows, own = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = palette(own) if own & 0x80 else shared
            low = data[at]
            at += 1
            values = lzw_decode(blocks(), low, columns * rows)
            pixels = np.frombuffer(values.ljust(columns * rows, b"\0"), np.uint8).reshape(rows, columns)
            if own & 0x40:  # rows come in four passes
                order = np.concatenate([np.arange(s, rows, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(pixels)
                straight[order] = pixels
                pixels = straight
            gif.frames.append(Frame(left, top, pixels, colours, *control))
            control = (0, 0, None)
        else:
            raise ValueError(f"unknown block {kind:#x}")
    return gif


def composite(gif: Gif):
    """The screen after each frame: (rows x columns x RGBA, delay in ms), in order."""
    screen = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = screen.copy() if f.disposal == 3 else None
        box = (slice(f.top, min(f.top + f.pixels.shape[0], gif.height)), slice(f.left, min(f.left + f.pixels.shape[1], gif.width)))
        view = screen[box]
        pixels = f.pixels[: view.shape[0], : view.shape[1]]
        table = np.zeros((256, 4), np.uint8)
        table[: len(f.palette), :3] = f.palette
        table[: len(f.palette), 3] = 255
        drawn = table[pixels]
        if f.transparent is not None:
            drawn = np.where((pixels == f.transparent)[..., None], view, drawn)
        screen[box] = drawn
        yield screen.copy(), f.delay_ms
        if f.disposal == 2:
            screen[box] = 0
        elif before is not None:
            screen = before


def histogram(screen: np.ndarray) -> np.ndarray:
    """Pixels by colour: 4 x 4 x 4 bins of red, green, blue, then transparent ones."""
    seen = screen[..., 3] > 0
    bins = (screen[..., 0] >> 6).astype(np.int64) << 4 | (screen[..., 1] >> 6).astype(np.int64) << 2 | screen[..., 2] >> 6
    return np.append(np.bincount(bins[seen], minlength=64), (~seen).sum())
