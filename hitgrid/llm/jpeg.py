"""Progressive JPEG in numpy: scans accumulate into coefficient arrays, many entropy segments side by side.

A scan's restart segments are independent, so the decoder holds a bit position and a place in the block
order for each segment of each image of a batch and takes one symbol of all of them at a time. That works
for any progressive or restart-free file; restarts only make more lanes. `encode` writes given coefficients
with spectral selection and successive approximation, with tables that make most codes byte-aligned.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np

#: Zigzag order of an 8 x 8 block.
ZIGZAG = np.array([x + 8 * y for s in range(15) for x, y in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), key=lambda p: -p[0] if s % 2 else p[0])])


@dataclass
class Component:
    name: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks of the padded grid
    high: int = 0
    used_wide: int = 0  # blocks that hold samples of the image
    used_high: int = 0
    base: int = 0  # first block of this component in the batch


@dataclass
class Scan:
    components: list[int]
    dc: list[int]  # number of the Huffman table in the batch, for each component
    ac: list[int]
    first: int
    last: int
    high: int
    low: int
    restart: int
    starts: list[int] = field(default_factory=list)  # where the segments begin in the file, after markers


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    progressive: bool = True
    orders: dict[tuple, tuple] = field(default_factory=dict)  # block orders by the components of a scan

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


class Tables:
    """Huffman tables of a batch as lookups of 16 bits: length << 8 | symbol; equal tables are held once."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.lookups: list[np.ndarray] = []

    def add(self, spec: bytes) -> int:
        if spec not in self.known:
            out, code, at = np.zeros(65536, np.uint16), 0, 16
            for length in range(1, 17):
                for _ in range(spec[length - 1]):
                    out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | spec[at]
                    code, at = code + 1, at + 1
                code <<= 1
            self.known[spec] = len(self.lookups)
            self.lookups.append(out)
        return self.known[spec]


def parse(data: bytes, tables: Tables) -> Image:
    """Markers of a file. Baseline and progressive files with 8-bit samples are taken."""
    raw = np.frombuffer(data, np.uint8)
    image, huffman, restart, at = Image(), {}, 0, 2
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    following = raw[marks + 1]
    restarts = marks[(following >= 0xD0) & (following <= 0xD7)].tolist()
    stops = marks[(following != 0) & (following != 0xFF) & ((following < 0xD0) | (following > 0xD7))].tolist()
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    while at < len(data) - 1:
        code = data[at + 1]
        if code == 0xFF:  # a fill byte
            at += 1
            continue
        if code == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 64 * (1 + (wide > 0))
                image.quant[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif code in (0xC0, 0xC1, 0xC2):
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.progressive = code == 0xC2
            image.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            across, down = image.mcus
            h, v = max(c.h for c in image.components), max(c.v for c in image.components)
            for c in image.components:
                c.wide, c.high = across * c.h, down * c.v
                c.used_wide, c.used_high = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
        elif code == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                huffman[body[0]] = tables.add(body[1:n])
                body = body[n:]
        elif code == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif code == 0xDA:
            names = {c.name: k for k, c in enumerate(image.components)}
            n = body[0]
            picks = [(names[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            scan = Scan([p[0] for p in picks], [huffman.get(p[1] >> 4, 0) for p in picks], [huffman.get(16 | (p[1] & 15), 0) for p in picks], first, last, approx >> 4, approx & 15, restart)
            k = bisect_left(stops, at)
            end = stops[k] if k < len(stops) else len(data)
            scan.starts = [at, *(m + 2 for m in restarts[bisect_left(restarts, at) : bisect_left(restarts, end)])]
            image.scans.append(scan)
            at = end
        elif 0xC3 <= code <= 0xCF:
            raise ValueError(f"frames of kind {code:#x} are not taken")
    return image


def block_order(image: Image, picks: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan over these components in their order, the component (its place among them) of each, and blocks of an MCU."""
    key = tuple(picks)
    if key not in image.orders:
        image.orders[key] = _order(image, picks)
    return image.orders[key]


def _order(image: Image, picks: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    if len(picks) == 1:
        c = image.components[picks[0]]
        if c.used_wide == c.wide:
            return c.base + np.arange(c.wide * c.used_high), np.zeros(c.wide * c.used_high, np.int8), 1
        y, x = np.divmod(np.arange(c.used_wide * c.used_high), c.used_wide)
        return c.base + y * c.wide + x, np.zeros(len(y), np.int8), 1
    across, down = image.mcus
    parts, which = [], []
    y, x = np.divmod(np.arange(across * down), across)
    for k, n in enumerate(picks):
        c = image.components[n]
        for v in range(c.v):
            for h in range(c.h):
                parts.append(c.base + (y * c.v + v) * c.wide + x * c.h + h)
                which.append(k)
    return np.stack(parts, 1).ravel(), np.tile(np.array(which, np.int8), across * down), len(which)


class _Lanes:
    """Entropy segments that are read side by side."""

    def __init__(self, raw: np.ndarray, pos: np.ndarray):
        self.raw, self.pos = raw, pos  # raw: unstuffed bytes with eight more at the end; pos: next bit of each lane

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        at = pos >> 3
        word = (self.raw[at] << 16) | (self.raw[at + 1] << 8) | self.raw[at + 2]
        return (word >> (8 - (pos & 7))) & 0xFFFF

    def bits(self, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The next n bits (0 to 16) as numbers."""
        return self.peek(pos) >> (16 - n)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def decode_coefficients(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Images and all their coefficients, blocks x 64 in zigzag order; component.base has each one's first block."""
    tables = Tables()
    images, total = [parse(f, tables) for f in files], 0
    for image in images:
        for c in image.components:
            c.base, total = total, total + c.wide * c.high
    out = np.zeros((total, 64), np.int16)
    lookups = np.stack(tables.lookups) if tables.lookups else np.zeros((1, 65536), np.uint16)
    # All files as one buffer without stuffed zeros; markers stay between segments and are never read.
    raw = np.frombuffer(b"".join(files) + bytes(8), np.uint8)
    places = np.cumsum([0, *map(len, files)])
    stuffed = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1
    keep = np.ones(len(raw), bool)
    keep[stuffed] = False
    raw = raw[keep].astype(np.int32)
    orders: dict[tuple, tuple] = {}
    for k in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict[tuple, list[int]] = {}
        for n, image in enumerate(images):
            if k < len(image.scans):
                s = image.scans[k]
                kind = "whole" if not image.progressive else ("dc" if s.first == 0 else "ac") + ("+" if s.high else "")
                kinds.setdefault((kind, s.first, s.last, s.low, tuple(s.components)), []).append(n)
        for (kind, first, last, low, picks), own in kinds.items():
            if (picks, *own) not in orders:
                parts = [block_order(images[n], list(picks)) for n in own]
                orders[picks, *own] = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([len(p[0]) for p in parts]), np.array([p[2] for p in parts])
            blocks, comps, sizes, per = orders[picks, *own]
            scans = [images[n].scans[k] for n in own]
            # Lanes: (first block, blocks) of each segment.
            step = np.array([s.restart for s in scans]) * per
            step = np.where(step > 0, step, np.maximum(sizes, 1))
            count = np.minimum(-(-sizes // step), [len(s.starts) for s in scans])
            starts = np.array([x for s, m in zip(scans, count.tolist(), strict=True) for x in s.starts[:m]]) + np.repeat(places[own], count)
            starts = starts - np.searchsorted(stuffed, starts)
            rank = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at = rank * np.repeat(step, count)
            lanes = np.column_stack([at + np.repeat(np.cumsum(sizes) - sizes, count), np.minimum(np.repeat(step, count), np.repeat(sizes, count) - at)])
            codes = np.repeat(np.array([[*(s.dc + [0] * 4)[:4], *(s.ac + [0] * 4)[:4]] for s in scans], np.int32), count, axis=0)
            _scan(kind, first, last, low, _Lanes(raw, starts * 8), blocks, comps, lanes, codes, out, lookups)
    return images, out


def _scan(kind: str, first: int, last: int, low: int, read: _Lanes, blocks: np.ndarray, comps: np.ndarray, lanes: np.ndarray, tables: np.ndarray, out: np.ndarray, lookups: np.ndarray) -> None:
    if kind == "dc":
        _dc_first(read, blocks, comps, lanes, tables, low, out, lookups)
    elif kind == "dc+":
        rank = np.arange(int(lanes[:, 1].sum())) - np.repeat(np.cumsum(lanes[:, 1]) - lanes[:, 1], lanes[:, 1])
        place = np.repeat(read.pos, lanes[:, 1]) + rank
        at = blocks[np.repeat(lanes[:, 0], lanes[:, 1]) + rank]
        out[at, 0] |= (((read.raw[place >> 3] >> (7 - (place & 7))) & 1) << low).astype(np.int16)
    elif kind == "ac":
        _ac_first(read, blocks, lanes, tables[:, 4], first, last, low, out, lookups)
    elif kind == "ac+":
        _ac_refine(read, blocks, lanes, tables[:, 4], first, last, low, out, lookups)
    else:
        _whole(read, blocks, comps, lanes, tables, out, lookups)


def _dc_step(read: _Lanes, pos: np.ndarray, table: np.ndarray, lookups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = lookups[table, read.peek(pos)].astype(np.int32)
    pos = pos + (found >> 8)
    size = found & 255
    return _extend(read.bits(pos, size), size), pos + size


def _dc_first(read: _Lanes, blocks, comps, lanes, tables, low, out, lookups) -> None:
    order = np.argsort(-lanes[:, 1], kind="stable")
    lanes, tables, pos = lanes[order], tables[order], read.pos[order]
    before = np.zeros((len(lanes), 4), np.int32)
    for i in range(int(lanes[:, 1].max(initial=0))):
        live = int(np.searchsorted(-lanes[:, 1], -i, side="left"))
        at = lanes[:live, 0] + i
        comp, rows = comps[at], np.arange(live)
        diff, pos[:live] = _dc_step(read, pos[:live], tables[rows, comp], lookups)
        before[rows, comp] += diff
        out[blocks[at], 0] = before[rows, comp] << low


def _ac_first(read: _Lanes, blocks, lanes, table, first, last, low, out, lookups) -> None:
    flat, base = out.reshape(-1), blocks.astype(np.int64) * 64
    at, end, pos, table = lanes[:, 0].copy(), lanes.sum(axis=1), read.pos.copy(), table.astype(np.int64) << 16
    lookup, k = lookups.reshape(-1).astype(np.int32), np.full(len(at), first, np.int64)
    while len(at):
        found = lookup[table + read.peek(pos)]
        pos += found >> 8
        run, size = (found >> 4) & 15, found & 15
        k += run
        value = read.bits(pos, size)
        pos += size
        value = _extend(value, size)
        if size.all():
            flat[base[at] + k] = value << low
            k += 1
        else:
            some = size > 0
            flat[base[at[some]] + k[some]] = value[some] << low
            k += 1  # sixteen zeros are a run of fifteen and one more
            end_run = ~some & (run < 15)
            r = run[end_run]
            at[end_run] += (1 << r) - 1 + read.bits(pos[end_run], r)
            pos[end_run] += r
            k[end_run] = last + 1
        over = k > last
        at[over] += 1
        k[over] = first
        live = at < end
        if not live.all():
            at, end, pos, table, k = at[live], end[live], pos[live], table[live], k[live]


def _ac_refine(read: _Lanes, blocks, lanes, table, first, last, low, out, lookups) -> None:
    at, end, pos, table = lanes[:, 0].copy(), lanes.sum(axis=1), read.pos.copy(), table.astype(np.int64) << 16
    lookup, k, left = lookups.reshape(-1).astype(np.int32), np.full(len(at), first), np.zeros(len(at), np.int64)
    band, one = np.arange(first, last + 1), np.int16(1 << low)
    while len(at):
        # left: blocks of an end-of-band run, this one included
        run, new = np.full(len(at), 99), np.zeros(len(at), np.int16)
        ask = left == 0
        if ask.any():
            found = lookup[table[ask] + read.peek(pos[ask])]
            p = pos[ask] + (found >> 8)
            r, s = (found >> 4) & 15, found & 15
            ends = (s == 0) & (r < 15)
            bits = read.bits(p, np.where(ends, r, s))
            p += np.where(ends, r, s)
            left[ask] = np.where(ends, (1 << r) + bits, 0)
            run[ask] = np.where(ends, 99, r)
            new[ask] = np.where(s > 0, np.where(bits > 0, one, -one), 0)
            pos[ask] = p
        rows = blocks[at]
        block = out[rows, first : last + 1]
        ahead = band >= k[:, None]
        old = block != 0
        if (run < 99).any():
            zeros = np.cumsum(ahead & ~old, axis=1)
            stop = np.where(run < 99, first + np.minimum((zeros <= run[:, None]).sum(axis=1), last + 1 - first), last + 1)
            hit = old & ahead & (band < stop[:, None])
        else:
            stop = np.full(len(at), last + 1)
            hit = old & ahead
        count = np.cumsum(hit, axis=1)
        where = pos[:, None] + count - 1
        bit = (read.raw[where >> 3] >> (7 - (where & 7))) & 1
        change = hit & (bit > 0) & ((np.abs(block) & one) == 0)
        block += np.where(change, np.sign(block) * one, 0).astype(np.int16)
        pos += count[:, -1]
        put = (new != 0) & (stop <= last)
        block[np.flatnonzero(put), stop[put] - first] = new[put]
        out[rows, first : last + 1] = block
        k = np.where(left > 0, last + 1, stop + 1)
        left = np.maximum(left - 1, 0)
        over = k > last
        at[over] += 1
        k[over] = first
        live = at < end
        if not live.all():
            at, end, pos, table, k, left = at[live], end[live], pos[live], table[live], k[live], left[live]


def _whole(read: _Lanes, blocks, comps, lanes, tables, out, lookups) -> None:
    """Baseline: all 64 coefficients of a block in turn."""
    pos, before = read.pos.copy(), np.zeros((len(lanes), 4), np.int32)
    for i in range(int(lanes[:, 1].max(initial=0))):
        live = np.flatnonzero(lanes[:, 1] > i)
        at = lanes[live, 0] + i
        comp = comps[at]
        diff, pos[live] = _dc_step(read, pos[live], tables[live, comp], lookups)
        before[live, comp] += diff
        out[blocks[at], 0] = before[live, comp]
        rest, k, row = live, np.ones(len(live), np.int64), blocks[at]
        table = tables[live, 4 + comp]
        while len(rest):
            found = lookups[table, read.peek(pos[rest])].astype(np.int32)
            pos[rest] += found >> 8
            run, size = (found >> 4) & 15, found & 15
            k += run
            value = _extend(read.bits(pos[rest], size), size)
            pos[rest] += size
            some = size > 0
            out[row[some], k[some]] = value[some]
            k += 1
            go = (some | (run == 15)) & (k < 64)
            rest, k, row, table = rest[go], k[go], row[go], table[go]


# ---- samples ---------------------------------------------------------------------------------

_SCALE = 1 << 13


def _inverse_matrix() -> np.ndarray:
    """64 coefficients in zigzag order to 64 samples, in whole numbers: sums are exact in doubles, so equal blocks give equal samples."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    full = np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * _SCALE)


_INVERSE_DCT = _inverse_matrix()


def samples(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Full-resolution RGB, height x width x 3: inverse transform, chroma repeated to full size, JFIF colours."""
    planes = []
    top_h, top_v = max(c.h for c in image.components), max(c.v for c in image.components)
    for c in image.components:
        block = coefficients[c.base : c.base + c.wide * c.high].astype(np.float64)
        quant = image.quant[c.table]
        block = block if (quant == 1).all() else block * quant
        flat = np.clip(np.floor_divide(block @ _INVERSE_DCT + _SCALE / 2, _SCALE) + 128, 0, 255).astype(np.uint8)
        plane = flat.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(c.high * 8, c.wide * 8)
        if (c.v, c.h) != (top_v, top_h):
            plane = plane.repeat(top_v // c.v, axis=0).repeat(top_h // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = (planes[0].astype(np.int32) << 16) + 32768, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((*planes[0].shape, 3), np.uint8)
    out[..., 0] = np.clip((y + 91881 * cr) >> 16, 0, 255)
    out[..., 1] = np.clip((y - 22554 * cb - 46802 * cr) >> 16, 0, 255)
    out[..., 2] = np.clip((y + 116130 * cb) >> 16, 0, 255)
    return out


# ---- writing ---------------------------------------------------------------------------------


def _codes(table: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table's bytes and (code, length) by symbol, from {symbol: length}."""
    ordered = sorted(table.items(), key=lambda x: x[1])
    counts, out, code, before = [0] * 16, {}, 0, 0
    for symbol, length in ordered:
        code <<= length - before
        counts[length - 1] += 1
        out[symbol], code, before = (code, length), code + 1, length
    return bytes(counts) + bytes(s for s, _ in ordered), out


#: A code length for each symbol that the writer uses: any table would do.
_DC = _codes({s: 4 for s in range(12)})
_AC = _codes({0x07: 1, 0x00: 2} | {s: 8 for s in range(1, 16) if s != 7} | {0xF0: 8} | {16 * r + s: 12 for r in range(1, 15) for s in range(1, 9)} | {16 * r: 12 for r in range(1, 15)} | {0xF0 + s: 13 for s in range(1, 9)})
_REFINE = _codes({16 * r: 3 for r in range(4)} | {16 * r + 1: 8 for r in range(16)} | {0xF0: 8} | {16 * r: 8 for r in range(4, 15)})


def _segment(code: str) -> bytes:
    code += "1" * (-len(code) % 8)
    return int(code, 2).to_bytes(len(code) // 8, "big").replace(b"\xff", b"\xff\x00") if code else b""


def _joined(segments: list[bytes]) -> bytes:
    out = []
    for k, s in enumerate(segments):
        out += [s, bytes([0xFF, 0xD0 + k % 8])]
    return b"".join(out[:-1])


def _bits_of(value: int, size: int) -> str:
    return format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def _dc_pieces(values: np.ndarray, comps: np.ndarray, segment: np.ndarray) -> list[bytes]:
    """Segments of a first DC scan: fixed codes of four bits and the difference's bits. segment: each value's, ascending."""
    diff = values.copy()
    for c in np.unique(comps):
        own = np.flatnonzero(comps == c)
        same = segment[own[1:]] == segment[own[:-1]]
        diff[own[1:]] -= np.where(same, values[own[:-1]], 0)
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    code = (size << size) | np.where(diff > 0, diff, diff + (1 << size) - 1) * (size > 0)
    return _pieces(code, size + 4, segment)


def _pieces(code: np.ndarray, length: np.ndarray, segment: np.ndarray) -> list[bytes]:
    """Codes as bits, each segment padded with ones to whole bytes and stuffed."""
    total = np.bincount(segment, weights=length).astype(np.int64)
    room = -(-total // 8) * 8
    begin = np.cumsum(room) - room
    first = np.searchsorted(segment, np.arange(len(total)))
    ends = np.cumsum(length)
    start = begin[segment] + (ends - length) - (ends - length)[first][segment]
    bits = np.ones(int(room.sum()), np.uint8)
    rank = np.arange(int(length.sum())) - np.repeat(ends - length, length)
    bits[np.repeat(start, length) + rank] = (np.repeat(code, length) >> (np.repeat(length, length) - 1 - rank)) & 1
    raw = np.packbits(bits).tobytes()
    return [raw[a : a + m].replace(b"\xff", b"\xff\x00") for a, m in zip((begin // 8).tolist(), (room // 8).tolist(), strict=True)]


def _ac_block(values: np.ndarray) -> str:
    """One block's band in the first AC scan, the general way."""
    out, run = [], 0
    for v in values.tolist():
        if v == 0:
            run += 1
            continue
        while run > 15:
            out.append(format(_AC[1][0xF0][0], f"0{_AC[1][0xF0][1]}b"))
            run -= 16
        size = abs(v).bit_length()
        code, length = _AC[1][16 * run + size]
        out.append(format(code, f"0{length}b") + _bits_of(v, size))
        run = 0
    if run:
        out.append(format(_AC[1][0][0], f"0{_AC[1][0][1]}b"))
    return "".join(out)


def _ac_scan(band: np.ndarray, restart: int) -> bytes:
    """band: blocks x width, already shifted. Segments of size-7 values alone are whole bytes, the sign and value after a zero bit."""
    n, width = band.shape
    plain = ((band >= 64) & (band <= 127) | (band <= -64) & (band >= -127)).all(axis=1)
    fast = int(np.argmin(plain)) if not plain.all() else n
    fast -= fast % restart if fast < n else 0
    full = fast // restart
    segments = []
    raw = np.where(band[:fast] > 0, band[:fast], band[:fast] + 127).astype(np.uint8)
    marked = np.empty((full, restart * width + 2), np.uint8)
    marked[:, :-2] = raw[: full * restart].reshape(full, restart * width)
    marked[:, -2] = 0xFF
    marked[:, -1] = 0xD0 + np.arange(full) % 8
    head = marked.tobytes()
    if full * restart < fast:
        segments.append(raw[full * restart :].tobytes())
    zero = ~band[fast:].any(axis=1)
    for a in range(fast, n, restart):
        now = band[a : a + restart]
        k = int(np.argmin(plain[a : a + restart])) if not plain[a : a + restart].all() else len(now)
        if zero[a - fast + k : a - fast + len(now)].all():  # whole bytes, then empty blocks
            whole = np.where(now[:k] > 0, now[:k], now[:k] + 127).astype(np.uint8).tobytes()
            segments.append(whole + _segment("10" * (len(now) - k)))
        else:
            segments.append(_segment("".join(map(_ac_block, now))))
    if not segments:
        return head[:-2]
    out = [head]
    for k, s in enumerate(segments):
        out += [s, bytes([0xFF, 0xD0 + (full + k) % 8])]
    return b"".join(out[:-1])


def _refine_scan(band: np.ndarray, restart: int) -> bytes:
    """Corrections by one bit for bands without a value of size one: an end-of-band run for each segment and the bits of all values."""
    n, width = band.shape
    if (np.abs(band) == 1).any():
        return _joined([_segment("".join(map(_refine_block, band[a : a + restart]))) for a in range(0, n, restart)])
    there = band != 0
    bits = (np.abs(band) & 1).astype(np.uint8)
    full = there.all(axis=1)
    whole = n // restart if full.all() else int(np.argmin(full)) // restart
    r = restart.bit_length() - 1
    code, length = _REFINE[1][16 * r]
    lead = np.array([int(x) for x in format(code, f"0{length}b") + format(restart - (1 << r), f"0{r}b" if r else "")], np.uint8) if r else np.array([int(x) for x in format(code, f"0{length}b")], np.uint8)
    rows = np.concatenate([np.broadcast_to(lead, (whole, len(lead))), bits[: whole * restart].reshape(whole, restart * width)], axis=1)
    rows = np.concatenate([rows, np.ones((whole, -rows.shape[1] % 8), np.uint8)], axis=1)
    segments = [x.tobytes().replace(b"\xff", b"\xff\x00") for x in np.packbits(rows, axis=1)]
    for a in range(whole * restart, n, restart):
        m = min(restart, n - a)
        r = m.bit_length() - 1
        code, length = _REFINE[1][16 * r]
        tail = "".join(map(str, bits[a : a + m][there[a : a + m]].tolist()))
        segments.append(_segment(format(code, f"0{length}b") + (format(m - (1 << r), f"0{r}b") if r else "") + tail))
    return _joined(segments)


def _refine_block(values: np.ndarray) -> str:
    """One block's band in a refinement scan, the general way: new values of size one, with the corrections that runs pass."""
    out, run, fixes = [], 0, ""
    last = max((k for k, v in enumerate(values.tolist()) if abs(v) == 1), default=-1)
    for k, v in enumerate(values.tolist()):
        if abs(v) > 1:
            fixes += str(abs(v) & 1)
        elif v == 0:
            if k > last:
                continue
            run += 1
            if run == 16:
                code, length = _REFINE[1][0xF0]
                out.append(format(code, f"0{length}b") + fixes)
                run, fixes = 0, ""
        else:
            code, length = _REFINE[1][16 * run + 1]
            out.append(format(code, f"0{length}b") + ("1" if v > 0 else "0") + fixes)
            run, fixes = 0, ""
    if last < len(values) - 1:
        code, length = _REFINE[1][0]
        out.append(format(code, f"0{length}b") + fixes)
    return "".join(out)


def _chunk(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body


def encode_dense(images: list[tuple[int, int, int]], blocks: np.ndarray, restart: int = 8) -> list[bytes]:
    """4:2:0 files for many images at once, whose blocks have values of magnitudes 128 to 255 alone.

    images: (MCUs across, MCUs down, blocks); blocks: those of all images, one after the other. They fill luma, then
    both chroma planes, row by row; blocks that are left stay zero. The files are those that `encode` writes: with
    these magnitudes each code of a first AC scan is one byte, so most of the work is one pass over all images.
    """
    half = np.sign(blocks) * (np.abs(blocks) >> 1)
    codes = np.where(half > 0, half, half + 127).astype(np.uint8)
    low, high, last = np.ascontiguousarray(codes[:, 1:6]), np.ascontiguousarray(codes[:, 6:]), (np.abs(blocks) & 1).astype(np.uint8)
    planes, firsts, lasts, comps, segments, begin, seen = [], [], [], [], [], 0, 0
    zero = np.zeros(1, blocks.dtype)
    for across, down, n in images:
        mcus = across * down
        held = np.concatenate([blocks[begin : begin + n, 0], np.broadcast_to(zero, 6 * mcus - n)])
        order = _mcu_order(across, down)
        dc = held[order]
        firsts.append(dc >> 1)
        lasts.append(dc & 1)
        seg = np.arange(6 * mcus) // (6 * restart)
        segments.append(seg + seen)
        comps.append(np.tile(_MCU_PLANES, mcus))
        seen += int(seg[-1]) + 1
        cuts = [0, 4 * mcus, 5 * mcus, 6 * mcus]
        planes.append([(begin + min(a, n), min(b, n) - min(a, n), (b - a) - (min(b, n) - min(a, n))) for a, b in zip(cuts, cuts[1:], strict=False)])
        begin += n
    segment = np.concatenate(segments)
    dc_first = _dc_pieces(np.concatenate(firsts), np.concatenate(comps), segment)
    dc_last = _pieces(np.concatenate(lasts), np.ones(len(segment), np.int64), segment)
    out, seen = [], 0
    heads = _dense_heads(restart)
    for (across, down, _), own in zip(images, planes, strict=True):
        m = -(-across * down // restart)
        parts = [b"\xff\xd8", heads["tables"], _chunk(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + _DENSE_FRAME), heads["codes"], heads["dc"], _joined(dc_first[seen : seen + m])]
        for name, band in (("low", low), ("high", high)):
            for k, (a, n, z) in enumerate(own):
                parts += [heads[name][k], _dense_ac(band[a : a + n], z, restart)]
        parts += [heads["dc+"], _joined(dc_last[seen : seen + m])]
        for k, (a, n, z) in enumerate(own):
            parts += [heads["ac+"][k], _dense_refine(last[a : a + n, 1:], z, restart)]
        out.append(b"".join([*parts, b"\xff\xd9"]))
        seen += m
    return out


_DENSE_FRAME = b"".join(bytes([k + 1, 0x22 if k == 0 else 0x11, 0]) for k in range(3))
_MCU_PLANES = np.array([0, 0, 0, 0, 1, 2], np.int8)


def _mcu_order(across: int, down: int) -> np.ndarray:
    """Blocks of luma, then both chroma planes, in the order of MCUs of 4:2:0."""
    y, x = np.divmod(np.arange(across * down), across)
    corner = 4 * across * y + 2 * x
    n = across * down
    return np.stack([corner, corner + 1, corner + 2 * across, corner + 2 * across + 1, 4 * n + y * across + x, 5 * n + y * across + x], 1).ravel()


def _dense_heads(restart: int) -> dict:
    def head(picks: list[int], first: int, last: int, approx: int, table: int) -> bytes:
        return _chunk(0xDA, bytes([len(picks)]) + b"".join(bytes([k + 1, table]) for k in picks) + bytes([first, last, approx]))

    return {
        "tables": _chunk(0xDB, b"\0" + bytes([1] * 64)),
        "codes": _chunk(0xC4, b"\x00" + _DC[0] + b"\x10" + _AC[0] + b"\x11" + _REFINE[0]) + _chunk(0xDD, struct.pack(">H", restart)),
        "dc": head([0, 1, 2], 0, 0, 0x01, 0x00), "dc+": head([0, 1, 2], 0, 0, 0x10, 0x00),
        "low": [head([k], 1, 5, 0x01, 0x00) for k in range(3)], "high": [head([k], 6, 63, 0x01, 0x00) for k in range(3)], "ac+": [head([k], 1, 63, 0x10, 0x01) for k in range(3)],
    }


def _dense_ac(band: np.ndarray, zeros: int, restart: int) -> bytes:
    """A first AC scan of one plane: a byte for each value, two bits for each empty block behind them."""
    n, width = band.shape
    full = n // restart
    marked = np.empty((full, restart * width + 2), np.uint8)
    marked[:, :-2] = band[: full * restart].reshape(full, restart * width)
    marked[:, -2] = 0xFF
    marked[:, -1] = _RESTARTS[:full] if full <= len(_RESTARTS) else 0xD0 + np.arange(full) % 8
    out, k = [marked.tobytes()], full
    rest = band[full * restart :].tobytes()
    while rest or zeros:
        room = restart - len(rest) // width
        now = min(room, zeros)
        out += [rest + _segment("10" * now), bytes([0xFF, 0xD0 + k % 8])]
        rest, zeros, k = b"", zeros - now, k + 1
    whole = b"".join(out)
    return whole[:-2]


_RESTARTS = (0xD0 + np.arange(4096) % 8).astype(np.uint8)


def _dense_refine(bits: np.ndarray, zeros: int, restart: int) -> bytes:
    """The last bits of one plane: each segment is one end-of-band run and the bits of its values."""
    n, width = bits.shape
    full = n // restart
    lead = _run_code(restart)
    rows = np.ones((full, -(-(len(lead) + restart * width) // 8) * 8), np.uint8)
    rows[:, : len(lead)] = [int(x) for x in lead]
    rows[:, len(lead) : len(lead) + restart * width] = bits[: full * restart].reshape(full, restart * width)
    packed, size = np.packbits(rows, axis=1).tobytes(), rows.shape[1] // 8
    segments = [packed[a : a + size].replace(b"\xff", b"\xff\x00") for a in range(0, full * size, size)]
    rest = bits[full * restart :]
    left = len(rest)
    while left or zeros:
        now = min(restart, left + zeros)
        segments.append(_segment(_run_code(now) + (rest.tobytes().translate(_DIGITS).decode() if left else "")))
        zeros, left = zeros - (now - left), 0
    return _joined(segments)


_DIGITS = bytes([48, 49, *range(2, 256)])


def _run_code(blocks: int) -> str:
    """An end-of-band run over so many blocks."""
    r = blocks.bit_length() - 1
    code, length = _REFINE[1][16 * r]
    return format(code, f"0{length}b") + (format(blocks - (1 << r), f"0{r}b") if r else "")


def encode(width: int, height: int, components: list[tuple[int, int, np.ndarray]], quant: np.ndarray | None = None, restart: int = 8) -> bytes:
    """A progressive file. components: (h, v, coefficients of the padded grid, blocks x 64 in zigzag order).

    Scans: DC and AC (1-5, then 6-63) without their last bit, then the last bit of each.
    """
    quant = np.ones(64, np.uint8) if quant is None else quant.astype(np.uint8)
    image = Image(width, height, [Component(k + 1, h, v, 0) for k, (h, v, _) in enumerate(components)])
    across, down = image.mcus
    top_h, top_v, base = max(h for h, _, _ in components), max(v for _, v, _ in components), 0
    for c in image.components:
        c.wide, c.high, c.base = across * c.h, down * c.v, base
        c.used_wide, c.used_high = -(-(-(-width * c.h // top_h)) // 8), -(-(-(-height * c.v // top_v)) // 8)
        base += c.wide * c.high
    every = np.concatenate([x for _, _, x in components]).astype(np.int32)
    n = len(components)
    out = [b"\xff\xd8", _chunk(0xDB, b"\0" + quant.tobytes()), _chunk(0xC2, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([c.name, c.h << 4 | c.v, 0]) for c in image.components))]
    out += [_chunk(0xC4, b"\x00" + _DC[0] + b"\x10" + _AC[0] + b"\x11" + _REFINE[0]), _chunk(0xDD, struct.pack(">H", restart))]

    def head(picks: list[int], first: int, last: int, approx: int, table: int) -> bytes:
        return _chunk(0xDA, bytes([len(picks)]) + b"".join(bytes([image.components[k].name, table]) for k in picks) + bytes([first, last, approx]))

    together = list(range(n))
    order, which, per = block_order(image, together)
    out += [head(together, 0, 0, 0x01, 0x00), _joined(_dc_pieces(every[order, 0] >> 1, which, np.arange(len(order)) // (restart * per)))]
    magnitude = np.sign(every) * (np.abs(every) >> 1)
    orders = [block_order(image, [k])[0] for k in together]
    for first, last in ((1, 5), (6, 63)):
        for k in together:
            out += [head([k], first, last, 0x01, 0x00), _ac_scan(magnitude[orders[k], first : last + 1], restart)]
    out += [head(together, 0, 0, 0x10, 0x00), _joined(_pieces(every[order, 0] & 1, np.ones(len(order), np.int64), np.arange(len(order)) // (restart * per)))]
    for k in together:
        out += [head([k], 1, 63, 0x10, 0x01), _refine_scan(every[orders[k], 1:], restart)]
    return b"".join([*out, b"\xff\xd9"])
