"""Progressive JPEG in numpy: a reader for any Huffman-coded progressive file of 8-bit samples, and
a writer that keeps bytes as quantised coefficients, which JPEG stores without loss.

The reader adds spectral-selection and successive-approximation scans up in one coefficient array,
transforms it back, and upsamples chroma to full resolution. Parts of a scan in which one code of
one bit repeats, and refinements of whole runs of blocks, are read by array operations; all else
bit by bit. Both ways give the same coefficients.

Components are taken as Y, Cb and Cr: files in other colour spaces (CMYK, or RGB by an application
marker) give values but not their colours. A header that claims more blocks than the file has bits
is an error, found before memory is taken for them.

The writer puts 192 bytes into one 8x8 place of three components. A block's first byte is its DC
coefficient (0 to 255); each other byte is the magnitude code of a coefficient of eight bits, so
values of 128 and more stand for themselves and smaller ones for themselves less 255.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

MAX_BLOCKS = 8191  # of 8 samples, in a file's longest side


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: along anti-diagonals, turning."""
    cells = [(i, j) for i in range(8) for j in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


@lru_cache(maxsize=1)
def inverse_dct() -> np.ndarray:
    """64 zigzag coefficients times this matrix are 64 samples, row by row."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.kron(c, c)[zigzag()].astype(np.float32)


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    first: int = 0  # of its blocks in the coefficient array
    wide: int = 0  # blocks in a row, whole MCUs
    tall: int = 0
    used_wide: int = 0  # blocks in a row of a scan of its own
    used_tall: int = 0


@dataclass
class Huffman:
    codes: dict[tuple[int, int], int]  # (length, code) -> symbol

    @property
    def zero(self) -> int | None:
        """The symbol of the one-bit code 0."""
        return self.codes.get((1, 0))


def huffman(counts: bytes, symbols: bytes) -> Huffman:
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return Huffman(codes)


class Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        x = 0
        for b in self.bits[self.at : self.at + n].tolist():
            x = 2 * x + b
        self.at += n
        return x

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = 2 * code + int(self.bits[self.at])
            self.at += 1
            if (s := table.codes.get((length, code))) is not None:
                return s
        raise ValueError("no such code")

    def many(self, n: int) -> np.ndarray:
        self.at += n
        return self.bits[self.at - n : self.at]


def signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


@dataclass
class Image:
    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at full resolution, chroma upsampled by repetition."""
        out, hm, vm = [], max(c.h for c in self.parts), max(c.v for c in self.parts)
        for c in self.parts:
            block = (self.coef[c.first : c.first + c.wide * c.tall] * self.quant[c.table]).astype(np.float32) @ inverse_dct()
            s = np.clip(np.rint(block + 128), 0, 255).astype(np.uint8)
            s = s.reshape(c.tall, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.tall, 8 * c.wide)
            if (vm, hm) != (c.v, c.h):
                s = s.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
            out.append(s[: self.height, : self.width])
        return out

    def rgb(self) -> np.ndarray:
        """(height, width, 3) of 8 bits."""
        planes = self.planes()
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2)
        y, cb, cr = (p.astype(np.float32) for p in planes)
        cb, cr = cb - 128, cr - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.image = data, Image()
        self.tables: dict[tuple[int, int], Huffman] = {}
        self.restart = 0

    def read(self) -> Image:
        data, at = self.data, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker = data[at + 1]
            if marker == 0xD9:
                return self.image
            size = data[at + 2] << 8 | data[at + 3]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC2:
                self.frame(body)
            elif marker == 0xC4:
                self.huffman_tables(body)
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.image.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                at = self.scan(body, at)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not a progressive Huffman-coded file")

    def frame(self, body: bytes) -> None:
        precision, height, width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8:
            raise ValueError("not 8-bit samples")
        im = self.image
        im.height, im.width = height, width
        im.parts = [Component(i, hv >> 4, hv & 15, t) for i, hv, t in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
        hm, vm = max(c.h for c in im.parts), max(c.v for c in im.parts)
        self.across, self.down = -(-width // (8 * hm)), -(-height // (8 * vm))
        first = 0
        for c in im.parts:
            c.first, c.wide, c.tall = first, self.across * c.h, self.down * c.v
            c.used_wide, c.used_tall = -(-width * c.h // (8 * hm)), -(-height * c.v // (8 * vm))
            first += c.wide * c.tall
        if first > 8 * len(self.data):  # each block takes a bit of the first scan at least
            raise ValueError("more blocks than the file can hold")
        im.coef = np.zeros((first, 64), np.int32)

    def huffman_tables(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.tables[body[0] >> 4, body[0] & 15] = huffman(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def order(self, parts: list[Component]) -> tuple[np.ndarray, np.ndarray, int]:
        """Blocks in the scan's order, the component of each, and blocks in an MCU."""
        if len(parts) == 1:
            c = parts[0]
            rows = c.first + np.arange(c.used_tall)[:, None] * c.wide + np.arange(c.used_wide)
            return rows.ravel(), np.zeros(rows.size, int), 1
        y, x = np.arange(self.down)[:, None, None], np.arange(self.across)[None, :, None]
        at, of = [], []
        for k, c in enumerate(parts):
            dy, dx = (d.ravel() for d in np.divmod(np.arange(c.h * c.v), c.h))
            at.append(c.first + (y * c.v + dy) * c.wide + x * c.h + dx)
            of += [k] * (c.h * c.v)
        blocks = np.concatenate(at, axis=2)
        return blocks.ravel(), np.tile(of, self.across * self.down), len(of)

    def scan(self, body: bytes, at: int) -> int:
        n = body[0]
        by_id = {c.id: c for c in self.image.parts}
        parts = [by_id[body[1 + 2 * i]] for i in range(n)]
        used = [body[2 + 2 * i] for i in range(n)]
        low, high, bits = body[1 + 2 * n : 4 + 2 * n]
        before, shift = bits >> 4, bits & 15
        pieces, start, end = [], at, at
        while True:
            end = self.data.index(b"\xff", end)
            follow = self.data[end + 1]
            if follow == 0:
                end += 2
            elif 0xD0 <= follow <= 0xD7:
                pieces.append(self.data[start:end])
                start = end = end + 2
            else:
                pieces.append(self.data[start:end])
                break
        blocks, of, each = self.order(parts)
        step = self.restart * each if self.restart else len(blocks)
        for i, piece in enumerate(pieces):
            b, o, r = blocks[i * step : (i + 1) * step], of[i * step : (i + 1) * step], Bits(piece)
            if not len(b):
                continue
            if low == 0:
                if before:
                    self.image.coef[b, 0] |= r.many(len(b)).astype(np.int32) << shift
                else:
                    self.dc_first(r, b, o, [self.tables[0, u >> 4] for u in used], shift)
            elif before:
                self.ac_refine(r, b, low, high, self.tables[1, used[0] & 15], shift)
            else:
                self.ac_first(r, b, low, high, self.tables[1, used[0] & 15], shift)
        return end

    def dc_first(self, r: Bits, blocks: np.ndarray, of: np.ndarray, tables: list[Huffman], shift: int) -> None:
        if all(t.zero == 0 for t in tables) and len(r.bits) >= len(blocks) and not r.bits[: len(blocks)].any():
            return  # each difference is 0
        last = [0] * len(tables)
        for b, k in zip(blocks.tolist(), of.tolist(), strict=True):
            size = r.symbol(tables[k])
            last[k] += signed(r.take(size), size)
            self.image.coef[b, 0] = last[k] << shift

    def ac_first(self, r: Bits, blocks: np.ndarray, low: int, high: int, table: Huffman, shift: int) -> None:
        band, coef = high - low + 1, self.image.coef
        if table.zero and table.zero < 8:
            size = table.zero
            need = len(blocks) * band
            if len(r.bits) >= need * (1 + size):
                codes = r.bits[: need * (1 + size)].reshape(need, 1 + size)
                if not codes[:, 0].any():  # the one-bit code all along: a value of `size` bits each
                    v = (np.packbits(codes, axis=1).ravel() >> (7 - size)).astype(np.int32)
                    v = np.where(codes[:, 1] == 1, v, v - (1 << size) + 1)
                    coef[blocks, low : high + 1] = (v << shift).reshape(-1, band)
                    return
        run = 0
        for b in blocks.tolist():
            if run:
                run -= 1
                continue
            k = low
            while k <= high:
                zeros, size = divmod(r.symbol(table), 16)
                if size:
                    k += zeros
                    coef[b, k] = signed(r.take(size), size) << shift
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) + r.take(zeros) - 1
                    break

    def ac_refine(self, r: Bits, blocks: np.ndarray, low: int, high: int, table: Huffman, shift: int) -> None:
        coef, one = self.image.coef, 1 << shift

        def correct(rows: np.ndarray, start: int) -> None:
            part = coef[rows, start : high + 1]
            old = part != 0
            part[old] += np.where(part[old] > 0, one, -one) * r.many(int(old.sum())).astype(np.int32)
            coef[rows, start : high + 1] = part

        i = 0
        while i < len(blocks):
            b, k, run = blocks[i], low, 0
            while k <= high:
                zeros, size = divmod(r.symbol(table), 16)
                if not size and zeros < 15:
                    run = (1 << zeros) + r.take(zeros)
                    break
                new = (one if r.take(1) else -one) if size else 0
                while k <= high:
                    if coef[b, k]:
                        if r.take(1):
                            coef[b, k] += one if coef[b, k] > 0 else -one
                    elif zeros == 0:
                        if new:
                            coef[b, k] = new
                        k += 1
                        break
                    else:
                        zeros -= 1
                    k += 1
            if run:
                if k > low:
                    correct(blocks[i : i + 1], k)
                    correct(blocks[i + 1 : i + run], low)
                else:
                    correct(blocks[i : i + run], low)
                i += run
            else:
                i += 1


def read(data: bytes) -> Image:
    return Reader(data).read()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, 2 + len(body)) + body


def scan_header(parts: list[int], tables: int, low: int, high: int, before: int, shift: int) -> bytes:
    return segment(0xDA, bytes([len(parts), *(x for p in parts for x in (p, tables)), low, high, before << 4 | shift]))


def stuffed(bits: np.ndarray) -> bytes:
    """Packed bits, filled up with ones, with a zero byte after each byte of ones."""
    fill = np.ones(-len(bits) % 8, np.uint8)
    return np.packbits(np.concatenate([bits, fill])).tobytes().replace(b"\xff", b"\xff\x00")


@lru_cache(maxsize=1)
def fixed_head() -> bytes:
    """Start, quantisation by one, and the Huffman tables: DC 0 has size 0 as its one-bit code, AC 0
    a value of 7 bits; AC 1 has the ends of runs of up to 2**15 - 1 blocks, in four bits each."""
    one = bytes([1, *[0] * 15])
    ends = bytes([0, 0, 0, 15, *[0] * 12]) + bytes(range(0, 0xF0, 16))
    return b"\xff\xd8" + segment(0xDB, bytes([0, *[1] * 64])) + segment(0xC4, b"\x00" + one + b"\x00" + b"\x10" + one + b"\x07" + b"\x11" + ends)


def write_bytes(payload: bytes) -> bytes:
    """A progressive file of three full-resolution components that holds the payload, whose length
    is a positive multiple of 192."""
    n, rest = divmod(len(payload), 192)
    if rest or not n:
        raise ValueError("a positive multiple of 192 bytes is needed")
    wide = min(n, MAX_BLOCKS)
    tall = -(-n // wide)
    p = np.frombuffer(payload, np.uint8)
    if wide * tall > n:
        p = np.concatenate([p, np.zeros(192 * (wide * tall - n), np.uint8)])
    p = p.reshape(-1, 3, 64)
    m = len(p)
    out = [fixed_head(), segment(0xC2, struct.pack(">BHHB", 8, 8 * tall, 8 * wide, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))]
    out += [scan_header([1, 2, 3], 0x00, 0, 0, 0, 8), stuffed(np.zeros(3 * m, np.uint8))]
    dc = np.unpackbits(p[:, :, 0].reshape(-1, 1), axis=1)
    for shift in range(7, -1, -1):
        out += [scan_header([1, 2, 3], 0x00, 0, 0, shift + 1, shift), stuffed(dc[:, 7 - shift])]
    for c in range(3):
        out += [scan_header([c + 1], 0x00, 1, 63, 0, 1), (p[:, c, 1:] >> 1).tobytes()]
    for c in range(3):
        b = p[:, c, 1:]
        lowest = (b & 1) ^ (b < 128)
        bits = []
        for i in range(0, m, 32767):
            run = min(32767, m - i)
            e = run.bit_length() - 1
            head = [int(x) for x in f"{e:04b}" + (f"{run - (1 << e):0{e}b}" if e else "")]
            bits += [np.array(head, np.uint8), lowest[i : i + run].ravel()]
        out += [scan_header([c + 1], 0x01, 1, 63, 1, 0), stuffed(np.concatenate(bits))]
    return b"".join(out) + b"\xff\xd9"


def payload_of(image: Image, size: int) -> bytes:
    """The bytes that `write_bytes` stored."""
    c = image.coef.reshape(3, -1, 64)
    c = np.where(c < 0, c + 255, c)
    return c.transpose(1, 0, 2).astype(np.uint8).tobytes()[:size]
