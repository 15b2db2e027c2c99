"""Baseline JPEG (sequential, Huffman, 8 bits) to samples, by the standard's decoding process.

For pixel data inside other files.  Gives one plane for each component, at
full size; chroma is enlarged by repeating samples.
"""

from __future__ import annotations

import struct

import numpy as np


class JpegError(ValueError):
    pass


def _zigzag() -> np.ndarray:
    """Place in an 8 x 8 block of each coefficient in file order: diagonals, in turns up and down."""
    cells = [(x, y) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (sum(c), c[1] if sum(c) % 2 else c[0]))
    return np.array([y * 8 + x for x, y in cells])


ZIGZAG = _zigzag()
#: Rows: the cosine of each frequency at the eight samples, scaled for an orthonormal transform.
COSINES = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        # all 16-bit prefixes: (symbol, length)
        self.table: list[tuple[int, int] | None] = [None] * 65536
        for (length, value), symbol in self.codes.items():
            low = value << (16 - length)
            self.table[low : low + (1 << (16 - length))] = [(symbol, length)] * (1 << (16 - length))


class Bits:
    """Bits of an entropy-coded segment without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            if self.at > len(self.data) + 8:
                raise JpegError("the scan is cut off")
            self.at += 1
            self.held = (self.held << 8 | byte) & 0xFFFFFFFFFF
            self.count += 8

    def symbol(self, table: Huffman) -> int:
        self.need(16)
        found = table.table[self.held >> (self.count - 16) & 0xFFFF]
        if found is None:
            raise JpegError("no such code")
        self.count -= found[1]
        return found[0]

    def number(self, size: int) -> int:
        """A signed value of the given size category."""
        if not size:
            return 0
        self.need(size)
        self.count -= size
        value = self.held >> self.count & ((1 << size) - 1)
        return value if value >> (size - 1) else value - (1 << size) + 1


def decode(data: bytes) -> np.ndarray:
    """(components, rows, columns) of 8-bit samples."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at, quant, dc, ac, frame, restart = 2, {}, {}, {}, None, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                count = 128 if wide else 64
                quant[number] = np.frombuffer(body[1 : 1 + count], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + count :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = Huffman(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xC0:
            depth, rows, columns, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not rows or not columns:
                raise JpegError("only images of 8 bits and a known size")
            frame = rows, columns, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise JpegError("not a baseline image")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None:
                raise JpegError("a scan without a frame")
            tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            if len(tables) != len(frame[2]):
                raise JpegError("components in several scans")
            return _scan(data[at:], frame, tables, quant, dc, ac, restart)
    raise JpegError("no scan")


def _scan(data: bytes, frame, tables, quant, dc, ac, restart: int) -> np.ndarray:
    rows, columns, components = frame
    across, down = max(c[1] for c in components), max(c[2] for c in components)
    if len(components) == 1:  # a single component is not interleaved
        components = [(components[0][0], 1, 1, components[0][3])]
        across = down = 1
    wide, high = -(-columns // (8 * across)), -(-rows // (8 * down))
    pieces = _segments(data)
    blocks = {c[0]: np.zeros((high * c[2], wide * c[1], 64)) for c in components}
    last, bits, piece = dict.fromkeys(blocks, 0), Bits(pieces[0]), 0
    for unit in range(wide * high):
        if restart and unit and unit % restart == 0:
            piece += 1
            if piece >= len(pieces):
                raise JpegError("the scan is cut off")
            bits, last = Bits(pieces[piece]), dict.fromkeys(blocks, 0)
        for name, h, v, _ in components:
            d, a = dc[tables[name][0]], ac[tables[name][1]]
            for j in range(v):
                for i in range(h):
                    block = blocks[name][unit // wide * v + j, unit % wide * h + i]
                    last[name] += bits.number(bits.symbol(d))
                    block[0] = last[name]
                    k = 1
                    while k < 64:
                        code = bits.symbol(a)
                        run, size = code >> 4, code & 15
                        if not size:
                            if run != 15:
                                break
                            k += 16
                            continue
                        k += run
                        if k > 63:
                            raise JpegError("too many coefficients")
                        block[k] = bits.number(size)
                        k += 1
    out = np.zeros((len(components), rows, columns), np.uint8)
    for n, (name, h, v, table) in enumerate(components):
        grid = np.zeros_like(blocks[name])
        grid[..., ZIGZAG] = blocks[name] * quant[table]
        square = grid.reshape(*grid.shape[:2], 8, 8)
        samples = np.einsum("kn,yxkl,lm->yxnm", COSINES, square, COSINES)
        plane = samples.transpose(0, 2, 1, 3).reshape(grid.shape[0] * 8, grid.shape[1] * 8)
        plane = np.clip(np.floor(plane + 128.5), 0, 255).astype(np.uint8)
        out[n] = plane.repeat(down // v, axis=0).repeat(across // h, axis=1)[:rows, :columns]
    return out


def _segments(data: bytes) -> list[bytes]:
    """The parts of a scan between restart markers."""
    out, begin, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[begin:]]
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[begin:at])
            begin = at = at + 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            return [*out, data[begin:at]]
