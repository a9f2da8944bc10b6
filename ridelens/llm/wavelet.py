"""A wavelet matrix over token ids: access, counting and lookup from one compressed file."""

from __future__ import annotations

import struct
from collections import OrderedDict
from itertools import accumulate

import numpy as np
import zstandard

MAGIC = b"WAVM2"
CHUNK = 1 << 17  # bits that are compressed together
BLOCK = 512  # bits between ranks, within an unpacked chunk
OPEN = 256  # unpacked chunks that a matrix keeps


class Chunk:
    """Some bits of a row, unpacked, with ranks every BLOCK bits."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        ones = np.bitwise_count(packed)
        starts = np.arange(0, max(len(packed), 1), BLOCK // 8)
        sums = np.add.reduceat(ones, starts, dtype=np.int64) if len(ones) else np.zeros(1, np.int64)
        self.before = np.concatenate([[0], np.cumsum(sums)])

    def get(self, i: int) -> int:
        return int(self.packed[i >> 3]) >> (7 - (i & 7)) & 1

    def rank(self, i: int) -> int:
        """Ones before place i."""
        block = i // BLOCK
        part = self.packed[block * BLOCK // 8 : (i + 7) // 8].copy()
        if i & 7:
            part[-1] &= 0xFF << (8 - (i & 7)) & 0xFF
        return int(self.before[block] + np.bitwise_count(part).sum(dtype=np.int64))

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero, which is in here."""
        before = self.before if bit else np.arange(len(self.before)) * BLOCK - self.before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.packed[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])


class Row:
    """A row of bits in compressed chunks, with the ones before each: rank and select unpack one chunk."""

    def __init__(self, n: int, data: memoryview, sizes: tuple[int, ...], before: tuple[int, ...], opened: OrderedDict):
        self.n, self.data, self.before, self.opened = n, data, np.array(before, np.int64), opened
        self.ends = [0, *accumulate(sizes)]

    @staticmethod
    def parts(packed: np.ndarray) -> tuple[bytes, list[int], list[int]]:
        """Chunks one after another, their sizes, and the ones before each chunk and in all."""
        chunks = [packed[i : i + CHUNK // 8] for i in range(0, len(packed), CHUNK // 8)]
        pack = zstandard.ZstdCompressor(level=1).compress
        made = [pack(c.tobytes()) for c in chunks]
        return b"".join(made), [len(m) for m in made], [0, *accumulate(int(np.bitwise_count(c).sum(dtype=np.int64)) for c in chunks)]

    def _unpacked(self, k: int) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[self.ends[k] : self.ends[k + 1]]), np.uint8)

    def chunk(self, k: int) -> Chunk:
        key = (id(self), k)
        if key not in self.opened:
            if len(self.opened) >= OPEN:
                self.opened.popitem(last=False)
            self.opened[key] = Chunk(self._unpacked(k))
        return self.opened[key]

    def get(self, i: int) -> int:
        return self.chunk(i // CHUNK).get(i % CHUNK)

    def rank(self, i: int) -> int:
        """Ones before place i."""
        k = i // CHUNK
        return int(self.before[k]) + (self.chunk(k).rank(i % CHUNK) if i % CHUNK else 0)

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero."""
        before = self.before if bit else np.minimum(np.arange(len(self.before)) * CHUNK, self.n) - self.before
        at = int(np.searchsorted(before, k, side="right")) - 1
        return at * CHUNK + self.chunk(at).select(bit, k - int(before[at]))

    def bits(self) -> np.ndarray:
        packed = [self._unpacked(k) for k in range(len(self.ends) - 1)]
        return np.unpackbits(np.concatenate(packed) if packed else np.zeros(0, np.uint8), count=self.n).view(bool)


class WaveletMatrix:
    """One row of bits for each binary place of the ids, highest first.

    Each row is in the order of the one before, with its zeros moved before its ones.
    """

    def __init__(self, rows: list[Row], n: int):
        self.rows, self.n = rows, n
        self.zeros = [n - int(r.before[-1]) for r in rows]

    @staticmethod
    def pack(ids: np.ndarray, width: int) -> bytes:
        """The file of ids below 2**width: length, width, then of each row the sizes of its chunks and the ones before each, then the chunks."""
        if len(ids) and int(ids.max()) >> width:
            raise ValueError(f"an id does not fit {width} bits")
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        heads, rows = [], []
        for place in range(width - 1, -1, -1):
            bits = (ids & ids.dtype.type(1 << place)).astype(bool)
            data, sizes, before = Row.parts(np.packbits(bits))
            heads.append(struct.pack(f"<{len(sizes)}I{len(before)}Q", *sizes, *before))
            rows.append(data)
            ids = np.concatenate([ids[~bits], ids[bits]])
        return b"".join([MAGIC, struct.pack("<QB", len(ids), width), *heads, *rows])

    @staticmethod
    def from_bytes(data: bytes) -> WaveletMatrix:
        """Reads the directory only; chunks are unpacked where they are looked at."""
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, width = struct.unpack_from("<QB", data, len(MAGIC))
        at, chunks = len(MAGIC) + 9, -(-n // CHUNK)
        heads = []
        for _ in range(width):
            head = struct.unpack_from(f"<{chunks}I{chunks + 1}Q", data, at)
            heads.append((head[:chunks], head[chunks:]))
            at += 4 * chunks + 8 * (chunks + 1)
        rows, opened = [], OrderedDict()
        for sizes, before in heads:
            rows.append(Row(n, memoryview(data)[at : at + sum(sizes)], sizes, before, opened))
            at += sum(sizes)
        return WaveletMatrix(rows, n)

    def access(self, i: int) -> int:
        """The id at a place."""
        value = 0
        for row, zeros in zip(self.rows, self.zeros, strict=True):
            bit, ones = row.get(i), row.rank(i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def count(self, value: int, end: int | None = None) -> int:
        """How often an id occurs before a place."""
        first, last = self._range(value, self.n if end is None else end)
        return last - first

    def _range(self, value: int, end: int) -> tuple[int, int]:
        first, last = 0, end
        for level, (row, zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            a, b = row.rank(first), row.rank(last)
            bit = value >> (len(self.rows) - 1 - level) & 1
            first, last = (zeros + a, zeros + b) if bit else (first - a, last - b)
        return first, last

    def find(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id; -1 if there are fewer."""
        first, last = self._range(value, self.n)
        if first + k >= last:
            return -1
        i = first + k
        for level in range(len(self.rows) - 1, -1, -1):
            bit = value >> (len(self.rows) - 1 - level) & 1
            i = self.rows[level].select(1, i - self.zeros[level]) if bit else self.rows[level].select(0, i)
        return i

    def all(self) -> np.ndarray:
        """Every id in order: rows are undone from the last to the first."""
        kind = np.uint16 if len(self.rows) <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for place, (row, zeros) in enumerate(zip(reversed(self.rows), reversed(self.zeros), strict=True)):
            bits = row.bits()
            earlier = np.empty_like(values)
            earlier[~bits] = values[:zeros]
            earlier[bits] = values[zeros:] | kind(1 << place)
            values = earlier
        return values
