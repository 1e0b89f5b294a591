"""Wavelet matrix files: the token ids of a shard as bit planes with rank and select, and its documents.

Plane 0 holds the highest bit of every id in order; each next plane holds the next bit after the ids have been put in the
order zeros before ones, stably, by the bit before. A plane is cut into blocks of 4,096 bytes, each stored constant, raw or
compressed on its own, and a directory gives every block's place and the ones before it. Looking up one id, counting one
or finding its occurrences therefore reads some blocks of each plane, never the whole file.

Layout: magic, blocks, the documents (an Arrow stream, compressed), the directories, a JSON footer, its length as
four bytes, magic. A file with no ids has no blocks.
"""

from __future__ import annotations

import io
import json
import struct
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard

MAGIC = b"WVMATRX1"
#: Bits of a block.
BLOCK = 1 << 15
_BYTES = BLOCK // 8
_ZEROS, _ONES, _RAW, _PACKED = range(4)
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def levels_for(largest: int) -> int:
    return max(1, int(largest).bit_length())


def _narrow(levels: int) -> type:
    return np.uint16 if levels <= 16 else np.uint32


def write(file: BinaryIO, ids: np.ndarray, levels: int, documents: pa.RecordBatch) -> int:
    """Write one shard; returns the file's size."""
    pack = zstandard.ZstdCompressor(level=1).compress
    at = file.write(MAGIC)
    zeros, kinds, sizes, ones = [], [], [], []
    now = np.ascontiguousarray(ids, _narrow(levels))
    if len(now) and int(now.max()) >> levels:
        raise ValueError(f"ids need more than {levels} bits")
    for level in range(levels - 1, -1, -1):
        bits = (now >> level & 1).astype(bool)
        plane = np.packbits(bits)
        now = np.concatenate([now[~bits], now[bits]])
        zeros.append(len(bits) - int(np.count_nonzero(bits)))
        for start in range(0, len(plane), _BYTES):
            block = plane[start : start + _BYTES]
            held = int(_POPCOUNT[block].sum())
            ones.append(held)
            data = b""
            if held == 0:
                kind = _ZEROS
            elif held == min(BLOCK, len(bits) - start * 8):
                kind = _ONES
            else:
                data, kind = pack(block.tobytes()), _PACKED
                if len(data) >= len(block):
                    data, kind = block.tobytes(), _RAW
            kinds.append(kind)
            sizes.append(len(data))
            at += file.write(data)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, documents.schema) as stream:
        stream.write_batch(documents)
    parts = {
        "documents": sink.getvalue(),
        "kinds": np.array(kinds, np.uint8).tobytes(),
        "sizes": np.array(sizes, "<u4").tobytes(),
        "ones": np.array(ones, "<u4").tobytes(),
    }
    places = {}
    for name, data in parts.items():
        packed = pack(data)
        places[name] = [at, len(packed)]
        at += file.write(packed)
    footer = json.dumps({"length": len(ids), "levels": levels, "block": BLOCK, "zeros": zeros, "parts": places}).encode()
    return at + file.write(footer) + file.write(struct.pack("<I", len(footer))) + file.write(MAGIC)


class Wavelet:
    """A shard's ids, read from a seekable file block by block."""

    def __init__(self, file: BinaryIO):
        self._file, self._unpack = file, zstandard.ZstdDecompressor().decompress
        end = file.seek(0, io.SEEK_END)
        tail = self._read(max(0, end - 12), 12)
        if len(tail) < 12 or tail[4:] != MAGIC:
            raise ValueError("no wavelet matrix file")
        size = struct.unpack("<I", tail[:4])[0]
        footer = json.loads(self._read(end - 12 - size, size))
        if footer["block"] != BLOCK:
            raise ValueError(f"blocks of {footer['block']} bits")
        self.length, self.levels, self.zeros, self._parts = footer["length"], footer["levels"], footer["zeros"], footer["parts"]
        self._kinds = np.frombuffer(self._part("kinds"), np.uint8)
        self._sizes = np.frombuffer(self._part("sizes"), "<u4").astype(np.int64)
        self._places = len(MAGIC) + np.cumsum(self._sizes) - self._sizes
        ones = np.frombuffer(self._part("ones"), "<u4").astype(np.int64).reshape(self.levels, -1)
        #: Ones of a plane before each of its blocks, and in all of it.
        self._before = np.concatenate([np.zeros((self.levels, 1), np.int64), np.cumsum(ones, axis=1)], axis=1)
        self.blocks_read = 0

    def __len__(self) -> int:
        return self.length

    def _read(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def _part(self, name: str) -> bytes:
        return self._unpack(self._read(*self._parts[name]))

    def documents(self) -> pa.RecordBatch:
        return pa.ipc.open_stream(self._part("documents")).read_next_batch()

    def _bits(self, level: int, block: int) -> np.ndarray:
        """The bits of one block, as zeros and ones."""
        held = min(BLOCK, self.length - block * BLOCK)
        at = level * (self._before.shape[1] - 1) + block
        kind = self._kinds[at]
        if kind in (_ZEROS, _ONES):
            return np.full(held, kind == _ONES, np.uint8)
        self.blocks_read += 1
        data = self._read(int(self._places[at]), int(self._sizes[at]))
        return np.unpackbits(np.frombuffer(data if kind == _RAW else self._unpack(data), np.uint8), count=held)

    def _ranks(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place (up to the length) the ones before it, and its bit (0 at the length)."""
        ones, bits = np.empty(len(places), np.int64), np.zeros(len(places), np.uint8)
        blocks = places // BLOCK
        for block in np.unique(blocks):
            rows = np.flatnonzero(blocks == block)
            if block * BLOCK >= self.length:
                ones[rows] = self._before[level, -1]
                continue
            held = self._bits(level, int(block))
            sums = np.concatenate([[0], np.cumsum(held, dtype=np.int64)])
            inside = places[rows] - block * BLOCK
            ones[rows] = self._before[level, block] + sums[inside]
            bits[rows] = np.append(held, 0)[inside]
        return ones, bits

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places``."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= self.length):
            raise IndexError("place outside the shard")
        ids = np.zeros(len(places), np.uint32)
        for level in range(self.levels):
            ones, bits = self._ranks(level, places)
            ids = ids << 1 | bits
            places = np.where(bits == 1, self.zeros[level] + ones, places - ones)
        return ids

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` before place ``stop`` lie after the last plane."""
        edges = np.array([0, stop], np.int64)
        for level in range(self.levels):
            ones, _ = self._ranks(level, edges)
            edges = self.zeros[level] + ones if token >> (self.levels - 1 - level) & 1 else edges - ones
        return int(edges[0]), int(edges[1])

    def rank(self, token: int, stop: int | None = None) -> int:
        """How often ``token`` occurs before place ``stop``, or at all."""
        stop = self.length if stop is None else stop
        if not 0 <= stop <= self.length:
            raise IndexError("place outside the shard")
        if token < 0 or token >> self.levels:
            return 0
        first, last = self._range(token, stop)
        return last - first

    def select(self, token: int, numbers: np.ndarray) -> np.ndarray:
        """The places of the occurrences of ``token`` with the given numbers, from 0."""
        numbers = np.asarray(numbers, np.int64)
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= self.rank(token)):
            raise IndexError("no such occurrence")
        if not len(numbers):
            return numbers
        places = self._range(token, self.length)[0] + numbers
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            before = self._before[level]
            if bit:
                places = places - self.zeros[level]
            else:
                before = np.minimum(np.arange(len(before)) * BLOCK, self.length) - before
            blocks = np.searchsorted(before, places, side="right") - 1
            up = np.empty(len(places), np.int64)
            for block in np.unique(blocks):
                rows = np.flatnonzero(blocks == block)
                same = np.flatnonzero(self._bits(level, int(block)) == bit)
                up[rows] = block * BLOCK + same[places[rows] - before[block]]
            places = up
        return places

    def occurrences(self, token: int) -> np.ndarray:
        """All places of ``token``, ascending."""
        return self.select(token, np.arange(self.rank(token)))

    def ids(self) -> np.ndarray:
        """All ids, by putting the planes' order back from the last to the first."""
        now = np.zeros(self.length, _narrow(self.levels))
        for level in range(self.levels - 1, -1, -1):
            blocks = [self._bits(level, b) for b in range(self._before.shape[1] - 1)]
            bits = np.concatenate([np.zeros(0, np.uint8), *blocks]).view(bool)
            back = np.empty_like(now)
            back[~bits] = now[: self.zeros[level]]
            back[bits] = now[self.zeros[level] :] | now.dtype.type(1 << (self.levels - 1 - level))
            now = back
        return now
