"""A wavelet matrix of token ids in one compressed file, with rank and select.

Layout: blocks of bit-planes, highest bit first, each block of ``BLOCK`` bits compressed on its own;
then a directory (place and size of each block, ones before it, zeros of each plane, the
documents of the shard); then the directory's length and a magic word. A reader fetches the
directory and afterwards only the blocks that an access needs.

Nulls and edges: a document id may be None; a shard without ids has empty planes (every count is 0); a position or
occurrence that does not exist is an IndexError; a token beyond the bit-planes counts 0; a file of another kind is a ValueError.
"""

from __future__ import annotations

import io
import json
from collections import OrderedDict

import numpy as np
import zstandard

MAGIC = b"FGWAVE01"
BLOCK = 1 << 18
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def build(ids: np.ndarray, doc_ids: list[int | None], doc_tokens: list[int], bits: int = 16) -> bytes:
    """The file's bytes for the ids of one shard and its documents in order."""
    out, places, ones = io.BytesIO(), [], []
    zeros, left = [], np.asarray(ids).astype(np.uint16 if bits <= 16 else np.uint32)
    press = zstandard.ZstdCompressor(level=1)
    for plane in range(bits - 1, -1, -1):
        on = (left & left.dtype.type(1 << plane)) != 0
        packed, before = np.packbits(on, bitorder="little"), 0
        for at in range(0, len(packed), BLOCK // 8):
            raw = packed[at : at + BLOCK // 8].tobytes()
            small = press.compress(raw)
            kept = small if len(small) < len(raw) else raw
            places += [(out.tell(), len(kept), int(kept is raw))]
            ones.append(before)
            before += int(_POP[packed[at : at + BLOCK // 8]].sum())
            out.write(kept)
        zeros.append(len(left) - before)
        left = np.concatenate([np.compress(~on, left), np.compress(on, left)])
    tables = [np.array(places, dtype="<u8").reshape(-1, 3), np.array(ones, dtype="<u8"), np.array([x or 0 for x in doc_ids], dtype="<i8"), np.array([x is None for x in doc_ids], dtype="u1"), np.array(doc_tokens, dtype="<u8")]
    head = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "tables": [[t.dtype.str, list(t.shape)] for t in tables]}).encode()
    directory = press.compress(len(head).to_bytes(8, "little") + head + b"".join(t.tobytes() for t in tables))
    out.write(directory + len(directory).to_bytes(8, "little") + MAGIC)
    return out.getvalue()


class WaveletFile:
    """Reads a file made by :func:`build`; ``source`` is any seekable binary file."""

    def __init__(self, source, cached_blocks: int = 64):
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a wavelet file")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - length)
        raw = zstandard.ZstdDecompressor().decompress(source.read(length))
        at = 8 + int.from_bytes(raw[:8], "little")
        meta = json.loads(raw[8:at])
        self.n, self.bits, self.zeros, tables = meta["n"], meta["bits"], meta["zeros"], []
        for kind, shape in meta["tables"]:
            count = int(np.prod(shape))
            tables.append(np.frombuffer(raw, dtype=kind, count=count, offset=at).reshape(shape))
            at += count * np.dtype(kind).itemsize
        self.places, self.ones, ids, null, self.doc_tokens = tables
        self.doc_ids = [None if gone else int(x) for x, gone in zip(ids, null)]
        self.blocks = -(-self.n // BLOCK)
        self._kept, self._most, self._unpress = OrderedDict(), cached_blocks, zstandard.ZstdDecompressor()

    def _block(self, plane: int, k: int) -> np.ndarray:
        """Packed bits of block ``k`` of a plane (0 is the highest bit)."""
        key = plane * self.blocks + k
        if key not in self._kept:
            place, size, raw = (int(x) for x in self.places[key])
            self.source.seek(place)
            data = self.source.read(size)
            self._kept[key] = np.frombuffer(data if raw else self._unpress.decompress(data, max_output_size=BLOCK // 8), dtype=np.uint8)
            if len(self._kept) > self._most:
                self._kept.popitem(last=False)
        return self._kept[key]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        k, rest = divmod(i, BLOCK)
        bits = self._block(plane, k)
        whole, odd = divmod(rest, 8)
        return int(self.ones[plane * self.blocks + k]) + int(_POP[bits[:whole]].sum()) + (int(_POP[bits[whole] & ((1 << odd) - 1)]) if odd else 0)

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            k, rest = divmod(i, BLOCK)
            bit = int(self._block(plane, k)[rest // 8]) >> rest % 8 & 1
            one = self._rank1(plane, i)
            value, i = value << 1 | bit, self.zeros[plane] + one if bit else i - one
        return value

    def _narrow(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for plane in range(self.bits):
            a, b = self._rank1(plane, lo), self._rank1(plane, hi)
            lo, hi = (self.zeros[plane] + a, self.zeros[plane] + b) if token >> (self.bits - 1 - plane) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands among the first ``i`` ids."""
        if not 0 <= token < 1 << self.bits:
            return 0
        lo, hi = self._narrow(token, 0, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._narrow(token, 0, self.n)[0] + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select_bit(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        starts = self.ones[plane * self.blocks : (plane + 1) * self.blocks].astype(np.int64)
        if not bit:
            starts = np.arange(self.blocks, dtype=np.int64) * BLOCK - starts
        block = int(np.searchsorted(starts, k, side="right")) - 1
        bits = np.unpackbits(self._block(plane, block), bitorder="little")[: min(BLOCK, self.n - block * BLOCK)]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(starts[block])])

    def locate(self, token: int) -> list[int]:
        """All positions of ``token``, ascending."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest."""
        values = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            packed = [self._block(plane, k) for k in range(self.blocks)]
            on = np.unpackbits(np.concatenate(packed), bitorder="little")[: self.n].astype(bool) if packed else np.zeros(0, bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~on)] = values[: self.zeros[plane]]
            above[np.flatnonzero(on)] = values[self.zeros[plane] :] | values.dtype.type(1 << (self.bits - 1 - plane))
            values = above
        return values.astype(np.uint32)
