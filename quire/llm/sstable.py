"""Sorted-string-table shards: prefix-compressed blocks, a sparse index, a Bloom filter and a footer.

Layout of a shard, all integers little-endian::

    block*  entries: varint shared, varint unshared, varint value length,
            unshared key bytes, value; then the restart offsets (u32 each),
            their number (u32) and a CRC-32 of all before it (u32)
    index   per block: u16 key length, last key, u64 offset, u32 length
    bloom   u32 number of probes, then the bits
    footer  u64 x 7: index offset and length, bloom offset and length, entries,
            sum of weights, value width; then the magic
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import xxhash

MAGIC = b"QUIRESST"
FOOTER = struct.Struct("<7Q8s")
RESTART_EVERY = 16
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY = 10
BLOOM_PROBES = 7


def id_key(value: int | None) -> bytes:
    """A key whose byte order is the order of ids, null first."""
    return b"\0" if value is None else b"\1" + (int(value) + (1 << 63)).to_bytes(8, "big")


def key_id(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append((n & 0x7F) | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _probes(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    step = (hashes >> np.uint64(17)) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Writes a shard to a binary stream; keys come in order, and may repeat."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.entries = self.weight = 0
        self.block, self.restarts, self.in_block = bytearray(), [], 0
        self.last = b""
        self.index: list[bytes] = []
        self.hashes: list[int] = []

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must come in order")
        if self.in_block % RESTART_EVERY == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = next((k for k, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.entries += 1
        self.weight += len(value) // self.width
        self.last = key
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= self.block_bytes:
            self._end_block()

    def _end_block(self) -> None:
        if self.in_block:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            body += struct.pack("<I", zlib.crc32(body))
            self.out.write(body)
            self.index.append(struct.pack("<H", len(self.last)) + self.last + struct.pack("<QI", self.at, len(body)))
            self.at += len(body)
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> None:
        self._end_block()
        index = b"".join(self.index)
        bits = max(64, -(-BLOOM_BITS_PER_KEY * len(self.hashes) // 8) * 8)
        bloom = np.zeros(bits, bool)
        if self.hashes:
            bloom[_probes(np.array(self.hashes, np.uint64), bits, BLOOM_PROBES).ravel().astype(np.int64)] = True
        packed = struct.pack("<I", BLOOM_PROBES) + np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.entries, self.weight, self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable binary file; of it, only footer, index and filter stay in memory."""

    def __init__(self, file, size: int):
        self.file = file
        footer = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if footer[-1] != MAGIC:
            raise ValueError("not a shard, or not whole")
        index_at, index_len, bloom_at, bloom_len, self.entries, self.weight, self.width = footer[:-1]
        self.last_keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        index, at = self._at(index_at, index_len), 0
        while at < len(index):
            (n,) = struct.unpack_from("<H", index, at)
            self.last_keys.append(index[at + 2 : at + 2 + n])
            self.places.append(struct.unpack_from("<QI", index, at + 2 + n))
            at += n + 14
        bloom = self._at(bloom_at, bloom_len)
        (self.probes,) = struct.unpack_from("<I", bloom)
        self.bloom = np.frombuffer(bloom, np.uint8, offset=4)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("the shard is cut short")
        return data

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        data = self._at(*self.places[k])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        (n,) = struct.unpack_from("<I", data, len(data) - 8)
        end = len(data) - 8 - 4 * n
        return data[:end], list(struct.unpack_from(f"<{n}I", data, end))

    @staticmethod
    def _entries(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, data[at : at + length]
            at += length

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            yield from self._entries(self._block(k)[0], 0)

    def may_have(self, key: bytes) -> bool:
        bits = _probes(np.array([xxhash.xxh64_intdigest(key)], np.uint64), len(self.bloom) * 8, self.probes)[0]
        return bool(all(self.bloom[int(b) >> 3] >> (int(b) & 7) & 1 for b in bits))

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key, by binary search over the index and then over a block's restarts."""
        found: list[bytes] = []
        if not self.may_have(key):
            return found
        for k in range(bisect_left(self.last_keys, key), len(self.places)):
            data, restarts = self._block(k)
            low, high = 0, len(restarts)
            while high - low > 1:  # the last restart whose key is below the one sought
                mid = (low + high) // 2
                if next(self._entries(data, restarts[mid]))[0] < key:
                    low = mid
                else:
                    high = mid
            for own, value in self._entries(data, restarts[low]):
                if own == key:
                    found.append(value)
                elif own > key:
                    return found
        return found
