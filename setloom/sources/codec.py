"""The compact binary form of a set, encoded, decoded and validated with numpy.

Standard form: a 16-byte header (magic, version, flags, container count, cardinality), then three
columns over the containers (key, cardinality - 1, type and offset), then the payloads. Inline form:
a two-byte magic, a count and the values. All numbers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

# fixed values of the format
MAGIC, VERSION, INLINE_MAGIC = 0x46524F5A, 3, b"FI"
HAS_RUNS, FULL, HAS_BITMAP = 1, 2, 4
ARRAY, BITMAP, RUN = 0, 1, 2
MOST_ARRAY, MOST_RUNS, BITMAP_BYTES, MOST_INLINE = 4096, 2047, 8192, 65535
DOMAIN = 1 << 32

_HEADER = struct.Struct("<IHHII")


def _up(n: int, to: int) -> int:
    return -(-n // to) * to


def container(lows: np.ndarray) -> tuple[int, bytes]:
    """(type, payload) of a block's ascending low halves in the smallest form; ties prefer runs, then arrays."""
    cut = np.flatnonzero(np.diff(lows) != 1) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(lows)] - 1
    run_bytes, array_bytes = 2 + 4 * len(first), 2 * len(lows)
    if run_bytes <= array_bytes and run_bytes <= BITMAP_BYTES:
        pairs = np.c_[lows[first], lows[last] - lows[first]].astype("<u2")
        return RUN, struct.pack("<H", len(first)) + pairs.tobytes()
    if array_bytes <= BITMAP_BYTES:
        return ARRAY, lows.astype("<u2").tobytes()
    bits = np.zeros(65536, dtype=np.uint8)
    bits[lows] = 1
    return BITMAP, np.packbits(bits, bitorder="little").tobytes()


def assemble(blocks: list[tuple[int, int, int, bytes]], standard: bool = False) -> bytes:
    """Bytes of a set from its (key, cardinality, type, payload) blocks in key order; inline where that is smaller."""
    total = sum(b[1] for b in blocks)
    bitmaps = any(b[2] == BITMAP for b in blocks)
    base = _up(16 + 8 * len(blocks), 64 if bitmaps else 8)
    data, at, index = [], 0, []
    for _, _, kind, payload in blocks:
        pad = _up(at, 64 if kind == BITMAP else 2) - at
        data += [bytes(pad), payload]
        index.append(kind << 30 | at + pad)
        at += pad + len(payload)
    if not standard and total <= MOST_INLINE and (_up(4 + 4 * total, 8) < base + at or not blocks):
        values = np.concatenate([(k << 16) + lows_of(kind, payload) for k, _, kind, payload in blocks]) if blocks else np.empty(0)
        out = INLINE_MAGIC + struct.pack("<H", total) + values.astype("<u4").tobytes()
        return out.ljust(_up(len(out), 8), b"\0")
    flags = HAS_RUNS * any(b[2] == RUN for b in blocks) | FULL * (total == DOMAIN) | HAS_BITMAP * bitmaps
    head = _HEADER.pack(MAGIC, VERSION, flags, len(blocks), total % DOMAIN)
    columns = np.array([b[0] for b in blocks], "<u2").tobytes() + np.array([b[1] - 1 for b in blocks], "<u2").tobytes() + np.array(index, "<u4").tobytes()
    return (head + columns).ljust(base if blocks else 16, b"\0") + b"".join(data)


def encode(values, standard: bool = False) -> bytes:
    """Bytes of a strictly ascending sequence of ids; raises ValueError where it is not."""
    v = np.asarray(values, dtype=np.int64)
    if len(v) and (v[0] < 0 or v[-1] >= DOMAIN or (np.diff(v) <= 0).any()):
        raise ValueError("values must be strictly ascending unsigned 32-bit ids")
    keys, begin = np.unique(v >> 16, return_index=True)
    blocks = []
    for k, lows in zip(keys.tolist(), np.split(v & 0xFFFF, begin[1:]), strict=False):
        kind, payload = container(lows)
        blocks.append((k, len(lows), kind, payload))
    return assemble(blocks, standard)


def lows_of(kind: int, payload: bytes) -> np.ndarray:
    """Low halves of a payload, not checked."""
    if kind == ARRAY:
        return np.frombuffer(payload, "<u2").astype(np.int64)
    if kind == BITMAP:
        return np.flatnonzero(np.unpackbits(np.frombuffer(payload, np.uint8), bitorder="little"))
    pairs = np.frombuffer(payload, "<u2", offset=2).reshape(-1, 2).astype(np.int64)
    sizes = pairs[:, 1] + 1
    return np.repeat(pairs[:, 0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _sound(kind: int, card: int, payload: bytes) -> bool:
    if kind == ARRAY:
        lows = np.frombuffer(payload, "<u2").astype(np.int64)
        return bool((np.diff(lows) > 0).all())
    if kind == BITMAP:
        return int(np.bitwise_count(np.frombuffer(payload, np.uint8)).sum()) == card
    pairs = np.frombuffer(payload, "<u2", offset=2).reshape(-1, 2).astype(np.int64)
    stops = pairs[:, 0] + pairs[:, 1]
    return bool((stops <= 0xFFFF).all() and (pairs[1:, 0] > stops[:-1]).all() and int((pairs[:, 1] + 1).sum()) == card)


def blocks_of(data: bytes, validate: bool = True) -> list[tuple[int, int, int, bytes]] | None:
    """(key, cardinality, type, payload) blocks of the standard form; None where it is not sound."""
    if len(data) < 16:
        return None
    magic, version, flags, n, card = _HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION or n > 65536 or len(data) < 16 + 8 * n:
        return None
    keys = np.frombuffer(data, "<u2", n, 16).astype(np.int64)
    cards = np.frombuffer(data, "<u2", n, 16 + 2 * n).astype(np.int64) + 1
    index = np.frombuffer(data, "<u4", n, 16 + 4 * n).astype(np.int64)
    if validate and ((np.diff(keys) <= 0).any() or int(cards.sum()) != (DOMAIN if flags & FULL else card)):
        return None
    base = _up(16 + 8 * n, 64 if flags & HAS_BITMAP else 8)
    out = []
    for k, c, at in zip(keys.tolist(), cards.tolist(), index.tolist(), strict=True):
        kind, begin = at >> 30, base + (at & (1 << 30) - 1)
        if kind == RUN:
            if begin + 2 > len(data):
                return None
            pairs = int.from_bytes(data[begin : begin + 2], "little")
            if validate and not 1 <= pairs <= MOST_RUNS:
                return None
            size = 2 + 4 * pairs
        elif kind in (ARRAY, BITMAP):
            size = 2 * c if kind == ARRAY else BITMAP_BYTES
        else:
            return None
        payload = data[begin : begin + size]
        if len(payload) < size or validate and not _sound(kind, c, payload):
            return None
        out.append((k, c, kind, payload))
    return out


def decode(data: bytes | None, validate: bool = True) -> np.ndarray | None:
    """Ascending values of either form; None where the bytes are not a sound set. Bytes after the end are fine."""
    if data is None or len(data) < 4:
        return None
    if data[:2] == INLINE_MAGIC:
        n = int.from_bytes(data[2:4], "little")
        if len(data) < 4 + 4 * n:
            return None
        values = np.frombuffer(data, "<u4", n, 4).astype(np.int64)
        return values if not validate or (np.diff(values) > 0).all() else None
    blocks = blocks_of(data, validate)
    if blocks is None:
        return None
    return np.concatenate([(k << 16) + lows_of(kind, payload) for k, _, kind, payload in blocks]) if blocks else np.empty(0, dtype=np.int64)
