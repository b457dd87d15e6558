"""The public portable format of Roaring bitmaps, read and written with numpy.

A cookie, a flag for each container that is a run list, pairs of (key, cardinality - 1), offsets and
the containers: sorted arrays up to 4096 values, bitmaps above, or run lists of (start, length - 1).
"""

from __future__ import annotations

import struct

import numpy as np

from .codec import ARRAY, BITMAP, RUN, container, lows_of

# fixed values of the format
PLAIN, WITH_RUNS, OFFSETS_FROM = 12346, 12347, 4


def assemble(blocks: list[tuple[int, int, int, bytes]], standard: bool = False) -> bytes:
    """Bytes of a set from its (key, cardinality, type, payload) blocks in key order."""
    n = len(blocks)
    runs = any(b[2] == RUN for b in blocks)
    if runs:
        flags = np.packbits(np.array([b[2] == RUN for b in blocks]), bitorder="little").tobytes()
        head = struct.pack("<I", WITH_RUNS | (n - 1) << 16) + flags
    else:
        head = struct.pack("<II", PLAIN, n)
    head += np.array([(b[0], b[1] - 1) for b in blocks], "<u2").tobytes()
    if not runs or n >= OFFSETS_FROM:
        sizes = np.array([len(b[3]) for b in blocks], dtype=np.int64)
        head += (len(head) + 4 * n + np.cumsum(sizes) - sizes).astype("<u4").tobytes()
    return head + b"".join(b[3] for b in blocks)


def encode(values) -> bytes:
    """Bytes of ascending ids."""
    v = np.asarray(values, dtype=np.int64)
    keys, begin = np.unique(v >> 16, return_index=True)
    lows = np.split(v & 0xFFFF, begin[1:]) if len(keys) else []
    return assemble([(k, len(x), *container(x)) for k, x in zip(keys.tolist(), lows, strict=True)])


def decode(data: bytes | None, validate: bool = True) -> np.ndarray | None:
    """Ascending values; None where the bytes are not a sound set."""
    if data is None or len(data) < 8 and data[:2] != struct.pack("<H", WITH_RUNS):
        return None
    try:
        return _decoded(data, validate)
    except (struct.error, ValueError, IndexError):
        return None


def _decoded(data: bytes, validate: bool) -> np.ndarray | None:
    cookie, at = struct.unpack_from("<I", data)[0], 4
    if cookie & 0xFFFF == WITH_RUNS:
        n = (cookie >> 16) + 1
        flags = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")[:n]
        at += (n + 7) // 8
        at_offsets = n >= OFFSETS_FROM
    elif cookie == PLAIN:
        n, at = struct.unpack_from("<I", data, at)[0], 8
        if n > 65536:
            return None
        flags, at_offsets = np.zeros(n, np.uint8), True
    else:
        return None
    index = np.frombuffer(data, "<u2", 2 * n, at).reshape(-1, 2).astype(np.int64)
    at += 4 * n * (2 if at_offsets else 1)
    keys, cards = index[:, 0], index[:, 1] + 1
    if validate and (np.diff(keys) <= 0).any():
        return None
    out = [np.empty(0, np.int64)]
    for key, card, run in zip(keys.tolist(), cards.tolist(), flags.tolist(), strict=True):
        kind = RUN if run else ARRAY if card <= 4096 else BITMAP
        size = 2 + 4 * struct.unpack_from("<H", data, at)[0] if run else 2 * card if kind == ARRAY else 8192
        if at + size > len(data):
            return None
        lows = lows_of(kind, data[at : at + size])
        if validate and (len(lows) != card or (np.diff(lows) <= 0).any() or card and lows[-1] > 0xFFFF):
            return None
        out.append((key << 16) + lows)
        at += size
    return np.concatenate(out)
