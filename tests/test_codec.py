"""The binary form: pinned digests, round trips, bytes that must not decode."""

import numpy as np
import pytest

from setloom.sources import blobs, codec, roaring


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


MIXED = [*range(0, 0x10000, 2), *range(0x10000, 0x12000), *range(0x20000, 0x26000, 3), *range(0x30000, 0x31000, 3), 0x50000, 0x50001, 0x7FFFF, 2**32 - 1]


@pytest.mark.parametrize(
    ("values", "standard", "digest"),
    [
        ([7, 70_000, 2**32 - 1], False, 0xAA0BD3FE829CD44A),
        (range(0, 9000, 3), False, 0xFB80C64D7ADF00C3),
        (range(0, 60_000, 2), False, 0xC620C56608CAD07B),
        (range(5000), False, 0x3C84DD0233C3C719),
        (MIXED, False, 0x040CEF52E01D4BD3),
        ([0, 65_536, 131_072, 196_608], True, 0xD8E60B51AB91CB3D),
    ],
)
def test_pinned_bytes(values, standard, digest):
    assert fnv(codec.encode(list(values), standard)) == digest


@pytest.mark.parametrize("values", [[], [0], [2**32 - 1], list(range(65_536)), MIXED, [k << 16 for k in range(1000)], list(range(0, 8192, 2)), list(range(0, 8194, 2))])
@pytest.mark.parametrize("standard", [False, True])
def test_round_trip(values, standard):
    assert codec.decode(codec.encode(values, standard)).tolist() == values


def test_sizes_and_order():
    assert len(codec.encode([])) == 8 and len(codec.encode([], True)) == 16
    assert len(codec.encode([k << 16 for k in range(1000)])) == 4008
    for bad in ([2, 1], [1, 1], [-1], [2**32]):
        with pytest.raises(ValueError):
            codec.encode(bad)


def test_unsound_bytes():
    arrays, runs, bitmap = (codec.encode(v, True) for v in ([1, 5, 9], range(100), range(0, 60_000, 2)))
    bad = [b"", bytes(8), b"\xff" * 64, arrays[:15], bytes([arrays[0] ^ 1]) + arrays[1:], arrays[:4] + b"\x63" + arrays[5:], bitmap[:-1], bitmap[:-8192] + bytes(8) + bitmap[-8184:]]
    bad.append(arrays[:-6] + arrays[-4:-2] + arrays[-6:-4] + arrays[-2:])  # not ascending
    bad.append(runs[:24] + bytes(2) + runs[26:])  # no run
    bad.append(b"FI" + (2).to_bytes(2, "little") + np.array([5, 3], "<u4").tobytes())
    bad.append(b"FI" + (9).to_bytes(2, "little") + bytes(8))
    assert [codec.decode(b) is None for b in bad] == [True] * len(bad)
    assert codec.decode(b"FI\0\0" + bytes(4)).tolist() == []
    assert codec.decode(arrays + b"tail").tolist() == [1, 5, 9]


@pytest.mark.parametrize("values", [[], [0], [2**32 - 1], list(range(65_536)), MIXED, [k << 16 for k in range(1000)], list(range(0, 8192, 2)), list(range(0, 60_000, 2)), [k << 16 | j for k in range(3) for j in range(5000)]])
def test_roaring_round_trip(values):
    assert roaring.decode(roaring.encode(values)).tolist() == values


def test_roaring_layout():
    """The public format's fixed parts, by hand: an array, and a run list without and with offsets."""
    assert roaring.encode([1, 5, 65_536 + 7]) == bytes.fromhex("3a300000 02000000 0000 0100 0100 0000 18000000 1c000000 0100 0500 0700".replace(" ", ""))
    assert roaring.encode(list(range(10, 20))) == bytes.fromhex("3b300000 01 0000 0900 0100 0a00 0900".replace(" ", ""))
    many = roaring.encode([k << 16 | j for k in range(4) for j in range(10)])
    assert many[:5] == bytes.fromhex("3b3003000f") and int.from_bytes(many[21:25], "little") == 37


def test_roaring_hostile():
    whole = roaring.encode(MIXED)
    bad = [None, b"", bytes(8), whole[:20], whole[:-3], b"\xff" * 64, bytes.fromhex("3a30000002000000010000000000000018000000")]
    assert [roaring.decode(b) for b in bad] == [None] * len(bad)


def test_files_and_packed_files(spark, tmp_path):
    """Sinks write whole files, again with the same bytes, and readers give the sets back, whatever their names."""
    sets = {"a": [1, 2, 3], "b/c d%": list(range(0, 60_000, 2)), "é": [2**32 - 1]}
    rows = spark.createDataFrame([(n, v) for n, vs in sets.items() for v in vs], "set_id string, value bigint")
    made = blobs.encode(rows)
    want = sorted(map(tuple, made.collect()))
    for _ in range(2):
        assert sorted(r.set_id for r in blobs.write_files(made, str(tmp_path / "files")).collect()) == sorted(sets)
    assert len(list((tmp_path / "files").iterdir())) == 3
    assert sorted(r.payload for r in blobs.read_files(spark, str(tmp_path / "files")).collect()) == sorted(p for _, p in want)
    directory = blobs.write_packed(made, str(tmp_path / "packed"), files=2)
    assert all(r.offset % 64 == 0 for r in directory.collect())
    assert sorted(map(tuple, blobs.read_packed(str(tmp_path / "packed"), directory).collect())) == want
