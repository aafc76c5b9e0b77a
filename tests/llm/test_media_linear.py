"""Validators over hostile bytes: linear time with varied declared ends, and chains and checksums against plain walks."""

import random
import struct
import zlib
from time import perf_counter

import pytest

from lexiforge.llm import media as M


def chunk(name, data, size=None):
    return struct.pack(">I", len(data) if size is None else size) + name + data + struct.pack(">I", zlib.crc32(name + data))


HEAD = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13))


def riff_ends(n):
    """Headers whose declared ends all differ, before a shared run of empty chunks."""
    heads = n // 24
    b = b"".join(b"RIFF" + struct.pack("<I", max(4, n - 12 * k - 8 - 8 * (k % (n // 32)) - 4)) + b"WAVE" for k in range(heads))
    return b + bytes(n - len(b))


def png_ends(n):
    """Headers each followed by a chunk that claims all the rest."""
    step = len(HEAD) + 12
    return b"".join(HEAD + struct.pack(">I", n - step * (i + 1) - 100) + b"IDATabcd" for i in range(n // step - 3)).ljust(n, b"\0")


@pytest.mark.parametrize("made", [riff_ends, png_ends, lambda n: b"GIF89a" + bytes([0] * 7) + b"\x21\xf9\x01" * (n // 3), lambda n: (b"\xff\xd8\xff\xe0" + b"\0\x10") * (n // 6), lambda n: b"BM" * (n // 2), lambda n: b"%PDF-1" * (n // 6), lambda n: M.stored("RIFFabcdWAVEfmt " * (n // 16))])
def test_a_megabyte_takes_seconds(made):
    at = perf_counter()
    M.sniffed(made(1_000_000))
    assert perf_counter() - at < 5


def test_chains_match_plain_walks():
    rng = random.Random(2)
    for _ in range(300):
        b = b"".join(rng.choice([b"RIFF", b"WAVE", b"fmt ", b"data", b"LIST", struct.pack("<I", rng.choice([0, 0, 1, 2, 8, 12, 40])), bytes(4)]) for _ in range(rng.randint(3, 40)))
        chains = M.Chains(b)
        for at in range(len(b)):
            if b[at : at + 4] != b"RIFF":
                continue
            for end in range(at + 12, len(b) + 1):
                c, names = at + 12, set()
                while c + 8 <= end:
                    size = int.from_bytes(b[c + 4 : c + 8], "little")
                    names.add(b[c : c + 4])
                    c += 8 + size + size % 2
                assert chains.between(at + 12, end) == (names & set(M.RIFF_NAMES) if c == end else None)


def test_sums_match_plain_checksums():
    b = random.Random(3).randbytes(200_000)
    sums = M.Sums(b)
    for start, end in [(0, 0), (0, 200_000), (1, 199_999), (5, 5000), (1023, 1025), (1024, 9216), (77_777, 188_888)]:
        assert sums.of(start, end) == zlib.crc32(b[start:end])


def test_files_within_bytes_are_found():
    png = HEAD + chunk(b"IDAT", random.Random(4).randbytes(9000)) + chunk(b"IEND", b"")
    wav = M.wav(bytes(64))
    assert M.sniffed(wav + png + b"x" + wav) == [("audio/wav", 0, len(wav)), ("image/png", len(wav), len(png)), ("audio/wav", len(wav) + len(png) + 1, len(wav))]
    broken = bytearray(png)
    broken[500] ^= 1
    assert M.sniffed(bytes(broken)) == []
