"""Files of the public tokenizers, read from their own path and never copied; serialised sentencepiece models."""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterable

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [pairs[i] for i in range(len(pairs))]


@functools.cache
def byte_chars() -> list[str]:
    """A printable character for each byte: the byte's own where Latin-1 has one that shows, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def model(pieces: Iterable[tuple[str, float, int]], kind: int, byte_fallback: bool = False, dummy_prefix: bool = False, escape: bool = False) -> bytes:
    """A sentencepiece model (protocol-buffer wire format) of (piece, score, type), with identity normalisation."""
    pieces = list(pieces)
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    out = b"".join(_bytes(1, _bytes(1, p.encode()) + struct.pack("<Bf", 2 << 3 | 5, score) + _int(3, t)) for p, score, t in pieces)
    none = (1 << 64) - 1  # -1
    out += _bytes(2, _int(3, kind) + _int(4, len(pieces)) + _int(35, byte_fallback) + _int(40, unk) + _int(41, none) + _int(42, none) + _int(43, none))
    return out + _bytes(3, _bytes(1, b"identity") + _int(3, dummy_prefix) + _int(4, 0) + _int(5, escape))


def pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a sentencepiece model file."""
    with open(path, "rb") as f:
        data = f.read()
    out, at = [], 0

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return n, at

    def fields(at: int, end: int):
        while at < end:
            tag, at = varint(at)
            wire = tag & 7
            if wire == 2:
                n, at = varint(at)
                yield tag >> 3, (at, at + n)
                at += n
            elif wire == 5:
                yield tag >> 3, struct.unpack_from("<f", data, at)[0]
                at += 4
            elif wire == 1:
                yield tag >> 3, struct.unpack_from("<d", data, at)[0]
                at += 8
            else:
                n, at = varint(at)
                yield tag >> 3, n

    for field, value in fields(at, len(data)):
        if field == 1:
            got = dict(fields(*value))
            out.append((data[got[1][0] : got[1][1]].decode(), float(got.get(2, 0.0)), int(got.get(3, NORMAL))))
    return out
