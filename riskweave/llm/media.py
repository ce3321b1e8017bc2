"""Media columns: progressive JPEG.

The decoder accumulates the scans of a progressive JPEG (spectral selection and successive approximation, for DC and AC,
first and refining) into coefficient arrays, dequantises and inverse-transforms them with numpy, upsamples chroma and gives a
full-resolution RGB tensor.

`pack` stores bytes losslessly in such a file, in the format's unit, the quantised coefficient: 64 bytes are the
coefficients of one 8x8 block in zigzag order, the first byte as DC, the others plus 256 as AC, so that all AC coefficients
have one magnitude category. The file is in colour, with chroma of half the width and height of luma, so that its tensor
takes chroma upsampling. It has an interleaved DC scan of the bits above the eighth, eight DC refinements of a bit each, and for each component an AC
scan without the lowest bit and an AC refinement. Scans whose code table has a single one-bit code have fixed places for
all bits, which numpy packs and unpacks without a loop; other scans are decoded coefficient by coefficient. The length
of the payload is in an application segment.

Edge cases: a null or empty text is 64 zero bytes; payloads up to 4 GB fit one image; equal texts give equal files; repeated
rows are treated alike; an empty table gives an empty result; other columns are kept by `with_media`, whose column is media."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave.llm import common

#: Fixed values of the format: the zigzag order of an 8x8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
MARK = b"RWPL"


@dataclass
class Component:
    key: int
    h: int
    v: int
    table: int
    wide: int = 0
    high: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))  # rows of blocks, zigzag order


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]
    payload: int = 0


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(components: tuple[int, ...], ss: int, se: int, ah: int, al: int, bits: np.ndarray) -> bytes:
    data = np.packbits(bits)
    data[-1] |= (1 << -len(bits) % 8) - 1  # ones up to a whole byte
    return _segment(0xDA, bytes([len(components), *[x for c in components for x in (c, 0)], ss, se, ah << 4 | al])) + data.tobytes().replace(b"\xff", b"\xff\x00")


def _one_code(table: int, symbol: int) -> bytes:
    """A code table whose only code is the bit 0."""
    return _segment(0xC4, bytes([table, 1, *[0] * 15, symbol]))


def pack(payload: bytes) -> bytes:
    """A progressive JPEG in colour whose coefficients hold the payload, a positive multiple of 64 bytes.

    Of the blocks two thirds are luma; the rest are two chroma components of half its width and height."""
    n = len(payload) // 64
    units = -(-n // 6)
    wide = int(np.ceil(np.sqrt(units)))
    high = -(-units // wide)
    blocks = np.zeros((wide * high * 6, 64), np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    out = [b"\xff\xd8", _segment(0xEB, MARK + struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # DC scans are interleaved: the four luma blocks of a unit, then one of each chroma
    count = wide * high
    luma = np.arange(4 * count).reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(count, 4)
    dc = blocks[np.c_[luma, 4 * count + np.arange(count), 5 * count + np.arange(count)].reshape(-1), 0]
    out += [_one_code(0x00, 0), _scan((1, 2, 3), 0, 0, 0, 8, np.zeros(len(dc), np.uint8))]
    out += [_scan((1, 2, 3), 0, 0, bit + 1, bit, dc >> bit & 1) for bit in range(7, -1, -1)]
    for key, own in enumerate(np.split(blocks, [wide * high * 4, wide * high * 5]), 1):
        out += _component_scans(key, own)
    return b"".join([*out, b"\xff\xd9"])


def _component_scans(key: int, blocks: np.ndarray) -> list[bytes]:
    """The AC scans of a component's blocks, with their code tables."""
    count = len(blocks)
    # AC values are 256 to 511; without the lowest bit they have 8 bits, the first of which is set
    ac = np.zeros((count, 63, 9), np.uint8)
    ac[:, :, 1] = 1
    ac[:, :, 2:] = np.unpackbits(blocks[:, 1:, None], axis=2)[:, :, :7]
    out = [_one_code(0x10, 0x08), _scan((key,), 1, 63, 0, 1, ac.reshape(-1))]
    # one run covers up to 16384 blocks: symbol E0 says 2**14 plus a number of 14 bits, then come the blocks' refining bits
    low = blocks[:, 1:] & 1
    runs, left, at = [], count, 0
    sizes = set()
    while left:
        size = min(14, left.bit_length() - 1)
        now = min(left, (1 << (size + 1)) - 1)
        sizes.add(size)
        runs.append((at, now, size))
        at, left = at + now, left - now
    # two codes of two bits suffice for any choice of run sizes: at most a size of 14 and one other
    names = sorted(sizes)
    out.append(_segment(0xC4, bytes([0x10, 0, len(names), *[0] * 14, *[s << 4 for s in names]])))
    bits = []
    for at, now, size in runs:
        code = names.index(size)
        head = [code >> 1 & 1, code & 1, *[(now - (1 << size)) >> i & 1 for i in range(size - 1, -1, -1)]]
        bits += [np.array(head, np.uint8), low[at : at + now].reshape(-1)]
    return [*out, _scan((key,), 1, 63, 1, 0, np.concatenate(bits))]


class Bits:
    """Bits of one entropy-coded stretch; beyond its end they are zero."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        short = self.at + n - max(self.at, min(len(self.bits), self.at + n))
        self.at += n
        return out << short

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")


def _signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n in range(16):
        for _ in range(counts[n]):
            out[n + 1, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def read(data: bytes) -> Image:
    """Decodes all scans into coefficient arrays."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    img, codes, restart, payload, at = None, {}, 0, 0, 2
    tables: dict[int, np.ndarray] = {}
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                tables[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xEB and body[:4] == MARK:
            payload = struct.unpack(">Q", body[4:12])[0]
        elif marker == 0xC2:
            _, high, wide, n = struct.unpack_from(">BHHB", body)
            comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(c.h for c in comps), max(c.v for c in comps)
            mcux, mcuy = -(-wide // (8 * hm)), -(-high // (8 * vm))
            for c in comps:
                c.wide, c.high = mcux * c.h, mcuy * c.v
                c.coef = np.zeros((c.wide * c.high, 64), np.int32)
            img = Image(wide, high, comps, tables)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive JPEG with Huffman codes")
        elif marker == 0xDA:
            end = at
            stretches = []
            while True:  # up to the next marker that isn't a restart
                stop = data.index(b"\xff", end)
                if data[stop + 1] == 0:
                    end = stop + 2
                    continue
                stretches.append(data[at:stop])
                at = end = stop + 2
                if not 0xD0 <= data[stop + 1] <= 0xD7:
                    at = stop
                    break
            picks = [(next(c for c in img.components if c.key == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            ss, se, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            _decode(img, picks, ss, se, approx >> 4, approx & 15, codes, restart, stretches)
    if img is None:
        raise ValueError("no frame")
    img.payload = payload
    return img


def _places(img: Image, picks: list[tuple[Component, int]]) -> list[list[tuple[int, int]]]:
    """The blocks (pick, index) of each coding unit of a scan."""
    hm, vm = max(c.h for c in img.components), max(c.v for c in img.components)
    if len(picks) == 1:
        c = picks[0][0]
        wide, high = -(-(-(-img.width * c.h // hm)) // 8), -(-(-(-img.height * c.v // vm)) // 8)
        return [[(0, y * c.wide + x)] for y in range(high) for x in range(wide)]
    mcux, mcuy = -(-img.width // (8 * hm)), -(-img.height // (8 * vm))
    return [[(k, (my * c.v + y) * c.wide + mx * c.h + x) for k, (c, _) in enumerate(picks) for y in range(c.v) for x in range(c.h)] for my in range(mcuy) for mx in range(mcux)]


@functools.lru_cache(maxsize=3)
def _order(high: int, wide: int, v: int, h: int) -> np.ndarray:
    """A component's blocks in interleaved order, v times h a unit."""
    return np.arange(high * wide).reshape(high // v, v, wide // h, h).transpose(0, 2, 1, 3).reshape(-1)


def _decode(img: Image, picks: list, ss: int, se: int, ah: int, al: int, codes: dict, restart: int, stretches: list[bytes]) -> None:
    """One scan. Scans of a single component, all of whose blocks have samples, without restarts and with fixed places for bits go through numpy."""
    c, tab = picks[0]
    whole = img.width % (8 * max(x.h for x in img.components)) == 0 and img.height % (8 * max(x.v for x in img.components)) == 0
    full = len(picks) == 1 and (whole or len(img.components) == 1) and not restart and len(stretches) == 1
    dc, ac = codes.get(tab >> 4, {}), codes.get(0x10 | tab & 15, {})
    if full and _fixed(c.coef, ss, se, ah, al, dc if ss == 0 else ac, stretches[0]):
        return
    if len(picks) > 1 and ss == 0 and not restart and len(stretches) == 1 and (ah or all(codes.get(x >> 4) == {(1, 0): 0} for _, x in picks)):
        # one bit a block, or only differences of zero: bits have fixed places in the interleaved order
        hm, vm = max(x.h for x in img.components), max(x.v for x in img.components)
        if ah:
            units = -(-img.width // (8 * hm)) * -(-img.height // (8 * vm))
            bits, at = Bits(stretches[0]).bits[: units * sum(x.v * x.h for x, _ in picks)].reshape(units, -1), 0
            for x, _ in picks:
                x.coef[_order(x.high, x.wide, x.v, x.h), 0] |= bits[:, at : at + x.v * x.h].reshape(-1).astype(np.int32) << al
                at += x.v * x.h
        return
    units = _places(img, picks)
    step = restart or len(units)
    for k, data in enumerate(stretches):
        bits, last, run = Bits(data), [0] * len(picks), 0
        for unit in units[k * step : (k + 1) * step]:
            for pick, block in unit:
                c, tab = picks[pick]
                coef = c.coef[block]
                if ss == 0:
                    if ah:
                        coef[0] |= bits.take(1) << al
                    else:
                        size = bits.symbol(codes[tab >> 4])
                        last[pick] += _signed(bits.take(size), size)
                        coef[0] = last[pick] << al
                elif ah == 0:
                    run = _ac_first(coef, bits, codes[0x10 | tab & 15], ss, se, al, run)
                else:
                    run = _ac_refine(coef, bits, codes[0x10 | tab & 15], ss, se, al, run)


def _ac_first(coef: np.ndarray, bits: Bits, codes: dict, ss: int, se: int, al: int, run: int) -> int:
    if run:
        return run - 1
    k = ss
    while k <= se:
        sym = bits.symbol(codes)
        zeros, size = sym >> 4, sym & 15
        if size:
            k += zeros
            coef[k] = _signed(bits.take(size), size) << al
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1
    return 0


def _ac_refine(coef: np.ndarray, bits: Bits, codes: dict, ss: int, se: int, al: int, run: int) -> int:
    def correct(k: int) -> None:
        if bits.take(1) and not (abs(int(coef[k])) >> al) & 1:
            coef[k] += (1 << al) if coef[k] > 0 else -(1 << al)

    k = ss
    if not run:
        while k <= se:
            sym = bits.symbol(codes)
            zeros, size = sym >> 4, sym & 15
            new = 0
            if size:
                new = (1 << al) if bits.take(1) else -(1 << al)
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= se:
                if coef[k]:
                    correct(k)
                elif zeros == 0:
                    if new:
                        coef[k] = new
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
    if run:
        while k <= se:
            if coef[k]:
                correct(k)
            k += 1
        run -= 1
    return run


def _fixed(coef: np.ndarray, ss: int, se: int, ah: int, al: int, codes: dict, data: bytes) -> bool:
    """Decodes a scan in which every bit has a fixed place, if it is one."""
    n, band = len(coef), se - ss + 1
    if ss == 0 and ah:
        coef[:, 0] |= Bits(data).bits[:n].astype(np.int32) << al
        return True
    if ss == 0:
        return codes == {(1, 0): 0}  # only differences of zero
    if ah == 0:
        if list(codes) != [(1, 0)] or codes[1, 0] >> 4 or not 0 < (size := codes[1, 0]) < 11:
            return False
        bits = Bits(data).bits[: n * band * (1 + size)].reshape(n, band, 1 + size)
        value = np.zeros((n, band), np.int32)
        for i in range(size):
            value = value << 1 | bits[:, :, 1 + i]
        coef[:, ss : se + 1] = np.where(bits[:, :, 1] == 1, value, value - (1 << size) + 1) << al
        return True
    if any(s & 15 for s in codes.values()) or not (coef[:, ss : se + 1] > 0).all() or ((coef[:, ss : se + 1] >> al) & 1).any():
        return False
    bits, at = Bits(data), 0
    while at < n:
        zeros = bits.symbol(codes) >> 4
        run = (1 << zeros) + bits.take(zeros)
        low = bits.bits[bits.at : bits.at + run * band].reshape(run, band)
        coef[at : at + run, ss : se + 1] += low.astype(np.int32) << al
        bits.at += run * band
        at += run
    return True


def payload(img: Image) -> bytes:
    """The bytes that `pack` stored."""
    # AC values are 256 more
    return b"".join((c.coef & 0xFF).astype(np.uint8).tobytes() for c in img.components)[: img.payload]


_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)], np.float32)


def samples(c: Component, table: np.ndarray) -> np.ndarray:
    """The component's plane of 8-bit samples, by the inverse transform of its blocks."""
    out = np.empty((c.high * 8, c.wide * 8), np.uint8)
    for y in range(0, c.high, max(1, 16384 // c.wide)):
        y1 = min(c.high, y + max(1, 16384 // c.wide))
        flat = np.empty(((y1 - y) * c.wide, 64), np.float32)
        flat[:, ZIGZAG] = c.coef[y * c.wide : y1 * c.wide] * table
        plane = _COS @ flat.reshape(-1, 8, 8) @ _COS.T
        plane = np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)
        out[y * 8 : y1 * 8] = plane.reshape(y1 - y, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape((y1 - y) * 8, c.wide * 8)
    return out


def rgb(img: Image) -> np.ndarray:
    """The full-resolution (height, width, 3) tensor; chroma is repeated to the size of luma."""
    hm, vm = max(c.h for c in img.components), max(c.v for c in img.components)
    planes = [samples(c, img.tables[c.table]) for c in img.components]
    if len(planes) == 1:
        return np.repeat(planes[0][: img.height, : img.width, None], 3, axis=2)
    scale = [(vm // c.v, hm // c.h) for c in img.components]
    rgb = np.empty((img.height, img.width, 3), np.uint8)
    step = vm * max(1, (1 << 20) // (vm * img.width))  # rows at a time, so that floats take little memory
    for top in range(0, img.height, step):
        end = min(img.height, top + step)
        y, cb, cr = (p[top // v : -(-end // v)].repeat(v, axis=0).repeat(h, axis=1)[: end - top, : img.width].astype(np.float32) for p, (v, h) in zip(planes[:3], scale[:3], strict=True))
        out = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2)
        rgb[top:end] = np.clip(np.rint(out), 0, 255)
    return rgb


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


def feature(img: Image) -> str:
    """Size and a brightness profile of the decoded RGB tensor: shares of dark, middle and bright samples per mille, and the mean."""
    h = np.bincount(rgb(img).reshape(-1), minlength=256)
    total = h.sum()
    share = [int(1000 * h[a:b].sum() // total) for a, b in ((0, 64), (64, 192), (192, 256))]
    return f"{img.width}x{img.height}:{share[0]}-{share[1]}-{share[2]}:{int((h * np.arange(256)).sum() // total)}"


def with_media(docs: DataFrame) -> DataFrame:
    """docs with the column media: the text's padded UTF-8 bytes as a progressive JPEG."""
    docs = docs.drop("media")
    names, schema = docs.columns, StructType([*docs.schema.fields, *StructType.fromDDL("media binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 4 << 20):
            made = [pack(padded((t or "").encode())) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*names, "media"])

    return docs.mapInArrow(run, schema)


def tensors(media: DataFrame) -> DataFrame:
    """media (any progressive JPEGs) with width, height and rgb, the bytes of the row-major RGB tensor, added; columns of these names are replaced."""
    media = media.drop("width", "height", "rgb")
    names, schema = media.columns, StructType([*media.schema.fields, *StructType.fromDDL("width int, height int, rgb binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "media", 1 << 20):
            got = [rgb(read(b)) if b else None for b in batch.column(batch.schema.get_field_index("media")).to_pylist()]
            cols = [pa.array([g.shape[1] if g is not None else None for g in got], pa.int32()), pa.array([g.shape[0] if g is not None else None for g in got], pa.int32()), pa.array([g.tobytes() if g is not None else None for g in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, "width", "height", "rgb"])

    return media.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), each from the stored file but for n_bytes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 2 << 20):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                stored = pack(padded(raw))
                img = read(stored)
                back = payload(img)
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(img)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_media": op9_media}
ORACLE: dict[str, str] = {}
