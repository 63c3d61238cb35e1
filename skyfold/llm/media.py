"""Media columns: progressive JPEG to full-resolution RGB tensors.

The scans of a progressive file are accumulated into coefficient arrays: spectral selection says which of the 64
coefficients a scan has, successive approximation which bits of them.  The arrays are inverse-transformed strip by strip, by
one matrix product each; chroma is repeated up to the luma's size, and the result is a height x width x 3 tensor of bytes,
as one value (`rgb_columns`) or as a table of its strips (`rgb_strips`).

Files are read and written in runs of blocks too, so that beside payload, file and coefficients (two bytes each) no array
grows with the file.

`decode` reads any Huffman-coded progressive file of 8-bit samples with 1 or 3 components.  A scan whose layout is fixed
(one symbol in its table, or only raw bits) is read by array operations; any other scan symbol by symbol.

`encode_payload` stores bytes losslessly.  The format's lossless unit is the quantized coefficient, so each byte is one:
64 bytes make a block.  An AC coefficient is 256 + byte and the DC coefficients of a component alternate between
512 + byte and byte - 256, so that all have one size category and every scan has a fixed layout.

Inputs that need a rule: a null text or an empty text is a payload of 64 zero bytes; a null file gives a null tensor;
repeated rows are rows of their own; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rename_inputs


@functools.lru_cache(1)
def zigzag() -> np.ndarray:
    """The place (row * 8 + column) of each coefficient in the order of the file."""
    at = [(r, c) for r in range(8) for c in range(8)]
    at.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in at])


@functools.lru_cache(1)
def inverse() -> np.ndarray:
    """64 x 64: coefficients in file order times this are samples, row by row."""
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(basis, basis)[zigzag()].astype(np.float32)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    coef: np.ndarray = field(repr=False, default=None)  # rows x columns x 64, in file order, whole MCUs
    rows: int = 0  # of blocks that hold samples
    cols: int = 0


@dataclass
class Table:
    """A Huffman table: codes by length and value."""

    codes: dict[tuple[int, int], int]

    @functools.cached_property
    def only(self) -> tuple[int, int] | None:
        """Length and symbol of the code, if there is one alone."""
        return next(((n, s) for (n, _), s in self.codes.items()), None) if len(self.codes) == 1 else None

    @functools.cached_property
    def runs_only(self) -> bool:
        """All symbols end bands: no coefficient becomes nonzero."""
        return all(s & 15 == 0 and s >> 4 < 15 for s in self.codes.values())


@dataclass
class Frame:
    width: int
    height: int
    parts: list[Component]
    quants: dict[int, np.ndarray]
    comments: list[bytes]

    @property
    def mcus(self) -> tuple[int, int]:
        hm, vm = max(c.h for c in self.parts), max(c.v for c in self.parts)
        return -(-self.height // (8 * vm)), -(-self.width // (8 * hm))


class Bits:
    """Reads bits; past the end come zeros."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        p = self.at
        self.at += n
        return (int.from_bytes(self.data[p >> 3 : (p >> 3) + 4], "big") >> (32 - n - (p & 7))) & ((1 << n) - 1)

    def symbol(self, table: Table) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (s := table.codes.get((n, code))) is not None:
                return s
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _tables(body: bytes) -> dict[tuple[int, int], Table]:
    out = {}
    while body:
        counts, at, code, codes = body[1:17], 17, 0, {}
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                codes[n, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        out[body[0] >> 4, body[0] & 15] = Table(codes)
        body = body[at:]
    return out


#: Blocks that are read, written or transformed at a time; a multiple of 8, so that runs begin with a byte.
RUN = 4096


def _bits_of(data: bytes, n: int, skip: int = 0) -> np.ndarray:
    """n bits from bit `skip` on; past the end come zeros."""
    own = np.frombuffer(data, np.uint8)[skip >> 3 : (skip + n + 7) >> 3]
    return np.unpackbits(own, count=(skip & 7) + n)[skip & 7 :]


def _numbers(bits: np.ndarray, skip: int, size: int) -> np.ndarray:
    """Rows of skip + size bits: the last size of each as a number."""
    out = np.packbits(bits.reshape(-1, skip + size)[:, skip:], axis=1)
    if size <= 8:
        return (out[:, 0] >> (8 - size)).astype(np.int32)
    return (out[:, 0].astype(np.int32) << 8 | out[:, 1]) >> (16 - size)


def _interleaved(c: Component, frame: Frame) -> np.ndarray:
    """A view of the component's coefficients by MCU: rows, columns, then the blocks within."""
    my, mx = frame.mcus
    return c.coef.reshape(my, c.v, mx, c.h, 64).transpose(0, 2, 1, 3, 4)


def _dc(frame: Frame, parts: list[Component], tables: list[Table], pieces: list[bytes], low: int, refine: bool, restart: int) -> None:
    if len(parts) == 1:
        views = [parts[0].coef[: parts[0].rows, : parts[0].cols, 0][:, :, None, None]]
    else:
        views = [_interleaved(c, frame)[..., 0] for c in parts]
    my, mx = views[0].shape[:2]
    sizes = [v.shape[2] * v.shape[3] for v in views]
    total, ends = sum(sizes), np.cumsum(sizes)
    only = {t.only for t in tables}
    one = next(iter(only)) if len(only) == 1 else None
    if len(pieces) == 1 and (refine or one):
        n = my * mx * total
        if refine:
            got = _bits_of(pieces[0], n).astype(np.int32).reshape(-1, total)
        else:
            code, size = one
            got = _numbers(_bits_of(pieces[0], n * (code + size)), code, size) if size else np.zeros(n, np.int32)
            got = np.where(got >> (size - 1) & 1, got, got - (1 << size) + 1).reshape(-1, total) if size else got.reshape(-1, total)
        for v, size, end in zip(views, sizes, ends, strict=True):
            own = got[:, end - size : end]
            own = own if refine else np.cumsum(own.ravel(), dtype=np.int32)
            own = own.reshape(v.shape) << low
            v[...] = v | own if refine else own
        return
    units = [(y, x) for y in range(my) for x in range(mx)]
    for i, piece in enumerate(pieces):
        bits, last = Bits(piece), [0] * len(views)
        for y, x in units[i * restart : (i + 1) * restart] if restart else units:
            for k, v in enumerate(views):
                for a in range(v.shape[2]):
                    for b in range(v.shape[3]):
                        if refine:
                            v[y, x, a, b] |= bits.take(1) << low
                        else:
                            last[k] += bits.signed(bits.symbol(tables[k]))
                            v[y, x, a, b] = last[k] << low


def _ac_first(blocks: np.ndarray, table: Table, pieces: list[bytes], first: int, last: int, low: int, restart: int) -> None:
    """blocks: a component's blocks in raster order, written in place."""
    n, width = len(blocks), last - first + 1
    if len(pieces) == 1 and table.only and table.only[1] >> 4 == 0 and table.only[1]:
        code, size = table.only
        for i in range(0, n, RUN):
            m = min(RUN, n - i)
            got = _numbers(_bits_of(pieces[0], m * width * (code + size), i * width * (code + size)), code, size)
            got = np.where(got >> (size - 1) & 1, got, got - (1 << size) + 1)
            blocks[i : i + m, first : last + 1] = got.reshape(m, width) << low
        return
    for i, piece in enumerate(pieces):
        bits, run = Bits(piece), 0
        for b in range(i * restart, min(n, (i + 1) * restart)) if restart else range(n):
            if run:
                run -= 1
                continue
            k = first
            while k <= last:
                zeros, size = divmod(bits.symbol(table), 16)
                if size:
                    k += zeros
                    blocks[b, k] = bits.signed(size) * (1 << low)
                    k += 1
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros) - 1
                    break
                else:
                    k += 16


def _ac_refine(blocks: np.ndarray, table: Table, pieces: list[bytes], first: int, last: int, low: int, restart: int) -> None:
    n, step = len(blocks), 1 << low
    for i, piece in enumerate(pieces):
        begin, end = (i * restart, min(n, (i + 1) * restart)) if restart else (0, n)
        if table.runs_only:
            bits, b = Bits(piece), begin
            while b < end:
                zeros = bits.symbol(table) >> 4
                to = min(end, b + (1 << zeros) + bits.take(zeros))
                band = blocks[b:to, first : last + 1]
                live = band != 0
                count = int(live.sum())
                raw = _bits_of(piece, count, bits.at)
                old = band[live]
                band[live] = old + np.sign(old) * (raw.astype(np.int32) << low)
                bits.at += count
                b = to
            continue
        bits, run = Bits(piece), 0
        for b in range(begin, end):
            k, block = first, blocks[b]

            def fix(k: int, block=block, bits=bits) -> None:
                if bits.take(1):
                    block[k] += step if block[k] > 0 else -step

            if not run:
                while k <= last:
                    zeros, size = divmod(bits.symbol(table), 16)
                    if not size and zeros < 15:
                        run = (1 << zeros) + bits.take(zeros)
                        break
                    value = (step if bits.take(1) else -step) if size else 0
                    while k <= last:
                        if block[k]:
                            fix(k)
                        elif zeros:
                            zeros -= 1
                        else:
                            break
                        k += 1
                    if value:
                        block[k] = value
                    k += 1
            if run:
                for k in range(k, last + 1):
                    if block[k]:
                        fix(k)
                run -= 1


def decode(data: bytes) -> Frame:
    """The coefficients of a progressive file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quants, tables, frame, restart, comments = 2, {}, {}, None, 0, []
    while at < len(data):
        kind = data[at + 1]
        if kind == 0xD9:
            break
        if kind in (0x01, 0xFF):
            at += 1 + (kind == 0x01)
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            comments.append(body)
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            tables |= _tables(body)
        elif kind == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif kind == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            frame = Frame(width, height, parts, quants, comments)
            my, mx = frame.mcus
            hm, vm = max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                c.coef = np.zeros((my * c.v, mx * c.h, 64), np.int16)  # samples have 8 bits
                c.rows, c.cols = -(-(-(-height * c.v // vm)) // 8), -(-(-(-width * c.h // hm)) // 8)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError(f"not a Huffman-coded progressive file: marker {kind:#x}")
        elif kind == 0xDA:
            n = body[0]
            own = {c.ident: c for c in frame.parts}
            parts, picks = [own[body[1 + 2 * i]] for i in range(n)], [body[2 + 2 * i] for i in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            pieces, begin = [], at
            while True:
                at = data.index(b"\xff", at)
                if data[at + 1] == 0:
                    at += 2
                elif 0xD0 <= data[at + 1] <= 0xD7:
                    pieces.append(data[begin:at])
                    at = begin = at + 2
                else:
                    break
            pieces = [p.replace(b"\xff\x00", b"\xff") for p in [*pieces, data[begin:at]]]
            refine, low = approx >> 4, approx & 15
            if first == 0:
                _dc(frame, parts, [tables.get((0, p >> 4), Table({})) for p in picks], pieces, low, bool(refine), restart)
            else:
                c, whole = parts[0], None
                blocks = c.coef.reshape(-1, 64)
                if (c.rows, c.cols) != c.coef.shape[:2]:
                    whole = c.coef[: c.rows, : c.cols]
                    blocks = whole.reshape(-1, 64).copy()
                (_ac_refine if refine else _ac_first)(blocks, tables[1, picks[0] & 15], pieces, first, last, low, restart)
                if whole is not None:
                    whole[...] = blocks.reshape(whole.shape)
    if frame is None:
        raise ValueError("the file has no frame")
    return frame


def _samples(c: Component, frame: Frame, begin: int, end: int) -> np.ndarray:
    """The component's samples in MCU rows begin to end, level-shifted and clipped."""
    coef = c.coef[begin * c.v : end * c.v]
    rows, cols = coef.shape[:2]
    scaled = coef.reshape(-1, 64).astype(np.float32)
    quant = frame.quants[c.quant]
    if (quant != 1).any():
        scaled *= quant.astype(np.float32)
    out = scaled @ inverse()
    out += np.float32(128)
    np.clip(np.rint(out, out=out), 0, 255, out=out)
    return out.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def strips(frame: Frame) -> Iterator[tuple[int, np.ndarray]]:
    """The tensor in strips of whole MCU rows: the first pixel row, and rows x width x 3 bytes."""
    hm, vm = max(c.h for c in frame.parts), max(c.v for c in frame.parts)
    my, mx = frame.mcus
    step = max(1, RUN // (mx * sum(c.h * c.v for c in frame.parts)))
    for begin in range(0, my, step):
        top = begin * 8 * vm
        height = min(frame.height, (begin + step) * 8 * vm) - top
        planes = []
        for c in frame.parts:
            p = _samples(c, frame, begin, min(my, begin + step))
            if vm > c.v:
                p = np.repeat(p, vm // c.v, 0)
            if hm > c.h:
                p = np.repeat(p, hm // c.h, 1)
            planes.append(p[:height, : frame.width])
        if len(planes) == 1:
            yield top, np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
            continue
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        out = np.empty((*y.shape, 3), np.float32)
        out[..., 0] = y + np.float32(1.402) * cr
        out[..., 1] = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
        out[..., 2] = y + np.float32(1.772) * cb
        yield top, np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def rgb(frame: Frame) -> np.ndarray:
    """height x width x 3 bytes; chroma is repeated up to full resolution."""
    return np.concatenate([strip for _, strip in strips(frame)])


def rgb_columns(files: DataFrame, key: str = "key", data: str = "data") -> DataFrame:
    """(key, height, width, rgb): the tensors of a column of files, row by row and channel last."""
    schema = pa.schema([("key", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch["key"].to_pylist(), batch["data"], strict=True):  # a tensor at a time
                image = rgb(decode(value.as_py())) if value.is_valid else None
                row = (key, None, None, None) if image is None else (key, *image.shape[:2], image.tobytes())
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return rename_inputs(files, key=key, data=data).mapInArrow(run, "key bigint, height int, width int, rgb binary")


def rgb_strips(files: DataFrame, key: str = "key", data: str = "data") -> DataFrame:
    """(key, height, width, top, rgb): the tensors in strips, each from pixel row `top` on.  A null file has one null strip.

    However large a file is, a row holds some `RUN` blocks.
    """
    schema = pa.schema([("key", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("top", pa.int32()), ("rgb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch["key"].to_pylist(), batch["data"], strict=True):
                frame = decode(value.as_py()) if value.is_valid else None
                rows = [(key, None, None, None, None)] if frame is None else ((key, frame.height, frame.width, top, strip.tobytes()) for top, strip in strips(frame))
                for row in rows:
                    yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return rename_inputs(files, key=key, data=data).mapInArrow(run, "key bigint, height int, width int, top int, rgb binary")


# Storing a payload

BLOCK = 64
_BANDS = ((1, 5), (6, 63))
#: Luma has four blocks in an MCU, each chroma component one.
_LAYOUT = ((1, 2, 2, 0, 4), (2, 1, 1, 4, 5), (3, 1, 1, 5, 6))


def _segment(kind: int, body: bytes) -> bytes:
    return b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body


def _one_code(group: int, slot: int, symbols: list[int]) -> bytes:
    """A table of up to 16 symbols: one has the code 0, more have codes of five bits."""
    return _segment(0xC4, bytes([group << 4 | slot]) + bytes([1] + [0] * 15 if len(symbols) == 1 else [0, 0, 0, 0, len(symbols)] + [0] * 11) + bytes(symbols))


#: Luma and chroma: DC differences have 9 bits without the lowest, AC coefficients 8; band ends with runs to 2**14.
_HEAD_TABLES = _one_code(0, 0, [9]) + _one_code(1, 0, [8]) + _one_code(1, 1, [r << 4 for r in range(15)])
_QUANT = _segment(0xDB, bytes([0]) + bytes([1] * 64))


class _Writer:
    """Entropy-coded bytes out of rows of bits; what doesn't fill a byte waits for more."""

    def __init__(self):
        self.out, self.rest = bytearray(), np.zeros(0, np.uint8)

    def put(self, bits: np.ndarray) -> None:
        if len(self.rest):
            bits = np.concatenate([self.rest, bits])
        whole = len(bits) & ~7
        self.out += np.packbits(bits[:whole]).tobytes().replace(b"\xff", b"\xff\x00")
        self.rest = bits[whole:]

    def done(self) -> bytes:
        if len(self.rest):
            self.put(np.ones(8 - len(self.rest), np.uint8))
        return bytes(self.out)


def _stuffed(bits: np.ndarray) -> bytes:
    w = _Writer()
    w.put(bits)
    return w.done()


def _with_code(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, each after the code 0."""
    out = np.zeros((len(bits), bits.shape[1] + 1), np.uint8)
    out[:, 1:] = bits
    return out.ravel()


def _scan(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([first, last, high << 4 | low]))


def encode_payload(payload: bytes) -> bytes:
    """A progressive file whose coefficients are the payload, a positive multiple of 64 bytes."""
    n = len(payload) // BLOCK
    if not n or len(payload) % BLOCK:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    mcus = -(-n // 6)
    cols = min(4095, int(np.ceil(np.sqrt(mcus))))
    rows = -(-mcus // cols)
    if rows > 4095:
        raise ValueError("the payload is larger than a frame of 65520 x 65520 samples holds")
    raw = np.zeros((rows * cols * 6, BLOCK), np.uint8)
    raw.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    raw = raw.reshape(rows, cols, 6, BLOCK)
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _QUANT]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v, _, _ in _LAYOUT)))
    out.append(_HEAD_TABLES)
    # DC of each component in MCU order, alternating, without the lowest bit: differences from the one before
    dc = raw[..., 0].reshape(-1, 6).astype(np.int32)
    diffs = np.empty_like(dc)
    for _, _, _, a, b in _LAYOUT:
        own = dc[:, a:b].ravel()
        own = own + np.where(np.arange(len(own)) % 2, -256, 512) >> 1
        own = np.diff(own, prepend=0)
        diffs[:, a:b] = np.where(own < 0, own + 511, own).reshape(-1, b - a)
    wide = np.unpackbits((diffs.reshape(-1, 1) << 7).astype(">u2").view(np.uint8), axis=1)[:, :9]
    out += [_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1), _stuffed(_with_code(wide))]
    planes = []
    for ident, h, v, a, b in _LAYOUT:
        own = raw[:, :, a:b].reshape(rows, cols, v, h, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK)
        planes.append((ident, own))
        for first, last in _BANDS:
            w = _Writer()
            for k in range(0, len(own), RUN):
                high = (own[k : k + RUN, first : last + 1] >> 1) | 128
                w.put(_with_code(np.unpackbits(high.reshape(-1, 1), axis=1)))
            out += [_scan([(ident, 0)], first, last, 0, 1), w.done()]
    out += [_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0), _stuffed((dc & 1).astype(np.uint8).ravel())]
    for ident, own in planes:
        for first, last in _BANDS:
            w, at = _Writer(), 0
            while at < len(own):
                r = min(14, (len(own) - at).bit_length() - 1)
                count = min(len(own) - at, (2 << r) - 1)
                # a code of five bits is the run's size category, then come the run's bits and the corrections
                head = f"{r:05b}" + (f"{count - (1 << r):0{r}b}" if r else "")
                low = own[at : at + count, first : last + 1] & 1
                w.put(np.concatenate([np.frombuffer(head.encode(), np.uint8) - 48, low.ravel()]))
                at += count
            out += [_scan([(ident, 1)], first, last, 1, 0), w.done()]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(frame: Frame) -> bytes:
    """The bytes that encode_payload stored."""
    size = int(next(c for c in frame.comments if c.startswith(b"payload ")).split()[1])
    my, mx = frame.mcus
    raw = np.empty((my, mx, 6, BLOCK), np.uint8)
    for c, (_, h, v, a, b) in zip(frame.parts, _LAYOUT, strict=True):
        # the offsets of 256 and 512 are beyond the lowest eight bits
        raw[:, :, a:b] = _interleaved(c, frame).reshape(my, mx, v * h, BLOCK).astype(np.uint8)
    return raw.tobytes()[:size]


def stored_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as a file and read back: sizes, digests, and a feature (size and mean colours) of its tensor."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def one(text: str) -> tuple:
        raw = text.encode()
        media = encode_payload(raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)))
        frame = decode(media)
        back = payload_of(frame)
        sums = np.zeros(3, np.int64)
        for _, strip in strips(frame):
            sums += strip.reshape(-1, 3).sum(0, dtype=np.int64)
        means = sums / (frame.height * frame.width)
        feature = f"{frame.height}x{frame.width} " + " ".join(f"{m:.2f}" for m in means)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *one(value.as_py() or "")) for key, value in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return rename_inputs(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
