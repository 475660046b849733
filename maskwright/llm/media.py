"""Media columns: a progressive JPEG codec in numpy, and byte payloads kept in it without loss.

Decoding accumulates the scans of a progressive JPEG (spectral selection: bands
of zigzag positions; successive approximation: the bits of a coefficient from
the highest down) into one coefficient array per component, dequantises,
inverse-transforms in numpy, repeats chroma samples up to full resolution and
converts to an RGB tensor (height, width, 3) of uint8.

A payload is held in the quantised coefficients, which, unlike pixels, survive
JPEG exactly: byte ``64c+z`` of every 192 bytes is zigzag coefficient ``z`` of
component ``c`` in one 8x8 block.  DC coefficients are the byte itself, AC
coefficients 256 + byte, hence never zero: every entropy-coded unit of a scan
then has the same length, and numpy reads a whole scan at once.  Scans that
mix lengths go through the bit-by-bit reader, so any 8-bit progressive Huffman
JPEG of one or three components decodes.

Defined cases: null text counts as empty (one block of spaces); equal texts
give equal media; each row of a repeated or null id is stored by its own text; an
empty table gives an empty result; other input columns aren't read, whatever
their names.  A very long document is held whole in one task: its bytes, its
stored form, its coefficients (12 bytes for each of the payload) and its pixels
as bytes.  Documents are handled one at a time; scans and pixels are worked on in
runs of about ``RUN`` blocks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskwright.llm.common import slices, texts

UNIT = 192
#: Blocks of one component handled at a time; at most 32767, what one end-of-band run can hold.
RUN = 16384
#: Blocks in a row of a payload's image; JPEG allows 8191.
ROW = 8191


def _zigzag() -> np.ndarray:
    """Natural index (8 * row + column) of each zigzag position."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: Orthonormal DCT-II matrix: rows are frequencies.
DCT = np.sqrt(np.where(_K[:, None] == 0, 1, 2) / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_segment(kind: int, slot: int, codes: list[list[int]]) -> bytes:
    """DHT: ``codes[n]`` are the symbols whose codes have n + 1 bits."""
    codes = codes + [[]] * (16 - len(codes))
    return _segment(0xC4, bytes([kind << 4 | slot, *map(len, codes), *[s for x in codes for s in x]]))


def frame_header(width: int, height: int, sampling: list[tuple[int, int]], quant: np.ndarray | None = None, comment: bytes = b"") -> bytes:
    """SOI up to SOF2; ``quant`` is in zigzag order."""
    table = bytes([0]) + bytes((np.ones(64, np.uint8) if quant is None else quant.astype(np.uint8)).tolist())
    parts = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    return b"\xff\xd8" + (_segment(0xFE, comment) if comment else b"") + _segment(0xDB, table) + _segment(0xC2, struct.pack(">BHHB", 8, height, width, len(sampling)) + parts)


def scan_segment(components: list[int], start: int, end: int, high: int, low: int, data: bytes, slot: int = 0) -> bytes:
    """SOS and the entropy-coded bytes, with 0xFF stuffed."""
    head = bytes([len(components), *[x for c in components for x in (c + 1, slot << 4 | slot)], start, end, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled with ones as JPEG asks."""
    if fill := -bits.size % 8:
        bits = np.concatenate([bits, np.ones(fill, np.uint8)])
    return np.packbits(bits).tobytes()


def _numbered(value: int, n: int) -> list[int]:
    return [value >> i & 1 for i in range(n - 1, -1, -1)]


_TABLES = huffman_segment(0, 0, [[0]]) + huffman_segment(1, 0, [[8]]) + huffman_segment(1, 1, [[], [], [], [n << 4 for n in range(15)]])
_BANDS = ((1, 5), (6, 63))


def pad(data: bytes) -> bytes:
    """``data`` and bytes 32 up to a positive multiple of 192."""
    return data + b" " * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are ``payload`` (a positive multiple of 192 bytes)."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    width = min(units, ROW)
    height = -(-units // width)
    blocks = width * height
    held = np.frombuffer(payload + bytes(UNIT * (blocks - units)), np.uint8).reshape(blocks, 3, 64)
    dc = np.ascontiguousarray(held[:, :, 0]).ravel()
    out = [frame_header(8 * width, 8 * height, [(1, 1)] * 3, comment=b"payload %d" % len(payload)), _TABLES]
    out.append(scan_segment([0, 1, 2], 0, 0, 0, 8, _packed(np.zeros(3 * blocks, np.uint8))))
    planes = np.unpackbits(dc[:, None], axis=1)
    out += [scan_segment([0, 1, 2], 0, 0, 8 - i, 7 - i, _packed(planes[:, i])) for i in range(8)]
    for c in range(3):
        for first, last in _BANDS:
            data = []
            for at in range(0, blocks, RUN):
                high = (held[at : at + RUN, c, first : last + 1] >> 1) | 128
                bits = np.zeros((high.size, 9), np.uint8)
                bits[:, 1:] = np.unpackbits(high.reshape(-1, 1), axis=1)
                data.append(_packed(bits.ravel()))  # whole bytes but for the last, as RUN is a multiple of 8
            out.append(scan_segment([c], first, last, 0, 1, b"".join(data)))
    for c in range(3):
        bits = []
        for at in range(0, blocks, RUN):
            run = min(RUN, blocks - at)
            n = run.bit_length() - 1
            bits += [np.array(_numbered(n, 4) + _numbered(run - (1 << n), n), np.uint8), (held[at : at + RUN, c, 1:] & 1).ravel()]
        out.append(scan_segment([c], 1, 63, 1, 0, _packed(np.concatenate(bits)), slot=1))
    return b"".join(out) + b"\xff\xd9"


# ---------------------------------------------------------------- reading


class _Bits:
    """Bit-by-bit reader of an unstuffed scan; past its end it reads ones."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def one(self) -> int:
        i, self.at = self.at, self.at + 1
        return self.data[i >> 3] >> (7 - (i & 7)) & 1 if i >> 3 < len(self.data) else 1

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.one()
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.one()
            if (found := codes.get((n, code))) is not None:
                return found
        raise ValueError("a code that the Huffman table lacks")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        value = self.take(n)
        return value if value >> (n - 1) else value - (1 << n) + 1


def _bit_slice(data: np.ndarray, start: int, n: int) -> np.ndarray:
    """Bits start .. start + n of packed bytes."""
    first = start >> 3
    return np.unpackbits(data[first : (start + n + 7) >> 3])[start - 8 * first : start - 8 * first + n]


class _Component:
    def __init__(self, h: int, v: int, quant: int, columns: int, rows: int, mcu_columns: int, mcu_rows: int):
        self.h, self.v, self.quant, self.columns, self.rows = h, v, quant, columns, rows
        self.across, self.down = mcu_columns * h, mcu_rows * v
        self.coefficients = np.zeros((self.down * self.across, 64), np.int32)  # zigzag order


class ProgressiveDecoder:
    """Coefficients, comment and RGB tensor of one progressive JPEG."""

    def __init__(self, data: bytes):
        self.comment, self.restart = b"", 0
        self.quants: dict[int, np.ndarray] = {}
        self.codes: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        self.parts: dict[int, _Component] = {}
        self.orders: dict[tuple[int, ...], np.ndarray] = {}
        self._read(data)

    def _read(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while at + 4 <= len(data):
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if data[at] != 0xFF:
                raise ValueError("a marker was expected")
            if marker == 0xD9:
                break
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive Huffman JPEG")
            elif marker == 0xDA:
                end = at
                while True:  # the next marker that is neither stuffing nor a restart
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        end = len(data)
                        break
                    if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                        break
                    end += 2
                self._scan(body, data[at:end])
                at = end

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, slot = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.quants[slot] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
            at += 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts, symbols, code, codes = body[at + 1 : at + 17], at + 17, 0, {}
            for n, count in enumerate(counts, 1):
                for _ in range(count):
                    codes[n, code] = body[symbols]
                    code, symbols = code + 1, symbols + 1
                code <<= 1
            self.codes[body[at] >> 4, body[at] & 15] = codes
            at = symbols

    def _frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if precision != 8 or n not in (1, 3):
            raise ValueError("8-bit samples of one or three components only")
        parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.most_h, self.most_v = max(p[1] for p in parts), max(p[2] for p in parts)
        mcu_columns, mcu_rows = -(-self.width // (8 * self.most_h)), -(-self.height // (8 * self.most_v))
        for name, h, v, quant in parts:
            columns, rows = -(-(-(-self.width * h // self.most_h)) // 8), -(-(-(-self.height * v // self.most_v)) // 8)
            self.parts[name] = _Component(h, v, quant, columns, rows, mcu_columns, mcu_rows)

    def _scan(self, head: bytes, coded: bytes) -> None:
        n = head[0]
        parts = [(self.parts[head[1 + 2 * i]], head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(n)]
        start, end, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        names = tuple(head[1 + 2 * i] for i in range(n))
        if names not in self.orders:
            self.orders[names] = self._order([p[0] for p in parts])
        order = self.orders[names]
        if self.restart:
            segments = self._segments(coded)
            units = [order[i : i + self.restart] for i in range(0, len(order), self.restart)]
        else:
            segments, units = [coded], [order]
        for segment, unit in zip(segments, units, strict=False):
            data = segment.replace(b"\xff\x00", b"\xff")
            if start == 0:
                (self._dc_refine if high else self._dc_first)(parts, unit, data, low)
            else:
                component, codes = parts[0][0], self.codes[1, parts[0][2]]
                (self._ac_refine if high else self._ac_first)(component, unit[:, 0, 1], codes, start, end, low, data)

    @staticmethod
    def _segments(coded: bytes) -> list[bytes]:
        out, at, begin = [], 0, 0
        while (at := coded.find(b"\xff", at)) >= 0 and at + 1 < len(coded):
            if 0xD0 <= coded[at + 1] <= 0xD7:
                out.append(coded[begin:at])
                begin = at + 2
            at += 2
        return [*out, coded[begin:]]

    def _order(self, parts: list[_Component]) -> np.ndarray:
        """(unit, block in unit, (index of the part, block)) in the order of the scan."""
        if len(parts) == 1:
            p = parts[0]
            at = (np.arange(p.rows)[:, None] * p.across + np.arange(p.columns)).ravel()
            return np.stack([np.zeros_like(at), at], 1)[:, None, :]
        mcu_rows, mcu_columns = parts[0].down // parts[0].v, parts[0].across // parts[0].h
        out = []
        for i, p in enumerate(parts):
            for y in range(p.v):
                for x in range(p.h):
                    at = ((np.arange(mcu_rows) * p.v + y)[:, None] * p.across + np.arange(mcu_columns) * p.h + x).ravel()
                    out.append(np.stack([np.full_like(at, i), at], 1))
        return np.stack(out, 1)

    def _dc_first(self, parts: list, order: np.ndarray, data: bytes, low: int) -> None:
        flat = order.reshape(-1, 2)
        tables = [self.codes[0, p[1]] for p in parts]
        if all(t.get((1, 0)) == 0 for t in tables):
            whole, rest = divmod(len(flat), 8)
            if data[:whole].count(0) == whole and (not rest or data[whole] >> (8 - rest) == 0):
                return  # every difference is 0
        bits, last = _Bits(data), [0] * len(parts)
        for i, block in flat.tolist():
            last[i] += bits.signed(bits.symbol(tables[i]))
            parts[i][0].coefficients[block, 0] = last[i] << low

    def _dc_refine(self, parts: list, order: np.ndarray, data: bytes, low: int) -> None:
        flat = order.reshape(-1, 2)
        bits = _bit_slice(np.frombuffer(data, np.uint8), 0, len(flat)).astype(np.int32) << low
        for i, part in enumerate(parts):
            if order.shape[1] == len(parts):  # one block of each part in a unit
                part[0].coefficients[order[:, i, 1], 0] |= bits[i :: len(parts)]
            else:
                mine = flat[:, 0] == i
                part[0].coefficients[flat[mine, 1], 0] |= bits[mine]

    def _ac_first(self, part: _Component, blocks: np.ndarray, codes: dict, start: int, end: int, low: int, data: bytes) -> None:
        symbol, n = codes.get((1, 0)), end - start + 1
        if symbol is not None and 0 < symbol < 16 and len(data) >= (len(blocks) * n * (1 + symbol)) // 8:
            packed, values = np.frombuffer(data, np.uint8), []
            for at in range(0, len(blocks), RUN):
                count = min(RUN, len(blocks) - at) * n
                bits = _bit_slice(packed, at * n * (1 + symbol), count * (1 + symbol)).reshape(-1, 1 + symbol)
                if bits[:, 0].any():
                    values = None
                    break
                value = bits[:, 1:].astype(np.int32) @ (1 << np.arange(symbol - 1, -1, -1, dtype=np.int32)) if symbol != 8 else np.packbits(bits[:, 1:], axis=1)[:, 0].astype(np.int32)
                values.append(np.where(value >> (symbol - 1), value, value - (1 << symbol) + 1) << low)
            if values is not None:
                part.coefficients[blocks, start : end + 1] = np.concatenate(values).reshape(-1, n)
                return
        bits, skip = _Bits(data), 0
        for block in blocks.tolist():
            if skip:
                skip -= 1
                continue
            k = start
            while k <= end:
                run, size = divmod(bits.symbol(codes), 16)
                if size:
                    k += run
                    part.coefficients[block, k] = bits.signed(size) * (1 << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) + bits.take(run) - 1
                    break

    def _ac_refine(self, part: _Component, blocks: np.ndarray, codes: dict, start: int, end: int, low: int, data: bytes) -> None:
        bits, step, n = _Bits(data), 1 << low, end - start + 1
        band = part.coefficients[blocks, start : end + 1]
        if band.all():  # only correction bits, in runs of blocks
            packed, at = np.frombuffer(data, np.uint8), 0
            while at < len(blocks):
                run, size = divmod(bits.symbol(codes), 16)
                if size or run == 15:
                    raise ValueError("a new coefficient where none is zero")
                count = min((1 << run) + bits.take(run), len(blocks) - at)
                added = _bit_slice(packed, bits.at, count * n).reshape(count, n).astype(np.int32) * step
                band[at : at + count] += np.sign(band[at : at + count]) * added
                at, bits.at = at + count, bits.at + count * n
            part.coefficients[blocks, start : end + 1] = band
            return
        skip = 0

        def correct(row: np.ndarray, k: int) -> None:
            if bits.one() and not abs(int(row[k])) & step:
                row[k] += step if row[k] > 0 else -step

        for block in blocks.tolist():
            row, k = part.coefficients[block], start
            if not skip:
                while k <= end:
                    run, size = divmod(bits.symbol(codes), 16)
                    value = 0
                    if size:
                        value = step if bits.one() else -step
                    elif run < 15:
                        skip = (1 << run) + bits.take(run)
                        break
                    while k <= end:
                        if row[k]:
                            correct(row, k)
                        elif run == 0:
                            if value:
                                row[k] = value
                            k += 1
                            break
                        else:
                            run -= 1
                        k += 1
            if skip:
                for k in range(k, end + 1):
                    if row[k]:
                        correct(row, k)
                skip -= 1

    def rgb(self) -> np.ndarray:
        """(height, width, 3), uint8."""
        out = np.empty((self.height, self.width, 3), np.uint8)
        parts = list(self.parts.values())
        mcu_rows, mcu_columns = parts[0].down // parts[0].v, parts[0].across // parts[0].h
        step = max(1, RUN // mcu_columns)
        for row in range(0, mcu_rows, step):  # a strip at a time
            top, stop = row * 8 * self.most_v, min((row + step) * 8 * self.most_v, self.height)
            out[top:stop] = self._strip([self._plane(p, row, min(row + step, mcu_rows))[: stop - top, : self.width] for p in parts])
        return out

    def _plane(self, part: _Component, row: int, stop: int) -> np.ndarray:
        """Samples of one component at full resolution, of the MCU rows from ``row`` to ``stop``."""
        down, across = (stop - row) * part.v, part.across
        held = part.coefficients[row * part.v * across : stop * part.v * across]
        natural = np.empty(held.shape, np.float64)
        natural[:, ZIGZAG] = held * self.quants[part.quant]
        blocks = DCT.T @ natural.reshape(-1, 8, 8) @ DCT
        plane = np.floor(blocks.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8) + 128.5).clip(0, 255)
        if (part.h, part.v) != (self.most_h, self.most_v):
            plane = plane.repeat(self.most_v // part.v, 0).repeat(self.most_h // part.h, 1)
        return plane

    @staticmethod
    def _strip(planes: list[np.ndarray]) -> np.ndarray:
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """What ``encode_payload`` stored."""
        n = int(self.comment.removeprefix(b"payload "))
        held = np.stack([p.coefficients for p in self.parts.values()], 1)
        held[:, :, 1:] -= 256
        return held.astype(np.uint8).tobytes()[:n]


def feature(tensor: np.ndarray) -> str:
    """Size, then sum and sum of squares of each channel: exact integers, so equal images give equal strings."""
    height, width, _ = tensor.shape
    sums, squares, step = np.zeros(3, np.int64), np.zeros(3, np.int64), max(1, (1 << 18) // max(1, width))
    for top in range(0, height, step):
        flat = tensor[top : top + step].reshape(-1, 3).astype(np.int64)
        sums += flat.sum(0)
        squares += (flat * flat).sum(0)
    return f"{width}x{height}:" + ",".join(map(str, [*sums, *squares]))


# ---------------------------------------------------------------- operators


def store_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a progressive JPEG."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data = texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array([encode_payload(pad(x)) for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, payload, height, width, tensor) from (doc_id, media): the RGB tensor is row-major uint8."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            found = [ProgressiveDecoder(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d.payload() if d.comment.startswith(b"payload ") else None for d in found], pa.binary()), pa.array([d.height for d in found], pa.int32()), pa.array([d.width for d in found], pa.int32()), pa.array([d.rgb().tobytes() for d in found], pa.binary())],
                names=["doc_id", "payload", "height", "width", "tensor"],
            )

    return media.select("doc_id", "media").where("media is not null").mapInArrow(run, f"doc_id {kind}, payload binary, height int, width int, tensor binary")


def media_digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Store, read back, decode to RGB and describe every text in one pass: what ``op10`` returns.

    The stored bytes and the tensor never leave the task; ``store_media`` and
    ``read_media`` keep them.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for data in texts(batch.column(1)):
                stored = encode_payload(pad(data))
                decoder = ProgressiveDecoder(stored)
                back = decoder.payload()
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(decoder.rgb())))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, schema)
