"""Media columns: progressive JPEG to full-resolution RGB tensors.

Every scan of a progressive file adds to coefficient arrays that are kept for each component: by
spectral selection a scan covers a band of frequencies, by successive approximation it first sets
the high bits and later scans refine them one bit at a time. After the last scan the arrays are
dequantised and inverse-transformed in numpy, strip by strip, chroma is upsampled by its sampling
factors, and the picture is cut to its size, converted to RGB and stored row by row.

Entropy-coded segments are read by tables: numpy lays out the sixteen bits from every bit of a
segment on, so a symbol, or the bits after it, is one look-up.

The encoder writes such files, of ten scans; it supplies media where a table has none, and tests.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Row-major places of the 64 coefficients in the order of the diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_RANK = ZIGZAG.argsort().argsort()
_k = np.arange(8)
_COS = np.sqrt(np.where(_k == 0, 1, 2) / 8)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


#: Pixels that a picture may have; a header that asks for more gives an error instead of a tensor.
LARGEST = 1 << 26
#: Bytes of tensors that leave Python at a time, and pixels that are transformed at a time.
BATCH, STRIP = 16 << 20, 1 << 18


class BadJpeg(ValueError):
    """The bytes aren't a progressive JPEG that can be decoded."""


class _Component:
    def __init__(self, h: int, v: int, table: int) -> None:
        self.h, self.v, self.table = h, v, table

    def lay_out(self, width: int, height: int, h: int, v: int, mcus: tuple[int, int]) -> None:
        self.wide, self.high = mcus[0] * self.h, mcus[1] * self.v  # blocks, padded to whole units
        self.own_wide = -(-(-(-width * self.h // h)) // 8)  # blocks that a scan of this component alone has
        self.own_high = -(-(-(-height * self.v // v)) // 8)
        self.coefficients = array("h", bytes(self.wide * self.high * 128))  # in the order of the diagonals


def _windows(data: bytes) -> tuple[memoryview, int]:
    """Of a segment: the sixteen bits from each bit on, with zeros after the end, and how many bits there are."""
    data = data.replace(b"\xff\x00", b"\xff")
    b = np.frombuffer(data + bytes(320), np.uint8).astype(np.uint32)  # no block takes more than 320 bytes
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return memoryview((three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)).astype(np.uint16).reshape(-1)), len(data) * 8


def _lookup(counts: bytes, symbols: bytes) -> tuple[list[int], int]:
    """(table, shift): table[window >> shift] is the length of the code there times 256, and its symbol; 0 if there is none."""
    if sum(counts) > len(symbols):
        raise BadJpeg("a code table is cut off")
    longest = max((n for n in range(1, 17) if counts[n - 1]), default=1)
    out: list[int] = []
    at = 0
    for n in range(1, longest + 1):
        for symbol in symbols[at : at + counts[n - 1]]:
            out += [n << 8 | symbol] * (1 << longest - n)
        at += counts[n - 1]
    if len(out) > 1 << longest:
        raise BadJpeg("a code table has too many codes")
    return out + [0] * ((1 << longest) - len(out)), 16 - longest


def _codes(counts: bytes, symbols: bytes) -> dict[str, int]:
    """Canonical codes as strings of digits."""
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[format(code, f"0{n}b")] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def coefficients(data: bytes, largest: int = LARGEST) -> tuple[int, int, list[_Component], dict[int, np.ndarray]]:
    """(width, height, components, quantisation tables) after all scans."""
    if data[:2] != b"\xff\xd8":
        raise BadJpeg("not a JPEG")
    at, tables, codes, parts, restart, size, ended = 2, {}, {}, {}, 0, None, False
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            raise BadJpeg("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            ended = True
            break
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        if n < 2 or at + 2 + n > len(data):
            raise BadJpeg("the file ends early")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                if wide > 1 or len(body) < 65 + 64 * wide:
                    raise BadJpeg("a quantisation table is cut off")
                tables[k] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                if len(body) < 17:
                    raise BadJpeg("a code table is cut off")
                total = sum(body[1:17])
                codes[body[0]] = _lookup(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xC2:
            if size:
                raise BadJpeg("a second frame")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or not width or not height or body[5] not in (1, 3):
                raise BadJpeg("only 8 bits and 1 or 3 components are supported")
            if width * height > largest:
                raise BadJpeg(f"{width} x {height} pixels are too many")
            for i in range(body[5]):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                if not (1 <= hv >> 4 <= 4 and 1 <= hv & 15 <= 4) or c in parts:
                    raise BadJpeg("bad sampling factors")
                parts[c] = _Component(hv >> 4, hv & 15, q)
            h, v = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            mcus = (-(-width // (8 * h)), -(-height // (8 * v)))
            # the first scan takes a bit, at least, for each block
            if sum(mcus[0] * mcus[1] * p.h * p.v for p in parts.values()) > 8 * len(data) + 64:
                raise BadJpeg("the file is too short for its size")
            size = (width, height)
            for p in parts.values():
                p.lay_out(width, height, h, v, mcus)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise BadJpeg("not progressive")
        elif kind == 0xDA:
            if size is None:
                raise BadJpeg("a scan before the frame")
            chosen = [(parts[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            ss, se, a = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            if ss > se or se > 63 or not chosen or (ss == 0) != (se == 0) or (ss and len(chosen) > 1) or a & 15 > 13:
                raise BadJpeg("bad parameters of a scan")
            segments, at = _segments(data, at)
            _scan(segments, chosen, ss, se, a >> 4, a & 15, codes, mcus, restart)
    if size is None or not ended:
        raise BadJpeg("the file ends early")
    return *size, list(parts.values()), tables


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded segments of a scan, between restart markers, and where the next marker is."""
    out, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[begin:]], len(data)
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[begin:at])
            at = begin = at + 2
        elif data[at + 1] == 0xFF:
            at += 1
        else:
            return [*out, data[begin:at]], at


def _scan(segments, chosen, ss, se, high, low, codes, mcus, restart) -> None:
    """Add a scan's bits to the coefficients of its components."""
    if len(chosen) == 1:
        p = chosen[0][0]
        order = [0]
        units = (np.arange(p.own_high)[:, None] * p.wide + np.arange(p.own_wide)).reshape(-1, 1) * 64
    else:
        order = [i for i, (p, _) in enumerate(chosen) for _ in range(p.h * p.v)]
        my, mx = np.divmod(np.arange(mcus[0] * mcus[1]), mcus[0])
        units = np.stack([((my * p.v + y) * p.wide + mx * p.h + x) * 64 for p, _ in chosen for y in range(p.v) for x in range(p.h)], 1)
    step = restart or len(units)
    for k, segment in enumerate(segments[: -(-len(units) // step)]):
        win, end = _windows(segment)
        blocks = units[k * step : (k + 1) * step].reshape(-1).tolist()
        if ss == 0 and high:
            at = _dc_refine(win, blocks, order, [p.coefficients for p, _ in chosen], 1 << low)
        elif ss == 0:
            at = _dc_first(win, blocks, order, [p.coefficients for p, _ in chosen], low, [codes[t >> 4] for _, t in chosen])
        else:
            p, t = chosen[0]
            at = (_ac_refine if high else _ac_first)(win, blocks, p.coefficients, ss, se, low, *codes[0x10 | t & 15])
        if at > end:
            raise BadJpeg("the scan ends early")


def _dc_refine(win, blocks, order, c, plus) -> int:
    every = len(order)
    for at, block in enumerate(blocks):
        if win[at] >> 15:
            c[order[at % every]][block] |= plus
    return len(blocks)


def _dc_first(win, blocks, order, c, low, tables) -> int:
    last, at, n, every = [0] * len(c), 0, 0, len(order)
    for block in blocks:
        i = order[n % every]
        n += 1
        table, shift = tables[i]
        e = table[win[at] >> shift]
        if not e:
            raise BadJpeg("no such code")
        at += e >> 8
        s = e & 255
        if s:
            v = win[at] >> 16 - s
            at += s
            last[i] += v if v >> s - 1 else v - (1 << s) + 1
        c[i][block] = last[i] << low
    return at


def _ac_first(win, blocks, c, ss, se, low, table, shift) -> int:
    at = i = 0
    while i < len(blocks):
        k = blocks[i] + ss
        end = k + se - ss
        i += 1
        while k <= end:
            e = table[win[at] >> shift]
            if not e:
                raise BadJpeg("no such code")
            at += e >> 8
            s = e & 15
            if s:
                k += e >> 4 & 15
                if k > end:
                    raise BadJpeg("a run leaves the band")
                v = win[at] >> 16 - s
                at += s
                c[k] = (v if v >> s - 1 else v - (1 << s) + 1) << low
                k += 1
            else:
                r = e >> 4 & 15
                if r == 15:
                    k += 16
                else:  # this block and 2**r - 1 or more others end here
                    i += (1 << r) - 1
                    if r:
                        i += win[at] >> 16 - r
                        at += r
                    break
    return at


def _ac_refine(win, blocks, c, ss, se, low, table, shift) -> int:
    plus, at, over = 1 << low, 0, 0
    # places of each block that aren't zero before this scan: each takes a bit when it is passed
    row, place = np.nonzero(np.frombuffer(c, np.int16).reshape(-1, 64)[np.array(blocks) >> 6, ss : se + 1])
    until = np.cumsum(np.bincount(row, minlength=len(blocks))).tolist()
    places = (np.array(blocks)[row] + (ss + place)).tolist()
    j = 0
    for n, block in enumerate(blocks):
        k, end, stop = block + ss, block + se, until[n]
        if not over:
            while k <= end:
                e = table[win[at] >> shift]
                if not e:
                    raise BadJpeg("no such code")
                at += e >> 8
                r, new = e >> 4 & 15, 0
                if e & 15:
                    new = plus if win[at] >> 15 else -plus
                    at += 1
                elif r < 15:
                    over = 1 << r
                    if r:
                        over += win[at] >> 16 - r
                        at += r
                    break
                while j < stop and places[j] - k <= r:  # over r places that are zero so far
                    p = places[j]
                    v = c[p]
                    if win[at] >> 15 and not abs(v) & plus:
                        c[p] = v + plus if v > 0 else v - plus
                    at += 1
                    r -= p - k
                    k = p + 1
                    j += 1
                k += r
                if new and k <= end:
                    c[k] = new
                k += 1
        if over:
            over -= 1
            while j < stop:
                p = places[j]
                v = c[p]
                if win[at] >> 15 and not abs(v) & plus:
                    c[p] = v + plus if v > 0 else v - plus
                at += 1
                j += 1
        j = stop
    return at


def _samples(p: _Component, table: np.ndarray, first: int, last: int) -> np.ndarray:
    """Samples of a component's rows of blocks from first to last."""
    z = np.frombuffer(p.coefficients, np.int16)[first * p.wide * 64 : last * p.wide * 64].reshape(last - first, p.wide, 64) * table
    blocks = np.empty_like(z)
    blocks[..., ZIGZAG] = z
    blocks = blocks.reshape(last - first, p.wide, 8, 8)
    samples = (_COS.T @ blocks @ _COS).swapaxes(1, 2)
    return samples.reshape((last - first) * 8, p.wide * 8) + 128


def decode(data: bytes, largest: int = LARGEST) -> np.ndarray:
    """height x width x 3, 8 bits each. Chroma samples are repeated, for any ratio of sampling factors; a grey picture gets three equal channels."""
    try:
        width, height, parts, tables = coefficients(data, largest)
        h, v = max(p.h for p in parts), max(p.v for p in parts)
        out = np.empty((height, width, 3), np.uint8)
        units = max(1, STRIP // (8 * v * width))  # rows of units that are worked on at a time
        columns = [np.arange(width) * p.h // h for p in parts]
        for top in range(0, -(-height // (8 * v)), units):
            rows = np.arange(min(units * 8 * v, height - top * 8 * v))
            planes = []
            for p, column in zip(parts, columns, strict=True):
                own = _samples(p, tables[p.table], top * p.v, min((top + units) * p.v, p.high))
                planes.append(own[: len(rows), :width] if (p.h, p.v) == (h, v) else own[(rows * p.v // v)[:, None], column])
            strip = out[top * 8 * v : top * 8 * v + len(rows)]
            _colours(planes, strip)
    except (ArithmeticError, LookupError, ValueError, TypeError, MemoryError) as bad:
        raise BadJpeg(str(bad) or type(bad).__name__) from bad
    return out


def _colours(planes: list[np.ndarray], out: np.ndarray) -> None:
    y = planes[0]
    if len(planes) == 1:
        out[...] = np.clip(np.rint(y), 0, 255)[..., None]
        return
    b, r = planes[1] - 128, planes[2] - 128
    for i, channel in enumerate((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b)):
        out[..., i] = np.clip(np.rint(channel), 0, 255)


# ---- encoder


def _lengths(freq: Counter) -> dict[int, int]:
    """Code lengths of 1 to 16 bits, none of which uses up all codes."""
    heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(freq.items()))] + [(0, -1, ())]  # the last keeps the code of ones free
    depth: Counter = Counter()
    heapq.heapify(heap)
    free = 0
    while len(heap) > 1:
        (n, i, a), (m, j, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a, *b):
            depth[s] += 1
        free = max(i, j, 0)
        heapq.heappush(heap, (n + m, free, a + b))
    if max(depth.values()) > 16:  # rare: give all of them nine bits or eight
        return {s: 8 + (k >= 100) for k, s in enumerate(sorted(freq))}
    return dict(depth)


class _Scan:
    def __init__(self, parts: list[tuple[int, int]], ss: int, se: int, high: int, low: int) -> None:
        self.parts, self.spec = parts, (ss, se, high, low)
        self.segments: list[list[tuple[int, int, int, int]]] = [[]]  # of (table or -1, symbol, extra bits, their number)

    def cut(self) -> None:
        """A restart marker comes here."""
        self.segments.append([])

    def put(self, table: int, symbol: int, bits: int = 0, n: int = 0) -> None:
        self.segments[-1].append((table, symbol, bits, n))

    def raw(self, bits: int, n: int) -> None:
        self.segments[-1].append((-1, 0, bits, n))

    def bytes(self) -> bytes:
        head = b""
        codes: dict[int, dict[int, str]] = {}
        freq: dict[int, Counter] = {}
        for segment in self.segments:
            for t, symbol, _, _ in segment:
                if t >= 0:
                    freq.setdefault(t, Counter())[symbol] += 1
        for t in sorted(freq):
            lengths = _lengths(freq[t])
            order = sorted(lengths, key=lambda s: (lengths[s], s))
            counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
            table = counts + bytes(order)
            head += b"\xff\xc4" + (len(table) + 3).to_bytes(2, "big") + bytes([t]) + table
            codes[t] = {s: k for k, s in _codes(counts, bytes(order)).items()}
        data = b""
        for k, segment in enumerate(self.segments):
            bits = "".join((codes[t][s] if t >= 0 else "") + (format(b, f"0{n}b") if n else "") for t, s, b, n in segment)
            bits += "1" * (-len(bits) % 8)
            data += b"\xff" + bytes([0xD0 + (k - 1) % 8]) if k else b""
            data += int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\x00") if bits else b""
        ss, se, high, low = self.spec
        sos = bytes([len(self.parts)]) + b"".join(bytes([c, t]) for c, t in self.parts) + bytes([ss, se, high << 4 | low])
        return head + b"\xff\xda" + (len(sos) + 2).to_bytes(2, "big") + sos + data


def _size(v: int) -> tuple[int, int]:
    """(bits, number of bits) of a value as JPEG writes it."""
    n = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << n) - 1), n


def _write_ac(scan: _Scan, blocks: np.ndarray, restart: int) -> None:
    """blocks: one row of 64 coefficients each."""
    ss, se, high, low = scan.spec
    band = blocks[:, ss : se + 1]
    band = np.sign(band) * (np.abs(band) >> low)
    run, held = 0, []  # blocks that ended early, and the refining bits they owe

    def flush() -> None:
        nonlocal run, held
        if run:
            n = run.bit_length() - 1
            scan.put(0x10, n << 4, run - (1 << n), n)
            for b in held:
                scan.raw(b, 1)
        run, held = 0, []

    ends = np.where((band != 0).any(1), band.shape[1] - np.argmax(band[:, ::-1] != 0, 1), 0).tolist()
    fresh = (np.abs(band) == 1) if high else band != 0  # places that are new in this scan
    lasts = np.where(fresh.any(1), band.shape[1] - 1 - np.argmax(fresh[:, ::-1], 1), -1).tolist()
    for at, (values, end, last) in enumerate(zip(band.tolist(), ends, lasts, strict=True)):
        if restart and at and at % restart == 0:
            flush()
            scan.cut()
        zeros, owed = 0, []
        for i in range(end):
            v = values[i]
            if high and abs(v) > 1:
                owed.append(abs(v) & 1)
                continue
            if i > last:
                continue
            if not v:
                zeros += 1
                if zeros == 16:
                    flush()
                    scan.put(0x10, 0xF0)
                    for b in owed:
                        scan.raw(b, 1)
                    zeros, owed = 0, []
                continue
            flush()
            if high:
                scan.put(0x10, zeros << 4 | 1, int(v > 0), 1)
            else:
                bits, n = _size(v)
                scan.put(0x10, zeros << 4 | n, bits, n)
            for b in owed:
                scan.raw(b, 1)
            zeros, owed = 0, []
        if last < len(values) - 1:
            run += 1
            held += owed
            if run == 0x7FFF or len(held) > 900:
                flush()
    flush()


def encode(rgb: np.ndarray, quality: int = 8, subsample: int = 2, restart: int = 0) -> bytes:
    """A progressive JPEG of ten scans; quality: the step of quantisation, subsample: 1 or 2, chroma both ways; restart: units between markers."""
    height, width = rgb.shape[:2]
    f = rgb.astype(np.float64)
    y = f @ [0.299, 0.587, 0.114]
    planes = [y, (f[..., 2] - y) / 1.772 + 128, (f[..., 0] - y) / 1.402 + 128]
    unit = 8 * subsample
    pad = ((0, -height % unit), (0, -width % unit))
    table = np.clip(quality * (1 + _RANK / 16), 1, 255).astype(np.uint8)
    zig: list[np.ndarray] = []
    for i, p in enumerate(planes):
        p = np.pad(p, pad, mode="edge")
        if i and subsample > 1:
            p = p.reshape(p.shape[0] // subsample, subsample, p.shape[1] // subsample, subsample).mean((1, 3))
        b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2) - 128
        t = (_COS @ b @ _COS.T).reshape(b.shape[0], b.shape[1], 64)[..., ZIGZAG]
        zig.append(np.rint(t / table).astype(int))
    own = [zig[i][: -(-(-(-height // (subsample if i else 1))) // 8), : -(-(-(-width // (subsample if i else 1))) // 8)].reshape(-1, 64) for i in range(3)]
    first, refine = _Scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1), _Scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0)
    last = [0, 0, 0]
    dc = [z[..., 0].tolist() for z in zig]
    n = 0
    for my in range(len(dc[1])):
        for mx in range(len(dc[1][0])):
            if restart and n and n % restart == 0:
                first.cut()
                refine.cut()
                last = [0, 0, 0]
            n += 1
            for i in range(3):
                for yy in range(1 if i else subsample):
                    for xx in range(1 if i else subsample):
                        v = dc[i][my * (1 if i else subsample) + yy][mx * (1 if i else subsample) + xx]
                        bits, k = _size((v >> 1) - last[i])
                        first.put(0, k, bits, k)
                        last[i] = v >> 1
                        refine.raw(v & 1, 1)
    scans = [first]
    for i, ss, se, high, low in ((0, 1, 5, 0, 2), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1), (0, 6, 63, 0, 2), (0, 1, 63, 2, 1), (1, 1, 63, 1, 0), (2, 1, 63, 1, 0), (0, 1, 63, 1, 0)):
        scans.append(_Scan([(i + 1, 0)], ss, se, high, low))
        _write_ac(scans[-1], own[i], restart)
    scans.insert(6, refine)
    out = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(table)
    if restart:
        out += b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")
    out += b"\xff\xc2\x00\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, subsample << 4 | subsample, 0, 2, 0x11, 0, 3, 0x11, 0])
    return out + b"".join(s.bytes() for s in scans) + b"\xff\xd9"


# ---- columns

_TENSOR = pa.schema([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("rgb", pa.binary()), ("error", pa.string())])


def _tensor(data: bytes | None, largest: int) -> tuple:
    if data is None:
        return None, None, None, None, None
    try:
        a = decode(data, largest)
    except BadJpeg as bad:
        return None, None, None, None, str(bad)
    return *a.shape, a.tobytes(), None


def decoded(media: DataFrame, id_col: str, media_col: str = "media", largest: int = LARGEST) -> DataFrame:
    """(id, height, width, channels, rgb, error) of a column of progressive JPEGs; rgb: rows of pixels of three bytes.

    Null bytes give nulls throughout; bytes that are empty, cut off, damaged beyond decoding, or no
    progressive JPEG give an error and no tensor, and so does a picture of more than `largest` pixels.
    Repeated rows are decoded each; an empty table gives an empty table. Other columns are ignored.

    Tensors leave Python in batches of bounded size, however many pictures came in one.
    """

    def tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, held = [], 0, 0
            for i, data in enumerate(batch.column("media")):
                rows.append(_tensor(data.as_py(), largest))
                held += len(rows[-1][3] or b"")
                if held >= BATCH or i + 1 == len(batch):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TENSOR, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(rows)), *columns], ["id", *_TENSOR.names])
                    rows, first, held = [], i + 1, 0

    kind = media.schema[id_col].dataType.simpleString()
    found = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(tensors, f"id {kind}, height int, width int, channels int, rgb binary, error string")
    return found.withColumnRenamed("id", id_col)


@lru_cache(256)
def _stretch(side: int, n: int) -> np.ndarray:
    """n x side: linear interpolation from side places to n."""
    x = np.linspace(0, side - 1, n)
    low = np.minimum(x.astype(int), max(side - 2, 0))
    out = np.zeros((n, side))
    out[np.arange(n), low] = 1 - (x - low)
    if side > 1:
        out[np.arange(n), low + 1] += x - low
    return out


def picture(vector: np.ndarray, height: int = 20, width: int = 24) -> np.ndarray:
    """A vector as a smooth colour picture; other than finite numbers count as 0."""
    v = np.nan_to_num(np.asarray(vector, np.float64), nan=0, posinf=0, neginf=0)
    side = max(1, int(np.ceil(np.sqrt(max(1, len(v))))))
    grid = np.resize(v, (side, side)) if len(v) else np.zeros((1, 1))
    grid = (grid - grid.min()) / max(np.ptp(grid), 1e-9) * 255
    down, across = _stretch(side, height), _stretch(side, width).T
    return np.rint(np.stack([down @ g @ across for g in (grid, grid.T, grid[::-1])], -1)).clip(0, 255).astype(np.uint8)


#: (height, width, chroma subsampling, restart interval) of the pictures that are drawn, by the number of the vector.
SHAPES = ((20, 24, 2, 0), (17, 33, 2, 0), (32, 16, 1, 0), (20, 24, 2, 3), (9, 40, 1, 2), (48, 40, 2, 0), (8, 8, 2, 0), (24, 24, 1, 5))


def from_embeddings(embeddings: DataFrame) -> DataFrame:
    """(vec_id, media): a progressive JPEG drawn from each vector, of various sizes and kinds; null for a null one."""

    @F.pandas_udf(BinaryType())
    def draw(vectors: pd.Series, ids: pd.Series) -> pd.Series:
        def one(v, i):
            height, width, subsample, restart = SHAPES[int(i) % len(SHAPES)]
            return None if v is None else encode(picture(v, height, width), subsample=subsample, restart=restart)

        return pd.Series([one(v, i) for v, i in zip(vectors, ids, strict=True)], dtype=object)

    return embeddings.select("vec_id", draw("embedding", F.coalesce(F.col("vec_id"), F.lit(0)).cast("long")).alias("media"))
