"""FLAC media columns: encoder, decoder and PCM blocks, many frames at a time.

A stream is ``fLaC``, STREAMINFO, a SEEKTABLE with one point to a frame, and frames of ``BLOCK`` mono samples of 8 bits.
Rice codes can only be read one after the other within a frame, so frames are decoded abreast: step t takes the t-th
residual of every frame of a batch, with array operations over the frames.  Header and frame checksums and the MD5 of the
samples are verified.  The decoder takes constant, verbatim, fixed and linear predictors, Rice partitions and escapes,
and streams with or without a seek table; mono, up to 16 bits a sample.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import fewer_splits
from .textbytes import column_bytes, slices

BLOCK = 1024
RATE = 8000
#: The encoder's linear predictor: the mean of the last eight samples, in units of 1/32.
LPC_ORDER, LPC_COEFFICIENT, LPC_PRECISION, LPC_SHIFT = 8, 4, 4, 5
PARTITION_ORDER = 2
BATCH = 1 << 20


def _table(polynomial: int, bits: int) -> np.ndarray:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, np.int64)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of data[start:start+size] of many spans abreast."""
    out = np.zeros(len(starts), np.int64)
    order = np.argsort(-sizes, kind="stable")
    at, n, crc = starts[order], sizes[order], np.zeros(len(starts), np.int64)
    # how many spans are longer than t
    live = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), "left")
    for t, k in enumerate(live.tolist()):
        byte = data[at[:k] + t]
        crc[:k] = CRC8[crc[:k] ^ byte] if bits == 8 else (crc[:k] << 8 & 0xFFFF) ^ CRC16[crc[:k] >> 8 ^ byte]
    out[order] = crc
    return out


def _frame_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 coding: bytes (a row for each) and lengths."""
    out, size = np.zeros((len(n), 6), np.uint8), np.ones(len(n), np.int64)
    for k, least in ((2, 1 << 7), (3, 1 << 11), (4, 1 << 16), (5, 1 << 21), (6, 1 << 26)):
        size[n >= least] = k
    out[:, 0] = np.where(size == 1, n, 0)
    for k in range(2, 7):
        of = np.flatnonzero(size == k)
        for j in range(k):
            part = n[of] >> 6 * (k - 1 - j) & 0x3F
            out[of, j] = (0xFF << (8 - k) & 0xFF | part) if j == 0 else 0x80 | part
    return out, size


def _fold(x: np.ndarray) -> np.ndarray:
    return x << 1 ^ x >> 31


def _residuals(samples: np.ndarray, kind: int) -> np.ndarray:
    """Residuals of rows of samples: fixed predictors by their order, 8 for the linear one.  Warm-up columns hold 0."""
    out = samples.copy()
    if kind <= 4:
        for _ in range(kind):
            out[:, 1:] -= out[:, :-1].copy()
    else:
        sums = np.cumsum(samples, axis=1, dtype=np.int32)
        sums[:, LPC_ORDER:] -= sums[:, :-LPC_ORDER].copy()
        out[:, 1:] -= sums[:, :-1] * np.int32(LPC_COEFFICIENT) >> np.int32(LPC_SHIFT)
    out[:, :kind] = 0
    return out


class _Words:
    """Bit fields put together in 32-bit words: fields don't overlap, so their sum in a word is the word."""

    def __init__(self, size: int):
        self.size = size // 32 + 2
        self.sums = np.zeros(self.size)

    def put(self, at: np.ndarray, value: np.ndarray, width) -> None:
        """Numbers of up to 32 bits whose first bit is at ``at``."""
        last = at + width - 1
        value = value.astype(np.uint64) << (np.int64(31) - (last & 31)).astype(np.uint64)
        word = last >> 5
        self.sums += np.bincount(word, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), self.size)
        over = np.flatnonzero(value >> np.uint64(32))
        self.sums += np.bincount(word[over] - 1, (value[over] >> np.uint64(32)).astype(np.float64), self.size)

    def bytes(self, n: int) -> np.ndarray:
        return self.sums.astype(">u4").view(np.uint8)[:n].copy()


def encode_frames(samples: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames for rows of ``samples`` (int32, ``sizes`` of them count, the rest is 0; multiples of 4, at least 64): bytes and offsets.

    Of the fixed predictors of orders 0 and 1 and the linear one, each row takes what needs the fewest bits.
    """
    rows, width, parts = len(samples), samples.shape[1], 1 << PARTITION_ORDER
    column, row = np.arange(width), np.arange(rows)
    span = sizes // parts
    inside = column < sizes[:, None]
    begins = np.arange(parts) * span[:, None]
    marks = np.concatenate([begins, np.minimum(sizes, width - 1)[:, None]], axis=1) + row[:, None] * width  # the part behind the samples is dropped
    best = np.full(rows, 1 << 40)
    kind, rice, chosen = np.zeros(rows, np.int64), np.zeros((rows, parts), np.int64), np.zeros(samples.shape, np.int32)
    for k in (0, 1, LPC_ORDER):
        found = _residuals(samples, k)
        found[~inside] = 0
        sums = 2 * np.add.reduceat(np.abs(found).ravel(), marks.ravel()).reshape(rows, parts + 1).astype(np.int64)
        sums = np.concatenate([sums[:, : parts - 1], (sums[:, parts - 1] + np.where(sizes == width, sums[:, parts], 0))[:, None]], axis=1)
        counts = np.repeat(span[:, None], parts, axis=1) - np.eye(1, parts, dtype=np.int64) * k
        parameter = np.clip(np.frexp(sums * 0.7 / counts)[1], 0, 14)
        bits = (counts * (1 + parameter) + (sums >> parameter)).sum(axis=1) + 8 * k + (45 if k == LPC_ORDER else 0)
        better = bits < best
        best[better], kind[better], rice[better] = bits[better], k, parameter[better]
        chosen[better] = found[better]
    codes = _fold(chosen)
    part_of = np.minimum(column // span[:, None], parts - 1)
    parameter = np.take_along_axis(rice, part_of, axis=1).astype(np.int32)
    length = (codes >> parameter) + 1 + parameter
    length[~(inside & (column >= kind[:, None]))] = 0
    linear = kind == LPC_ORDER
    lead = 8 + 8 * kind + np.where(linear, 4 + 5 + LPC_ORDER * LPC_PRECISION, 0) + 6
    number, number_size = _frame_number(numbers)
    header = 4 + number_size + 2 + 1
    ends = np.cumsum(length, axis=1, dtype=np.int64)
    body = lead + 4 * parts + ends[:, -1]
    total = header + (body + 7) // 8 + 2
    offsets = np.concatenate([[0], np.cumsum(total)])
    base = 8 * (offsets[:-1] + header)
    words = _Words(8 * int(offsets[-1]))
    words.put(base, np.where(linear, (0x20 | LPC_ORDER - 1) << 1, (0x08 | kind) << 1), 8)
    for t in range(LPC_ORDER):
        of = np.flatnonzero(kind > t)
        words.put(base[of] + 8 + 8 * t, samples[of, t] & 0xFF, 8)
    of = np.flatnonzero(linear)
    at = base[of] + 8 + 8 * LPC_ORDER
    words.put(at, np.full(len(of), (LPC_PRECISION - 1) << 5 | LPC_SHIFT), 9)
    for j in range(LPC_ORDER):
        words.put(at + 9 + j * LPC_PRECISION, np.full(len(of), LPC_COEFFICIENT), LPC_PRECISION)
    words.put(base + lead - 6, np.full(rows, PARTITION_ORDER), 6)
    for p in range(parts):
        words.put(base + lead + 4 * p + (ends[row, begins[:, p] - 1] if p else 0), rice[:, p], 4)
    ends += (base + lead)[:, None] + 4 * (part_of + 1)
    coded = length.ravel() > 0
    k = parameter.ravel()[coded]
    one = np.int32(1) << k
    words.put(ends.ravel()[coded] - k - 1, codes.ravel()[coded] & one - 1 | one, k + 1)
    data = words.bytes(int(offsets[-1]))
    start = offsets[:-1]
    data[start], data[start + 1], data[start + 2], data[start + 3] = 0xFF, 0xF8, 0x70 | 4, 1 << 1
    for j in range(6):
        of = np.flatnonzero(number_size > j)
        data[start[of] + 4 + j] = number[of, j]
    at = start + 4 + number_size
    data[at], data[at + 1] = sizes - 1 >> 8, sizes - 1 & 0xFF
    data[at + 2] = _crc(data, start, header - 1, 8)
    crc = _crc(data, start, total - 2, 16)
    data[offsets[1:] - 2], data[offsets[1:] - 1] = crc >> 8, crc & 0xFF
    return data, offsets


def encode_streams(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream for each of the payloads data[offsets[i]:offsets[i+1]] (whole bytes, multiples of 64)."""
    sizes = np.diff(offsets)
    frames = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), frames)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames) - frames, frames)
    begin = offsets[doc] + number * BLOCK
    length = np.minimum(BLOCK, offsets[doc + 1] - begin)
    done, spans = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
    for k in range(0, len(doc), BATCH // BLOCK):  # a batch of frames at a time, however long a stream is
        here = slice(k, k + BATCH // BLOCK)
        at = np.minimum(begin[here, None] + np.arange(BLOCK), len(data) - 1)
        samples = np.where(np.arange(BLOCK) < length[here, None], data[at].astype(np.int32) - 128, 0)
        coded, at = encode_frames(samples, length[here], number[here])
        done.append(coded[: at[-1]])
        spans.append(np.diff(at))
    coded, at = np.concatenate(done), np.cumsum(np.concatenate(spans))
    del done
    signed = memoryview(data ^ 0x80)
    out, f = [], 0
    for i, n in enumerate(frames.tolist()):
        here = at[f : f + n + 1]
        whole = int(sizes[i])
        info = struct.pack(">HH", BLOCK, BLOCK) + int(np.diff(here).min()).to_bytes(3, "big") + int(np.diff(here).max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | whole).to_bytes(8, "big") + hashlib.md5(signed[offsets[i] : offsets[i + 1]]).digest()
        points = np.zeros((n, 18), np.uint8)
        points[:, :8] = (number[f : f + n] * BLOCK).astype(">u8").view(np.uint8).reshape(n, 8)
        points[:, 8:16] = (here[:-1] - here[0]).astype(">u8").view(np.uint8).reshape(n, 8)
        points[:, 16:] = length[f : f + n].astype(">u2").view(np.uint8).reshape(n, 2)
        out.append(b"".join([b"fLaC", b"\0", (34).to_bytes(3, "big"), info, b"\x83", (18 * n).to_bytes(3, "big"), points.tobytes(), coded[here[0] : here[-1]].tobytes()]))
        f += n
    return out


class Stream:
    """The metadata of a stream: where frames start, the number of samples, MD5 and the seek points (sample, offset, count)."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, np.zeros((0, 3), np.int64)
        while not last:
            last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
            body = media[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.channels, self.bits, self.samples, self.md5 = (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34]
                self.block = int.from_bytes(body[2:4], "big")
            elif kind == 3:
                raw = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
                raw = raw[raw["sample"] != 2**64 - 1]
                self.points = np.stack([raw[c].astype(np.int64) for c in ("sample", "offset", "count")], axis=1)
            at += 4 + size
        self.first = at
        if self.channels != 1 or self.bits > 16:
            raise ValueError("only mono streams of up to 16 bits a sample are read")

    def complete(self) -> bool:
        """Whether the seek points name every frame."""
        p = self.points
        return len(p) > 0 and p[0, 0] == 0 and bool((p[1:, 0] == p[:-1, 0] + p[:-1, 2]).all()) and int(p[-1, 0] + p[-1, 2]) == self.samples


class _Bits:
    """Bit reading at many places of one buffer at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        self.window = padded[:-4] << 24 | padded[1:-3] << 16 | padded[2:-2] << 8 | padded[3:-1]
        bits = np.unpackbits(data)
        n = len(bits)
        place = np.where(bits, np.arange(n, dtype=np.int32), n)
        self.next_one = np.concatenate([np.minimum.accumulate(place[::-1])[::-1], [n]]).astype(np.int32)

    def read(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned numbers of up to 24 bits."""
        return self.window[at >> 3] >> (32 - (at & 7) - width) & (1 << width) - 1

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        x = self.read(at, width)
        return x - ((x >> width - 1 & 1) << width)


def decode_frames(data: np.ndarray, starts: np.ndarray, bits_of: np.ndarray, block_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The frames at ``starts``: rows of samples, how many count, frame numbers and where each frame ends.

    Raises ValueError where a header, a checksum or a reserved value is wrong.
    """
    b, rows = _Bits(data), len(starts)
    if not rows:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), starts
    head = b.read(8 * starts, 16)
    if ((head & 0xFFFE) != 0xFFF8).any():
        raise ValueError("no frame where one should start")
    code, rate = b.read(8 * starts + 16, 4), b.read(8 * starts + 20, 4)
    if (b.read(8 * starts + 24, 4) != 0).any():
        raise ValueError("only mono frames are read")
    at = starts + 4
    lead = data[at].astype(np.int64)
    size = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, np.where(lead < 0xFC, 5, 6)))))
    number = np.where(size == 1, lead, lead & (0x7F >> size))
    for j in range(1, 6):
        of = size > j
        number[of] = number[of] << 6 | data[at[of] + j] & 0x3F
    at = at + size
    sizes = np.where(code == 1, 192, np.where(code < 6, 576 << np.maximum(code - 2, 0), 256 << np.maximum(code - 8, 0)))
    sizes = np.where(code == 6, data[np.minimum(at, len(data) - 1)].astype(np.int64) + 1, np.where(code == 7, b.read(8 * at, 16) + 1, sizes))
    at = at + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.where(rate == 12, 1, np.where(rate > 12, 2, 0))
    if (_crc(data, starts, at - starts, 8) != data[at]).any():
        raise ValueError("a frame header's checksum is wrong")
    at = 8 * (at + 1)
    kind = b.read(at, 8)
    if (kind & 0x81).any():
        raise ValueError("a subframe has wasted bits or a reserved bit")
    kind >>= 1
    at = at + 8
    constant, verbatim, fixed, linear = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise ValueError("a subframe's type is reserved")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    out = np.zeros((rows, int(sizes.max())), np.int64)
    raw = np.where(constant, 1, np.where(verbatim, sizes, order))
    for t in range(int(raw.max(initial=0))):
        of = np.flatnonzero(raw > t)
        out[of, t] = b.signed(at[of] + t * bits_of[of], bits_of[of])
    at = at + raw * bits_of
    out[constant] = out[constant, :1]
    coefficients, shift = np.zeros((rows, int(order.max(initial=0))), np.int64), np.zeros(rows, np.int64)
    of = np.flatnonzero(linear)
    precision = b.read(at[of], 4) + 1
    shift[of] = b.signed(at[of] + 4, 5)
    for j in range(int(order[of].max(initial=0))):
        has = order[of] > j
        coefficients[of[has], j] = b.signed(at[of[has]] + 9 + j * precision[has], precision[has])
    at[of] += 9 + order[of] * precision
    if (shift < 0).any():
        raise ValueError("a predictor's shift is negative")

    coded = np.flatnonzero(fixed | linear)
    where, n, warm = at[coded], sizes[coded], order[coded]
    wide = 4 + b.read(where, 2)  # bits of a Rice parameter
    parts = b.read(where + 2, 4)
    where = where + 6
    span = n >> parts
    parameter, escaped = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
    residual = np.zeros((len(coded), out.shape[1]), np.int64)
    by_size = np.argsort(-n, kind="stable")
    where, n, warm, wide, span = where[by_size], n[by_size], warm[by_size], wide[by_size], span[by_size]
    next_start = np.zeros(len(coded), np.int64)  # sample at which the next parameter stands
    live = np.searchsorted(-n, -np.arange(out.shape[1]), "left").tolist()
    column = np.zeros((out.shape[1], len(coded)), np.int64)
    any_escape, warmest = False, int(warm.max(initial=0))
    starts_at = next_start.copy()
    for t in range(out.shape[1]):
        k = live[t]
        if not k:
            break
        new = np.flatnonzero(starts_at[:k] == t)
        if len(new):
            parameter[new] = b.read(where[new], wide[new])
            where[new] += wide[new]
            starts_at[new] += span[new]
            out_of = parameter[new] == (1 << wide[new]) - 1
            escaped[new] = 0
            if out_of.any():
                any_escape = True
                those = new[out_of]
                escaped[those] = b.read(where[those], 5) + 1  # one more, so 0 means not escaped
                where[those] += 5
        if t < warmest:
            go = np.flatnonzero(warm[:k] <= t)
            if not len(go):
                continue
        else:
            go = slice(0, k)
        here, p = where[go], parameter[go]
        if any_escape and escaped[go].any():
            e = escaped[go]
            stop = b.next_one[here].astype(np.int64)
            plain = (stop - here << p) | b.read(stop + 1, p)
            plain = plain >> 1 ^ -(plain & 1)
            width = np.maximum(e - 1, 1)
            column[t, go] = np.where(e > 0, np.where(e > 1, b.signed(here, width), 0), plain)
            where[go] = np.where(e > 0, here + e - 1, stop + 1 + p)
            continue
        stop = b.next_one[here]
        u = (stop - here << p) | b.read(stop + 1, p)
        column[t, go] = u >> 1 ^ -(u & 1)
        where[go] = stop + 1 + p
    residual[by_size] = column.T
    at[coded[by_size]] = where

    for p in range(5):  # fixed predictors: integrate p times
        of = np.flatnonzero(fixed[coded] & (order[coded] == p))
        if not len(of):
            continue
        x, warmed = residual[of], out[coded[of]]
        for level in range(p, 0, -1):
            start = warmed[:, :level].copy()
            for _ in range(level - 1):
                start = np.diff(start, axis=1)
            x[:, level - 1] = start[:, -1]
            x[:, level - 1 :] = np.cumsum(x[:, level - 1 :], axis=1)
        x[:, :p] = warmed[:, :p]
        out[coded[of]] = x
    for p in np.unique(order[linear]).tolist():
        of = np.flatnonzero(linear & (order == p))
        x, rest = np.ascontiguousarray(out[of].T), residual[np.searchsorted(coded, of)].T
        c, s = np.ascontiguousarray(coefficients[of, p - 1 :: -1].T if p else coefficients[of, :0].T), shift[of]
        for t in range(p, x.shape[0]):
            x[t] = ((c * x[t - p : t]).sum(axis=0) >> s) + rest[t]
        out[of] = x.T
    ends = (at + 7) // 8
    if (_crc(data, starts, ends - starts, 16) != b.read(8 * ends, 16)).any():
        raise ValueError("a frame's checksum is wrong")
    out[np.arange(out.shape[1]) >= sizes[:, None]] = 0
    return out, sizes, number, ends + 2


def decode_streams(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks of each stream: (first sample, samples), unsigned bytes for 8 bits, else little-endian 16 bits.

    With a complete seek table all frames are read at once, else one frame of each stream after the other.
    """
    streams = [Stream(m) for m in media]
    base = np.concatenate([[0], np.cumsum([len(m) for m in media])]).astype(np.int64)
    data = np.frombuffer(b"".join(media), np.uint8)
    out: list[list[tuple[int, bytes]]] = [[] for _ in media]

    def run(doc: np.ndarray, at: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        samples, sizes, number, ends = decode_frames(data[first:last], at - first, np.array([streams[d].bits for d in doc]), np.array([streams[d].block for d in doc]))
        narrow = (samples + 128).astype(np.uint8)
        for r, d in enumerate(doc.tolist()):
            n = int(sizes[r])
            out[d].append((int(number[r]) * streams[d].block, narrow[r, :n].tobytes() if streams[d].bits == 8 else samples[r, :n].astype("<i2").tobytes()))
        return ends

    whole = [d for d, s in enumerate(streams) if s.complete()]
    if whole:
        doc = np.concatenate([np.full(len(streams[d].points), d) for d in whole])
        at = np.concatenate([base[d] + streams[d].first + streams[d].points[:, 1] for d in whole])
        for k in range(0, len(doc), BATCH // BLOCK):  # a batch of frames and the bytes that hold it
            j = min(k + BATCH // BLOCK, len(doc))
            run(doc[k:j], at[k:j], int(at[k]), int(base[doc[j - 1] + 1] if j == len(doc) or doc[j] != doc[j - 1] else at[j]))
    place = {d: int(base[d]) + s.first for d, s in enumerate(streams) if d not in set(whole)}
    while place := {d: p for d, p in place.items() if p < base[d + 1]}:
        doc = np.array(list(place))
        place = dict(zip(place, run(doc, np.array(list(place.values()))).tolist(), strict=True))
    for d, (s, blocks) in enumerate(zip(streams, out, strict=True)):
        pcm = b"".join(x for _, x in blocks)
        signed = (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes() if s.bits == 8 else pcm
        if s.md5 != bytes(16) and hashlib.md5(signed).digest() != s.md5:
            raise ValueError(f"stream {d}: the samples don't have the checksum of the header")
    return out


def read_samples(media: bytes, first: int, count: int) -> bytes:
    """Samples from ``first`` on, reading only the frames that hold them; the stream needs a complete seek table."""
    stream = Stream(media)
    points = stream.points[(stream.points[:, 0] < first + count) & (stream.points[:, 0] + stream.points[:, 2] > first)]
    if not len(points):
        return b""
    data = np.frombuffer(media, np.uint8)
    samples, sizes, _, _ = decode_frames(data, stream.first + points[:, 1], np.full(len(points), stream.bits), np.full(len(points), stream.block))
    flat = np.concatenate([samples[r, : sizes[r]] for r in range(len(points))])[first - points[0, 0] :][:count]
    return (flat + 128).astype(np.uint8).tobytes() if stream.bits == 8 else flat.astype("<i2").tobytes()


def _payloads(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes padded with 0 to a positive multiple of 64: data, offsets and the sizes before."""
    data, offsets = column_bytes(column)
    sizes = np.diff(offsets)
    padded = np.concatenate([[0], np.cumsum(np.maximum(-(-sizes // 64) * 64, 64))])
    out = np.zeros(int(padded[-1]), np.uint8)
    for i, j, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), padded[:-1].tolist(), strict=True):
        out[to : to + j - i] = data[i:j]
    return out, padded, sizes


def encode_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus n_bytes and media: the text's padded bytes as FLAC (null: empty)."""
    others = [c for c in docs.columns if c not in (text, "n_bytes", "media")]
    flat = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields[:-1]), "n_bytes long", "media binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, all_offsets = column_bytes(batch.column(len(others)))
            for a, b in slices(all_offsets, BATCH):
                part = batch.slice(a, b - a)
                data, offsets, sizes = _payloads(part.column(len(others)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(others))), pa.array(sizes), pa.array(encode_streams(data, offsets), pa.binary())], names=[*others, "n_bytes", "media"])

    return flat.mapInArrow(run, schema)


def _in_parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    return slices(column_bytes(column)[1], BATCH)


def decode_column(media: DataFrame, column: str = "media") -> DataFrame:
    """PCM blocks: all other columns, block, first_sample, n_samples and pcm.  A null stream has no blocks."""
    others = [c for c in media.columns if c not in (column, "block", "first_sample", "n_samples", "pcm")]
    flat = media.where(F.col(f"`{column}`").isNotNull()).select(*[F.col(f"`{c}`") for c in others], F.col(f"`{column}`").alias("media"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields[:-1]), "block int, first_sample long, n_samples long, pcm binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _in_parts(batch.column(len(others))):
                part = batch.slice(a, b - a)
                found = decode_streams(part.column(len(others)).to_pylist())
                rows = [(i, k, first, len(pcm), pcm) for i, blocks in enumerate(found) for k, (first, pcm) in enumerate(blocks)]
                at, block, first, count, pcm = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(at, pa.int64())) for k in range(len(others))), pa.array(block, pa.int32()), pa.array(first, pa.int64()), pa.array(count, pa.int64()), pa.array(pcm, pa.binary())], names=[*others, "block", "first_sample", "n_samples", "pcm"])

    return flat.mapInArrow(run, schema)


def feature(pcm: bytes) -> str:
    """Number of samples, their sum and energy around the middle, sign changes and peak."""
    data = np.frombuffer(pcm, np.uint8)
    total = energy = changes = peak = 0
    for k in range(0, len(data), BATCH):
        x = data[max(k - 1, 0) : k + BATCH].astype(np.int64) - 128  # one sample of the last part, for its sign
        changes += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[1:] if k else x
        total, energy, peak = total + int(x.sum()), energy + int((x * x).sum()), max(peak, int(np.abs(x).max(initial=0)))
    return f"samples={len(data)};sum={total};energy={energy};crossings={changes};peak={peak}"


def stored_features(media: DataFrame) -> DataFrame:
    """Digests of stored streams read back: payload, tail, stored form and features."""
    flat = media.select("doc_id", "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _in_parts(batch.column(2)):
                part = batch.slice(a, b - a)
                stored = part.column(2).to_pylist()
                read = [b"".join(x for _, x in blocks) for blocks in decode_streams(stored)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(p) for p in read], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in read]), pa.array([zlib.crc32(p[-64:]) for p in read], pa.int64()),
                    pa.array([len(m) for m in stored], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array([feature(p) for p in read]),
                ], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = flat.schema["doc_id"].dataType.simpleString()
    return flat.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fewer_splits(stored_features(encode_column(docs)), docs)
