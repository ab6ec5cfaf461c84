"""Vectorised work on UTF-8 bytes: words, fingerprints of spans and windows, and shingles of many texts at once.

A batch of texts is one ``uint8`` array plus document offsets, as Arrow holds a string column, so a batch costs a few
numpy passes instead of a Python loop over words.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; all white
space is ASCII, so this is exact on UTF-8 bytes.

Fingerprints have 64 bits.  A span is read eight bytes at a time, each of which is added to the state and stirred by an
invertible step that is neither linear in the integers nor in bits; spans above ``LONG`` bytes get a BLAKE2b digest.
Fingerprints of strings that aren't made to collide behave like random numbers: of n distinct strings two are the same
with a probability of about n*n/2**65.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[32, *range(9, 14)]] = False
#: Bytes of text that are worked on at a time.
SLICE = 1 << 20
LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (int64, from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE):
    """(first, last) document ranges of about ``size`` bytes; a longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA3B195354A39B70D)
    h ^= h >> np.uint64(32)
    return h


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros behind the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end]; the length takes part."""
    sizes = ends - starts
    out = sizes.astype(np.uint64)
    out *= np.uint64(BASE)
    if not len(out):
        return out
    eights = _eights(data)
    live, at, left = None, starts, sizes
    whole = np.flatnonzero(sizes > LONG)
    if len(whole):
        live = np.flatnonzero(sizes <= LONG)
        at, left = starts[live], sizes[live]
    while len(at):
        part = eights[at] & _KEEP[np.minimum(left, 8)]
        if live is None:
            out = mix(out ^ part)
        else:
            out[live] = mix(out[live] ^ part)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in whole.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


class Windows:
    """Fingerprints of windows of one or two lengths (at least ``least``) at any place of a text."""

    def __init__(self, data: np.ndarray, least: int):
        self.width, self.hashes = (8, _eights(data)[: max(len(data) - 7, 0)].copy()) if least >= 8 else (1, data.astype(np.uint64))
        while 2 * self.width <= min(least, 64):
            first, second = self.hashes[: -self.width], self.hashes[self.width :]
            self.hashes = self._join(first, second) if len(self.hashes) > self.width else self.hashes[:0]
            self.width *= 2

    @staticmethod
    def _join(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        x = first * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x += second
        x *= np.uint64(0xA3B195354A39B70D)
        x ^= x >> np.uint64(29)
        return x

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Of data[start:start+length] for each start; the window lies within the text."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        out = self.hashes[starts]
        for k in [*range(self.width, length - self.width, self.width), length - self.width]:
            out = self._join(out, self.hashes[starts + k])
        return mix(out + np.uint64(length))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of all words; offsets begin at 0 and words end at a document's end."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def cuts(data: np.ndarray, size: int = SLICE):
    """(start, end) parts of one text of about ``size`` bytes that end behind white space; a longer word stands whole."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + size, n)
        while end < n and IS_WORD[data[end - 1]]:
            ahead = np.flatnonzero(~IS_WORD[data[end : end + size]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + size, n)
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and document number of each word.  A long document is taken in parts, so beside its words little is held."""
    hashes, docs = [], []
    for a, b in slices(offsets):
        begin, end = int(offsets[a]), int(offsets[b])
        for s, e in cuts(data[begin:end]) if b == a + 1 and end - begin > SLICE else [(0, end - begin)]:
            part = lower(data[begin + s : begin + e])
            starts, ends, doc = word_spans(part, np.clip(offsets[a : b + 1] - begin - s, 0, e - s))
            hashes.append(span_hashes(part, starts, ends))
            docs.append(doc + a)
    return (np.concatenate(hashes), np.concatenate(docs)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the n-grams that start at each place but the last n-1."""
    m = max(0, len(h) - n + 1)
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(BASE)
        out += h[k : k + m]
        out ^= out >> np.uint64(31)
    return mix(out)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all n-word shingles with their documents; a document with fewer words has its whole sequence as one."""
    counts = np.bincount(doc, minlength=n_docs)
    grams = chain(h, n)
    keep = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    out, at = grams[keep], doc[: len(grams)][keep]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begin = np.cumsum(counts) - counts
        extra = np.empty(len(short), np.uint64)
        for k in range(1, n):
            of = np.flatnonzero(counts[short] == k)
            if len(of):
                acc = np.zeros(len(of), np.uint64)
                for j in range(k):
                    acc = mix(acc * np.uint64(BASE) + h[begin[short[of]] + j])
                extra[of] = mix(acc + np.uint64(k))
        out, at = np.concatenate([out, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at
