"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each word shingle of a text is hashed once; the top bits of the hash choose one of ``BINS`` bins and the rest is its
value, of which a bin keeps the least.  An empty bin takes the value of the first filled bin in a sequence of bins that
depends only on the empty bin's number, so two texts that leave it empty draw alike.  The fingerprint is the low byte of
each bin.  Two texts with likeness J agree in a bin with probability C + (1 - C) J with C = 1/256, the chance that
different values share their low byte; ``likeness`` inverts that.

A text of fewer than ``SHINGLE`` words has its whole sequence as its only shingle.  A text without words has a
fingerprint of zeros, is like another such text (1.0) and unlike any other (0.0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import chunk_count, few_files
from .textbytes import mix, shingles, slices, word_hashes

BINS = 256
SHINGLE = 5
CHANCE = 1 / 256


def _donor(bins: np.ndarray, attempt: int) -> np.ndarray:
    return (mix(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a filled one."""
    out = values.copy()
    row, empty = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    attempt = 1
    while len(row):
        donor = _donor(empty, attempt)
        hit = filled[row, donor]
        out[row[hit], empty[hit]] = values[row[hit], donor[hit]]
        row, empty, attempt = row[~hit], empty[~hit], attempt + 1
    return out


def fingerprints(texts: list[bytes], words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each text and bin, and whether each text has words."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    out, some = np.zeros((len(texts), BINS), np.uint8), np.zeros(len(texts), bool)
    bits = np.uint64(BINS.bit_length() - 1)
    for a, b in slices(offsets):
        h, doc = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        grams, at = shingles(h, doc, b - a, words)
        least = np.full((b - a) * BINS, np.uint64(2**64 - 1))
        place = at * BINS + (grams >> (np.uint64(64) - bits)).astype(np.int64)
        np.minimum.at(least, place, grams)
        filled = np.zeros((b - a) * BINS, bool)
        filled[place] = True
        filled = filled.reshape(-1, BINS)
        some[a:b] = filled.any(axis=1)
        out[a:b] = np.where(some[a:b, None], densify(least.reshape(-1, BINS), filled) & np.uint64(255), 0).astype(np.uint8)
    return out, some


def likeness(x: np.ndarray, y: np.ndarray, some_x: np.ndarray, some_y: np.ndarray) -> np.ndarray:
    """Bias-corrected share of equal bins, row by row, 0 to 1."""
    raw = np.clip(((x == y).mean(axis=1) - CHANCE) / (1 - CHANCE), 0, 1)
    return np.where(some_x & some_y, raw, (some_x == some_y).astype(float))


def fingerprint_documents(docs: DataFrame, text: str = "text", words: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` but the text, plus fingerprint (hex, a byte to a bin); a null text counts as empty."""
    others = [c for c in docs.columns if c not in (text, "fingerprint")]
    flat = docs.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema[:-1]), "fingerprint string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prints, _ = fingerprints([t.encode() for t in part.column(len(others)).to_pylist()], words)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(others))), pa.array([p.tobytes().hex() for p in prints])], names=[*others, "fingerprint"])

    return flat.mapInArrow(run, schema)


def edited_neighbours(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """Fingerprints of each document, and of its text with the second half replaced by the next document's beginning.

    ``docs`` has an integer doc_id and text.  The next document is the next by ascending doc_id (equal ids: by text; a
    null id comes first); after the last comes the first.  Ids are dealt into ranges between ids of the table, and the
    document at a bound also goes to the range before it, where it is the last one's next: no order over all rows is
    needed in one task.  The bounds, one to a range, are all that the driver sees.
    """
    ranges = chunk_count(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges)).alias("bounds"), F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"), F.sum(F.octet_length("text")).alias("size")).first()
    size = int(found["size"] or 0)
    bounds = np.unique(np.array(found["bounds"] or [], np.int64))
    least = found["least"] if found["least"] is not None else 0
    bounds = bounds[bounds > least]
    first = -(2**63) if found["nulls"] else least

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy()
            own = np.searchsorted(bounds, ids, "right")
            rows, place, extra = [np.arange(len(ids))], [own], [np.zeros(len(ids), np.int32)]
            for pick, to in ((np.flatnonzero((own > 0) & (bounds[np.maximum(own - 1, 0)] == ids) if len(bounds) else np.zeros(len(ids), bool)), None), (np.flatnonzero(ids == first), len(bounds))):
                rows.append(pick)
                place.append(own[pick] - 1 if to is None else np.full(len(pick), to))
                extra.append(np.full(len(pick), 1, np.int32))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(extra))], names=["doc_id", "text", "place", "extra"])

    def run(table: pa.Table) -> pa.Table:
        ids, texts, extra = table["doc_id"].to_pylist(), table["text"].to_pylist(), table["extra"].to_pylist()
        key = lambda i: (ids[i] is not None, ids[i] or 0, texts[i])
        own = sorted((i for i in range(len(ids)) if not extra[i]), key=key)
        after = min((i for i in range(len(ids)) if extra[i]), key=key)
        order = [*own, after]
        edited, size = [], []
        for i, j in zip(order, order[1:], strict=False):
            n = len(texts[i])
            edited.append((texts[i][: n - n // 2] + texts[j][: n // 2]).encode())
            size.append(n)
        prints, some = fingerprints([texts[i].encode() for i in order], words)
        changed, some_changed = fingerprints(edited, words)
        return pa.table({
            "doc_id": pa.array([ids[i] for i in own], pa.int64()), "n_chars": pa.array(size, pa.int64()), "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array([p.tobytes().hex() for p in prints[:-1]], pa.string()), "edited_fingerprint": pa.array([p.tobytes().hex() for p in changed], pa.string()),
            "near_edited": pa.array(likeness(prints[:-1], changed, some[:-1], some_changed)), "near_next": pa.array(likeness(prints[:-1], prints[1:], some[:-1], some[1:])),
        })

    dealt = docs.mapInArrow(deal, "doc_id long, text string, place int, extra int")
    out = dealt.groupBy("place").applyInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return few_files(out, size)


def op5_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
