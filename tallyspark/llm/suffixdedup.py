"""Suffix-array dedup by a difference cover, one bucket of suffixes at a time.

A byte goes if it is covered by a string of ``length`` bytes that also starts somewhere else in the corpus, so suffixes
need to be sorted to a depth of ``length`` only, and only suffixes that share that much matter.

1. *Cover sample.*  Positions whose residue modulo ``v`` lies in a difference cover D (for any two positions i and j
   there is a d < v with both i+d and j+d in the sample) get a name for their next ``length - v + 1`` bytes.  A bucket
   of names is sorted at a time; the answer says which samples tie with another one.
2. *Candidates.*  If the strings at i and j are equal, their common samples i+d and j+d tie.  So only suffixes that see
   a tied sample within their next v-1 bytes can repeat: all others are settled by the cover.
3. *Blocks.*  The candidates are named at full depth and sorted bucket by bucket; a suffix that ties at full depth
   repeats.  A bucket is a range of names, holds an even share and is bounded by the number of buckets, whatever the
   texts are: no bucket is larger because a passage is frequent.

Names are 64-bit fingerprints, in whose order the buckets are sorted; equal strings have equal names, and a suffix
counts as repeated only if one of its samples and its full-depth name tie.  Whole documents that are equal are settled
beforehand by their digests: one of them stands for all and counts as more than one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .exchange import BLOCK_SCHEMA, answer_repeats, blocks, bucket_count, chunk_count, few_files, flagged, once, read_repeats, release, repeat, settle, shared_dir, with_chunk
from .textbytes import SLICE, Windows, column_bytes, slices

MIN_BYTES = 200
#: Perfect difference sets, each difference modulo v occurs exactly once.
PERFECT_COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)}


def is_cover(v: int, residues: tuple[int, ...]) -> bool:
    return {(a - b) % v for a in residues for b in residues} == set(range(v))


@lru_cache
def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """The period v (at most two thirds of ``length``) and residues of the cover for strings of ``length`` bytes."""
    v = max((v for v in PERFECT_COVERS if 3 * v <= 2 * length), default=1)
    residues = PERFECT_COVERS.get(v, (0,))
    assert is_cover(v, residues)
    return v, residues


class _Part:
    """A stretch of bytes with its documents' bounds, the fingerprints of its windows and the cover sample.

    Only the first ``own`` places count as starts; what follows is seen by their windows.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, own: int):
        self.offsets, self.length, self.own = offsets, length, own
        self.v, residues = difference_cover(length)
        self.depth = length - self.v + 1
        self.size = len(data)
        self.windows = Windows(data, self.depth)
        sizes = np.diff(offsets)
        # residues count from a document's start, so the sample doesn't depend on the order of a chunk's rows
        pattern = np.zeros(self.v, bool)
        pattern[list(residues)] = True
        pattern = np.tile(pattern, int(sizes.max(initial=0)) // self.v + 1)
        at = np.flatnonzero(np.concatenate([pattern[:x] for x in sizes.tolist()])) if len(data) else np.zeros(0, np.int64)
        doc = np.searchsorted(offsets, at, "right") - 1
        fits = at + self.depth <= offsets[doc + 1]
        fits &= sizes[doc] >= length
        self.at, self.doc = at[fits], doc[fits]
        self.names = self.windows.at(self.at, self.depth)

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the samples that start here, and their documents."""
        here = self.at < self.own
        return self.names[here], self.doc[here]

    def candidates(self, tied) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes with a tied sample among their next v-1 bytes, their documents and names at full depth; ``tied`` tells of names."""
        of = tied(self.names)
        at, doc = self.at[of], self.doc[of]
        change = np.bincount(np.maximum(at - self.v + 1, self.offsets[doc]), minlength=self.size + 1) - np.bincount(at + 1, minlength=self.size + 1)
        start = np.flatnonzero(np.cumsum(change[: self.own]) > 0)
        doc = np.searchsorted(self.offsets, start, "right") - 1
        fits = start + self.length <= self.offsets[doc + 1]
        start, doc = start[fits], doc[fits]
        return start, doc, self.windows.at(start, self.length)


def _parts(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, _Part]]:
    """(place among the bytes, number of its first document, part); a long document is cut, and each cut sees as far as its windows reach."""
    v, _ = difference_cover(length)
    step = SLICE // v * v
    for a, b in slices(offsets):
        begin, end = int(offsets[a]), int(offsets[b])
        if b == a + 1 and end - begin > step + length + v:
            for s in range(begin, end, step):
                e = min(s + step + length + v, end)
                yield s, a, _Part(data[s:e], np.array([0, e - s]), length, min(step, end - s))
        else:
            yield begin, a, _Part(data[begin:end], offsets[a : b + 1] - begin, length, end - begin)


class _Chunk:
    """The texts of a chunk; ``several`` marks documents that stand for more than one."""

    def __init__(self, rows: pa.Table, several: np.ndarray, length: int):
        self.data, self.offsets = column_bytes(rows["text"])
        self.several, self.length = several, length

    def parts(self) -> Iterator[tuple[int, int, _Part]]:
        return _parts(self.data, self.offsets, self.length)

    def sample_keys(self) -> np.ndarray:
        found = [(names, self.several[a + doc]) for _, a, part in self.parts() for names, doc in [part.sample()]]
        return _flagged(found)

    def full_keys(self, tied) -> np.ndarray:
        found = [(names, self.several[a + doc]) for _, a, part in self.parts() for _, doc, names in [part.candidates(tied)]]
        return _flagged(found)

    def gone(self, tied, repeated) -> np.ndarray:
        """For each byte whether a repeated string covers it."""
        out = np.zeros(len(self.data), bool)
        for begin, _, part in self.parts():
            start, _, names = part.candidates(tied)
            start = start[repeated(names)]
            if len(start):
                change = np.bincount(start, minlength=part.size + 1) - np.bincount(start + self.length, minlength=part.size + 1)
                out[begin : begin + part.size] |= np.cumsum(change[:-1]) > 0
        return out


def _flagged(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return flagged(np.concatenate([n for n, _ in found]), np.concatenate([m for _, m in found])) if found else np.zeros(0, np.uint64)


def _answer(keys: np.ndarray, values: np.ndarray):
    """The answers for names (flag ignored): a function that looks them up among the sorted flagged ``keys``."""
    if len(keys) != len(values):
        raise RuntimeError("the rows of a chunk changed between two reads of the input")
    names = keys >> np.uint64(1)
    return lambda x: values[np.searchsorted(names, x >> np.uint64(1))] if len(names) else np.zeros(len(x), bool)


def _answers(table: pa.Table, kind: int) -> np.ndarray:
    return read_repeats(table.filter(pc.equal(table["kind"], kind)))


#: Kinds of notes to a chunk: answers for samples and for full depth; a row that equals an earlier text; one that stands for equal ones.
SAMPLE, FULL, LATER, FIRST = 0, 1, 2, 3
_NOTES = "chunk int, kind int, bucket int, answer binary, row long"


def _rows(notes: pa.Table, kind: int) -> np.ndarray:
    return notes.filter(pc.equal(notes["kind"], kind))["row"].to_numpy()


def _notes(table: pa.Table, notes: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a chunk that take part, whether each stands for several, and the others' numbers."""
    ids = table["_row"].to_numpy()
    later = np.isin(ids, _rows(notes, LATER))
    keep = np.flatnonzero(~later)
    return table.take(pa.array(keep)), np.isin(ids[keep], _rows(notes, FIRST)), np.flatnonzero(later)


def remove_repeats(docs: DataFrame, length: int = MIN_BYTES, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """``key`` (or with ``keep_text`` all columns, the text replaced by what is left), n_bytes, n_removed, n_spans and kept_sha256.

    Texts count as UTF-8 bytes, null as empty.  Matches never cross documents.  Rows with equal ids are documents of
    their own, and so are equal rows.  A text shorter than ``length`` is left alone; equal texts of that length or more
    go altogether.  With ``keep_text`` characters that the cut left incomplete are dropped, and columns of the input
    with the names of the results are replaced.  ``docs`` is read several times and must give the same rows each time
    (a file, or a written table).
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    others = [c for c in docs.columns if c not in own and c != text] if keep_text else [key]
    names = {f"c{i}": c for i, c in enumerate(others)}
    base = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], F.col(f"`{text}`").alias("text"))
    known = [F.to_json(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in base.schema]
    base, size = once(base.withColumn("_row", F.xxhash64(*known)).withColumn("_twin", F.xxhash64(F.lit(1), *known)), folder)
    n, buckets = chunk_count(docs, size=size), bucket_count(spark, size)
    base = with_chunk(base, "_row", n).drop("_twin")

    digests = base.where(F.octet_length("text") >= length).select("chunk", "_row", "_n", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), F.col("text")).alias("b"), F.octet_length("text").alias("l"))
    groups = digests.groupBy("a", "b", "l").agg(F.sum("_n").alias("n"), F.min("_row").alias("first")).where("n > 1").drop("n")
    groups = settle(groups, folder, "groups", size // 64)  # with a plain table on either side, AQE splits a frequent text's digest
    equal = digests.join(groups, ["a", "b", "l"]).select("chunk", F.when(F.col("_row") == F.col("first"), FIRST).otherwise(LATER).alias("kind"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("answer"), F.col("_row").alias("row"))
    equal = settle(equal.distinct(), folder, "equal", size // 64)

    def chunk_of(table: pa.Table, notes: pa.Table) -> tuple[pa.Table, _Chunk, np.ndarray]:
        rows, several, later = _notes(table, notes)
        return rows, _Chunk(rows, several, length), later

    def send_samples(table: pa.Table, notes: pa.Table) -> pa.Table:
        keys = chunk_of(table, notes)[1].sample_keys() if table.num_rows else np.zeros(0, np.uint64)
        return pa.Table.from_batches([blocks(table["chunk"][0].as_py() if table.num_rows else 0, keys, None, buckets)])

    def send_full(table: pa.Table, notes: pa.Table) -> pa.Table:
        keys = np.zeros(0, np.uint64)
        if table.num_rows:
            chunk = chunk_of(table, notes)[1]
            keys = chunk.full_keys(_answer(chunk.sample_keys(), _answers(notes, SAMPLE)))
        return pa.Table.from_batches([blocks(table["chunk"][0].as_py() if table.num_rows else 0, keys, None, buckets)])

    def results(table: pa.Table, notes: pa.Table) -> pa.Table:
        rows, chunk, later = chunk_of(table, notes)
        tied = _answer(chunk.sample_keys(), _answers(notes, SAMPLE))
        gone = chunk.gone(tied, _answer(chunk.full_keys(tied), _answers(notes, FULL)))
        found: list[tuple[int, int, int, str]] = []
        left: list[str] = []
        for i, j in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
            g = gone[i:j]
            stay = chunk.data[i:j][~g].tobytes()
            found.append((j - i, j - i - len(stay), int(np.count_nonzero(g[1:] & ~g[:-1])) + int(j > i and g[0]), hashlib.sha256(stay).hexdigest()))
            if keep_text:
                left.append(stay.decode("utf-8", "ignore"))
        out = rows
        if len(later):  # texts that another row holds whole
            more = table.take(pa.array(later))
            found += [(x, x, 1, hashlib.sha256(b"").hexdigest()) for x in pc.binary_length(more["text"]).to_pylist()]
            left += [""] * len(later) if keep_text else []
            out = pa.concat_tables([rows, more])
        out = out.select([*names, "_n"])
        if keep_text:
            out = out.append_column("text", pa.array(left, pa.string()))
        for k, name in enumerate(own):
            out = out.append_column(name, pa.array([x[k] for x in found], pa.string() if name == "kept_sha256" else pa.int64()))
        return out

    def meet(function, notes: DataFrame, schema: str) -> DataFrame:
        return base.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(function, schema)

    def as_notes(answers: DataFrame, kind: int) -> DataFrame:
        return answers.select("chunk", F.lit(kind).alias("kind"), "bucket", "answer", F.lit(None).cast("long").alias("row"))

    samples = settle(answer_repeats(meet(send_samples, equal, BLOCK_SCHEMA)), folder, "samples", size)
    release(spark)
    notes = equal.unionByName(as_notes(samples, SAMPLE))
    full = settle(answer_repeats(meet(send_full, notes, BLOCK_SCHEMA)), folder, "full", size)
    release(spark)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name in names), "_n long", *["text string"] * keep_text, "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"])
    out = repeat(meet(results, notes.unionByName(as_notes(full, FULL)), schema)).withColumnsRenamed(names | {"text": text})
    return few_files(out.select(*[c for c in docs.columns if c in others or (keep_text and c == text)], *own), size)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
