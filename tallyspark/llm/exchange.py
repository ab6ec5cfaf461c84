"""Exact corpus-wide counts of 64-bit keys without a row per key.

Documents are dealt into chunks by a hash of their id.  A chunk sends each of its distinct keys once to the bucket
that owns the key's range, as one binary block for each pair of chunk and bucket; a bucket sorts what it got, and
answers each block with the totals in the block's own order.  The chunk, which recomputes its keys from its documents,
reads the answers by bucket.  Keys are combined in the chunk first, so a key that a third of all documents hold
arrives at most once from each chunk, and ranges of hashed keys are even.  Nothing goes to the driver.  Every block
can be recomputed from its chunk's documents, in whatever order they arrive.
"""

from __future__ import annotations

import uuid
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_SCHEMA = "chunk int, bucket int, keys binary, counts binary"
ANSWER_SCHEMA = "chunk int, bucket int, answer binary"


#: Bytes of text to a file, to a chunk and to a bucket at least, where the number of shuffle partitions asks for fewer.
FILE_BYTES, CHUNK_BYTES, BUCKET_BYTES = 256 << 20, 32 << 20, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (tests), one under the local temp folder, with a warning."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
        warnings.warn(f"spark.checkpoint.dir is unset: intermediate tables go to {base}", stacklevel=2)
    return f"{base.rstrip('/')}/tallyspark-{uuid.uuid4().hex}"


def few_files(df: DataFrame, size: int) -> DataFrame:
    """``df``, made from ``size`` bytes of text, with several small partitions, one after the other, to a task and file.

    It stays at two tasks to a core, a fifth of the shuffle partitions and a task to ``FILE_BYTES`` of text at least.
    """
    spark = df.sparkSession
    return df.coalesce(max(36, int(spark.conf.get("spark.sql.shuffle.partitions")) // 5, 2 * spark.sparkContext.defaultParallelism, size // FILE_BYTES))


def fewer_splits(df: DataFrame, docs: DataFrame) -> DataFrame:
    """``df``, which is a projection of the table ``docs``, with up to four of its splits to a task and file."""
    spark = df.sparkSession
    return df.coalesce(max(36, docs.rdd.getNumPartitions() // 4, 2 * spark.sparkContext.defaultParallelism))


def settle(df: DataFrame, folder: str, name: str, size: int | None = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: it cuts the lineage and survives lost executors.

    ``size`` is the bytes of text behind it; with None its partitions stay as they are.
    """
    (df if size is None else few_files(df, size)).write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are over; ``tallyspark.release`` set to false leaves that to it.

    The session holds on to its last execution, so an empty one takes that place before the collection.
    """
    if spark.conf.get("tallyspark.release", "true") == "false":
        return
    import gc

    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def once(base: DataFrame, folder: str, text: str = "text") -> tuple[DataFrame, int]:
    """``base`` with one of each equal rows and _n, how often it occurs; and the bytes of text in all.

    Rows are known by ``_row`` and ``_twin``, two digests of all their columns.  A row that is there very often would
    be one group in one task otherwise; ``repeat`` brings the copies back.
    """
    rows = base.groupBy("_row", "_twin").agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes"))
    size, most = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most <= 1:
        return base.withColumn("_n", F.lit(1).cast("long")), int(size)
    others = [c for c in base.columns if c not in ("_row", "_twin")]
    return settle(base.groupBy("_row", "_twin").agg(*(F.first(c).alias(c) for c in others), F.count("*").alias("_n")), folder, "once", size), int(size)


def repeat(rows: DataFrame) -> DataFrame:
    """Results for the rows of ``once``, each ``_n`` times."""
    return rows.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).drop("_n")


def chunk_count(df: DataFrame, per_partition: int = 8, size: int = 0) -> int:
    """Number of chunks: a few to a partition of the input, so that a chunk holds a few MB and no more than ``CHUNK_BYTES`` beside long texts."""
    spark = df.sparkSession
    return max(per_partition * df.rdd.getNumPartitions(), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // CHUNK_BYTES)


def bucket_count(spark: SparkSession, size: int = 0) -> int:
    """Number of buckets: one to a shuffle partition, more where there are more than ``BUCKET_BYTES`` of text to each."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)


def with_chunk(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.withColumn("chunk", F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int"))


def _edges(buckets: int) -> np.ndarray:
    return np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)


def _width_of(values: np.ndarray) -> type:
    """The narrow type of counts where it holds them all."""
    return np.uint32 if values.max(initial=0) < 1 << 32 else np.uint64


def _pack(counts: np.ndarray) -> bytes:
    """Counts (rows x width) as a byte each, column by column; those from 255 on follow as 64-bit numbers."""
    flat = counts.T.ravel()
    return np.minimum(flat, 255).astype(np.uint8).tobytes() + flat[flat >= 255].astype("<u8").tobytes()


def _unpack(data: bytes, width: int, rows: int | None = None) -> np.ndarray:
    """The counts of ``_pack``; without ``rows`` the number of rows stands in front."""
    if rows is None:
        rows, data = int.from_bytes(data[:4], "little"), data[4:]
    large = np.frombuffer(data, "<u8", offset=rows * width)
    out = np.frombuffer(data, np.uint8, rows * width).astype(_width_of(large))
    out[out == 255] = large
    return out.reshape(width, rows).T


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all of them: the high bytes are nearly all 0, which the shuffle's compression drops."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _bucket_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys that came to a bucket, and where each block begins."""
    parts = [_unpack_keys(x) for x in table["keys"].to_pylist()]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def blocks(chunk: int, keys: np.ndarray, counts: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """Rows to send: ``keys`` sorted and distinct, ``counts`` (rows x width) beside them or None."""
    at = np.concatenate([[0], np.searchsorted(keys, _edges(buckets)), [len(keys)]]).astype(np.int64)
    used = np.flatnonzero(at[1:] > at[:-1]).tolist()
    sent = pa.array([_pack_keys(keys[at[k] : at[k + 1]]) for k in used], pa.binary())
    beside = pa.nulls(len(used), pa.binary()) if counts is None else pa.array([_pack(counts[at[k] : at[k + 1]]) for k in used], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(used), chunk, np.int32)), pa.array(used, pa.int32()), sent, beside], names=["chunk", "bucket", "keys", "counts"])


def _answers(table: pa.Table, answer: pa.Array) -> pa.Table:
    return pa.Table.from_arrays([table["chunk"].combine_chunks(), table["bucket"].combine_chunks(), answer], names=["chunk", "bucket", "answer"])


def _repeats(table: pa.Table) -> pa.Table:
    """One bucket of flagged keys (lowest bit: occurs more than once in its chunk); a byte for each key: it occurs more than once in all."""
    keys, at = _bucket_keys(table)
    order = np.argsort(keys)
    ranked = keys[order]
    names = ranked >> np.uint64(1)
    again = (ranked & np.uint64(1)).astype(bool)
    same = names[1:] == names[:-1]
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    sizes = np.diff(np.concatenate([starts, [len(names)]]))
    group = np.logical_or.reduceat(again, starts) | (sizes > 1)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(group, sizes)
    ends = pa.py_buffer(at.astype(np.int32))
    return _answers(table, pa.Array.from_buffers(pa.binary(), table.num_rows, [None, ends, pa.py_buffer(out)]))


def totals_schema(width: int) -> str:
    """An answer's columns; d0.. and t0.. hold, in one row of each bucket, how many keys have a total and the sum of the totals."""
    return ", ".join([ANSWER_SCHEMA, *(f"{c}{k} long" for c in "dt" for k in range(width))])


def _totals(width: int):
    def totals(table: pa.Table) -> pa.Table:
        """One bucket of keys with ``width`` counts each; the totals over all chunks."""
        keys, at = _bucket_keys(table)
        at = at.tolist()
        order = np.argsort(keys)
        ranked = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(ranked)]]))
        del ranked
        counts = np.concatenate([_unpack(c, width, j - i) for c, i, j in zip(table["counts"].to_pylist(), at, at[1:], strict=False)])
        sums = np.stack([np.add.reduceat(counts[order, k], starts, dtype=np.int64) for k in range(width)], axis=1)
        del counts
        out = np.empty((len(keys), width), _width_of(sums))
        for k in range(width):
            out[order, k] = np.repeat(sums[:, k].astype(out.dtype), sizes)
        answers = _answers(table, pa.array([(j - i).to_bytes(4, "little") + _pack(out[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.binary()))
        for name, values in (("d", (sums > 0).sum(axis=0)), ("t", sums.sum(axis=0))):
            for k in range(width):
                column = np.zeros(table.num_rows, np.int64)
                column[0] = values[k]
                answers = answers.append_column(f"{name}{k}", pa.array(column))
        return answers

    return totals


def answer_repeats(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(_repeats, ANSWER_SCHEMA)


def answer_totals(sent: DataFrame, width: int) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(_totals(width), totals_schema(width))


def flagged(keys: np.ndarray, multi: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct keys (63 bits, then the flag) of a chunk's occurrences; ``multi`` marks occurrences that stand for several."""
    raw = keys & ~np.uint64(1)
    if multi is not None:
        raw |= multi.astype(np.uint64)
    raw.sort()
    if not len(raw):
        return raw
    names = raw >> np.uint64(1)
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(raw)]]))
    last = raw[starts + sizes - 1]
    return last | (sizes > 1).astype(np.uint64)


def _by_bucket(table: pa.Table) -> list[bytes]:
    order = np.argsort(table["bucket"].to_numpy(), kind="stable")
    answers = table["answer"].to_pylist()
    return [answers[i] for i in order]


def read_repeats(table: pa.Table) -> np.ndarray:
    """A chunk's answers of ``answer_repeats`` in the order of its sorted keys."""
    return np.frombuffer(b"".join(_by_bucket(table)), np.uint8).astype(bool)


def read_totals(table: pa.Table, width: int) -> np.ndarray:
    """A chunk's answers of ``answer_totals`` (rows x width) in the order of its sorted keys."""
    parts = [_unpack(a, width) for a in _by_bucket(table)]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.uint32)
