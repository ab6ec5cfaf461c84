"""Rows of one key side by side: a stream of runs for a Python function, with frequent keys dealt into blocks.

``by_key`` sorts rows by key within the partitions of a shuffle and hands whole runs on as they come, so a task holds
a batch and a run, not its partition.  ``dealt`` splits keys of more than ``limit`` rows: a row lives in one block of
its key and visits the later ones, so any two rows of a key meet in one block, and no run has more than about
``limit`` rows that live there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import settle


def dealt(rows: DataFrame, key: str, member: Column, limit: int, folder: str, name: str) -> DataFrame:
    """``rows`` with block (int) and visits (boolean): once in the block that ``member`` hashes to, and in the later blocks of the key as a visitor.

    ``rows`` is computed twice.  The table of frequent keys has at most a row for ``limit`` rows; Spark broadcasts it only while its files are small.
    """
    often = rows.groupBy(key).count().where(F.col("count") > limit).select(F.col(key).alias("_often"), F.ceil(F.col("count") / limit).cast("int").alias("_blocks"))
    often = settle(often, folder, name)
    if often.isEmpty():
        return rows.withColumn("block", F.lit(0)).withColumn("visits", F.lit(False))
    home = F.pmod(F.xxhash64(member), F.col("_blocks").cast("long")).cast("int")
    placed = rows.join(often, F.col(key) == F.col("_often"), "left").withColumn("_home", F.coalesce(home, F.lit(0)))
    last = F.coalesce(F.col("_blocks"), F.lit(1)) - 1
    placed = placed.withColumn("block", F.explode(F.sequence(F.col("_home"), last)))
    return placed.withColumn("visits", F.col("block") > F.col("_home")).drop("_often", "_blocks", "_home")


def by_key(rows: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on tables of whole runs of equal ``keys`` (long or int, no nulls) with the places where runs begin, and the number of rows at the end."""

    def starts(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for c in keys:
            values = table[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            first = starts(table)
            if waiting and any(table[c][0] != waiting[-1][c][waiting[-1].num_rows - 1] for c in keys):
                yield from finish(waiting)
                waiting = []
            if len(first) > 1:  # the last run may go on
                yield from finish([*waiting, table.slice(0, int(first[-1]))])
                waiting, table = [], table.slice(int(first[-1]))
            waiting.append(table)
        if waiting:
            yield from finish(waiting)

    def finish(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(tables).combine_chunks()
        out = work(table, np.concatenate([starts(table), [table.num_rows]]))
        if out is not None and out.num_rows:
            yield out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)
