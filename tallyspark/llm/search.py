"""Ranked lexical search by maxima over document ranges.

A corpus is indexed in shards of at most ``SHARD`` documents, one row each: ids, lengths, and for each term of interest
its postings.  In a shard documents are ordered by length and cut into leaves of ``LEAF``; a term's impact (all of the
score but the query's weight) has its maximum for each leaf, for each ``FAN`` leaves, and so on up to the shard.  The sum of
weighted maxima bounds the scores below a node, so a query opens the node of the highest bound first, and stops when no
bound reaches the k-th best score; nodes whose bound equals it are opened too, as a tie may go to a smaller id.

A task reads shard after shard and carries each query's best documents on, so later shards are entered with the bar
that the earlier ones have set.  Only k documents for each query leave a task.  Queries are taken in blocks of bounded size,
whose terms and weights go to all tasks; the postings that a block needs are written once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import fewer_splits, settle, shared_dir
from .textbytes import SLICE, column_bytes, cuts, slices, span_hashes, word_spans

LEAF, FAN, SHARD, SHARD_BYTES = 32, 8, 4096, 32 << 20
#: Queries, and distinct terms in them, to a block.
QUERIES, TERMS = 1024, 1 << 14
TOP = 50
_TERM = np.full(256, 32, np.uint8)  # A-Z lower-cased, what is in no term is a space
_TERM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_TERM[65:91] = np.arange(97, 123)


def terms(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last, fingerprints of its terms, their documents) of slices of a text column; a long text comes in parts."""
    data, offsets = column_bytes(column)
    for a, b in slices(offsets):
        begin, end = int(offsets[a]), int(offsets[b])
        for s, e in cuts(data[begin:end]) if b == a + 1 and end - begin > SLICE else [(0, end - begin)]:
            part = _TERM[data[begin + s : begin + e]]
            starts, ends, doc = word_spans(part, np.clip(offsets[a : b + 1] - begin - s, 0, e - s))
            yield a, b, span_hashes(part, starts, ends), doc + a


def index(docs: DataFrame, vocabulary: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Shards: ids, lengths (tokens, long) and the postings (term's place in the sorted ``vocabulary``, document's place, tf) sorted by term."""
    flat = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"ids array<{flat.schema['key'].dataType.simpleString()}>, lengths binary, term binary, doc binary, tf binary"

    def shard(keys: list[pa.Array], lengths: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, n = pa.concat_arrays(keys), sum(map(len, lengths))
        code = np.concatenate([t.astype(np.int64) * n + d for t, d in found]) if found else np.zeros(0, np.int64)
        code, tf = np.unique(code, return_counts=True)
        rows = [np.concatenate(lengths).astype("<i8"), (code // n).astype("<i4"), (code % n).astype("<i4"), tf.astype("<i8")]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in rows)], names=["ids", "lengths", "term", "doc", "tf"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths, found, n, size = [], [], [], 0, 0
        for batch in batches:
            _, at = column_bytes(batch.column(1))
            start = 0
            while start < batch.num_rows:
                room = int(np.searchsorted(at, at[start] + SHARD_BYTES - size, "right")) - 1
                stop = min(batch.num_rows, start + SHARD - n, max(room, start + (not n)))
                if stop > start:
                    count = np.zeros(stop - start, np.int64)
                    for _, _, h, doc in terms(batch.column(1).slice(start, stop - start)):
                        count += np.bincount(doc, minlength=stop - start)
                        place = np.searchsorted(vocabulary, h)
                        known = np.flatnonzero(vocabulary[np.minimum(place, len(vocabulary) - 1)] == h) if len(vocabulary) else np.zeros(0, np.int64)
                        if len(known):
                            found.append((place[known], doc[known] + n))
                    keys.append(batch.column(0).slice(start, stop - start))
                    lengths.append(count)
                    n, size, start = n + stop - start, size + int(at[stop] - at[start]), stop
                if start < batch.num_rows or n >= SHARD or size >= SHARD_BYTES:
                    yield shard(keys, lengths, found)
                    keys, lengths, found, n, size = [], [], [], 0, 0
        if n:
            yield shard(keys, lengths, found)

    return flat.mapInArrow(build, schema)


class Tree:
    """Maxima of a shard's impacts; ``levels[0]`` are the leaves, each level a row for each term and a column for each node."""

    def __init__(self, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_docs: int, n_tokens: int):
        self.order = np.argsort(lengths, kind="stable")
        place = np.empty(len(lengths), np.int64)
        place[self.order] = np.arange(len(lengths))
        m = 50 + (50 * lengths * n_docs) // max(n_tokens, 1)
        self.term, row = np.unique(term, return_inverse=True)
        by = np.lexsort((place[doc], row))
        self.doc, row = place[doc][by], row[by]
        self.impact = ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))[by]
        leaves = max(1, -(-len(lengths) // LEAF))
        cell = row * leaves + self.doc // LEAF
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        most = np.zeros(len(self.term) * leaves, np.int64)
        most[cell[first]] = np.maximum.reduceat(self.impact, first) if len(first) else 0
        self.starts = np.searchsorted(cell, np.arange(len(self.term) * leaves + 1)).reshape(-1) if len(cell) else np.zeros(len(self.term) * leaves + 1, np.int64)
        self.leaves, self.levels = leaves, [most.reshape(len(self.term), leaves)]
        while self.levels[-1].shape[1] > 1:
            low = self.levels[-1]
            low = np.pad(low, ((0, 0), (0, -low.shape[1] % FAN)))
            self.levels.append(low.reshape(len(low), -1, FAN).max(axis=2))

    def search(self, wanted: np.ndarray, weights: np.ndarray, bar) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, scores) of the leaves that may hold a score of ``bar()`` or more (and above 0), best bound first; ``bar`` rises meanwhile."""
        at = np.searchsorted(self.term, wanted)
        have = np.flatnonzero(self.term[np.minimum(at, len(self.term) - 1)] == wanted) if len(self.term) else np.zeros(0, np.int64)
        rows, weights = at[have], weights[have]
        if not len(rows):
            return
        top = len(self.levels) - 1
        heap = [(-int((weights * self.levels[top][rows, 0]).sum()), top, 0)]
        while heap:
            bound, level, node = heapq.heappop(heap)
            if -bound < max(bar(), 1):
                return
            if level:
                low = self.levels[level - 1]
                children = range(node * FAN, min((node + 1) * FAN, low.shape[1]))
                bounds = (weights[:, None] * low[rows, children.start : children.stop]).sum(axis=0)
                for child, b in zip(children, bounds.tolist(), strict=True):
                    if b >= max(bar(), 1):
                        heapq.heappush(heap, (-b, level - 1, child))
                continue
            score = np.zeros(LEAF, np.int64)
            cells = rows * self.leaves + node
            for w, s, e in zip(weights.tolist(), self.starts[cells].tolist(), self.starts[cells + 1].tolist(), strict=True):
                score[self.doc[s:e] - node * LEAF] += w * self.impact[s:e]
            hit = np.flatnonzero(score >= max(bar(), 1))
            yield self.order[node * LEAF + hit], score[hit]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Blocks of (row number, distinct terms of the row) for the rows (number, text) of ``items``."""
    block, seen = [], set()
    for row in items.toLocalIterator():
        found = np.unique(np.concatenate([h for _, _, h, _ in terms(pa.array([row["text"] or ""]))] or [np.zeros(0, np.uint64)]))
        new = set(found.tolist())
        if block and (len(block) >= QUERIES or len(seen | new) > TERMS):
            yield block
            block, seen = [], set()
        block.append((row["number"], found))
        seen |= new
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The ``k`` best documents for each row of ``items`` (``item``, text): ``item``, rank from 1, ``key``, score.

    Terms are runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased.  Null texts have no terms, and
    neither they nor documents without the query's terms are returned.  Equal scores go by ascending ``key``, null last;
    rows of equal keys are documents of their own, and equal items are queries of their own.  Empty tables give an empty
    result; other columns aren't read.  A term is known by a 64-bit fingerprint.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    kind = docs.schema[key].dataType.simpleString()
    asked = items.select(F.col(f"`{item}`").alias("item"), F.col("`text`").alias("text"))
    asked = settle(asked.withColumn("number", F.monotonically_increasing_id()), folder, "items", None)
    results = []
    for number, block in enumerate(_blocks(asked.select("number", "text"))):
        vocabulary = np.unique(np.concatenate([t for _, t in block]))
        shards = settle(fewer_splits(index(docs, vocabulary, text, key), docs), folder, f"shards-{number}", None)
        results.append(settle(_top(shards, block, vocabulary, k, kind), folder, f"top-{number}"))
    empty = spark.createDataFrame([], f"number long, key {kind}, score long")
    best = empty
    for part in results:
        best = best.unionByName(part)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("number", "item"), "number").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _count(shards: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, tokens, and for each place of the vocabulary the documents that hold the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_tokens = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for lengths, term in zip(batch.column(0), batch.column(1), strict=True):
                n = np.frombuffer(lengths.as_py(), "<i8")
                n_docs, n_tokens = n_docs + int((n > 0).sum()), n_tokens + int(n.sum())
                df += np.bincount(np.frombuffer(term.as_py(), "<i4"), minlength=size)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *used.tolist()], pa.int64()), pa.array([n_docs, n_tokens, *df[used].tolist()], pa.int64())], names=["place", "n"])

    found = {r["place"]: r["n"] for r in shards.select("lengths", "term").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(p, 0) for p in range(size)], np.int64)  # no more than the terms of a block


def _top(shards: DataFrame, block: list[tuple[int, np.ndarray]], vocabulary: np.ndarray, k: int, kind: str) -> DataFrame:
    """(number, key, score) of at least the ``k`` best documents of each query of the block, not more than ``k`` from a task."""
    n_docs, n_tokens, df = _count(shards, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    asked = [(number, np.searchsorted(vocabulary, t)) for number, t in block]
    schema = f"number long, key {kind}, score long"

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values
                tree = Tree(*(np.frombuffer(batch.column(c)[row].as_py(), t).astype(np.int64) for c, t in enumerate(("<i8", "<i4", "<i4", "<i8"), 1)), n_docs, n_tokens)
                for (_, places), kept in zip(asked, best, strict=True):
                    for doc, score in tree.search(places, weight[places], lambda kept=kept: -kept[-1][0] if len(kept) >= k else 0):
                        for i, s in zip(ids.take(pa.array(doc)).to_pylist(), score.tolist(), strict=True):
                            kept.append((-s, i is None, 0 if i is None else i))
                        kept.sort()
                        del kept[k:]
        if id_type is not None:
            rows = [(number, *r) for (number, _), kept in zip(asked, best, strict=True) for r in kept]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([None if r[2] else r[3] for r in rows], id_type), pa.array([-r[1] for r in rows], pa.int64())], names=["number", "key", "score"])

    return shards.mapInArrow(best_of, schema)


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS u FROM documents)),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM cut GROUP BY doc_id, term),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
asked AS (
  SELECT DISTINCT item_id, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS u FROM benchmark)),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term), total),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN n USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""
