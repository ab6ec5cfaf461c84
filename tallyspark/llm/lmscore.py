"""LM scoring by deleted interpolation.

A bigram model over lower-cased words and one end token for each text; the end of a text is also the context of the
first word of the next.  The probability of a word w after h is

    P(w|h) = a[b(h)] c(hw)/c(h) + (1 - a[b(h)]) (l c(w)/N + (1 - l) / (V + 1))

with maximum-likelihood estimates from the training texts' counts, and b(h) the bucket of the context's frequency (its
binary logarithm).  The weights a[.] and l are learned by expectation-maximisation on the counts of a deleted part of the
training texts, with the estimates taken from the rest; then all training texts count.

Counts of all words and pairs are exact and go through ``exchange``: a chunk of documents sends its distinct words and
pairs and gets their totals back.  What EM needs of the deleted part is gathered as a table of (context bucket, octave
of the pair's estimate, octave of the word's estimate), whose size is bounded by the number of octaves; it covers every
token of the deleted part, and each cell keeps the mean of its estimates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import BLOCK_SCHEMA, answer_totals, blocks, bucket_count, chunk_count, few_files, once, read_totals, release, repeat, settle, shared_dir, with_chunk
from .textbytes import column_bytes, mix, slices, word_hashes

END = np.uint64(0xE4D0F7E47)
#: Parts of the documents: counted for the estimates, deleted from them for EM, not learned from.
COUNTED, DELETED, HELD_OUT = 0, 1, 2
#: One training document in so many is deleted from the first estimates.
DELETED_EVERY = 8
BUCKETS = 40
WORDS, PAIRS = 0, 1
OCTAVE = 4  # cells to an octave of an estimate


def _tokens(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a chunk, an end after each document, and the number of tokens of each document."""
    data, offsets = column_bytes(table[text])
    out, sizes = [], []
    for a, b in slices(offsets):
        h, doc = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        counts = np.bincount(doc, minlength=b - a)
        tokens = np.full(len(h) + b - a, END, np.uint64)
        tokens[np.arange(len(h)) + doc] = h
        out.append(tokens)
        sizes.append(counts + 1)
    return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _pairs(tokens: np.ndarray) -> np.ndarray:
    return mix(np.concatenate([[END], tokens[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + tokens)


def _count(keys: np.ndarray, part: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs in the counted part and in all training documents; a place stands for ``copies``."""
    order = np.argsort(keys)
    ranked, part, copies = keys[order], part[order], copies[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    counts = [np.add.reduceat(np.where(x, copies, 0), starts, dtype=np.int64) for x in (part == COUNTED, part != HELD_OUT)]
    return ranked[starts], np.stack(counts, axis=1)


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 plus the whole binary logarithm of its frequency."""
    return np.minimum(np.frexp(count.astype(np.float64))[1].astype(np.int64), BUCKETS - 1)


def learn_weights(bucket_of: np.ndarray, pair: np.ndarray, word: np.ndarray, weight: np.ndarray, uniform: float, rounds: int = 100) -> tuple[np.ndarray, float]:
    """EM for the mixture weights: a for each context bucket, and l."""
    a, low = np.full(BUCKETS, 0.5), 0.9
    seen = np.bincount(bucket_of, weight, BUCKETS)
    before = -np.inf
    for _ in range(rounds):
        lower = low * word + (1 - low) * uniform
        high = a[bucket_of] * pair
        total = high + (1 - a[bucket_of]) * lower
        share = high / total
        a = np.where(seen > 0, np.bincount(bucket_of, weight * share, BUCKETS) / np.maximum(seen, 1), a)
        rest = weight * (1 - share)
        low = float(np.clip(np.sum(rest * low * word / lower) / max(rest.sum(), 1e-300), 1e-6, 1 - 1e-6))
        a = np.clip(a, 0, 1 - 1e-6)
        a[0] = 0.0  # an unseen context has no estimate
        now = float(np.sum(weight * np.log(total)))
        if now - before < 1e-7 * abs(now):
            break
        before = now
    return a, low


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", held_out=None) -> DataFrame:
    """For each row: ``key``, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    ``held_out`` is a boolean column over ``docs`` of documents that nothing is learned from; by default those whose
    crc32 of the key as text leaves 2 when divided by 7 (a null key is learned from).  A null or empty text is its end
    token alone.  Without training documents all probabilities are uniform.  Words and pairs are known by 64-bit
    fingerprints.  ``docs`` is read several times and must give the same rows each time.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    if held_out is None:
        held_out = F.crc32(F.col(f"`{key}`").cast("string")) % 7 == 2
    part = F.when(held_out, HELD_OUT).when(F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(DELETED_EVERY)) == 0, DELETED).otherwise(COUNTED)
    base = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), part.alias("part")).withColumn("_row", F.xxhash64("key", "text", "part"))
    base, size = once(base.withColumn("_twin", F.xxhash64(F.lit(1), "key", "text", "part")), folder)
    n, buckets = chunk_count(docs, size=size), bucket_count(spark, size)
    base = with_chunk(base, "_row", n).drop("_row", "_twin")
    kind = base.schema["key"].dataType.simpleString()

    def send(pairs: bool):
        def run(table: pa.Table) -> pa.Table:
            tokens, sizes = _tokens(table, "text")
            part, copies = (np.repeat(table[c].to_numpy(), sizes) for c in ("part", "_n"))
            return pa.Table.from_batches([blocks(table["chunk"][0].as_py(), *_count(_pairs(tokens) if pairs else tokens, part, copies), buckets)])

        return run

    notes = []
    for k in (WORDS, PAIRS):
        answers = settle(answer_totals(base.groupBy("chunk").applyInArrow(send(k == PAIRS), BLOCK_SCHEMA), 2), folder, f"counts-{k}", size)
        release(spark)
        if k == WORDS:
            sums = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("d0", "t0", "d1", "t1"))).first()
        notes.append(answers.select("chunk", F.lit(k).alias("kind"), "bucket", "answer"))
    v0, n0, v1, n1 = (int(x) for x in sums)
    notes = notes[0].unionByName(notes[1])

    def features(table: pa.Table, notes: pa.Table):
        """Tokens of each document, and the totals of each token's pair, context and word: (counted, training) each."""
        tokens, sizes = _tokens(table, "text")
        out = []
        for k, keys in ((WORDS, tokens), (PAIRS, _pairs(tokens))):
            totals = read_totals(notes.filter(pc.equal(notes["kind"], k)), 2)
            distinct, inverse = np.unique(keys, return_inverse=True)
            if len(distinct) != len(totals):
                raise RuntimeError("the rows of a chunk changed between two reads of the input")
            out.append(totals[inverse])
            if k == WORDS:
                end = totals[np.searchsorted(distinct, END)]
        word, pair = out
        return sizes, pair, np.concatenate([[end], word[:-1]]), word

    def octave(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, np.floor(OCTAVE * np.log2(np.maximum(x, 1e-30))), 1).astype(np.int64)

    def gather(table: pa.Table, notes: pa.Table) -> pa.Table:
        sizes, pair, context, word = features(table, notes)
        at = np.repeat(table["part"].to_numpy() == DELETED, sizes)
        copies = np.repeat(table["_n"].to_numpy(), sizes)[at].astype(float)
        pair, context, word = pair[at, 0].astype(float), context[at, 0].astype(float), word[at, 0].astype(float)
        f2, f1 = pair / np.maximum(context, 1), word / max(n0, 1)
        cell = (bucket(context) << 40) + (octave(f2) + (1 << 19) << 20) + octave(f1) + (1 << 19)
        cells, inverse = np.unique(cell, return_inverse=True)
        return pa.table(_cells(cells, inverse, copies, f2, f1))

    def meet(function, schema: str) -> DataFrame:
        return base.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(function, schema)

    table = meet(gather, "cell long, n double, f2 double, f1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("f2").alias("f2"), F.sum("f1").alias("f1"))
    table = settle(table, folder, "cells")  # a frame that was collected would hold on to its shuffle files
    release(spark)
    cells = np.array([tuple(r) for r in table.collect()], float).reshape(-1, 4)  # bounded by buckets x octaves x octaves
    cells = cells[np.argsort(cells[:, 0])]
    weight = np.maximum(cells[:, 1], 1)
    a, low = learn_weights((cells[:, 0].astype(np.int64) >> 40), cells[:, 2] / weight, cells[:, 3] / weight, cells[:, 1], 1 / (v0 + 1))

    def score(table: pa.Table, notes: pa.Table) -> pa.Table:
        sizes, pair, context, word = features(table, notes)
        pair, context, word = pair[:, 1].astype(float), context[:, 1].astype(float), word[:, 1].astype(float)
        weight = a[bucket(context)]
        p = weight * pair / np.maximum(context, 1) + (1 - weight) * (low * word / max(n1, 1) + (1 - low) / (v1 + 1))
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return pa.table({
            "key": table["key"], "held_out": pa.array(table["part"].to_numpy() == HELD_OUT), "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(add((word > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(sizes), n1, np.int64)), "base_score": pa.array(add(np.log10((word + 1) / (n1 + v1 + 1)))), "score": pa.array(add(np.log10(p))), "_n": table["_n"],
        })

    out = meet(score, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, _n long")
    return few_files(repeat(out.withColumnRenamed("key", key)), size)


def _cells(cells: np.ndarray, inverse: np.ndarray, copies: np.ndarray, f2: np.ndarray, f1: np.ndarray) -> dict[str, pa.Array]:
    k = len(cells)
    sums = {"n": np.bincount(inverse, copies, k), "f2": np.bincount(inverse, copies * f2, k), "f1": np.bincount(inverse, copies * f1, k)}
    return {"cell": pa.array(cells, pa.int64())} | {c: pa.array(x[:k].astype(float)) for c, x in sums.items()}


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
