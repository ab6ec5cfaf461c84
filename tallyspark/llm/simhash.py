"""SimHash near-duplicates by signatures with one bit deleted.

1. A document's fingerprint has a bit set where over half of its word shingles' XXH64 digests have it set.  Documents of
   equal fingerprints are one class.
2. Fingerprints that differ in at most ``bits`` bits, cut into ``bits // 2 + 1`` segments, have a segment that differs in
   at most one bit.  So each class is listed under all its one-wildcard variants, which are (segment, wildcard, other
   bits of the segment): 64 rows, whatever ``bits`` is.  Two fingerprints that link share a variant.
3. Rows of equal variants meet; pairs are verified by all 64 bits, and a run of a variant gives a spanning forest of its
   links, not all pairs.  Variants of more than ``LIMIT`` classes are first refined by a part of the remaining bits
   that must agree (those differ in ``bits`` bits at most, so one of ``bits + 1`` parts is equal), and what is still too
   frequent is dealt into blocks: no run grows with the corpus, and no pair is left out.
4. Components of the links name the documents' groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .exchange import few_files, fewer_splits, release, settle, shared_dir
from .runs import by_key, dealt
from .textbytes import SLICE, column_bytes, cuts

SEED = 42
LIMIT = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _digests(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of the n-word shingles of ``words``, joined by a space."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    line, m = b" ".join(words), max(0, len(words) - n + 1)
    begin, end = (ends - sizes)[:m].tolist(), ends[n - 1 :].tolist()
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(begin, end, strict=True)), np.uint64, m)


def _fingerprint(data: np.ndarray, n: int) -> int:
    """Of one text's bytes; a long text is taken in parts that overlap by n-1 words."""
    votes, total, before = np.zeros(64, np.int64), 0, []
    for a, b in cuts(data) if len(data) > SLICE else [(0, len(data))]:
        words = before + data[a:b].tobytes().translate(_LOWER).split()
        if len(words) >= n:
            h = _digests(words, n)
            for k in range(0, len(h), 1 << 15):
                votes += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        before = words[-(n - 1) :] if n > 1 else []
    if not total:
        return int(_digests(before, len(before))[0]) if before else 0  # one shingle's majority is itself
    return int.from_bytes(np.packbits(2 * votes > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and fingerprint (long, two's complement) of each row; a text with fewer words is one shingle, without words (null, empty, blank) it is 0."""
    flat = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column(1))
            found = np.array([_fingerprint(data[a:b], words) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fingerprint"])

    return flat.mapInArrow(mark, f"key {flat.schema['key'].dataType.simpleString()}, fingerprint long").withColumnRenamed("key", key)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(of: list[int], n: int) -> list[int]:
    """Masks of n parts of the bits ``of``, as even as can be (empty parts where there are fewer bits)."""
    return [sum(1 << b for b in of[len(of) * k // n : len(of) * (k + 1) // n]) for k in range(n)]


def variants(bits: int) -> list[tuple[int, list[int]]]:
    """For each of the 64 wildcards the mask of its segment's other bits, and the masks of the parts that refine it."""
    out = []
    for mask in _parts(list(range(64)), bits // 2 + 1):
        rest = [b for b in range(64) if not mask >> b & 1]
        out += [(mask & ~(1 << b), _parts(rest, bits + 1)) for b in range(64) if mask >> b & 1]
    return out


def _forest(prints: np.ndarray, visits: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Places of links that connect what the links of a run connect: of all but visitors with each other."""
    order = np.argsort(visits, kind="stable")  # who lives here stands first
    prints, here = prints[order], int((~visits).sum())
    label, edges = np.arange(len(prints)), []
    for i in range(here):
        of = i + 1 + np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits)
        of = of[label[of] != label[i]]
        for k, name in zip(*np.unique(label[of], return_index=True), strict=True):
            edges.append((int(order[i]), int(order[of[name]])))
            label[label == k] = label[i]
    return edges


def _links(bits: int):
    def links(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        prints, visits = table["fingerprint"].to_numpy().view(np.uint64), table["visits"].to_numpy()
        sizes = np.diff(at)
        two = at[:-1][sizes == 2]
        two = two[(np.bitwise_count(prints[two] ^ prints[two + 1]) <= bits) & ~(visits[two] & visits[two + 1])]
        a, b = [prints[two]], [prints[two + 1]]
        for s, n in zip(at[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found = np.array(_forest(prints[s : s + n], visits[s : s + n], bits), np.int64).reshape(-1, 2)
            a.append(prints[s + found[:, 0]])
            b.append(prints[s + found[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return links


def links(classes: DataFrame, folder: str, bits: int = 4, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) between the distinct values of ``fingerprint`` that connect all that differ in at most ``bits`` bits."""
    own, masks = F.col("fingerprint"), variants(bits)
    listed = F.array(*(F.xxhash64(F.lit(k), own.bitwiseAND(F.lit(_signed(mask)))) for k, (mask, _) in enumerate(masks)))
    rows = classes.select("fingerprint", F.posexplode(listed).alias("wildcard", "variant"))
    often = settle(rows.groupBy("variant").count().where(F.col("count") > limit).select("variant", F.lit(True).alias("often")), folder, "often")
    if often.isEmpty():
        plain = rows.select("fingerprint", "variant", F.lit(0).alias("block"), F.lit(False).alias("visits"))
        return by_key(plain, ["variant", "block"], _links(bits), "a long, b long")
    # a frequent variant is refined by each part of the other bits
    parts = F.array(*(F.array(*(F.lit(_signed(m)) for m in refine)) for _, refine in masks))
    finer = F.transform(F.get(parts, F.col("wildcard")), lambda m: F.xxhash64(F.col("variant"), m, F.col("fingerprint").bitwiseAND(m)))
    marked = rows.join(often, "variant", "left")
    keys = marked.select("fingerprint", F.explode(F.when(F.col("often"), finer).otherwise(F.array("variant"))).alias("variant"))
    return by_key(dealt(keys, "variant", own, limit, folder, "dealt"), ["variant", "block"], _links(bits), "a long, b long")


def simhash_components(docs: DataFrame, words: int = 4, bits: int = 4, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """For each row ``key``, fingerprint (16 hexadecimal digits) and component_id, the smallest key reachable by links, itself included.

    Rows link when their fingerprints differ in at most ``bits`` bits; so all rows without words link with each other.
    Equal rows stay as often as they are there.  A null key is never the smallest of several; a group of null keys alone
    has a null component.  An empty table gives an empty result; other columns of ``docs`` aren't read.
    """
    folder = shared_dir(docs.sparkSession)
    prints = fingerprints(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), words, "text", "key")
    prints = settle(fewer_splits(prints, docs), folder, "prints", None)
    classes = settle(prints.groupBy("fingerprint").agg(F.min("key").alias("least")), folder, "classes")
    edges = settle(links(classes, folder, bits, limit), folder, "links")
    release(docs.sparkSession)
    found = connected_components(edges, folder, "components").withColumnRenamed("node", "fingerprint")
    named = settle(classes.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")), folder, "named")
    least = settle(named.groupBy("component").agg(F.min("least").alias("component_id")), folder, "least")
    named = settle(named.join(least, "component").select("fingerprint", "component_id"), folder, "groups")
    out = prints.join(named, "fingerprint").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
    return few_files(out, 0)


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
