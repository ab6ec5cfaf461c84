"""N-gram Jaccard join by prefix trees.

Documents link when the Jaccard similarity of their sets of word n-grams reaches a threshold.  All steps are exact.

1. Each chunk of documents sends its distinct n-grams to be counted (``exchange``).  A document can only link if enough
   of its n-grams occur elsewhere; most documents end here.  The rest are collapsed to their distinct sets.
2. Among the sets the n-grams are counted again, which gives the global order (rare first, then by name) and drops more
   sets.  Two linked sets share an n-gram among their first ``n - ceil(t n) + 1``; sets that share one are put into one
   cluster (connected components of sets and first n-grams).
3. The sets of a cluster are stored in a trie, the frequent n-grams first, so near copies share long paths.  A set
   walks the trie, takes its partial overlap with a shared path from the path's last visitor, and leaves a subtree when
   the n-grams missed on the way exceed what the threshold and the remaining lengths allow.  Sets known to be connected
   are passed over, so a large group of near copies costs about a walk for each set; so are those whose sizes, or whose
   bitmaps of n-grams, rule a link out.
4. A cluster of more than ``BLOCK`` sets is dealt into blocks by the rarest n-gram, with some hubs visiting all blocks.
   Then a set that isn't connected with its cluster's largest component visits those blocks of the cluster in which
   one of its first n-grams occurs among the first of a set of a suitable size in another component: all pairs that can
   link and aren't connected have been tried then, whatever the cluster's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .exchange import BLOCK_SCHEMA, answer_repeats, answer_totals, blocks, bucket_count, chunk_count, few_files, flagged, once, read_repeats, read_totals, release, repeat, settle, shared_dir, with_chunk
from .textbytes import column_bytes, mix, shingles, slices, word_hashes

BLOCK = 512
HUBS = 8
GUESTS = 2048


def _sets(table: pa.Table, text: str, words: int):
    """(first document, last, n-grams, their documents) of each slice: distinct in a document, ordered by n-gram."""
    data, offsets = column_bytes(table[text])
    for a, b in slices(offsets):
        part = offsets[a : b + 1] - offsets[a]
        h, doc = word_hashes(data[offsets[a] : offsets[b]], part)
        grams, at = shingles(h, doc, b - a, words)
        grams = grams & ~np.uint64(1)
        order = np.argsort(grams, kind="stable")
        grams, at = grams[order], at[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (at[1:] != at[:-1])
        yield a, b, grams[new], at[new]


def _set_names(grams: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each document's set, from two sums over its n-grams and its size."""
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(one, at, mix(grams))
    np.add.at(two, at, mix(grams ^ np.uint64(0x5851F42D4C957F2D)))
    return mix(mix(one) + two * np.uint64(0x9E3779B97F4A7C15) + np.bincount(at, minlength=n).astype(np.uint64)).view(np.int64)


def _binary_rows(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


class Trie:
    """Sets over a small vocabulary as sorted paths; the common depth of neighbours is all there is of inner nodes."""

    def __init__(self, paths: list[np.ndarray]):
        self.order = np.array(sorted(range(len(paths)), key=lambda i: paths[i].tolist()), np.int64)
        self.paths = [paths[i] for i in self.order]
        common = [0]
        for x, y in zip(self.paths, self.paths[1:], strict=False):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            common.append(int(differ[0]) if len(differ) else m)
        self.common = np.array(common)

    def walk(self, mask: np.ndarray, allowed: int, wanted: np.ndarray):
        """(set, overlap) of those sets that ``wanted`` marks and that miss at most ``allowed`` of the mask."""
        overlap: np.ndarray = np.zeros(0, np.int64)  # along the path of the last visited set
        depth, left_at, last = 0, None, -1  # how far it is valid here; where that path was left; the last place
        for i in np.flatnonzero(wanted[self.order]).tolist():
            path, depth, last = self.paths[i], min(depth, int(self.common[last + 1 : i + 1].min())), i
            if left_at is not None and depth >= left_at:
                continue  # below the node that was left
            before = int(overlap[depth - 1]) if depth else 0
            overlap = np.concatenate([overlap[:depth], before + np.cumsum(mask[path[depth:]])])
            missed = np.arange(1, len(path) + 1) - overlap
            depth, left_at = len(path), None
            if len(path) and missed[-1] > allowed:
                left_at = int(np.searchsorted(missed, allowed, "right")) + 1
                continue
            yield int(self.order[i]), int(overlap[-1]) if len(path) else 0


def _bitmaps(paths: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each path, one set for each of its n-grams (several may share one); about two bits to an n-gram of the longest path."""
    width = min(1 << 14, max(64, 1 << (2 * max(map(len, paths), default=0)).bit_length()))
    out = np.zeros((len(paths), width // 8), np.uint8)
    for row, path in zip(out, paths, strict=True):
        bits = np.zeros(width, bool)
        bits[path % width] = True
        row[:] = np.packbits(bits)
    return out.view(np.uint64)


def trie_join(nodes: list[int], sizes: list[int], grams: list[np.ndarray], parts: list[int], residents: list[int], queries: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that join the sets at ``queries`` with those at ``residents``; ``parts`` are components known before.

    The edges connect what links connect, without a link between sets that are connected already.  A resident that is
    too long or too short, connected, or misses too many bits of a query's bitmap isn't visited in the trie.
    """
    vocabulary, inverse, counts = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, -counts))] = np.arange(len(vocabulary))
    ends = np.cumsum([len(g) for g in grams])
    paths = [np.sort(rank[x]) for x in np.split(inverse, ends[:-1])]
    trie, bits = Trie([paths[r] for r in residents]), _bitmaps(paths)
    label, size, held = np.unique(np.array(parts), return_inverse=True)[1], np.array(sizes, np.int64), np.array([len(p) for p in paths])
    at, resident_bits = np.array(residents, np.int64), bits[residents]
    mask, edges, place = np.zeros(len(vocabulary), bool), [], {q: k for k, q in enumerate(residents)}
    for q in queries:
        n, ns = size[q], size[at]
        fits = (label[at] != label[q]) & (den * np.minimum(n, ns) >= num * np.maximum(n, ns))
        fits[: place.get(q, -1) + 1] = False  # two residents meet once, the first of them asks
        of = np.flatnonzero(fits)
        if not len(of):
            continue
        need = -(-num * (n + ns[of]) // (num + den))
        fits[of] = (held[q] - np.bitwise_count(bits[q] & ~resident_bits[of]).sum(axis=1) >= need) & (held[at[of]] - np.bitwise_count(resident_bits[of] & ~bits[q]).sum(axis=1) >= need)
        if not fits.any():
            continue
        mask[paths[q]] = True
        for k, overlap in trie.walk(mask, int((den - num) * n // num), fits):
            r = int(at[k])
            if label[r] != label[q] and den * overlap >= num * (n + size[r] - overlap):
                label[label == label[q]] = label[r]
                edges.append((nodes[q], nodes[r]))
        mask[paths[q]] = False
    return edges


def _join_unit(num: int, den: int, guests_only: bool = False):
    """Joins the residents of each cluster of a unit with each other and with the visitors, or with the visitors alone."""

    def join(table: pa.Table) -> pa.Table:
        rows = table.select(["cluster", "node", "n", "part", "visits", "grams"]).to_pydict()
        by: dict[int, list[int]] = {}
        for i, c in enumerate(rows["cluster"]):
            by.setdefault(c, []).append(i)
        edges: list[tuple[int, int]] = []
        for members in by.values():
            members.sort(key=lambda i: rows["node"][i])
            at = range(len(members))
            visitors = [k for k in at if rows["visits"][members[k]]]
            residents = [k for k in at if not rows["visits"][members[k]]]
            edges += trie_join(
                *([rows[c][i] for i in members] for c in ("node", "n")), [np.frombuffer(rows["grams"][i], np.uint64) for i in members], [rows["part"][i] for i in members],
                residents, visitors if guests_only else visitors + residents, num, den,
            )
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return join


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, text: str = "text", key: str = "doc_id", rows: bool = False) -> DataFrame:
    """For each row: ``key``, n_shingles (distinct n-grams) and component_id, the smallest key reachable by links.

    With ``rows`` also _row, a digest of key and text, and part, a number of the component (null for a document that
    can't link).

    Two documents link when den * intersection >= num * union of their n-gram sets.  A document with fewer words has its
    whole sequence as its only n-gram; without words (null, empty, white space) its set is empty and it links with
    nothing.  Rows with equal keys are documents of their own.  A null key is never the smallest of several.
    ``docs`` is read several times and must give the same rows each time.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    base = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("_row", F.xxhash64("key", "text"))
    base, size = once(base.withColumn("_twin", F.xxhash64(F.lit(1), "key", "text")), folder)
    n, buckets = chunk_count(docs, size=size), bucket_count(spark, size)
    base = with_chunk(base, "_row", n).drop("_twin")
    kind = base.schema["key"].dataType.simpleString()

    def send(table: pa.Table) -> pa.Table:
        grams = [g for _, _, g, _ in _sets(table, "text", words)]
        keys = flagged(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        return pa.Table.from_batches([blocks(table["chunk"][0].as_py(), keys, None, buckets)])

    answers = settle(answer_repeats(base.groupBy("chunk").applyInArrow(send, BLOCK_SCHEMA)), folder, "repeated", size)
    release(spark)

    def keep(table: pa.Table, notes: pa.Table) -> pa.Table:
        parts = list(_sets(table, "text", words))
        keys = flagged(np.concatenate([g for _, _, g, _ in parts])) if parts else np.zeros(0, np.uint64)
        repeated = read_repeats(notes)
        if len(repeated) != len(keys):
            raise RuntimeError("the rows of a chunk changed between two reads of the input")
        sizes, names, sets, lengths = [], [], [], []
        for a, b, grams, at in parts:
            common = repeated[np.searchsorted(keys >> np.uint64(1), grams >> np.uint64(1))] if len(keys) else np.zeros(0, bool)
            total, shared = np.bincount(at, minlength=b - a), np.bincount(at[common], minlength=b - a)
            alive = (total > 0) & (den * shared >= num * total)
            use = common & alive[at]
            order = np.argsort(at[use], kind="stable")
            sets.append(grams[use][order])
            lengths.append(np.where(alive, shared, 0))
            sizes.append(total)
            names.append(pa.array(_set_names(grams, at, b - a), mask=~alive))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"key": table["key"], "_row": table["_row"], "_n": table["_n"], "n": pa.array(cat(sizes, np.int64)), "node": pa.chunked_array(names, pa.int64()), "grams": _binary_rows(cat(sets, np.uint64), cat(lengths, np.int64))})

    kept = settle(base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(keep, f"key {kind}, _row long, _n long, n long, node long, grams binary"), folder, "kept", size)
    release(spark)

    classes = kept.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("grams").alias("grams"))
    classes = with_chunk(settle(classes, folder, "classes", size // 2), "node", n)

    def send_again(table: pa.Table) -> pa.Table:
        grams = np.frombuffer(b"".join(table["grams"].to_pylist()), np.uint64)
        keys, counts = np.unique(grams, return_counts=True)
        return pa.Table.from_batches([blocks(table["chunk"][0].as_py(), keys, counts.astype(np.uint32).reshape(-1, 1), buckets)])

    answers = settle(answer_totals(classes.groupBy("chunk").applyInArrow(send_again, BLOCK_SCHEMA), 1), folder, "counted", size // 2)

    def rank(table: pa.Table, notes: pa.Table) -> pa.Table:
        rows = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        keys = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        totals = read_totals(notes, 1)[:, 0]
        out: dict[str, list] = {c: [] for c in ("node", "n", "weight", "first", "grams")}
        for node, size, grams in zip(table["node"].to_pylist(), table["n"].to_pylist(), rows, strict=True):
            count = totals[np.searchsorted(keys, grams)]
            grams, count = grams[count > 1], count[count > 1]
            if den * len(grams) < num * size:
                continue
            order = np.lexsort((grams, count))
            first = size - (-(-num * size // den)) + 1 - (size - len(grams))  # n-grams of one set alone stand before
            out["node"].append(node)
            out["n"].append(size)
            out["weight"].append(int(count.sum()))
            out["first"].append(grams[order[: max(first, 0)]].view(np.int64))
            out["grams"].append(grams.tobytes())
        types = {"node": pa.int64(), "n": pa.int64(), "weight": pa.int64(), "first": pa.list_(pa.int64()), "grams": pa.binary()}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})

    ranked = classes.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rank, "node long, n long, weight long, first array<long>, grams binary")
    ranked = settle(ranked, folder, "ranked", size // 2)

    # nodes, postings and edges have tens of bytes where a document has thousands
    slim = size // 32
    postings = ranked.select("node", F.explode("first").alias("gram"))
    hubs = postings.groupBy("gram").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").drop("last")
    hubs = settle(hubs, folder, "hubs", slim)  # with a plain table on either side, AQE splits a frequent n-gram
    clusters = connected_components(postings.join(hubs, "gram").select(F.col("node").alias("a"), F.col("hub").alias("b")), folder, "clusters", slim)
    members = settle(ranked.join(clusters.withColumnRenamed("component", "cluster"), "node"), folder, "members", size // 2)

    centre = [F.max_by("node", F.struct("weight", "node")), *(F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(1, HUBS))]
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.array_distinct(F.array(*centre)).alias("hubs"))
    sizes = settle(sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), folder, "sizes", slim)
    crowded = sizes.where("blocks > 1")
    shape = ["cluster", "node", "n", "part", "visits", "grams"]
    alone = members.join(sizes.where("blocks = 1").select("cluster"), "cluster").withColumn("part", F.col("node")).withColumn("visits", F.lit(False))
    unit = F.pmod(F.xxhash64("cluster"), F.lit(n))
    edges = settle(alone.groupBy(unit.alias("u")).applyInArrow(_join_unit(num, den), "a long, b long"), folder, "edges", slim)
    if not crowded.isEmpty():
        edges = edges.unionByName(_join_crowded(members.join(crowded, "cluster"), shape, num, den, folder, slim))

    found = connected_components(edges, folder, "components", slim)
    found = classes.select("node", "key").join(found, "node")
    least = found.groupBy("component").agg(F.min("key").alias("least"))
    found = settle(found.join(least, "component").select("node", "least", "component"), folder, "found", slim)
    single = classes.select("node", F.col("key").alias("own"))
    named = single.join(found, "node", "left").select("node", F.coalesce("least", "own").alias("component_id"), F.coalesce("component", "node").alias("part"))
    out = kept.drop("grams").join(named, "node", "left")
    return few_files(repeat(out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"), *["_row", "part"] * rows, "_n")), slim)


def _join_crowded(placed: DataFrame, shape: list[str], num: int, den: int, folder: str, slim: int) -> DataFrame:
    """Edges of the clusters with more than a block of sets; ``placed`` has their members with ``blocks`` and ``hubs``.

    Sets are dealt to blocks by their rarest n-gram, those of a frequent one by a hash of their own.  First each block is
    joined with itself and with the cluster's hubs; then a set that isn't connected with the largest component visits
    those blocks that hold a set of a suitable size with one of its first n-grams, and nothing but its own component.
    """
    placed = placed.withColumn("lead", F.get("first", F.lit(0)))
    leads = placed.groupBy("cluster", "lead").agg(F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("shares"))
    leads = settle(leads, folder, "leads", slim)  # with a plain table on either side, AQE splits a frequent one
    placed = placed.join(leads, (placed["cluster"] == leads["cluster"]) & placed["lead"].eqNullSafe(leads["lead"])).drop(leads["cluster"]).drop(leads["lead"])
    own = F.xxhash64("cluster", "lead", F.pmod(F.xxhash64("node"), F.col("shares")))
    placed = placed.withColumn("block", F.when(F.col("shares") > 1, own).otherwise(F.xxhash64("cluster", F.pmod(F.xxhash64("lead"), F.col("blocks"))))).drop("lead", "shares", "blocks")
    placed = settle(placed, folder, "placed", 16 * slim)

    home = placed.withColumn("part", F.col("node")).withColumn("visits", F.lit(False))
    all_blocks = settle(placed.select("cluster", "block").distinct(), folder, "blocks", slim)
    hubs = home.where("array_contains(hubs, node)").drop("block").join(all_blocks, "cluster").withColumn("visits", F.lit(True))
    hubs = hubs.join(placed.select("node", F.col("block").alias("at")), "node").where("at <> block")
    first = home.select("block", *shape).unionByName(hubs.select("block", *shape))
    edges = settle(first.groupBy("block").applyInArrow(_join_unit(num, den), "a long, b long"), folder, "edges-1", slim)

    parts = settle(connected_components(edges, folder, "parts", slim), folder, "parts", slim)
    known = placed.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    known = settle(known, folder, "known", 16 * slim)
    counts = known.groupBy("cluster", "part").count()
    main = counts.groupBy("cluster").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    known = known.join(settle(main, folder, "main", slim), "cluster")
    rest = known.where("part <> main")
    posted = known.select("cluster", "block", "part", "n", F.explode("first").alias("gram"))
    posted = settle(posted.groupBy("cluster", "gram", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("part").alias("p"), F.max("part").alias("q")), folder, "posted", slim)
    asked = rest.select("cluster", "node", "n", "part", F.col("block").alias("at"), F.explode("first").alias("gram")).join(posted, ["cluster", "gram"])
    asked = asked.where((F.col("at") != F.col("block")) & (F.lit(den) * F.col("most") >= F.lit(num) * F.col("n")) & (F.lit(num) * F.col("least") <= F.lit(den) * F.col("n")) & ((F.col("p") != F.col("part")) | (F.col("q") != F.col("part"))))
    asked = settle(asked.select("node", "block").distinct(), folder, "asked", slim)
    tables = settle(asked.groupBy("block").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("tables")), folder, "tables", slim)  # so many groups of guests
    guests = rest.drop("block").join(asked.join(tables, "block"), "node").withColumn("table", F.pmod(F.xxhash64("node"), F.col("tables")).cast("int")).withColumn("visits", F.lit(True))
    hosts = known.join(tables, "block").withColumn("table", F.explode(F.sequence(F.lit(0), F.col("tables") - 1))).withColumn("visits", F.lit(False))
    more = hosts.select("block", "table", *shape).unionByName(guests.select("block", "table", *shape)).groupBy("block", "table").applyInArrow(_join_unit(num, den, True), "a long, b long")
    return edges.unionByName(settle(more, folder, "edges-2", slim))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest key (equal keys: of the smallest digest); all rows without words stay."""
    folder = shared_dir(docs.sparkSession)
    found = settle(jaccard_components(docs, words, num, den, text, key, rows=True).select(F.col(f"`{key}`").alias("_key9"), F.col("_row").alias("_row9"), "n_shingles", "part"), folder, "components", None)
    best = found.where("part is not null").groupBy("part").agg(F.min(F.struct("_key9", "_row9")).alias("b")).select("b.*")
    stay = best.unionByName(found.where("part is null").select("_key9", "_row9")).distinct()
    marked = docs.withColumn("_mark9", F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")))
    out = marked.join(stay, (F.col("_mark9") == F.col("_row9")) & F.col(f"`{key}`").eqNullSafe(F.col("_key9")), "left_semi")
    if not found.where("n_shingles > 0").groupBy("_key9", "_row9").count().where("count > 1").isEmpty():  # rows that are there more than once
        words_in = F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        out = out.where(words_in).dropDuplicates(["_mark9", key]).unionByName(out.where(~words_in))
    return out.drop("_mark9")


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
