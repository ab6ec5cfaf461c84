"""Best-fit packing by a linear grouping scheme.

Pieces are whole documents, and 1024-token cuts of longer ones.  The plan depends on the multiset of lengths only,
which is a histogram with at most ``capacity`` entries at any corpus size; it is all that the driver sees.

1. Pieces longer than ``small`` are ordered by length and put into ``groups`` groups of equal cardinality (of 8 pieces
   at least); each length is rounded up to its group's largest.
2. For these few sizes, column generation optimises the configuration problem (which multisets of sizes fill a
   sequence, and how often each is used), from the configurations of a first fit on; the integer parts of the counts
   are taken.
3. Slots of a configuration get actual pieces: the longest left that isn't longer than the slot, and in the last slot
   the longest left that fits.
4. The few pieces that the integer parts leave, then the small pieces, go by best-fit decreasing into the room that remains.

Sequences with the same contents are handled as one run with a count, so the work on the driver is bounded by the
number of distinct lengths and configurations.  Executors then give each piece its rank among the pieces of its length
(ranks come from counts for each pair of hash part and length, so no length is gathered in one task), and the rank falls
into a run of the plan, which names the sequence and the place in it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import few_files, fewer_splits, release, settle, shared_dir

CAPACITY = 1024
GROUPS = 512
END_ID = 2
TOKENIZER = "byte_bpe_50k"
#: The pattern and the special token that the public vocabulary file states.
SPECIAL = {"<|endoftext|>": 50256}


def load_encoder(path: str, pattern: str):
    """A byte-level BPE encoder over the public rank file at ``path``; the special token's string is read as its id."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def _default_encoder():
    import public_tokenizers as public

    return load_encoder(public.path(f"{TOKENIZER}.tiktoken"), public.PATTERN)


#: The encoder's pattern keeps a state for each character of a run of white space; texts with longer runs go to the other library.
LONG_SPACE = 1 << 14
_encoder = None


class _Encoder:
    """Ids of a text: by the rank file, or where white space runs on for long by the same vocabulary's other file, which takes a few times as long."""

    def __init__(self):
        self.fast = _default_encoder()
        self.space = re.compile(r"\s{%d}" % LONG_SPACE)
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < LONG_SPACE or not self.space.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all")
        if self.slow is None:
            import public_tokenizers as public
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(public.path(f"{TOKENIZER}.json"))
            self.slow.no_truncation()
            self.slow.no_padding()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(docs: DataFrame, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Rows of ``docs`` without its text, once for each piece, with piece, start, length and ids_crc32.

    The ids are those of the byte-level BPE, then ``END_ID``; a null text counts as empty and gives one piece of
    length 1.  A document of more than ``capacity`` tokens is cut into full pieces after a first one with the rest.
    """
    others = [c for c in docs.columns if c != text]
    names = {c: f"c{i}" for i, c in enumerate(others)}
    flat = docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in others], F.col(text).alias("text"))
    schema = ", ".join([*(f"c{i} {flat.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(others))), "piece int", "start long", "length long", "ids_crc32 long"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _encoder
        _encoder = _encoder or _Encoder()
        end = np.array([END_ID], "<u4")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(len(others)).to_pylist()):
                ids = np.concatenate([_encoder(value), end]).astype("<u4", copy=False) if value else end
                first = (len(ids) - 1) % capacity + 1
                for p, s in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[s : first if s == 0 else s + capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            kept = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(len(others))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[*names.values(), "piece", "start", "length", "ids_crc32"],
            )

    return flat.mapInArrow(pieces, schema).withColumnsRenamed({v: k for k, v in names.items()})


class _Room:
    """Runs of equal open sequences, by the room left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        self.free: list[int] = []

    def add(self, count: int, contents: tuple[int, ...]) -> None:
        left = self.capacity - sum(contents)
        if not self.runs[left]:
            insort(self.free, left)
        self.runs[left].append((count, contents))

    def best_fit(self, length: int, n: int) -> None:
        """Place n pieces of one length, each into the fullest sequence that takes it; open new ones at need."""
        while n:
            at = bisect_left(self.free, length)
            if at == len(self.free):
                each = self.capacity // length
                if n >= each:
                    self.add(n // each, (length,) * each)
                    n %= each
                else:
                    self.add(1, (length,) * n)
                    n = 0
                continue
            left = self.free[at]
            count, contents = self.runs[left].pop()
            if not self.runs[left]:
                self.free.pop(at)
            each = left // length
            if n >= each * count:
                self.add(count, contents + (length,) * each)
                n -= each * count
            else:
                full, rest = divmod(n, each)
                if full:
                    self.add(full, contents + (length,) * each)
                if rest:
                    self.add(1, contents + (length,) * rest)
                if count - full - bool(rest):
                    self.add(count - full - bool(rest), contents)
                n = 0


def _price(sizes: np.ndarray, values: np.ndarray, capacity: int):
    """For each size the value of the best configuration that holds it, and a function that gives that configuration.

    The best single size for each room, then (max, +) products of it with itself: 2, 4, ... sizes to a sequence.
    """
    best = np.zeros(capacity + 1)
    best[sizes] = values
    number = np.full(capacity + 1, -1)
    number[sizes] = np.arange(len(sizes))
    run = np.maximum.accumulate(best)
    single = number[np.maximum.accumulate(np.where((best == run) & (number >= 0), np.arange(capacity + 1), 0))]
    rooms = np.arange(capacity + 1)
    rest = rooms[:, None] - rooms[None, :]
    levels, splits = [run], []
    while 1 << len(splits) < capacity // sizes.min():
        grid = np.where(rest >= 0, levels[-1][np.maximum(rest, 0)] + levels[-1][None, :], -1)
        splits.append(grid.argmax(axis=1))
        levels.append(grid[rooms, splits[-1]])

    def fill(level: int, room: int, counts: np.ndarray) -> None:
        if level:
            part = int(splits[level - 1][room])
            fill(level - 1, part, counts)
            fill(level - 1, room - part, counts)
        elif single[room] >= 0 and best[sizes[single[room]]] > 0:
            counts[single[room]] += 1

    def column(k: int) -> np.ndarray:
        counts = np.zeros(len(sizes))
        fill(len(splits), capacity - int(sizes[k]), counts)
        counts[k] += 1
        return counts

    return values + levels[-1][capacity - sizes], column


def _greedy(sizes: list[int], demand: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Configurations by first fit, each used until a size runs out, how often, and that size: later configurations don't hold it, so they are independent."""
    alive, left = list(range(len(sizes))), [float(d) for d in demand]  # sizes fall
    columns, use, gone = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes)), []
    for j in range(len(sizes)):
        room, counts, falling = capacity, columns[:, j], [-sizes[k] for k in alive]
        i = 0
        while i < len(alive):
            n = room // sizes[alive[i]] if i else 1
            counts[alive[i]] += n
            room -= n * sizes[alive[i]]
            i = bisect_left(falling, -room, i if not i else i + 1)
        use[j], out = min((left[k] / counts[k], k) for k in alive if counts[k])
        for k in alive:
            left[k] -= use[j] * counts[k]
        alive.remove(out)
        gone.append(out)
    return columns, use, gone


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The product, elementwise: a BLAS with threads of its own can block for ever in a process that has started a JVM."""
    return (matrix * vector).sum(axis=1)


def _triangular_inverse(basis: np.ndarray, gone: list[int]) -> np.ndarray:
    """The inverse of a basis whose column j is the last with a number in row ``gone[j]``, by substitution."""
    inverse = np.zeros_like(basis)
    for j, row in enumerate(gone):
        inverse[j] = -(basis[row, :j, None] * inverse[:j]).sum(axis=0)
        inverse[j, row] += 1
        inverse[j] /= basis[row, j]
    return inverse


def _inverse(basis: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row exchanges."""
    n = len(basis)
    work = np.concatenate([basis, np.eye(n)], axis=1)
    for j in range(n):
        k = j + int(np.abs(work[j:, j]).argmax())
        work[[j, k]] = work[[k, j]]
        work[j] /= work[j, j]
        factor = work[:, j].copy()
        factor[j] = 0
        rows = np.flatnonzero(factor)
        work[rows] -= factor[rows, None] * work[j]
    return work[:, n:]


def configurations(sizes: list[int], demand: list[int], capacity: int, pricings: int = 40) -> list[tuple[list[int], float]]:
    """Configurations and how often each is used to hold ``demand`` pieces of falling ``sizes``: column generation with the simplex method.

    It starts from the configurations of a first fit, and stops at the fractional optimum or after ``pricings``
    searches for columns; every step is a valid plan.
    """
    wanted = np.array(demand, float)
    basis, use, gone = _greedy(sizes, demand, capacity)
    lengths, inverse = np.array(sizes), _triangular_inverse(basis, gone)
    for _ in range(pricings):
        values, column = _price(lengths, np.maximum(inverse.sum(axis=0), 0), capacity)
        entered = 0
        for k in np.argsort(-values)[: max(8, len(sizes) // 8)]:
            new = column(int(k))
            if (inverse.sum(axis=0) * new).sum() <= 1 + 1e-6:
                continue
            move = _times(inverse, new)
            up = np.flatnonzero(move > 1e-9)
            if not len(up):
                continue
            leave = up[np.argmin(use[up] / move[up])]
            step = max(use[leave] / move[leave], 0.0)
            use = use - step * move
            use[leave] = step
            basis[:, leave] = new
            row = inverse[leave] / move[leave]
            inverse -= np.outer(move, row)
            inverse[leave] = row
            entered += 1
        if not entered:
            break
        use = np.maximum(_times(inverse, wanted), 0)
        if np.abs(_times(basis, use) - wanted).max() > 1e-7 * wanted.max():  # the updates have lost digits
            inverse = _inverse(basis)
            use = np.maximum(_times(inverse, wanted), 0)
    return [([int(x) for x in basis[:, j]], float(use[j])) for j in range(len(sizes)) if use[j] > 1e-9]


def _grouped(left: dict[int, int], small: int, groups: int) -> tuple[list[int], list[int]]:
    """The sizes, falling, that lengths above ``small`` are rounded up to in groups of equal cardinality, and how many pieces each stands for."""
    large = sorted((k for k in left if k > small), reverse=True)
    total = sum(left[k] for k in large)
    per = -(-total // max(1, min(groups, total // 8)))
    demand: dict[int, int] = {}
    size, room = 0, 0
    for k in large:
        n = left[k]
        while n:
            if not room:
                size, room = k, per
            take = min(n, room)  # a length may straddle groups; groups that round to one size are one
            demand[size] = demand.get(size, 0) + take
            n, room = n - take, room - take
    return list(demand), list(demand.values())


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = CAPACITY // 8, by_configuration: list[int] | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (count, lengths in a sequence) that hold each length as often as the histogram says.

    ``by_configuration``, where given, gets the number of pieces that the configurations placed.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v}
    room = _Room(capacity)
    out: list[tuple[int, tuple[int, ...]]] = []
    if full := left.pop(capacity, 0):
        out.append((full, (capacity,)))
    sizes, demand = _grouped(left, small, groups)
    have, placed = sorted(k for k in left if k > small), 0
    for contents, used in configurations(sizes, demand, capacity) if sizes else []:
        slots, count = [s for s, n in zip(sizes, contents, strict=True) for _ in range(n)], int(used + 1e-9)
        while count:
            # a slot takes the longest piece that its size allows, the last one the longest that still fits: a run lasts while none runs out
            chosen: dict[int, int] = defaultdict(int)
            inside: list[int] = []
            for i, s in enumerate(slots):
                at = bisect_right(have, s if i < len(slots) - 1 else capacity - sum(inside)) - 1
                while at >= 0 and left[have[at]] == chosen[have[at]]:
                    at -= 1
                if at < 0:
                    break
                chosen[have[at]] += 1
                inside.append(have[at])
            if len(inside) < len(slots):
                break  # what is left is shorter than all groups it could stand for
            run = min(count, *(left[x] // n for x, n in chosen.items()))
            for x, n in chosen.items():
                left[x] -= run * n
                if not left[x]:
                    have.remove(x)
            room.add(run, tuple(inside))
            count, placed = count - run, placed + run * len(inside)
    if by_configuration is not None:
        by_configuration.append(placed)
    for k in sorted((k for k in left if left[k]), reverse=True):
        room.best_fit(k, left[k])
    return out + [run for f in sorted(room.runs) for run in room.runs[f]]


def lay_out(runs: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The plan as intervals: pieces of a length with ranks from ``rank`` on (``count`` of them) go to sequences from ``base`` on, at ``offset``."""
    seen: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for count, contents in runs:
        offset = 0
        for length in contents:
            rows.append((length, seen[length], count, base, offset))
            seen[length] += count
            offset += length
        base += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "count", "base", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece"), groups: int = GROUPS) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) plus sequence_id and offset.  ``pieces`` is read twice: hand in a written table.

    Ties among equal rows are broken at random within a rank; either gets a place of its own.
    """
    spark = pieces.sparkSession
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 16)
    ranked = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = ranked.groupBy("length", "_part").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    laid = lay_out(plan(histogram, capacity, groups, capacity // 8))
    before = counts.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_part").orderBy(*order)
    ranks = ranked.withColumn("_rank", F.row_number().over(within) - 1).join(before, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_part", "_before")
    ranks = ranks.select(*pieces.columns, "_rank")
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long", "offset long"])
    names = [*pieces.columns, "sequence_id", "offset"]
    span = int(laid["rank"].max(initial=0) + laid["count"].max(initial=0) + 1)
    keys = laid["length"] * span + laid["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(laid["base"][at] + rank - laid["rank"][at]), pa.array(laid["offset"][at])], names=names)

    return few_files(ranks.mapInArrow(place, kinds), 4 * sum(k * n for k, n in histogram.items()))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequences; every other column of ``docs`` stays beside its pieces.

    Columns of the input called piece, start, length, ids_crc32, sequence_id, offset, _rank or _part are left out.
    """
    own = {"piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_rank", "_part", "_before", "count"}
    docs = docs.drop(*[c for c in docs.columns if c in own])
    folder = shared_dir(docs.sparkSession)
    pieces = settle(fewer_splits(cut(docs, capacity), docs), folder, "pieces", None)
    release(docs.sparkSession)
    return pack(pieces, capacity)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
