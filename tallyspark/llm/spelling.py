"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

1. Each document counts its words, chunks of documents add up, and Spark sums: the vocabulary with its frequencies.
2. Two words that differ by one inserted, deleted or replaced code point share all but ``q`` of the longer one's positional
   q-grams, at the same place or one further on.  No single edit touches two q-grams
   that are ``q`` places apart, so a word is posted only under its rarest ones up to the first that is so far from an
   earlier one: near words share one of these.  A list is (q-gram, place, length); words of that length live in it, and words that
   are a code point shorter visit it, so lists keep the limits of length and position.
3. A list is joined by itself: for each word the postings of its other q-grams within the list are merged by a heap, words
   that come up less often than the overlap bound of one edit are passed over, and the rest are verified.  A pair
   is given in the first list that both words are in, so nothing is sorted out later.  Lists of more than ``LIMIT``
   words are dealt into blocks.
4. Each word takes its most frequent near word, and forms are followed to the last by doubling.

A word is held as Latin-1 bytes, a byte to a code point: all letters of words are below U+0100.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import few_files, fewer_splits, release, settle, shared_dir
from .runs import by_key, dealt
from .textbytes import SLICE

LEAST, OFTEN, TIMES, DROP = 7, 2, 10, 31
Q = 3
LIMIT = 4096
#: Different words that a task sums up before it hands them on.
HELD = 500_000
#: A-Z lower-cased; what is in no word is a space.
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def _runs(text: str) -> Iterator[list[bytes]]:
    """Words of a text as Latin-1 bytes, a slice of a long text at a time."""
    start, n = 0, len(text)
    while start < n:
        part = text[start : start + SLICE].encode("latin-1", "replace").translate(_LETTER)
        stop = start + len(part)
        while stop < n and part[-1] != 32:  # a word goes on behind the slice
            more = text[stop : stop + SLICE].encode("latin-1", "replace").translate(_LETTER)
            end = more.find(b" ") + 1 or len(more)
            part, stop = part + more[:end], stop + end
        yield part.split()
        start = stop


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN, drop: int = DROP, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word (string) and n (long): the lower-cased runs of letters with at least ``least`` code points and ``often`` occurrences in all.

    Where ``drop`` divides the CRC-32 of ``<key>:<run>``, the run loses the code point at that number modulo its length first.
    Null texts have no words; a null key reads as an empty string.
    """
    flat = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").alias("text"))

    def hand_on(sums: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = defaultdict(int)
        crc32 = zlib.crc32
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = value.as_py()
                if not value:
                    continue
                prefix, found = crc32(f"{name}:".encode()), Counter()
                for words in _runs(value):
                    found.update([w for w in words if len(w) >= least])
                for w, n in found.items():
                    h = crc32(w if w.isascii() else w.decode("latin-1").encode(), prefix)
                    if not h % drop:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    sums[w] += n
                if len(sums) >= HELD:
                    yield hand_on(sums)
                    sums = defaultdict(int)
        if sums:
            yield hand_on(sums)

    counted = fewer_splits(flat.mapInArrow(count, "word string, n long"), docs)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _code(gram: bytes) -> int:
    """A number for a q-gram of letters, below 91 ** q."""
    out = 0
    for c in gram:
        out = out * 91 + (c - 96 if c < 192 else c - 165)
    return out


def _gram_counts(words: DataFrame, q: int) -> np.ndarray:
    """How often each q-gram is in the vocabulary, by its number: a table of 91 ** q places at any size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                w = word.encode("latin-1")
                sums.update([w[k : k + q] for k in range(len(w) - q + 1)])
        yield pa.RecordBatch.from_arrays([pa.array([_code(g) for g in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["gram", "n"])

    table = np.zeros(91**q, np.int64)
    for row in words.select("word").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        table[row["gram"]] = row["n"]
    return table


class Grams:
    """Ranks of q-grams, rare first, and the prefix that a word is posted under."""

    def __init__(self, counts: np.ndarray, q: int):
        order = np.lexsort((np.arange(len(counts)), counts))
        self.table, self.q, self.known = np.empty(len(counts), np.int32), q, {}
        self.table[order] = np.arange(len(counts), dtype=np.int32)

    def rank(self, gram: bytes) -> int:
        found = self.known.get(gram)
        if found is None:
            found = self.known[gram] = int(self.table[_code(gram)])
        return found

    def prefix(self, word: bytes) -> list[tuple[int, int]]:
        """(rank, place) of the word's rarest q-grams, up to the first by which two are so far apart that no single edit touches both.

        A q-gram that repeats stands for itself at its first and at its last place: before an edit the first one is the first
        in either word, behind it the last one is the last.
        """
        q, rank, places = self.q, self.rank, {}
        for k in range(len(word) - q + 1):
            places.setdefault(word[k : k + q], [k, k])[1] = k
        out, low, high = [], len(word), 0
        for r, (a, b) in sorted((rank(g), ab) for g, ab in places.items()):
            out += [(r, a), (r, b)] if a < b else [(r, a)]
            low, high = min(low, a), max(high, b)
            if high - low >= q:
                break
        return out


def _pack(rank: int, place: int, length: int) -> int:
    """A list's number; words of over a million letters may share one with shorter ones."""
    return rank << 40 | (place & 0xFFFFF) << 20 | length & 0xFFFFF


def _post(grams: Grams, words: DataFrame) -> DataFrame:
    """list, word, n, shorter: each word in its own lists, and as a visitor in those of words with one code point more."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, row, shorter = [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                n = len(word)
                own = grams.prefix(word.encode("latin-1"))
                for length, places in ((n, own), (n + 1, {(r, k + d) for r, k in own for d in (0, 1)})):
                    lists += [_pack(r, k, length) for r, k in places]
                    row += [i] * len(places)
                    shorter += [length > n] * len(places)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(shorter, pa.bool_())], names=["list", "word", "n", "shorter"])

    return words.select("word", "n").mapInArrow(post, "list long, word string, n long, shorter boolean")


def _one_edit(a: bytes, b: bytes) -> bool:
    """Whether a becomes b by one inserted, deleted or replaced byte."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    k, m = 0, len(short)
    while k < m and short[k] == long[k]:
        k += 1
    if len(short) == len(long):
        return k < m and short[k + 1 :] == long[k + 1 :]
    return len(long) == m + 1 and long[k + 1 :] == short[k:]


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """Numbers that are in at least ``least`` of the rising lists.

    The ``least - 1`` longest lists aren't merged: a number must be in one of the others, which a heap of their heads
    brings into order, and is looked up in the long ones then.
    """
    lists = sorted(lists, key=len)
    split = len(lists) - least + 1
    if split <= 0:
        return
    longest, heap = lists[split:], []
    for i, x in enumerate(lists[:split]):
        ahead = iter(x)
        heap.append((next(ahead), i, ahead))
    heapq.heapify(heap)
    replace, pop = heapq.heapreplace, heapq.heappop
    while heap:
        head, count = heap[0][0], 0
        while heap and heap[0][0] == head:
            _, i, ahead = heap[0]
            count += 1
            following = next(ahead, None)
            if following is None:
                pop(heap)
            else:
                replace(heap, (following, i, ahead))
        spare = count + len(longest) - least  # so many of the long lists may lack it
        for x in longest:
            at = bisect_left(x, head)
            if at == len(x) or x[at] != head:
                spare -= 1
                if spare < 0:
                    break
        else:
            yield head


def _join(words: list[bytes], visits: list[bool], shorter: list[bool], here: int, grams: Grams) -> Iterator[tuple[int, int]]:
    """Places (longer or equal, other) of the near pairs of a list, each in the first list that has both.

    A replaced letter leaves q-grams at their places; an inserted one moves those behind it one place on in the longer
    word.  Either touches ``q`` of the longer word's q-grams at most.
    """
    q, length = grams.q, max(len(w) + x for w, x in zip(words, shorter, strict=True))
    least, prefixes = length - 2 * q + 1, {}
    here_place = here >> 20 & 0xFFFFF
    own = least > 1  # all share the list's own q-gram: it counts for each pair and needs no list
    long, short = defaultdict(list), defaultdict(list)
    for i, (w, x) in enumerate(zip(words, shorter, strict=True)):
        postings = short if x else long
        for k in range(len(w) - q + 1):
            postings[w[k : k + q], k].append(i)

    def prefix(i: int) -> list[tuple[int, int]]:
        if i not in prefixes:
            prefixes[i] = grams.prefix(words[i])
        return prefixes[i]

    def first(i: int, j: int) -> int:
        """The first list that the longer word at i and the one at j share."""
        shift, has = len(words[i]) - len(words[j]), set(prefix(i))
        return min(_pack(r, k + d, length) for r, k in prefix(j) for d in range(shift + 1) if (r, k + d) in has)

    places = [k for k in range(length - q + 1) if not (own and k == here_place)]
    for i, w in enumerate(words):
        if shorter[i]:
            continue
        lists = []
        for k in places:
            gram = w[k : k + q]
            same = long[gram, k]
            if same[-1] > i:
                lists.append(same[bisect_right(same, i) :])
            if not short:
                continue
            at, before = short.get((gram, k)), short.get((gram, k - 1))
            if at or before:
                lists.append(sorted({*at, *before}) if at and before else at or before)
        for j in merged(lists, least - own):
            if not (visits[i] and visits[j]) and _one_edit(words[j], w) and first(i, j) == here:
                yield i, j


def _near(grams: Grams):
    """Near pairs of the lists, as (word, near word, its n) both ways."""

    def near(table: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([], [], [])
        sizes, shorter = np.diff(at), table["shorter"].to_numpy()
        homes = np.add.reduceat(~shorter, at[:-1])
        keep = (sizes > 1) & (homes > 0)
        for s, n in zip(at[:-1][keep].tolist(), sizes[keep].tolist(), strict=True):
            part = table.slice(s, n)
            texts, times, visits, shorts = (part[c].to_pylist() for c in ("word", "n", "visits", "shorter"))
            rows = defaultdict(list)
            for k, (w, x) in enumerate(zip(texts, shorts, strict=True)):
                rows[len(w) + x].append(k)
            for of in rows.values():
                words = [texts[k].encode("latin-1") for k in of]
                for i, j in _join(words, [visits[k] for k in of], [shorts[k] for k in of], part["list"][0].as_py(), grams):
                    for a, b in ((of[i], of[j]), (of[j], of[i])):
                        out[0].append(texts[a])
                        out[1].append(texts[b])
                        out[2].append(times[b])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "n"])

    return near


def near_words(words: DataFrame, folder: str, least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """word, near, n (of near): all pairs of the distinct ``word`` of ``words`` that one edit tells apart, both ways, each once.

    Words have ``least`` (2 at least) code points or more; ``words`` is read several times: hand in a written table.
    """
    grams = Grams(_gram_counts(words, q := min(Q, least // 2)), q)
    posted = settle(_post(grams, words), folder, "posted", None)
    lists = dealt(posted, "list", F.col("word"), limit, folder, "frequent")
    return by_key(lists, ["list", "block"], _near(grams), "word string, near string, n long")


def _roots(forms: DataFrame, folder: str) -> DataFrame:
    """word and root for the rows (word, form): the end of the chain of forms; each step doubles what has been followed."""
    now, step = settle(forms.select("word", F.col("form").alias("root")), folder, "roots-0"), 0
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        step += 1
        joined = now.join(ahead, now["root"] == ahead["_at"], "left")
        after = settle(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), folder, f"roots-{step}")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = settle(after.drop("moved"), folder, f"roots-{step}-kept")


def spelling_groups(docs: DataFrame, least: int = LEAST, often: int = OFTEN, times: int = TIMES, drop: int = DROP, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """word, n, form, form_n, n_near and root for each word of the vocabulary.

    ``form`` is the near word (one inserted, deleted or replaced code point) of the largest n, of equal ones the smallest
    in code-point order, if its n is ``times`` that of the word at least; else it and ``form_n`` are null.  ``root``
    is the last of the forms' chain, the word itself where it has none; n_near counts the near words.  Repeated rows count
    as often as they are there.  An empty table, or one without such words, gives an empty result; other columns aren't read.
    """
    folder = shared_dir(docs.sparkSession)
    words = settle(vocabulary(docs, least, often, drop, text, key), folder, "words")
    release(docs.sparkSession)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words, folder, least, limit).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = settle(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), folder, "near")
    release(docs.sparkSession)
    good = F.col("form_n") >= F.lit(times) * F.col("n")
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    named = settle(named, folder, "named")
    out = named.join(_roots(named.where("form is not null"), folder), "word", "left")
    return few_files(out.select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root")), 0)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
