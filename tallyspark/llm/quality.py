"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its labels.

1. *Labellers* vote bad, good or nothing on each document, for two questions: is it prose of some quality (cases, symbols,
   noisy words, monotony, echoed words, the commonest word, repeated lines, and given labels where there are any), and is it free of abuse
   (two halves of a word list, their density, and given labels).  The word list is learned: words that abusive labelled
   documents hold many times as often as others.
2. *Weak labels.*  Documents with the same votes are one pattern, so the corpus is a table of pattern counts whose size
   doesn't depend on the corpus.  Expectation-maximisation over it estimates how often each labeller votes what on either
   class, and the posterior probability of each pattern.
3. *Scorer.*  A logistic regression over hashed features (words by density, shapes of words and the labellers' shares by steps) with an L1
   penalty is trained on the posterior labels of a bounded sample, ``sample`` documents chosen by a hash of id and text, in
   one task that holds their features; its few non-zero weights score every document.  Half of the sample is drawn from all documents alike, a
   quarter evenly from the vote patterns of either question, so what is rare in the corpus isn't rare in the sample.
   Documents weigh by the inverse of their rate, but those that the posterior calls bad at least as much as in a draw
   from all alike, and where they make up less than ``FLOOR`` they are raised to it (by ``RAISE`` at most): the penalty
   would keep a rare kind of bad documents from getting weights otherwise.

A document is kept if its quality is at least one half and its toxicity below one half.  A document without words gives
the scorer nothing to go by and is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import fewer_splits, settle, shared_dir
from .textbytes import column_bytes, lower, mix, slices, span_hashes, word_spans

SAMPLE = 8_000
DIMENSIONS = 1 << 22
FLOOR, RAISE = 0.05, 16
GOOD, BAD, NONE = 1, 0, 2
#: Bytes of a word that stand for it beside the whole, so inflected forms count together.
BEGINNINGS = (4, 6)
QUALITY = ("case", "symbols", "noisy words", "monotony", "echo", "commonest word", "repeated lines", "label")
TOXICITY = ("first half of the list", "second half of the list", "density", "label")

_UPPER, _LOWER, _DIGIT, _SYMBOL, _OTHER = 1, 2, 3, 4, 5
_CLASS = np.full(256, _LOWER, np.int8)
_CLASS[:128] = _OTHER
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
_CLASS[[ord(c) for c in "!#$%&*+<=>@\\^_`{|}~"]] = _SYMBOL
_CLASS[[32, *range(9, 14)]] = 0
_LETTER = (_CLASS == _UPPER) | (_CLASS == _LOWER)


class _Batch:
    """Byte and word statistics of the documents of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        self.data, self.offsets = data, offsets
        self.kind = _CLASS[data]
        self.starts, self.ends, self.doc = word_spans(data, offsets)
        self.words = np.bincount(self.doc, minlength=self.n)

    def count(self, kind: int) -> np.ndarray:
        if self.n == 1:
            return np.array([np.count_nonzero(self.kind == kind)])
        return np.diff(np.concatenate([[0], np.cumsum(self.kind == kind)])[self.offsets])

    def per_word(self, marked: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, marked, self.n)

    def letter_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (document, fingerprint) of runs of letters, A-Z lower-cased, and of the beginnings of longer ones; how often each occurs."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        letter = _LETTER[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1] | edge[1:n]
        last[:-1] &= ~letter[1:] | edge[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        data, doc = lower(self.data), np.searchsorted(self.offsets, starts, "right") - 1
        docs, hashes = [doc], [span_hashes(data, starts, ends)]
        for k in BEGINNINGS:
            of = np.flatnonzero(ends - starts > k)
            docs.append(doc[of])
            hashes.append(mix(span_hashes(data, starts[of], starts[of] + k) + np.uint64(k)))
        doc, h = np.concatenate(docs), np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        order = order[np.argsort(doc[order], kind="stable")]
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        return doc[first], h[first], np.diff(np.append(first, len(h)))

    def shapes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, fingerprint) of a word's first and last character class and the share of words like it, by steps."""
        ends = self.kind[self.ends - 1]
        last = np.where(ends == _SYMBOL, 16 + self.data[self.ends - 1].astype(np.int64), ends)
        second = np.where(self.ends - self.starts > 1, self.kind[np.maximum(self.ends - 2, 0)], 0)
        shape = (self.kind[self.starts].astype(np.int64) * 8 + second) * 512 + last
        pair, counts = np.unique(self.doc.astype(np.int64) << 32 | shape, return_counts=True)
        doc = pair >> 32
        share = counts / np.maximum(self.words[doc], 20)  # a few words aren't a share
        out = [(doc[share > s], mix((pair[share > s] & 0xFFFFFFFF).astype(np.uint64) * np.uint64(8) + np.uint64(k) + np.uint64(1 << 40))) for k, s in enumerate((0, 0.05, 0.2, 0.5))]
        return np.concatenate([d for d, _ in out]), np.concatenate([h for _, h in out])


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def statistics(b: _Batch) -> dict[str, np.ndarray]:
    """Shares that the labellers look at; NaN where a document has too little of something."""
    upper, lower, symbols = (b.count(k) for k in (_UPPER, _LOWER, _SYMBOL))
    letters, solid = upper + lower, upper + lower + symbols + b.count(_DIGIT) + b.count(_OTHER)
    word = span_hashes(b.data, b.starts, b.ends)
    doc, name = _distinct(b.doc, word)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (b.doc[1:] == b.doc[:-1])
    order = np.lexsort((word, b.doc))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (b.doc[order][1:] != b.doc[order][:-1])
    first = np.flatnonzero(new)
    most = np.zeros(b.n)
    np.maximum.at(most, b.doc[order][first], np.diff(np.append(first, len(word))).astype(float))
    ends = np.flatnonzero(b.data == 10) + 1
    cuts = np.unique(np.concatenate([b.offsets, ends]))
    line_doc = np.searchsorted(b.offsets, cuts[:-1], "right") - 1
    lines = np.bincount(line_doc, minlength=b.n)
    once = np.bincount(_distinct(line_doc, span_hashes(b.data, cuts[:-1], cuts[1:]))[0], minlength=b.n)
    share = lambda x, of, least: np.where(of >= least, x / np.maximum(of, 1), np.nan)
    return {
        "case": share(upper, letters, 20), "symbols": share(symbols, solid, 1), "noisy words": share(b.per_word(b.kind[b.ends - 1] == _SYMBOL), b.words, 1),
        "monotony": 1 - share(np.bincount(doc, minlength=b.n), b.words, 50), "echo": share(b.per_word(same), b.words, 5), "commonest word": share(most, b.words, 20), "repeated lines": share(lines - once, lines, 5),
    }


#: What counts as good and as bad of each share; between them a labeller doesn't vote.
BOUNDS = {"case": (0.25, 0.5), "symbols": (0.01, 0.05), "noisy words": (0.02, 0.1), "monotony": (0.7, 0.85), "echo": (0.05, 0.2), "commonest word": (0.15, 0.3), "repeated lines": (0.1, 0.5)}


def quality_votes(b: _Batch) -> np.ndarray:
    """A column for each labeller of ``QUALITY`` but the labels."""
    out = []
    for name, x in statistics(b).items():
        good, bad = BOUNDS[name]
        out.append(_vote(x > bad, x < good))
    return np.stack(out, axis=1)


def toxicity_votes(b: _Batch, lexicon: np.ndarray) -> np.ndarray:
    """A column for each labeller of ``TOXICITY`` but the labels; ``lexicon`` holds sorted fingerprints of words."""
    if not len(lexicon):
        return np.full((b.n, 3), NONE)
    doc, h, often = b.letter_words()
    at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
    hit = lexicon[at] == h
    doc, at, often = doc[hit], at[hit], often[hit]
    halves = [np.bincount(doc[at % 2 == k], often[at % 2 == k], b.n) for k in (0, 1)]
    some, hits = b.words > 0, halves[0] + halves[1]
    # a long text may hold a listed word by chance
    return np.stack([*(_vote(x >= np.maximum(1, b.words / 400), some & (x == 0)) for x in halves), _vote(hits >= np.maximum(2, b.words / 150), some & (hits < b.words / 400))], axis=1)


def weak_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of the good class for each pattern of votes, and P(vote | class) as [labeller, class, vote].

    Expectation-maximisation from a majority vote; the votes are taken to be independent given the class.
    """
    n, labellers = votes.shape
    good, bad = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    post = np.where(bad == 0, 0.9, np.where((bad == 1) & (good > 0), 0.3, 0.05))  # a complaint weighs more than its absence
    one_hot = np.stack([votes == v for v in (BAD, GOOD, NONE)], axis=2).astype(float)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        rates = np.einsum("cn,nlv->lcv", weight, one_hot) + 0.1
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        logs = np.log(prior)[:, None] + np.einsum("nlv,lcv->cn", one_hot, np.log(rates))
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(now - post).max(initial=0) < 1e-9:
            break
        post = now
    return post, rates if n else np.full((labellers, 2, 3), 1 / 3)


def _features(b: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, hashed features and their values up to 1: words by their density, shapes and shares by steps."""
    (d1, h1, often), (d2, h2) = b.letter_words(), b.shapes()
    docs, hashes, values = [d1, d2], [h1, h2], [np.minimum(often * 100 / np.maximum(b.words[d1], 1), 1), np.ones(len(d2))]
    for k, (name, x) in enumerate(statistics(b).items()):
        good, bad = BOUNDS[name]
        for j, step in enumerate((good, (good + bad) / 2, bad)):
            of = np.flatnonzero(x > step)
            docs.append(of)
            hashes.append(mix(np.full(len(of), 16 * k + j + (1 << 41), np.uint64)))
            values.append(np.ones(len(of)))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64), np.concatenate(values)


def train_scorer(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, penalty: float = 3e-4, rounds: int = 500, least: int = 10, clear: float = 6.0, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Features and weights that aren't 0, and the bias: logistic regression on soft labels by accelerated proximal gradient.

    Weights are evidence against the good class only, so a short document isn't held to lack evidence for it.  Features
    of fewer than ``least`` documents, and those whose documents' mean label is within ``clear`` standard errors of the
    mean of all, are left out.  ``weight`` is what each document counts, one where it isn't given.
    """
    n = len(target)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    weight = np.ones(n) if weight is None else weight / weight.mean()
    away = target - np.dot(weight, target) / n
    spread, of = max(np.dot(weight, away * away) / n, 1e-12), value * weight[doc]
    shift = np.bincount(feature, of * away[doc], DIMENSIONS)
    good = (np.bincount(feature, minlength=DIMENSIONS) >= least) & (shift <= -clear * np.sqrt(np.bincount(feature, of * of, DIMENSIONS) * spread + 1e-12))
    kept = np.flatnonzero(good)
    use = good[feature]
    row, value, column, k = doc[use].astype(np.int64), value[use].astype(float), np.searchsorted(kept, feature[use]), len(kept)
    # a column of ones for the bias beside the features; the step is the inverse of the curvature's bound, by power iteration
    v, top = np.ones(k + 1), 1.0
    for _ in range(30):
        x = (np.bincount(row, value * v[:k][column], n) + v[k]) * weight
        v = np.append(np.bincount(column, value * x[row], k), x.sum())
        top = np.linalg.norm(v)
        v /= top
    step = 3.5 * n / top
    w, z, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * z[:k][column], n) + z[k], -30, 30)))
        error = (p - target) * weight / n
        new = z - step * np.append(np.bincount(column, value * error[row], k), error.sum())
        new[:k] = np.minimum(new[:k] + step * penalty, 0)
        if np.dot(z - new, new - w) > 0:
            t = 1.0  # restart where the momentum points uphill
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / ahead * (new - w), new, ahead
    some = np.flatnonzero(w[:k])
    return kept[some], w[some], float(w[k])


def _each(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, _Batch]]:
    data, offsets = column_bytes(column)
    for a, b in slices(offsets):
        yield a, b, _Batch(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _sampled(rows: DataFrame, key: str, size: int, total: int, salt: int) -> DataFrame:
    """About ``size`` of ``total`` rows, the same ones each time: those whose hashed key is small enough."""
    if total <= size:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) < F.lit(int((1 << 30) * size / total)))


def _level(counts: np.ndarray, size: float) -> float:
    """The level at which ``counts`` cut to it sum to ``size``; the largest count where they don't reach it."""
    rising = np.sort(counts)
    filled = np.cumsum(rising) - rising + rising * np.arange(len(rising), 0, -1)  # the sum when cut to each count
    k = int(np.searchsorted(filled, size))
    return float(rising[-1]) if k == len(rising) else float((size - rising[:k].sum()) / (len(rising) - k))


def draw_rates(counts: np.ndarray, patterns: list[np.ndarray], size: int) -> np.ndarray:
    """The share to draw of each group of ``counts`` documents, about ``size`` in all: a half from all documents alike,
    the rest in equal parts from each numbering of the groups in ``patterns``, as evenly from its numbers as they allow."""
    if counts.sum() <= size:
        return np.ones(len(counts))
    rates = np.full(len(counts), size / 2 / counts.sum())
    for numbers in patterns:
        sizes = np.bincount(numbers, counts)
        some = sizes > 0
        rates += np.where(some, np.minimum(sizes, _level(sizes[some], size / 2 / len(patterns))) / np.maximum(sizes, 1), 0)[numbers]
    return np.minimum(rates, 1)


def learn_lexicon(docs: DataFrame, labels: DataFrame, size: int) -> np.ndarray:
    """Sorted fingerprints of words that abusive labelled documents hold far more often, from ``size`` labelled documents.

    Half of them are abusive and half aren't, or as many as there are of either.
    """
    known = labels.where("toxic is not null")
    per_class = dict(known.groupBy(F.col("toxic").cast("int")).count().collect())
    level = _level(np.array(list(per_class.values()), float), size) if per_class else 0.0
    drawn = [_sampled(known.where(F.col("toxic").cast("int") == c), "key", int(level), n, 5) for c, n in sorted(per_class.items())]
    ids = (drawn[0].unionByName(drawn[1]) if len(drawn) == 2 else (drawn or [known])[0]).select("key", "toxic")
    rows = docs.join(F.broadcast(ids), "key").select("text", "toxic")  # at most about `size` ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, part in _each(batch.column(0)):
                doc, h, _ = part.letter_words()
                names, inverse = np.unique(h, return_inverse=True)
                bad = np.bincount(inverse, toxic[a:b][doc], len(names)) if len(names) else np.zeros(0)
                all_ = np.bincount(inverse, minlength=len(names)) if len(names) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array((all_ - bad).astype(np.int64))], names=["word", "bad", "good"])

    counts = rows.mapInArrow(count, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = ids.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)), F.count("*")).first()
    n_bad, n_good = int(totals[0]), int(totals[1] - totals[0])
    much = (F.col("bad") + 0.5) / (n_bad + 1) >= 20 * (F.col("good") + 0.5) / (n_good + 1)
    found = counts.where((F.col("bad") >= max(3, 0.01 * n_bad)) & much).select("word").collect()  # each is in a hundredth of the sample's abusive documents at least
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


Model = list[tuple[np.ndarray, np.ndarray, float]]


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """The scorers of quality and of freedom from abuse: features, weights and bias of each.

    ``labels`` (doc_id, quality 0/1, toxic 0/1) may cover some documents; nulls in it count as missing, of repeated ids
    the worse label counts.  The word list and the scorers are fitted on at most about ``sample`` labelled documents and
    ``sample`` documents; the weak labels come from all documents.  A feature needs 10 of the documents drawn.  Without
    documents all scores are one half.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    base = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("key", "text"))
    if labels is None:
        labels = base.select("key", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).limit(0)
    else:
        labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labels = settle(labels, folder, "labels")
    lexicon = learn_lexicon(base, labels, sample)
    kind = base.schema["key"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in _each(batch.column(1)):
                both = np.concatenate([quality_votes(part), toxicity_votes(part, lexicon)], axis=1)
                code = both @ 3 ** np.arange(both.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(code.astype(np.int64))], names=["key", "row", "votes"])

    width = len(QUALITY) + len(TOXICITY) - 2
    given = F.coalesce(F.col("quality").cast("long"), F.lit(NONE)) * 3 + F.coalesce(1 - F.col("toxic").cast("long"), F.lit(NONE))
    votes = base.mapInArrow(vote, f"key {kind}, row long, votes long").join(labels, "key", "left").select("row", (F.col("votes") * 9 + given).alias("votes"))
    votes = settle(votes, folder, "votes", None)
    patterns = votes.groupBy("votes").count().collect()  # at most 3 ** (labellers) rows
    codes = np.array([r[0] for r in patterns], np.int64)
    counts = np.array([r[1] for r in patterns], float)
    table = codes[:, None] // 9 // 3 ** np.arange(width) % 3
    quality = np.concatenate([table[:, : len(QUALITY) - 1], (codes // 3 % 3)[:, None]], axis=1)
    toxicity = np.concatenate([table[:, len(QUALITY) - 1 :], (codes % 3)[:, None]], axis=1)
    posts = [weak_labels(x, counts)[0] for x in (quality, toxicity)]
    rates = draw_rates(counts, [x @ 3 ** np.arange(x.shape[1]) for x in (quality, toxicity)], sample)
    order = np.argsort(codes)
    codes, rates, posts = codes[order], rates[order], [p[order] for p in posts]
    even = min(1.0, sample / max(counts.sum(), 1))

    limits = spark.createDataFrame(pa.table({"votes": codes, "below": np.ceil(rates * (1 << 30)).astype(np.int64)}))  # a row for each pattern
    drawn = F.pmod(F.xxhash64(F.lit(11), F.col("row")), F.lit(1 << 30)) < F.col("below")
    chosen = votes.join(F.broadcast(limits), "votes").where(drawn).groupBy("row", "votes").agg(F.count("*").alias("copies"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features of the drawn documents, so that the one task that trains holds no texts."""
        for batch in batches:
            for a, b, part in _each(batch.column(0)):
                doc, feature, value = _features(part)
                order = np.argsort(doc, kind="stable")
                at = pa.array(np.searchsorted(doc[order], np.arange(part.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x[order].astype(t))) for x, t in ((feature, np.int32), (value, np.float32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (1, 2, 3)), *lists], names=["row", "votes", "copies", "features", "values"])

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("votes", "ascending")])
        at, copies = np.searchsorted(codes, table["votes"].to_numpy()), table["copies"].to_numpy()
        sizes = pc.list_value_length(table["features"]).to_numpy()
        doc = np.repeat(np.arange(table.num_rows, dtype=np.int32), sizes)
        feature, value = (pc.list_flatten(table[c]).to_numpy() for c in ("features", "values"))
        model = []
        for post in posts:
            weight = 1 / np.where(post < 0.5, np.minimum(rates, even), rates)
            weight, bad = weight[at] * copies, post[at] < 0.5
            if 0 < (rare := weight[bad].sum()) < FLOOR * weight.sum():
                weight[bad] *= min(RAISE, FLOOR / (1 - FLOOR) * weight[~bad].sum() / rare)
            names, weights, bias = train_scorer(doc, feature, value, post[at], weight=weight)
            model.append({"features": names.tolist(), "weights": weights.tolist(), "bias": bias})
        return pa.table({"model": [json.dumps(model)]})

    # at most about `sample` rows; equal ones are one with a count
    rows = base.join(F.broadcast(chosen), "row").groupBy("row", "votes", "copies").agg(F.first("text").alias("text")).select("text", "row", "votes", "copies")
    rows = rows.mapInArrow(gather, "row long, votes long, copies long, features array<int>, values array<float>")
    found = rows.groupBy(F.lit(0).alias("one")).applyInArrow(train, "model string").first()
    return [(np.array(m["features"], np.int64), np.array(m["weights"]), m["bias"]) for m in (json.loads(found[0]) if found else [{"features": [], "weights": [], "bias": 0.0}] * 2)]


def score_batch(b: _Batch, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quality, toxicity and whether to keep."""
    doc, feature, value = _features(b)
    good = []
    for names, weights, bias in model:
        sums = np.full(b.n, bias)
        if len(names):
            place = np.minimum(np.searchsorted(names, feature), len(names) - 1)
            hit = names[place] == feature
            sums += np.bincount(doc[hit], value[hit] * weights[place[hit]], b.n)
        good.append(1 / (1 + np.exp(-np.clip(sums, -50, 50))))
    return good[0], 1 - good[1], ((good[0] >= 0.5) & (good[1] > 0.5)) | (b.words == 0)


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, quality_score, toxic_score (0 to 1) and keep for each row of ``docs``, each scored by itself; a null text counts as empty."""
    base = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in _each(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, score_batch(part, model))], names=["key", "quality_score", "toxic_score", "keep"])

    kind = base.schema["key"].dataType.simpleString()
    return base.mapInArrow(score, f"key {kind}, quality_score double, toxic_score double, keep boolean").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, as they are."""
    at = docs.columns.index(text)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in _each(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(score_batch(part, model)[2]))

    return docs.mapInArrow(choose, docs.schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fewer_splits(classify(docs, fit(docs, labels)), docs)
