"""Line dedup, n-gram join and suffix-array dedup against brute force."""

import hashlib
import random
import sys
from itertools import groupby
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from helpers import components, line_dedup, repeats, shingles  # noqa: E402

from tallyspark.llm import linededup, ngramjoin, suffixdedup  # noqa: E402
from tallyspark.llm.components import connected_components  # noqa: E402
from tallyspark.llm.exchange import shared_dir  # noqa: E402

SCHEMA = "doc_id long, text string, chunk string, n_bytes string, rid string"


def corpus(seed=0, n=40):
    """Texts with copies, near copies, shared lines and passages, nulls, empty ones, and one that is long."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(r.randint(1, 14)))
    common = [line() for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.2:
            texts.append(r.choice(texts))
        elif texts and kind < 0.5:
            w = (r.choice(texts) or "x").split(" ")
            w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
        else:
            texts.append("\n".join(r.choice(common) if r.random() < 0.3 else line() for _ in range(r.randint(1, 9))))
    texts += [None, "", "   ", "\n\n", "one", "one", "A B c", "a b C", " ".join(word() for _ in range(4000))]
    texts.append(texts[-1][:9000] + "!" + texts[-1][9000:])
    return list(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "own", "own", "own") for i, t in docs], SCHEMA).repartition(3)


@pytest.mark.parametrize("min_lines,min_words", [(1, 99), (2, 8), (3, 99)])
def test_line_dedup(spark, min_lines, min_words):
    docs = corpus(min_lines)
    # equal keys fall back on the order of the rows, so keys are unique here
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.remove_repeated_lines(frame(spark, docs), min_lines, min_words).collect()}
    assert [got[i] for i, _ in docs] == line_dedup(docs, min_lines, min_words)


def test_line_dedup_edges(spark):
    empty = frame(spark, corpus()).limit(0)
    out = linededup.remove_repeated_lines(empty)
    assert out.count() == 0 and "chunk" in out.columns
    same = spark.createDataFrame([(None, "a\nb\nc"), (7, "a\nb"), (7, "a\nb"), (8, "x\na\nb\n\nb\na\nb")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_removed, r.n_runs) for r in linededup.remove_repeated_lines(same).collect())
    assert got == [("7", "", 2, 1), ("7", "", 2, 1), ("8", "x\n\nb", 4, 2), ("None", "a\nb\nc", 0, 0)]


def test_intervals_are_the_repeated_runs(spark):
    docs = [(1, "a\nb\nc\nd\ne"), (2, "z\na\nb\nc\nd"), (3, "b\nc\ny")]
    rows = linededup.intervals(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    depth = lambda h: sorted((r.first.key, r.first.pos, r.copies) for r in rows if r.depth == h)
    assert depth(1) == [(1, 0, 2), (1, 1, 3), (1, 2, 3), (1, 3, 2)] and depth(2) == [(1, 0, 2), (1, 1, 3), (1, 2, 2)] and depth(4) == [(1, 0, 2)]
    names = {(r.first.key, r.first.pos): r.name for r in rows if r.depth == 2}
    assert len(set(names.values())) == 3


@pytest.mark.parametrize("words,num,den,block", [(4, 85, 100, 512), (5, 80, 100, 512), (2, 60, 100, 2), (1, 50, 100, 3)])
def test_ngram_join(spark, monkeypatch, words, num, den, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "HUBS", 2)
    monkeypatch.setattr(ngramjoin, "GUESTS", 5)
    docs = corpus(words)
    got = {r.doc_id: (r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(frame(spark, docs), words, num, den).collect()}
    assert [got[i] for i, _ in docs] == components(docs, words, num, den)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text), (2, text), (2, text), (3, text + " more"), (4, "other words stand here now"), (5, None), (6, ""), (7, "x")]
    kept = sorted(r.doc_id for r in ngramjoin.keep_one(frame(spark, docs)).collect())
    assert kept == [1, 4, 5, 6, 7]
    twice = ngramjoin.keep_one(frame(spark, [(2, text), (2, text)]))
    assert [r.doc_id for r in twice.collect()] == [2] and ngramjoin.keep_one(frame(spark, docs).limit(0)).count() == 0


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "a long, b long"), shared_dir(spark), "t").collect()}
    want = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(want[a], want[b])
            changed |= want[a] != m or want[b] != m
            want[a] = want[b] = m
    loops = {a for a, b in pairs if a == b} - {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k not in loops}


def test_difference_covers():
    for v, residues in suffixdedup.PERFECT_COVERS.items():
        assert suffixdedup.is_cover(v, residues)
    for length in (1, 5, 12, 60, 200, 500):
        v, _ = suffixdedup.difference_cover(length)
        assert 1 <= v and 3 * v <= max(3, 2 * length)


@pytest.mark.parametrize("length", [12, 50, 200])
def test_suffix_dedup(spark, length):
    docs = corpus(length)
    out = {r.doc_id: r for r in suffixdedup.remove_repeats(frame(spark, docs), length).collect()}
    for (i, t), gone in zip(docs, repeats([t for _, t in docs], length), strict=True):
        data = (t or "").encode()
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for g, _ in groupby(gone) if g)
        r = out[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()), i


def test_suffix_dedup_edges(spark):
    assert suffixdedup.remove_repeats(frame(spark, corpus()).limit(0)).count() == 0
    a, rest = "ab" * 20 + "é" * 3, "0123456789"
    rows = spark.createDataFrame([(None, a, 1), (3, rest + a, 2), (3, rest + a, 3), (4, "xyz" + a, 4)], "doc_id long, text string, chunk int")
    out = suffixdedup.remove_repeats(rows, 20, keep_text=True)
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got == [("3", ""), ("3", ""), ("4", "xyz"), ("None", "")] and out.columns == ["doc_id", "text", "chunk", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_unlinked_sets_of_one_cluster(spark, monkeypatch):
    """Shuffled templates share many first n-grams, yet none link: sets visit blocks, and brute force agrees."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 32)
    r = random.Random(5)
    parts = [" ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(12)) for _ in range(40)]
    docs = [(i, " ".join(r.sample(parts, 12))) for i in range(200)]
    docs += [(1000 + i, docs[i][1] + " and one word more") for i in range(0, 200, 9)]
    got = {x.doc_id: (x.doc_id, x.n_shingles, x.component_id) for x in ngramjoin.jaccard_components(frame(spark, docs)).collect()}
    want = components(docs, 4, 85, 100)
    assert [got[i] for i, _ in docs] == want and sum(i != c for i, _, c in want) == 23


@pytest.mark.parametrize("n", [10, 11, 13])
def test_regular_words_differ(spark, n):
    """Thue-Morse words and their complements, which polynomials modulo 2**64 can't tell apart, neither link nor repeat."""
    word = "a"
    while len(word) < 1 << n:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, word), (2, other), (3, word[:300] + " x"), (4, other[:300] + " y")]
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(frame(spark, docs), 1).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    out = {r.doc_id: r for r in suffixdedup.remove_repeats(frame(spark, docs), 200).collect()}
    for (i, t), gone in zip(docs, repeats([t for _, t in docs], 200), strict=True):
        assert out[i].n_removed == sum(gone)


def test_repeated_rows_in_one_group(spark):
    """Equal rows are counted once and come back as often as they were there."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text)] * 50 + [(2, text + " more")] + [(3, "short")] * 20
    got = sorted((r.doc_id, r.component_id) for r in ngramjoin.jaccard_components(frame(spark, docs)).collect())
    assert got == [(1, 1)] * 50 + [(2, 1)] + [(3, 3)] * 20
    out = [(r.doc_id, r.n_removed) for r in suffixdedup.remove_repeats(frame(spark, docs[:51]), 200).collect()]
    assert sorted(out) == [(1, len(text))] * 50 + [(2, len(text))]


def test_long_document(spark):
    """A text of several slices is cut for the work and comes out whole."""
    r = random.Random(9)
    passage = " ".join(str(r.random()) for _ in range(30))
    long = " ".join(str(r.random()) for _ in range(150_000))
    long = long[:1_048_500] + passage + long[1_048_500:] + passage
    (a, b) = sorted(suffixdedup.remove_repeats(frame(spark, [(1, long), (2, "before " + passage)]), 200).collect())
    assert (a.n_bytes, a.n_spans) == (len(long), 2) and b.n_spans == 1 and 2 * len(passage) <= a.n_removed <= 2 * len(passage) + 8
    left = {x.doc_id: x.n_shingles for x in ngramjoin.jaccard_components(frame(spark, [(1, long), (2, long + " end")])).collect()}
    assert left == {1: len(shingles(long, 4)), 2: len(shingles(long + " end", 4))}
