"""SimHash near-dedup, ranked search and spelling variants against brute force."""

import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))

from helpers import LOWER, words  # noqa: E402

from tallyspark.llm import search, simhash, spelling  # noqa: E402
from tallyspark.llm.exchange import shared_dir  # noqa: E402
from tallyspark.llm.runs import by_key, dealt  # noqa: E402

SCHEMA = "doc_id long, text string, fingerprint string, variant long, block int, n string, item_id long"


def frame(spark, docs):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", 3) for i, t in docs], SCHEMA).repartition(3)


def groups(prints, bits):
    """Smallest place reachable by links of at most ``bits`` bits, for each fingerprint."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(prints):
        for b in range(a):
            if (x ^ prints[b]).bit_count() <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(prints))]


# --- SimHash


def simhash_of(text, n):
    w = words(text)
    grams = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = (r.choice(out) or "x").split(" ")
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(["é", "Été", "x", "longer", " ", "a\tb"])
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(["the", "The", "cat", "été", "sat", "on", "mat", "ß"]) + str(r.randrange(50)) for _ in range(r.randint(1, 90))))
    return [*out, None, "", " \t\n", "one", "ONE", "a b c", "A  B\nC"]


@pytest.mark.parametrize("n,bits,limit", [(4, 4, 4096), (4, 4, 3), (3, 9, 4096), (1, 0, 4096), (2, 1, 2)])
def test_simhash(spark, n, bits, limit):
    texts = near_texts(bits + limit)
    docs = [(len(texts) - k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(frame(spark, docs), n, bits, limit=limit).collect()}
    docs.sort()
    prints = [simhash_of(t, n) for _, t in docs]
    assert [got[i] for i, _ in docs] == [(f"{p:016x}", docs[g][0]) for p, g in zip(prints, groups(prints, bits), strict=True)]


def test_simhash_of_a_long_text(spark):
    r = random.Random(2)
    text = " ".join(r.choice(["alpha", "Beta", "gámma"]) + str(r.randrange(99)) for _ in range(200_000))
    assert simhash.fingerprints(frame(spark, [(1, text)])).first().fingerprint & (1 << 64) - 1 == simhash_of(text, 4)


def test_simhash_edges(spark):
    assert simhash.simhash_components(frame(spark, []).limit(0)).count() == 0
    out = simhash.simhash_components(frame(spark, [(None, "same words stand here"), (7, "same words stand here"), (7, "same words stand here"), (None, "alone is what this one is")]))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(str((r.doc_id, r.component_id)) for r in out.collect()) == ["(7, 7)", "(7, 7)", "(None, 7)", "(None, None)"]


@pytest.mark.parametrize("limit", [8, 64, 10_000])
def test_links_of_crowded_variants(spark, limit):
    """Fingerprints about one centre, all in the same variants, and strays: no link is lost in blocks, and edges are a few to a run, not all pairs."""
    r = random.Random(limit)
    prints = {0, (1 << 64) - 1}
    for _ in range(400):
        x = 0
        for _ in range(r.randint(1, 9)):
            x |= 1 << r.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    classes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fingerprint long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(classes, shared_dir(spark), 4, limit).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(x) for x in prints] == [prints[g] for g in groups(prints, 4)]


def test_blocks_of_a_frequent_key(spark):
    """Any two rows of a key meet once, in a block where one of them lives, and no block has more than about the limit of these."""
    rows = spark.createDataFrame([(1, k) for k in range(500)] + [(k, 0) for k in range(2, 9)], "k long, m long")
    placed = dealt(rows, "k", rows["m"], 50, shared_dir(spark), "t").collect()
    homes = {(x.k, x.m): x.block for x in placed if not x.visits}
    assert len(homes) == 507 and max(Counter((x.k, x.block) for x in placed if not x.visits).values()) < 100
    by = defaultdict(list)
    for x in placed:
        by[x.k, x.block].append(x)
    met = Counter((a.k, *sorted((a.m, b.m))) for g in by.values() for i, a in enumerate(g) for b in g[:i] if not (a.visits and b.visits))
    assert len(met) == 500 * 499 // 2 and set(met.values()) == {1}
    runs = by_key(rows.repartition(5), ["k"], lambda t, at: t.select(["k"]).take(at[:-1].tolist()).combine_chunks().to_batches()[0], "k long").collect()
    assert sorted(x.k for x in runs) == [*range(1, 9)]


# --- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        wanted = {t for t in TERM.findall((text or "").translate(LOWER)) if df[t]}
        scores = []
        for i, c in found:
            m = 50 + (50 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("shard,leaf,terms,k", [(4096, 32, 1 << 14, 50), (7, 2, 5, 3), (3, 1, 1, 1)])
def test_search(spark, monkeypatch, shard, leaf, terms, k):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("TERMS", terms), ("FAN", 2)):
        monkeypatch.setattr(search, name, value)
    r = random.Random(shard)
    vocabulary = ["the", "The", "été", "Été", "x1", "a-b", "日本", "rare" + str(shard), "q", "z_z"]
    text = lambda n: " ".join(r.choices(vocabulary, [9, 5, 3, 2, 2, 1, 1, 0.2, 1, 1], k=n))
    docs = [(i, text(r.randint(1, 40))) for i in range(80)] + [(100 + i, "the same text") for i in range(30)]
    docs += [(200, None), (201, ""), (202, "--- ..."), (None, "the été"), (5, "the same text"), (203, "only here " + text(3000))]
    items = [(1, "the été"), (2, "rare" + str(shard) + " x1 Q"), (3, None), (4, "nowhere"), (5, "same, text; the SAME"), (6, "--"), (None, "q z 日本")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = search.search(frame(spark, docs), asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(x)) for x in got.collect()) == ranked(docs, items, k)


def test_search_edges(spark):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(frame(spark, []).limit(0), asked).count() == 0
    assert search.search(frame(spark, [(1, "a b")]), asked.limit(0)).count() == 0
    twice = search.search(frame(spark, [(1, "a b"), (1, "a b"), (2, "c")]), asked.union(asked)).collect()
    assert Counter((x.item_id, x.doc_id) for x in twice) == {(1, 1): 4}


def test_search_opens_few_leaves():
    """A query for a rare term reads the leaves that hold it, not the shard."""
    lengths, n = np.full(4096, 100, np.int64), 4096
    doc = np.concatenate([np.arange(n), [17, 3001]])
    tree = search.Tree(lengths, np.concatenate([np.zeros(n, np.int64), [1, 1]]), doc, np.concatenate([np.ones(n, np.int64), [4, 5]]), n, 100 * n)
    best, opened = [], 0
    for found, scores in tree.search(np.array([0, 1]), np.array([1, 9000]), lambda: sorted(best)[-2] if len(best) > 1 else 0):
        best += scores.tolist()
        opened += 1
    assert opened <= 3 and len(found) <= 32


def test_search_sql(spark):
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("the synthetic tables aren't here")
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    assert sorted(tuple(x) for x in search.op12_ranked_search(spark, str(data)).collect()) == sorted(c.execute(search.OP12_SQL).fetchall())


# --- spelling variants


def spelling_groups(docs, least, often, times, drop):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in n if one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], form[w], n.get(form[w]), len(near[w]), root))
    return out


@pytest.mark.parametrize("least,often,times,drop,limit", [(7, 2, 10, 31, 4096), (7, 1, 2, 3, 4), (4, 1, 2, 5, 4096), (2, 1, 1000, 2, 3)])
def test_spelling(spark, least, often, times, drop, limit):
    r = random.Random(least + drop)
    docs = []
    roots = ["".join(r.choice("abéÿl") for _ in range(r.randint(2, 13))) for _ in range(12)] + ["lllllllll", "Ébéniste", "À" * 9]
    for i in range(120):
        out = []
        for _ in range(r.randint(0, 12)):
            w = roots[min(int(r.expovariate(0.4)), len(roots) - 1)]
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w) + 1)
                w = r.choice([w[:k] + r.choice("abélZ") + w[k:], w[:k] + w[k + 1 :], w[:k] + "b" + w[k + 1 :]]) or "a"
            out.append(w)
        docs.append((i, r.choice([" ", "-", "Ā", "日", "×", "'"]).join(out)))
    docs += [(None, "nullkey nullkey Nullkey"), (500, None), (501, ""), (5, docs[5][1]), (5, docs[5][1]), (502, "x" * 900 + " " + "x" * 899), (503, ("x" * 900 + " ") * 2)]
    got = spelling.spelling_groups(frame(spark, docs), least, often, times, drop, limit=limit)
    assert got.columns == ["word", "n", "form", "form_n", "n_near", "root"]
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == spelling_groups(docs, least, often, times, drop)


def test_spelling_edges(spark):
    assert spelling.spelling_groups(frame(spark, []).limit(0)).count() == 0
    assert spelling.spelling_groups(frame(spark, [(1, "short words only")])).count() == 0


def test_spelling_follows_chains(spark):
    """Ten times at each step: the root is the end of the chain."""
    docs = [(1, "wordlike " * 1000 + "wordlika " * 100 + "wordliza " * 10 + "wirdliza")]
    rows = {x.word: (x.form, x.root) for x in spelling.spelling_groups(frame(spark, docs), often=1, drop=1 << 40).collect()}
    assert rows == {"wordlike": (None, "wordlike"), "wordlika": ("wordlike", "wordlike"), "wordliza": ("wordlika", "wordlike"), "wirdliza": ("wordliza", "wordlike")}


def test_words_across_slices(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 5)
    text = "eins zweitausend dreißigĀvier" + "f" * 23 + " ende"
    assert [w.decode("latin-1") for part in spelling._runs(text) for w in part] == re.findall("[A-Za-zÀ-ÿ]+", text)


def test_heap_merge():
    r = random.Random(1)
    for _ in range(200):
        lists = [sorted(r.sample(range(20), r.randint(1, 12))) for _ in range(r.randint(1, 6))]
        least = r.randint(1, 4)
        assert list(spelling.merged(lists, least)) == sorted(x for x, n in Counter(x for p in lists for x in p).items() if n >= least)
