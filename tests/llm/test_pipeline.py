"""The pipeline's stages against brute force on a small corpus, and the registered queries."""

import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from helpers import components, line_dedup, repeats  # noqa: E402
from test_dedup import corpus  # noqa: E402

import corpus_pipeline  # noqa: E402
from tallyspark.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


def documents(spark, docs):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def stage(spark, name, docs):
    out = dict(corpus_pipeline.STAGES)[name](spark, documents(spark, docs), str(DATA))
    return out


def test_line_dedup_stage(spark):
    docs = corpus(11)
    want = {i: t for (i, _), (t, lines, removed) in zip(docs, line_dedup(docs, 2, 50), strict=True) if not removed or removed < lines}
    rows = stage(spark, "line dedup", docs).collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.text is None or r.n_chars == len(r.text) for r in rows)


def test_join_stage(spark):
    docs = corpus(12)
    want = {i for i, n, c in components(docs, 5, 80, 100) if i == c or not n}
    rows = stage(spark, "n-gram Jaccard join", docs).collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want) and all(dict(docs)[r.doc_id] == r.text for r in rows)


def test_suffix_stage(spark):
    docs = corpus(13)
    docs += [(900, "start " + "passage to be found " * 15 + "end"), (901, "other " + "passage to be found " * 15)]
    rows = stage(spark, "suffix-array dedup", docs).collect()
    want = {i: bytes(b for b, g in zip((t or "").encode(), gone, strict=True) if not g).decode("utf-8", "ignore") for (i, t), gone in zip(docs, repeats([t for _, t in docs], 200), strict=True)}
    assert {r.doc_id: r.text for r in rows} == want and {r.doc_id: r.n_chars for r in rows} == {i: len(t) for i, t in want.items()}


def test_packing_stage(spark):
    rows = stage(spark, "best-fit packing", corpus(14)).collect()
    sequences = defaultdict(int)
    for r in rows:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 1024 and {r.doc_id for r in rows} == {i for i, _ in corpus(14)}


@pytest.mark.skipif(not DATA.exists(), reason="the synthetic tables aren't here")
def test_run(spark):
    out = corpus_pipeline.run(spark, str(DATA))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, docs, str(DATA))
        assert after.columns == docs.columns, name
        assert f(spark, docs.limit(0), str(DATA)).count() == 0, name


def test_registered_queries():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="the synthetic tables aren't here")
def test_line_dedup_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(c.execute(f"SELECT doc_id, n_lines, n_removed, n_runs, kept_sha256 FROM ({ORACLE_SQL['op1_line_dedup']})").fetchall())
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) for r in QUERIES["op1_line_dedup"](spark, str(DATA)).collect())
    assert got == want
