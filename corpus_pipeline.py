"""A corpus pipeline: what the classifier rejects goes, later copies of line runs go, one document of each group of near
copies stays, long repeats go, and what is left is packed into training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import linededup, ngramjoin, packing, quality, suffixdedup
from tallyspark.llm.exchange import few_files, fewer_splits, release, shared_dir
from tallyspark.session import prepare


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the number of characters brought up to date."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of some quality and without abuse; those without words stay."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return fewer_splits(quality.keep_good(docs, model), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; a document that has nothing else goes."""
    out = linededup.remove_repeated_lines(docs)
    return _like(docs, out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 connect: that with the smallest id."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return few_files(ngramjoin.keep_one(docs), int(size))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any string of 200 bytes that starts anywhere else too; every document stays."""
    return _like(docs, suffixdedup.remove_repeats(docs, keep_text=True))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    out = packing.pack_documents(docs.select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents; each one's result is written and read again by the next."""
    prepare(spark)
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.mode("overwrite").parquet(f"{folder}/stage-{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/stage-{k}")
        release(spark)
    return docs
