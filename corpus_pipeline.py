"""From documents to token ids: toxic documents go, repeated lines go, one document of each near-copy group stays, sources are mixed to weights, and what is left is encoded.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. run() writes each stage's result as Parquet into the shared folder
and rereads it for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm import bpe, jaccard, lines, mixing, toxicity
from pagelattice.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones, doesn't reject. Null texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(~F.col("toxic")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that occur before, exactly or nearly; n_chars is counted again. A document that lost lines and has no word left goes."""
    out = lines.dedup(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    n = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(F.col("text").isNull() | left).withColumn("n_chars", n).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group that pairs of similar n-gram sets chain together; documents without words or doc_id stay."""
    return jaccard.deduplicate(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a mix of as many tokens as there are in which a source's weight is its share of the tokens to the power 0.7; a source that has less gives all."""
    return mixing.mix(docs).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids and n_tokens."""
    return bpe.encode(docs, keep_text=False).select("doc_id", "lang", "source", "token_ids", "n_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mixing", mix_sources),
    ("BPE encoding", encode_tokens),
]

#: SQL can't express the classifier, the components or the dynamic program; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
