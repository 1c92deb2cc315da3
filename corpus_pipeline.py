"""Corpus pipeline: documents in, token ids out, in five stages.

Each stage takes all that its predecessor kept, as (spark, docs, sf_dir), and
returns a DataFrame; ``run`` writes it as Parquet to the shared folder named by
``spark.checkpoint.dir`` and reads it back for the next one, so lineage ends at
every stage. All but the last return the columns of documents.

1. quality rules: documents that the rules reject go;
2. line dedup: repeated long lines go from all but the largest document;
3. MinHash near-dedup (five words, similarity 0.8): the smallest id of each
   group stays;
4. mixing: documents stand as often as the mix takes them;
5. SentencePiece: ids with an end id, their number and the decoded text.

Defined results: nulls, empty and very long texts, repeated rows, empty tables
and extra columns go through as each operator's docstring says; ``n_chars``, if
there, follows the text. A document whose lines all went stays with an empty
text until the mix, which takes documents without words not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import line_dedup, minhash, mixing, piece_codec, quality
from logweave.llm.common import stored
from logweave.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(docs).select(*docs.columns)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode(docs, carry=[c for c in docs.columns if c != "text"])


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

# hashing, components and the tokenizer have no SQL; tests/llm holds every stage against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
