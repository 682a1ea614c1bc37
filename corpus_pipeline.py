"""Documents to training tokens: quality, toxicity, near duplicates, benchmark leaks, piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again for the next. All but the last
return the columns of docs, whatever their names and however many they are beside doc_id, text, lang and source; nulls in any column stay.
Rows are judged by themselves: repeated rows and repeated ids are each kept or dropped. Texts are read whole, however long. An empty
table gives an empty one; without labels of both classes, without a benchmark, nothing is dropped for them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import op1_jaccard_join, op4_toxicity, op6_quality, op9_sentencepiece, op10_decontaminate
from ledgerline.llm.shared import written
from ledgerline.session import reachable

#: No SQL: the stages are trained models, a similarity join and a tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier scores under 0.5. A null or empty text is scored as one of figures of 0; null sources and languages are sites of their own."""
    return op6_quality.good_only(docs, reachable(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more as toxic. A null or empty text has the score of no terms at all."""
    return op4_toxicity.without_toxic(docs, reachable(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: five-word shingles, a similarity of 0.8 or more.

    That of the smallest doc_id stays; of rows with this id, the least as JSON; rows without an id go if the component has one. Texts without
    words, null ones among them, are no copies of each other and stay.
    """
    reachable(spark)
    return op1_jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item: ten words, or a whole shorter item. Texts without words hold none."""
    return op10_decontaminate.without_leaks(docs, reachable(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of the text, and the digests of the ids and of what they decode to; a row for each row, null texts as empty ones."""
    reachable(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = op9_sentencepiece.with_digests(docs.select("doc_id", "text"), path, "p", ids=True)
    return out.select("doc_id", "p.ids", "p.n_tokens", "p.ids_sha256", "p.decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
