"""A corpus pipeline: toxicity, line dedup, near-duplicate join, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `docs`. Texts that a stage shortens get a new n_chars.

In every stage a null text counts as empty and stays null, an empty table gives an empty result,
rows that repeat are rows like any other unless a stage says otherwise, and columns beside doc_id
and text are passed on unread, whatever their names. Texts are taken whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm.common import Stored, table
from packloom.llm.decontamination import decontaminate
from packloom.llm.line_dedup import line_dedup
from packloom.llm.ngram_join import one_of_each
from packloom.llm.sentencepiece_codec import model_file, sentencepiece_codec
from packloom.llm.toxicity import TARGETS, fit_chain, score_chain

MOST_TOXIC = 0.5


def _as(docs: DataFrame, done: DataFrame) -> DataFrame:
    """The columns of `docs`, with the text of `done` and the others from its `row`."""
    n_chars = F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
    return done.select(*[F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"row.{c}") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go. Empty texts and null ids are scored like others; with no
    labels none go."""
    scored = score_chain(docs, fit_chain(docs, table(spark, sf_dir, "labels"), TARGETS))
    return _as(docs, scored.filter(F.col("p")[1] < MOST_TOXIC))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines aligned with an earlier document go, and documents of which nothing is left. Repeated rows
    are one document and lose the same lines; rows without an id lose none; a text that was
    empty before stays."""
    done = line_dedup(docs)
    return _as(docs, done.filter((F.col("n_removed") == 0) | (F.trim("text") != "")))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the least id, a null id being the largest, and
    of texts under one id that whose hash is least. Texts without words all stay."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such passages go. Without
    benchmark items all stay as they are."""
    return _as(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (with an end id, for an empty or null text that alone), and the text they decode to."""
    done = sentencepiece_codec(docs, model_file())
    kept = [F.col(f"row.{c}") for c in docs.columns if c not in ("text", "n_chars")]
    return done.select(*kept, F.col("decoded").alias("text"), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL expresses neither the classifier nor patience diff nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is stored before the next reads it, and what a
    stage stored on its way is dropped then."""
    kept = Stored(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        mark, before = len(Stored.made), docs
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept.put(docs)
            kept.drop_since(mark, docs)
            kept.drop(before)
    return docs
