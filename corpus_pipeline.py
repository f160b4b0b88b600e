"""The training-data pipeline: stages that each take and return documents.

A stage is (spark, docs, sf_dir) -> DataFrame; the runner writes each result
as Parquet and reads it as the next stage's documents. All but the last
return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaweave.llm import decontaminate, language, line_rules, sentence_pieces, signature_join
from lineaweave.llm.common import stored
from lineaweave.llm.queries import held_out, table

#: Least score of a text's language, and least share of its words that training knows, whatever its length; it is rejected
#: below, as it is without a letter. Of clean texts far more words are known, even with a small training part.
MIN_LANGUAGE_SCORE, MIN_KNOWN_WORDS = 0.5, 0.1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not mostly boilerplate lines of their source, without such lines."""
    return line_rules.clean_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that this stage's documents teach."""
    model = language.fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text")
    judged = language.predict(whole, model, columns=["row"])
    fits = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE) & (F.col("known") >= MIN_KNOWN_WORDS)
    return judged.where(fits).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest id."""
    return signature_join.keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.reject_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids: doc_id, n_tokens, ids_crc32, parity, round_trip, ids."""
    return sentence_pieces.encode_documents(docs)


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", tokens)]

#: SQL can express neither the tokenizer nor the language model; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs
