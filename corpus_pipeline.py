"""From raw documents to token files: language, near-duplicates, contamination, mix, tokens.

``STAGES`` are (name, function) in order.  A function takes the session, the
documents that the stage before kept, reread from Parquet, and the folder of
the tables; all but the last return rows of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gapline.llm import decontamination, languages, mixing, simhash, tokens
from gapline.llm.common import new_dir, table
from gapline.llm.queries import END, held_out, tokenizer_path


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages stay; those without letters, or in none of the languages, go."""
    return languages.in_a_known_language(docs, languages.fit(docs, ~held_out()))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words are a benchmark's go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: a row per document in them, with doc_id, start, n_tokens and ids_crc32."""
    return tokens.read_tokens(spark, tokens.write_tokens(docs, tokenizer_path(), END))


STAGES = [("language_id", known_languages), ("near_dedup", one_of_near_duplicates), ("decontamination", uncontaminated), ("mixing", mixed), ("token_output", token_files)]
#: Suffix automata, tokenizers and files are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = new_dir(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{n}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
