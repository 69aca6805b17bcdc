"""From raw documents to training windows: five stages, each one of the corpus operators.

Every stage works on all rows its predecessor kept; its result is written as Parquet
in the shared folder and read again as the next one's input, so a lost executor never
repeats an earlier stage. Texts count whole; rows may have null ids, and other columns
of any names pass through up to the last stage; an empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillflow.llm.decontaminate import decontaminate
from quillflow.llm.language import document_languages
from quillflow.llm.minhash import keep_one
from quillflow.llm.packing import pack_documents
from quillflow.llm.secrets import redact
from quillflow.llm.staging import stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null and empty texts, and those without letters, go."""
    names = tuple(f"_{x}_{uuid.uuid4().hex}" for x in ("language", "probability", "kept"))
    return document_languages(docs, names=names).where(names[2]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; repeated rows of one id are one, rows without an id stay."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item of ``benchmark``, of whatever length; an empty ``benchmark`` keeps all."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), shortest=1)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and ``n_chars`` corrected."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token windows; a null id stays null."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("packing", packing)]
#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
