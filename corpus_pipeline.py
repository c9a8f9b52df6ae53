"""A training corpus from raw documents: quality, lines, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet to the shared folder and read again for the next one. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from rastrel.llm.components import saved
from rastrel.llm.queries import table, tokenizer_path
from rastrel.llm.text import free_name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble, trained on the labels, calls good."""
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "__score")
    return quality_rules.score(docs, model, out=name).where(F.col(name) >= quality_rules.CUT).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated multi-line chunks from the texts; n_chars follows. A document of which nothing is left goes."""
    return line_dedup.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest doc_id."""
    return ngram_join.keep_first(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of what they decode to."""
    return bpe.encoded(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("leaks", leaks),
    ("tokens", tokens),
]

#: BPE can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
