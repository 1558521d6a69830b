"""The corpus pipeline: documents to packed training sequences in five stages.

Language identification drops what it rejects; of each group of near copies one document stays; secrets in texts are
replaced by a mark; sources are mixed to their target weights, whole documents being repeated or left out; and what is
left is tokenised and packed. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemark.llm.common import table, written
from stridemark.llm.langid import NEW as NEW_LANGUAGE
from stridemark.llm.langid import identify
from stridemark.llm.mixing import NEW as NEW_MIX
from stridemark.llm.mixing import mixed
from stridemark.llm.ngram_join import jaccard_groups
from stridemark.llm.packing import pack
from stridemark.llm.secrets import redact


def _apart(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage on documents whose columns named like those that it makes are out of its way meanwhile."""
    away = {c: f"{c}__given" for c in docs.columns if c in names}
    return stage(docs.withColumnsRenamed(away)).withColumnsRenamed({new: old for old, new in away.items()})


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a text in a known language. Rejected: null, no letter, or too far from every centroid.

    Null lang: not learned from, but predicted. Null doc_id: predicted. Repeated rows: each by itself. Very long texts:
    read whole. Ties: the language that sorts first. Empty table, or nothing to learn from: no rows.
    """
    return _apart(docs, (*NEW_LANGUAGE, "held_out"), lambda d: identify(d).filter("NOT rejected").select(d.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id; equal rows once.

    Rows of one doc_id are one document, which stays if any of its texts is the first of its group. Rows without a
    doc_id stay, as do documents without a word. Very long texts count whole. Empty table: no rows.
    """
    groups = written(jaccard_groups(docs), "groups")
    by_id = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n"))
    rest = docs.join(written(by_id.filter("NOT first").select("doc_id"), "copies"), "doc_id", "left_anti").select(docs.columns)
    again = by_id.filter("first AND n > 1").select("doc_id")
    if again.isEmpty():
        return rest
    return rest.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(rest.join(again, "doc_id", "left_semi").select(docs.columns).distinct())


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced and n_chars counted anew.

    Null text: stays, with a null n_chars. Very long texts are scanned whole. Overlapping secrets: one mark. Repeated
    rows and null doc_ids: each row by itself. Empty table: no rows.
    """
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Documents without a word are not taken. Null source: a source of its own. Null doc_id: drawn as an empty id. Ties
    and repeated rows: by doc_id and size, then alike. Very long texts count whole. Empty table: no rows.
    """
    return _apart(docs, NEW_MIX, lambda d: mixed(d).select(d.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens with their sequences and places.

    Null or empty text: the closing id alone. Null doc_id: kept. Repeated rows, as the mix makes them: each packed by
    itself. Very long texts: cut into pieces, none lost. Empty table: no rows.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Neither the classifier nor the tokenizer can be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
