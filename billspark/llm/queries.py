"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.llm.bpe import encode_documents
from billspark.llm.common import table
from billspark.llm.decontaminate import contamination
from billspark.llm.fill_middle import fill_in_middle_digests
from billspark.llm.line_dedup import drop_repeated_lines
from billspark.llm.licenses import CONTAINMENT, TEMPLATES, classes_up_to, find_licenses
from billspark.llm.minhash import fingerprint_documents, near_duplicates
from billspark.llm.ngram_join import ngram_components
from billspark.llm.pii import find_pii
from billspark.llm.quality import rate
from billspark.llm.sql import CONTAMINATION, FILL_IN_MIDDLE, NEAREST_VECTORS, NGRAM_COMPONENTS, REPEATED_LINES, URL_VERDICTS, license_sql
from billspark.llm.token_counts import count_document_tokens
from billspark.llm.urls import filter_pages
from billspark.llm.vector_search import search_every_hundredth
from billspark.llm.vocabularies import BYTE_BPE, END_OF_DOCUMENT
from billspark.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_pii")
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(table(spark, folder, "documents", "doc_id", "text"))


@query("op2_bpe")
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents", "doc_id", "text"), BYTE_BPE)


@query("op3_licenses", license_sql(TEMPLATES, classes_up_to(64), CONTAINMENT))
def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return find_licenses(table(spark, folder, "documents", "doc_id", "text"))


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(table(spark, folder, "documents", "doc_id", "text"))


@query("minhash_classes")
def minhash_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents", "doc_id", "text"))


@query("op5_url_filter", URL_VERDICTS)
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The outcome of a page is the label of the document with its id."""
    labels = table(spark, folder, "labels").filter("quality IS NOT NULL AND toxic IS NOT NULL")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.expr("quality = 1 AND toxic = 0").alias("good"))
    return filter_pages(table(spark, folder, "pages", "page_id", "url"), outcomes)


@query("op6_quality")
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return rate(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels"))


@query("op7_ngram_join", NGRAM_COMPONENTS)
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents", "doc_id", "text"), n=3, percent=90)


@query("op8_line_dedup", REPEATED_LINES)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_lines(table(spark, folder, "documents", "doc_id", "text"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_document_tokens(table(spark, folder, "documents", "doc_id", "text"), BYTE_BPE, END_OF_DOCUMENT)


@query("op10_decontamination", CONTAMINATION)
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark"))


@query("op11_nearest", NEAREST_VECTORS)
def op11_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return search_every_hundredth(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op13_fill_middle", FILL_IN_MIDDLE)
def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, folder, "documents", "doc_id", "text"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
