"""Documents to training tokens in five stages, each over all that the one before it kept.

``run(spark, sf_dir)`` applies ``STAGES`` to the ``documents`` of a folder. Each stage takes
``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``; ``n_chars`` follows the text.

1. quality: documents whose chance of the grade "good" is too small go (toxic and poor ones).
2. lines: lines that three documents or more share stay in the last one only; documents that lose every
   line long enough to count go if each shorter line of theirs also stands in a document that does not.
3. near_duplicates: of documents linked by a Jaccard similarity of 0.8 of their five-word n-grams the one
   with the smallest id stays.
4. benchmark: passages of benchmark items are cut out; documents that are mostly such passages go.
5. tokens: what is left is encoded, and decoded as a check.

Rows with a missing text or id pass stages 1 to 4 by the rules of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from billspark.llm.bpe import encode_documents
from billspark.llm.common import materialize, table
from billspark.llm.decontaminate import decontaminate
from billspark.llm.line_dedup import split_lines
from billspark.llm.ngram_join import one_of_each
from billspark.llm.quality import keep_good
from billspark.llm.vocabularies import BYTE_BPE

#: SQL can express neither the fitted classifier nor the tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return split_lines(docs, copies=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, BYTE_BPE)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
