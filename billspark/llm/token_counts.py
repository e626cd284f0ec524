"""Token counts of documents in flat token files without an index.

A token file is one run of unsigned 16- or 32-bit ids; an end-of-document id closes each document. A file
is read in blocks of fixed size that know nothing of documents. A vectorised search finds the separators
of a block; the block reports how many there are, the lengths of the documents that lie inside it, and
the open ends before the first and after the last. A prefix scan over the reports, first inside chunks of
``CHUNK`` blocks and then over the chunks, gives each block the number of its first document and the
tokens that the document has from earlier blocks.

Defined cases: a file without separators is one open document; tokens after the last separator are an open
document, none if there are none; two separators in a row enclose an empty document; empty blocks are
allowed; a missing text is an empty document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark import TaskContext

from billspark.functions.arrays import scan
from billspark.llm.bpe import Vocabulary, worker_encoder
from billspark.llm.common import map_batches, map_partitions, materialize, texts_of

#: Tokens of a block, and blocks of a chunk of the scan.
BLOCK_TOKENS, CHUNK = 1 << 19, 1024


def block_reports(blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """``file, block, n_eod, head, tail, inner``: separators, open ends and inner lengths of each block."""

    def search(batch: pa.RecordBatch) -> list:
        n_eod, head, tail, inner = [], [], [], []
        for data in batch.column(2).to_pylist():
            ids = np.frombuffer(data or b"", dtype)
            ends = np.flatnonzero(ids == eod)
            n_eod.append(len(ends))
            head.append(int(ends[0]) if len(ends) else len(ids))
            tail.append(int(len(ids) - 1 - ends[-1]) if len(ends) else 0)
            inner.append((np.diff(ends) - 1).tolist())
        return [batch.column(0), batch.column(1), n_eod, head, tail, inner]

    return map_batches(
        blocks, ["file", "block", "data"], search, "file string, block long, n_eod long, head long, tail long, inner array<long>"
    )


def _combined(rows: F.Column) -> F.Column:
    """Separators and open tail after consecutive reports (sorted structs of block, n_eod, head, tail)."""
    start = F.struct(F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("open"))
    return F.aggregate(rows, start, lambda s, r: F.struct(
        (s["docs"] + r["n_eod"]).alias("docs"),
        F.when(r["n_eod"] > 0, r["tail"]).otherwise(s["open"] + r["head"]).alias("open"),
    ))


def token_counts(blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """``file, doc_no, n_tokens, closed`` from ``file, block, data``; documents are numbered from 0 in each file."""
    reports = materialize(block_reports(blocks, eod, dtype).withColumn("chunk", F.floor(F.col("block") / CHUNK)), "reports")
    part = F.struct("block", "n_eod", "head", "tail")
    chunks = reports.groupBy("file", "chunk").agg(F.sort_array(F.collect_list(part)).alias("rows"))  # at most CHUNK rows
    sums = chunks.select("file", "chunk", _combined(F.col("rows")).alias("sum"))
    # The open tail of earlier chunks: tokens since the last chunk that had a separator.
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    runs = Window.partitionBy("file").orderBy("chunk")
    sums = sums.withColumn("run", F.sum(F.when(F.col("sum.docs") > 0, 1).otherwise(0)).over(runs))
    since = Window.partitionBy("file", "run").orderBy("chunk")
    sums = sums.withColumn("open_now", F.sum("sum.open").over(since))
    before = sums.select(
        "file", "chunk", F.coalesce(F.sum("sum.docs").over(earlier), F.lit(0)).alias("docs_before"),
        F.coalesce(F.lag("open_now").over(runs), F.lit(0)).alias("open_before"),
    )
    first = F.struct(F.col("docs_before").alias("docs"), F.col("open_before").alias("open"))
    # Inside a chunk one scan keeps the state after each block; a block begins with the state of the one before.
    def after(now: F.Column, r: F.Column) -> F.Column:
        opened = F.when(r["n_eod"] > 0, r["tail"]).otherwise(now["open"] + r["head"])
        return F.struct((now["docs"] + r["n_eod"]).alias("docs"), opened.alias("open"))

    states = F.concat(F.array("first"), scan(F.col("rows"), F.col("first"), after, "struct<docs:bigint,open:bigint>"))
    scanned = chunks.join(before, ["file", "chunk"]).select("file", "rows", first.alias("first"))
    placed = scanned.select("file", F.explode(F.zip_with("rows", states, lambda r, at: F.struct(r["block"].alias("block"), at.alias("at")))).alias("p"))
    placed = placed.filter("p.block IS NOT NULL").select("file", "p.block", "p.at")  # the last state has no block
    joined = reports.join(placed, ["file", "block"])
    lengths = F.when(
        F.col("n_eod") > 0, F.concat(F.array(F.col("at.open") + F.col("head")), F.col("inner"))
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    closed = joined.select("file", "at", F.posexplode(lengths).alias("i", "n_tokens")).select(
        "file", (F.col("at.docs") + F.col("i")).alias("doc_no"), "n_tokens", F.lit(True).alias("closed")
    )
    ends = sums.groupBy("file").agg(F.sum("sum.docs").alias("doc_no"), F.max_by("open_now", "chunk").alias("n_tokens"))
    open_ends = ends.filter("n_tokens > 0").select("file", "doc_no", "n_tokens", F.lit(False).alias("closed"))
    return closed.unionByName(open_ends)


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """``file, block, data`` of flat token files of any size: every task seeks to the ranges it reads.

    The file system must be one that pyarrow opens (local, HDFS, S3, GCS). An empty file has no block.
    """
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the contents are not read here
    last = F.expr(f"(length - 1) div {size}")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    ranges = ranges.repartition(F.col("path"), F.floor(F.col("block") / 16))  # a task reads runs of neighbours

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        open_path, source = None, None
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != open_path:
                    system, inner = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if not name.startswith("file://") else name)
                    open_path, source = name, system.open_input_file(inner)
                yield [[name], [block], [source.read_at(min(size, max(source.size() - block * size, 0)), block * size)]]

    return map_partitions(ranges, ["path", "block"], read, "file string, block long, data binary")


def token_type(vocabulary: Vocabulary, eod: int) -> str:
    """How ids stand in the flat files: in 16 bits where these hold all of them, else in 32."""
    return "<u2" if max(len(vocabulary.bytes_at) - 1, eod) < 1 << 16 else "<u4"


def pack_tokens(docs: DataFrame, vocabulary: Vocabulary, eod: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token streams of ``docs``: rows of ``file, block, data``, and rows of ``file, ids`` that name the documents.

    Ids are of the ``token_type`` of the vocabulary. Each task writes one stream, its documents in the order read, each closed by ``eod``, in blocks that do not
    respect documents. Special strings in a text are ordinary text, so that ``eod`` stands only at ends.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = token_type(vocabulary, eod)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        encoder = worker_encoder(shared.value, False)
        file, block, held = f"part-{TaskContext.get().partitionId():06d}", 0, np.zeros(0, kind)
        first = 0
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            parts = [held]
            for packed in encoder.encode_many(texts_of(batch.column(1))):
                parts += [np.frombuffer(packed, np.uint32).astype(kind), np.array([eod], kind)]
            held = np.concatenate(parts)
            yield [[file], [None], [None], [first], [batch.column(0).to_pylist()]]
            first += batch.num_rows
            while len(held) >= block_tokens:
                yield [[file], [block], [held[:block_tokens].tobytes()], [None], [None]]
                block, held = block + 1, held[block_tokens:]
        if len(held):
            yield [[file], [block], [held.tobytes()], [None], [None]]

    schema = "file string, block long, data binary, first_doc long, ids array<long>"
    return map_partitions(docs, ["doc_id", "text"], pack, schema)


def count_document_tokens(docs: DataFrame, path: str, eod: int) -> DataFrame:
    """``doc_id, n_tokens`` of every document, counted in the flat streams that ``docs`` are written to."""
    vocabulary = Vocabulary(path)
    written = materialize(pack_tokens(docs, vocabulary, eod), "tokens")
    blocks = written.filter("block IS NOT NULL").select("file", "block", "data")
    counts = token_counts(blocks, eod, token_type(vocabulary, eod))
    names = written.filter("block IS NULL").select("file", "first_doc", F.posexplode("ids").alias("i", "doc_id")).select(
        "file", (F.col("first_doc") + F.col("i")).alias("doc_no"), "doc_id"
    )
    return names.join(counts, ["file", "doc_no"]).select("doc_id", "n_tokens")
