"""Token counts from flat token files by a separator scan.

A flat token file holds the ids of many documents in a row, each closed by an end-of-document id,
with no index. Cut into blocks at fixed sizes, it says nothing about where documents begin. Each
block is searched on its own (one vectorised comparison); a prefix scan over block summaries then
gives every block its offset and the last separator before it, which joins what a cut has parted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.llm.byte_pairs import line_encoding as _encoding
from tallystone.llm.byte_pairs import read_vocabulary
from tallystone.session import table, written

BLOCK_TOKENS = 1 << 18
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256


def token_type(vocabulary: str = VOCABULARY, separator: int = END_OF_DOCUMENT) -> str:
    """The narrowest type of ids, two or four bytes, that holds the vocabulary and the separator."""
    with open(vocabulary, "rb") as f:
        most = max((int(line.split()[1]) for line in f if line.strip()), default=0)
    return "<u2" if max(most, separator) < 1 << 16 else "<u4"


def flat_token_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` (doc_id, text) as flat token files in blocks of ``block_tokens`` ids.

    Returns file, block, data (little-endian ids of ``token_type``), doc_ids (of the documents that
    end in the block, in order; the scan doesn't need them). A task's documents make one file; a
    null text is an empty document. Written out, as a file's number is its task's.
    """
    ranks = read_vocabulary(vocabulary)
    sent, kind = docs.sparkSession.sparkContext.broadcast(ranks), np.dtype(token_type(vocabulary, separator))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(sent.value)
        file, block = TaskContext.get().partitionId(), 0
        parts: list[np.ndarray] = []
        ends: list[tuple[int, int | None]] = []  # place of the separator after the last cut, doc_id
        held = 0

        def cut(n: int) -> pa.RecordBatch:
            nonlocal parts, ends, held, block
            flat = np.concatenate(parts)
            here = [d for at, d in ends if at < n]
            ends = [(at - n, d) for at, d in ends if at >= n]
            parts, held = [flat[n:]], held - n
            block += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([block - 1], pa.int64()), pa.array([flat[:n].tobytes()], pa.binary()), pa.array([here], pa.list_(pa.int64()))],
                names=["file", "block", "data", "doc_ids"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encoding.encode_ordinary(text or ""), separator], kind)
                parts.append(ids)
                held += len(ids)
                ends.append((held - 1, doc_id))
                while held >= block_tokens:
                    yield cut(block_tokens)
        if held:
            yield cut(held)

    return written(docs.select("doc_id", "text").mapInArrow(encode, "file long, block long, data binary, doc_ids array<long>"), "token-blocks")


def scan_separators(blocks: DataFrame, separator: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """Documents of flat token files given as ``blocks`` (file, block, data; further columns stay out).

    Blocks of a file are ordered by ``block`` and may have any sizes, empty or null ones included.
    Returns file, block (in which it ends), nth (among those that end there), start (in the file),
    n_tokens (without the separator), closed (false for tokens after the last separator, if any).
    Two separators in a row enclose an empty document. The scan's window holds a row per block with
    the places of its separators; tokens never leave the task that read them.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", dtype)
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], names=["file", "block", "size", "ends"])

    found = blocks.select(F.col("file").cast("long"), F.col("block").cast("long"), "data").mapInArrow(search, "file long, block long, size long, ends array<long>")
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    offset = found.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("last_block", F.lead("block").over(in_file).isNull())
    placed = offset.withColumn("ends", F.transform("ends", lambda e: e + F.col("offset")))
    placed = placed.withColumn("previous", F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)))
    tail_end = F.col("offset") + F.col("size")
    open_tail = F.col("last_block") & (tail_end > F.coalesce(F.array_max("ends"), F.col("previous")) + 1)
    stops = placed.withColumn("n_closed", F.size("ends")).withColumn("ends", F.when(open_tail, F.concat("ends", F.array(tail_end))).otherwise(F.col("ends")))
    each = stops.select("file", "block", "n_closed", "previous", "ends", F.posexplode("ends").alias("nth", "end"))
    start = F.when(F.col("nth") == 0, F.col("previous")).otherwise(F.try_element_at("ends", F.greatest("nth", F.lit(1)))) + 1
    return each.select("file", "block", "nth", start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("nth") < F.col("n_closed")).alias("closed"))


def read_token_files(spark: SparkSession, path: str, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files under ``path`` as blocks (file, block, data, path), through Spark's own reader.

    A file is one task's work and passes through it once; Spark's binary reader takes files of up to
    2 GB, so a larger corpus is several files. An empty file gives one empty block.
    """
    step = block_tokens * token_bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, name, content in zip(*batch.columns, strict=True):
                data = content.as_buffer()
                for block, at in enumerate(range(0, max(len(data), 1), step)):
                    piece = data.slice(at, min(step, len(data) - at)).to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()], pa.int64()), pa.array([block], pa.int64()), pa.array([piece], pa.binary()), pa.array([name.as_py()], pa.string())], names=["file", "block", "data", "path"])

    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "path", "content")
    return files.mapInArrow(cut, "file long, block long, data binary, path string")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of each row of ``docs``: encoded to flat token files, which are scanned.

    Null and empty texts count 0; texts of any length are encoded whole, long runs of white space
    included; repeated ids keep a row each; further columns are ignored; an empty table gives none.
    """
    blocks = flat_token_blocks(docs, vocabulary, separator, block_tokens)
    ids = blocks.select("file", "block", F.posexplode("doc_ids").alias("nth", "doc_id"))
    return scan_separators(blocks, separator, token_type(vocabulary, separator)).filter("closed").join(ids, ["file", "block", "nth"]).select("doc_id", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
