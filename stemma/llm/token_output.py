"""Token ids of a corpus in Parquet: list columns with controlled encodings, row groups and page indexes.

The corpus is dealt by ranges of doc_id, so that files in order hold documents in order; each task
encodes its documents, adds the end id and writes through Spark's committer, so that a task that is
run again leaves no second copy. The files hold doc_id, shard, the place of the first id within the
shard, n_tokens and the ids. Ids go by dictionary (a vocabulary fits one dictionary page), the other
columns by delta encoding; row groups and pages have a stated size, and the writer adds column and
offset indexes, so that a reader of metadata reads no ids, and one of a few documents few pages.

Nulls: a null text is encoded as an empty one (the end id alone); null doc_ids come first. Very long
texts: whole, as one list. Repeated rows and ids: a row each, in any order among equals. Empty
tables: files without rows. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.common import partitions, shared_dir
from stemma.llm.segments import ENCODED_BYTES, SegmentEncoder, code_points, slices

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
#: What the files are written with.
OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
}
#: The tokenizer's pattern parts these from letters and digits before and after, and from a space before.
BREAKS = "\n.,"


@lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> SegmentEncoder:
    """Of a byte-level BPE tokenizer file; its special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    vocab = tok.get_vocab(with_added_tokens=True)
    token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():  # one character of a token stands for one byte
        token_bytes[i] = len(token)

    def kinds(points: np.ndarray) -> np.ndarray:
        """2: white space, 0: letter or digit, 1: another."""
        distinct, at = np.unique(points, return_inverse=True)
        return np.array([2 if c.isspace() else 0 if c.isalnum() else 1 for c in map(chr, distinct.tolist())], np.int8)[at]

    def codes(keys: list[str]) -> np.ndarray:
        """Bits 0 and 1: how it ends (letter or digit, mark, white space or empty, an empty first one); 2: it begins with a full stop or comma; 3: alone."""
        points, ends = code_points(keys)
        starts = np.append(0, ends[:-1])
        full = ends > starts
        out = np.full(len(keys), 8 + 2, np.int8)
        first, end = points[starts[full]], kinds(points[ends[full] - 1])
        stop = np.isin(first, [ord("."), ord(",")])
        out[full] = end + 4 * stop + 8 * ((end == 2) | stop | (first == ord(" ")))
        out[full & (ends - starts == 1) & (points[np.minimum(starts, len(points) - 1)] == ord(" "))] = 8 + 3
        return out

    # runs of white space, and of marks, are not split character by character
    i = np.arange(16)
    bad = ((i & 3 == 2)[:, None] | ((i & 3 == 1)[:, None] & (i & 4 > 0)[None, :]))
    whole = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    alone = lambda keys: whole([k[1:] if k[:1] == " " else k if k[:1] and k[0] in BREAKS else " " + k for k in keys])
    return SegmentEncoder(whole, whole, alone, token_bytes, 1, codes, bad, first=True, breaks=BREAKS)


def encode_table(df: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Rows of SCHEMA for (doc_id, text), in ascending doc_id within and over the partitions."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = byte_level_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, rows in slices(batch.column("text"), ENCODED_BYTES):
                part = batch.slice(at, rows)
                ids, sizes, _ = encoder.encode(part.column("text"))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id).astype(np.int32)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + offsets[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    spark = df.sparkSession
    ranged = df.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    return ranged.mapInArrow(encode, SCHEMA)


def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int, options: dict[str, str] = OPTIONS) -> None:
    encode_table(df, vocabulary, end_id).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files with ``start``, the number of ids of all documents before. Other columns than those asked for aren't read."""
    tokens = spark.read.schema(SCHEMA).parquet(path)
    # one row for each shard: as many as the writing job had tasks
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return tokens.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            at = ids.offsets.to_numpy()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the ids of ``df`` to a new folder, read them back and return the checksums."""
    path = shared_dir(df.sparkSession, "tokens")
    write_tokens(df, path, vocabulary, end_id)
    return checksums(read_tokens(df.sparkSession, path))
