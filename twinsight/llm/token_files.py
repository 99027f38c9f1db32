"""Token ids as Parquet files that can be read in part.

One row per document in ascending id order: ``doc_id, part, part_start, n_tokens, tokens``. The
ids are a dictionary-encoded list column (a vocabulary fits one dictionary page, so an id takes
about 16 bits before compression); the numbers beside it are delta-encoded. Row groups and pages
have set sizes, and pages carry column and offset indexes: a reader can take the
metadata alone, or the tokens of a range of documents, without touching the other pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinsight.llm.text import only, sliced, texts, words_of, worker_state
from twinsight.llm.vocabulary import ChunkEncoder, Remembered, id_bytes, whole_tokens

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"

#: Parquet settings of the format (row group and page sizes in bytes).
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def write_token_files(
    df: DataFrame, path: str, tokenizer_file: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode every whole text, append ``end_id`` and write the files in ascending id order.

    One shuffle by id range; a range is sorted and encoded as a stream, and each row keeps the number of ids
    before it in its own part, so no total order is ever held in one place. A null or empty text
    has the end id only. A null id comes first; repeated ids stay separate rows, ordered by text.
    An empty table gives files without rows. Other columns of ``df`` are not written.
    """
    source = Path(tokenizer_file).read_text()
    shared = df.sparkSession.sparkContext.broadcast((source, whole_tokens(source)))  # bound by the vocabulary
    end = b"" if end_id is None else id_bytes([end_id])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def build():
            encoder = ChunkEncoder(*shared.value)
            return encoder.lowered, Remembered(encoder.ids)

        lowered, table = worker_state("token_files", build, tokenizer_file)
        part, before = TaskContext.get().partitionId(), 0
        for batch in (part_of for whole in batches for part_of in sliced(whole)):
            ids, sizes = [], []
            for data in texts(batch.column("text")):
                blob = b"".join(map(table.__getitem__, words_of(lowered(data or b"")))) + end
                ids.append(blob)
                sizes.append(len(blob) // 4)
            n = np.array(sizes, "int64")
            ends = np.cumsum(n)
            tokens = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(np.frombuffer(b"".join(ids), "<i4"))
            )
            starts = before + ends - n
            before += int(n.sum())
            columns = [batch.column("doc_id"), pa.array(np.full(len(n), part, "int32")), pa.array(starts), pa.array(n), tokens]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "part_start", "n_tokens", "tokens"])

    rows = only(df, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; select or filter columns on it and only those pages are read."""
    return spark.read.schema(SCHEMA).parquet(path)


def with_starts(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """``files`` with ``start``, the ids of all documents before each one.

    Sums per part come from the ``metadata`` columns of the table as read, so no token page is opened for them; the running
    sum over them has one row per file.
    """
    parts = metadata.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = F.coalesce(F.sum("in_part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("part", before.alias("part_base"))
    return files.join(bases, "part").withColumn("start", F.col("part_base") + F.col("part_start")).drop("part_base")


def with_crc32(files: DataFrame) -> DataFrame:
    """``doc_id, part, part_start, n_tokens`` and ``ids_crc32`` of the stored ids."""

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("token_checksums", dict)  # the worker may be one that has encoded: its tables go before pages are read
        for batch in batches:
            tokens = batch.column("tokens")
            ends = tokens.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column(c) for c in ("doc_id", "part", "part_start", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums, "int64")], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"]
            )

    return files.mapInArrow(checksum, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
