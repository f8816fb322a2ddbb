"""Flat token files without an index: writing them, and counting tokens by a separator scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecraft.llm.common import BATCH_ROWS, saved
from tablecraft.llm.files import read_range, size_of, written
from tablecraft.llm.tokens import END, FOLDER, VOCABULARY, tokenizer
from tablecraft.session import scratch_path


def write_token_files(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """Each input partition becomes one flat file of uint16 ids, every document followed by the end mark.

    Returns the order of the documents, (path, ordinal, doc_id); the files themselves hold ids only.
    Null and empty texts are documents of no tokens; null ids stay null; partitions without rows write no file.
    """
    plain = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc"), F.col(f"`{text_column}`").cast("string").alias("text"))
    plain.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, encode, mark, ordinal, stream = f"{path}/tokens-{TaskContext.get().partitionId():06d}.bin", tokenizer(folder, name).encode, np.uint16(END).tobytes(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                stream = written(file)
                out = stream.__enter__()
            for text in batch["text"]:
                out.write(encode(text.as_py()) + mark)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.arange(ordinal, ordinal + n)), batch["doc"]], ["path", "ordinal", "doc_id"])
            ordinal += n
        if stream is not None:
            stream.__exit__(None, None, None)

    return plain.mapInArrow(write, "path string, ordinal bigint, doc_id bigint")


def token_counts(paths: DataFrame, separator: int = END, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """Documents of flat token files: path, ordinal, start, n_tokens, ended.

    ``paths`` (column path) are files of unsigned little-endian ids of ``width`` bytes. They are cut into blocks of
    ``block_tokens``, each searched on its own for the separator. A prefix scan over the blocks of a file, of one
    small row per block, gives each block the number of documents before it and the place of the last separator
    before it, which stitches documents that cross blocks, however many. Tokens after the last separator are a
    document with ``ended`` false; a file that ends with a separator has none; an empty file gives no row.
    Bytes beyond the last whole id are refused. Null paths are left out, repeated ones count once.
    """
    kind = np.dtype(f"<u{width}")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                size = size_of(path)
                if size % width:
                    raise ValueError(f"{path} ends within an id")
                starts = np.arange(0, size // width, block_tokens)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(np.minimum(block_tokens, size // width - starts), pa.int64())], ["path", "first", "length"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(read_range(row["path"], row["first"] * width, row["length"] * width), kind)
                found = np.flatnonzero(ids == separator) + row["first"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["first"]]), pa.array([row["first"] + row["length"]]), pa.array([len(found)], pa.int64()), pa.array([int(found[-1]) if len(found) else None], pa.int64()), pa.array([found], pa.list_(pa.int64()))],
                    ["path", "first", "stop", "n", "last", "found"],
                )

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.array(row["found"] + ([row["stop"]] if row["tail"] else []), np.int64)
                starts = np.concatenate([[row["before"] + 1], ends[:-1] + 1]) if len(ends) else ends
                ended = np.arange(len(ends)) < len(row["found"])
                some = ended | (ends > starts)
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * int(some.sum()), pa.string()), pa.array(np.arange(len(ends))[some] + row["ordinal"], pa.int64()), pa.array(starts[some], pa.int64()), pa.array((ends - starts)[some], pa.int64()), pa.array(ended[some], pa.bool_())], ["path", "ordinal", "start", "n_tokens", "ended"])

    cut = paths.select(F.col("path").cast("string")).filter("path IS NOT NULL").distinct().mapInArrow(blocks, "path string, first bigint, length bigint")
    spread = saved(cut, "blocks").repartition(F.col("path"), F.col("first"))
    scanned = saved(spread.mapInArrow(scan, "path string, first bigint, stop bigint, n bigint, last bigint, found array<bigint>"), "separators")
    upto = Window.partitionBy("path").orderBy("first")
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    light = scanned.select("path", "first", "n", "last").select(
        "path", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ordinal"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("before"), F.lead("first").over(upto).isNull().alias("tail"),
    )
    stitched = scanned.drop("n", "last").join(saved(light, "prefix"), ["path", "first"])
    return stitched.mapInArrow(stitch, "path string, ordinal bigint, start bigint, n_tokens bigint, ended boolean")


def document_token_counts(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Tokenise documents into flat files, then count each one's tokens from the files alone: doc_id, n_tokens, path, ordinal, start."""
    order = saved(write_token_files(docs, scratch_path(spark, "token-files"), **options), "token-order")
    counts = token_counts(order.select("path").distinct())
    return order.join(counts.filter("ended"), ["path", "ordinal"]).select("doc_id", "n_tokens", "path", "ordinal", "start")
