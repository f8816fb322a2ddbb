"""Training-order materialisation: every token sequence gets a global slot and is written at its place."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.llm.common import BATCH_ROWS, map_arrow
from tablecraft.llm.files import read_range, written
from tablecraft.llm.tokens import END, FOLDER, VOCABULARY, spaced, tokenizer
from tablecraft.llm.words import MASK, mix
from tablecraft.session import scratch_path

#: A record: document id (NO_ID where there is none), number of the piece in the document, tokens that count, then the ids.
NO_ID = -(1 << 63)
HEAD = [("doc", "<i8"), ("piece", "<i4"), ("n", "<i4")]


def record_type(length: int) -> np.dtype:
    return np.dtype([*HEAD, ("ids", "<u2", (length,))])


def feistel(index: np.ndarray, domain: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..domain-1: a balanced Feistel network over the next power of four, walked
    along its cycle until it is back inside the domain."""
    if domain <= 1:
        return index.copy()
    half = max(1, ((domain - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [mix(np.array([key * 0x9E3779B97F4A7C15 + r & MASK], np.uint64))[0] for r in range(rounds)]
    out, outside = index.astype(np.uint64), np.ones(len(index), bool)
    while outside.any():
        left, right = out[outside] >> np.uint64(half), out[outside] & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        out[outside] = left << np.uint64(half) | right
        outside = out >= np.uint64(domain)
    return out.astype(np.int64)


def _pieces(ids, texts, length: int, folder: str, name: str) -> np.ndarray:
    """Records of each document: its ids and an end mark, cut into pieces of ``length``, the last one filled up with end marks."""
    encode, parts, counts = tokenizer(folder, name).encode, [], []
    mark = np.uint16(END).tobytes()
    for text, loose in zip(texts, spaced(texts)):
        tokens = encode(text.as_py(), loose) + mark
        n = len(tokens) // 2
        parts.append(tokens + mark * (-n % length))
        counts.append(n)
    counts = np.array(counts)
    pieces = -(-counts // length)
    out = np.zeros(pieces.sum(), record_type(length))
    out["ids"] = np.frombuffer(b"".join(parts), "<u2").reshape(-1, length)
    out["doc"] = np.repeat(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), pieces)
    out["piece"] = np.arange(len(out)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    out["n"] = np.minimum(length, np.repeat(counts, pieces) - out["piece"].astype(np.int64) * length)
    return out


def materialise(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", length: int = 256, shard_records: int = 65_536, key: int = 1,
    folder: str = FOLDER, name: str = VOCABULARY,
) -> DataFrame:
    """Write all documents as shards of fixed-stride records in training order; returns (shard, path, first_slot, records).

    A first pass counts the tokens of each text and so the records of each input partition, which gives every record a dense global number; the
    second pass makes them again and sends each to the slot that the permutation names. Each shard is one range
    of ``shard_records`` slots, written by one task in slot order, so slot s is at byte (s mod shard_records) x
    stride of shard s div shard_records. ``docs`` must be a plain table scan, whose partitions are alike in both
    passes; a task that finds another count than before fails rather than write to wrong slots.

    A null or empty text is a record that holds only the end mark; a null id is written as NO_ID and read back as null; repeated rows are
    written each; an empty table gives no shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = tokenizer(folder, name).count
        n = sum(-(-(size(text.as_py(), loose) + 1) // length) for text, loose in zip(batch["text"], spaced(batch["text"])))
        return pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n]}, pa.schema([("part", pa.int32()), ("n", pa.int64())]))

    counted = map_arrow(plain, count, "part int, n bigint").groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row per input partition
    numbers = {row["part"]: row["n"] for row in counted}
    starts, total = {}, 0
    for part in sorted(numbers):
        starts[part], total = total, total + numbers[part]
    shards = -(-total // shard_records)
    if not shards:
        return spark.createDataFrame([], "shard int, path string, first_slot bigint, records bigint")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = starts.get(part, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            records = _pieces(batch["doc"], batch["text"], length, folder, name)
            slots = feistel(np.arange(at, at + len(records)), total, key)
            at += len(records)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(records.itemsize), len(records), [None, pa.py_buffer(records.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(slots // shard_records, pa.int32()), pa.array(slots), rows.cast(pa.binary())], ["shard", "slot", "record"])
        if at != starts.get(part, 0) + numbers.get(part, 0):
            raise RuntimeError("the input's partitions changed between the passes; give a saved table")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, shard, name_of, first, n = None, None, "", 0, 0
        for batch in batches:
            column = batch["shard"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(column)) + 1), len(column)] if len(column) else []
            for a, b in zip(edges, edges[1:]):
                if column[a] != shard:
                    if stream:
                        stream.__exit__(None, None, None)
                        yield _manifest(shard, name_of, first, n)
                    shard, first, n = int(column[a]), batch["slot"][int(a)].as_py(), 0
                    name_of = f"{path}/order-{shard:06d}.bin"
                    stream = written(name_of)
                    out = stream.__enter__()
                piece = batch["record"].slice(a, b - a)
                out.write(b"".join(piece.to_pylist()))
                n += b - a
        if stream:
            stream.__exit__(None, None, None)
            yield _manifest(shard, name_of, first, n)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    placed = plain.mapInArrow(place, "shard int, slot bigint, record binary")
    ranged = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    return ranged.mapInArrow(write, "shard int, path string, first_slot bigint, records bigint")


def _manifest(shard: int, path: str, first: int, n: int) -> pa.RecordBatch:
    kinds = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_slot", pa.int64()), ("records", pa.int64())])
    return pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "first_slot": [first], "records": [n]}, kinds)


def read_slots(path: str, start: int, count: int, length: int = 256, shard_records: int = 65_536) -> np.ndarray:
    """Records ``start`` to ``start + count``, read in order; a stopped run goes on at its next slot. Stops at the end of the data."""
    kind, out = record_type(length), []
    while count > 0:
        shard, at = divmod(start, shard_records)
        try:
            got = np.frombuffer(read_range(f"{path}/order-{shard:06d}.bin", at * kind.itemsize, min(count, shard_records - at) * kind.itemsize), kind)
        except FileNotFoundError:
            break
        if not len(got):
            break
        out.append(got)
        start, count = start + len(got), count - len(got)
    return np.concatenate(out) if out else np.zeros(0, kind)


def read_back(manifest: DataFrame, length: int = 256) -> DataFrame:
    """One row per record, read from the shards: slot, shard, doc_id, piece, n_tokens, crc32 of the ids that count."""
    kind, block = record_type(length), 8192

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for at in range(0, row["records"], block):
                    n = min(block, row["records"] - at)
                    got = np.frombuffer(read_range(row["path"], at * kind.itemsize, n * kind.itemsize), kind)
                    sums = [zlib.crc32(ids[:k].tobytes()) for ids, k in zip(got["ids"], got["n"])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(n) + row["first_slot"] + at), pa.array(np.full(n, row["shard"], np.int32)), pa.array(got["doc"].copy(), mask=got["doc"] == NO_ID), pa.array(got["piece"].copy()), pa.array(got["n"].copy()), pa.array(sums, pa.int64())],
                        ["slot", "shard", "doc_id", "piece", "n_tokens", "ids_crc32"],
                    )

    return manifest.mapInArrow(read, "slot bigint, shard int, doc_id bigint, piece int, n_tokens int, ids_crc32 bigint")


def in_training_order(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Materialise into a fresh folder of the shared storage and read every record back."""
    path = scratch_path(spark, "training-order")
    manifest = materialise(docs, path, **options)
    kept = scratch_path(spark, "training-manifest")
    manifest.write.parquet(kept)
    return read_back(spark.read.schema(manifest.schema).parquet(kept), options.get("length", 256))
