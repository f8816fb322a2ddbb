"""Document fingerprints: MinHash by universal hash functions over word shingles, bands joined in Spark, Jaccard verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.ordering import bucket_column, bucket_total, split_points
from tablecraft.llm.common import BATCH_ROWS, map_arrow, saved
from tablecraft.llm.words import shingles_of, word_hashes
from tablecraft.session import small_frame

SLOTS = 128
#: Bands of five slots; two texts of similarity 0.8 meet in one of 25 with probability 0.99995.
BANDS, BAND_SLOTS = 25, 5
#: Documents of a stretch of the order that one task goes through, and shingles that are hashed together.
STRETCH, TOGETHER = 4_000, 1 << 16
EMPTY = np.uint8(255)
RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
          "jaccard_edited double, jaccard_next double")


def _functions(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, SLOTS, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, SLOTS, np.uint64)


FACTORS, OFFSETS = _functions(12)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the shingles of five words of each text; all words are one shingle where there are fewer."""
    return shingles_of([word_hashes(t) for t in texts])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``SLOTS`` bytes per set: of each function's smallest value the low byte of its upper half.

    A function is the upper half of (a x + b) modulo 2^64 over 32-bit x, which is strongly universal. An empty set has 255 everywhere.
    """
    out = np.full((len(sets), SLOTS), EMPTY)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    groups = np.split(full, np.flatnonzero(np.diff(np.cumsum(sizes[full]) // TOGETHER)) + 1) if len(full) else []
    for rows in groups:
        x = np.concatenate([sets[i] for i in rows]) >> np.uint64(32)
        starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        value = np.empty_like(x)
        for slot in range(SLOTS):
            np.multiply(x, FACTORS[slot], out=value)
            np.add(value, OFFSETS[slot], out=value)
            out[rows, slot] = (np.minimum.reduceat(value, starts) >> np.uint64(32)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of each two rows: the share of equal slots, less what equal bytes by chance add."""
    same = (a == b).mean(-1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0, 1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two sets; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _given(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in ascending order; the one before a row is the next one in descending order. The first row of a stretch is a guest."""
    before, before_set, before_sign = "", np.zeros(0, np.uint64), signatures([np.zeros(0, np.uint64)])[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        texts, guest = batch["text"].to_pylist(), batch["guest"].to_numpy(zero_copy_only=False)
        nexts = [before, *texts[:-1]]
        new = [edited(t, n) for t, n in zip(texts, nexts)]
        own_sets, new_sets = shingle_sets(texts), shingle_sets(new)
        own, other = signatures(own_sets), signatures(new_sets)
        next_sets, next_signs = [before_set, *own_sets[:-1]], np.concatenate([before_sign[None], own[:-1]])
        keep = pa.array(~guest)
        columns = [
            batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
            pa.array([s.tobytes().hex() for s in own]), pa.array([s.tobytes().hex() for s in other]), pa.array(likeness(own, other)), pa.array(likeness(own, next_signs)),
            pa.array([jaccard(a, b) for a, b in zip(own_sets, new_sets)], pa.float64()), pa.array([jaccard(a, b) for a, b in zip(own_sets, next_sets)], pa.float64()),
        ]
        before, before_set, before_sign = texts[-1], own_sets[-1], own[-1]
        out = pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in RESULT.split(", ")])
        yield out.filter(keep)


def compare_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stretch: int = STRETCH) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited, jaccard_next.

    The edited text has the last half of the code points replaced by the beginning of the next document's text, in descending order of the
    id; after the last comes the first. ``near_`` are likenesses of fingerprints, ``jaccard_`` the exact similarities of the shingle sets.

    The order is cut into stretches at points of a bounded sample, at most 4096. Texts are shuffled once, each to its
    stretch; a task goes through it in order and holds one batch. The last document of each stretch is also sent to the one
    behind it. Keys of all documents are saved first, so a rerun task finds the same stretches.

    Null texts are read as empty; an empty text has the fingerprint of no shingle, which is like itself only. Null ids are the
    greatest; rows that repeat an id follow each other by the hash of their text. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = _given(docs, id_column, text_column).withColumn("h", F.xxhash64("text"))
    keys = saved(plain.select("doc_id", "h"), "keys")
    rows = keys.count()
    if not rows:
        return spark.createDataFrame([], RESULT)
    order = ["doc_id", "h"]
    points = split_points(keys, order, rows, bucket_total(rows, stretch))
    last = keys.groupBy(bucket_column(keys, order, points).alias("stretch")).agg(F.max(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h")).alias("last"))
    ends = sorted((row["stretch"], row["last"]["doc_id"], row["last"]["h"]) for row in last.collect())  # a row per stretch
    behind = [ends[(i + 1) % len(ends)][0] for i in range(len(ends))]
    known = small_frame(spark, [(d, h, s) for (_, d, h), s in zip(ends, behind)], "end_id bigint, end_h bigint, stretch int")
    guests = plain.join(F.broadcast(known), plain["doc_id"].eqNullSafe(known["end_id"]) & (plain["h"] == known["end_h"])).groupBy("stretch").agg(F.min("text").alias("text"))
    none = F.lit(None).cast("bigint")
    dealt = plain.select(bucket_column(plain, order, points).cast("int").alias("stretch"), F.lit(False).alias("guest"), "doc_id", "h", "text").unionByName(
        guests.select("stretch", F.lit(True).alias("guest"), none.alias("doc_id"), none.alias("h"), "text"))
    sorted_rows = dealt.repartitionById(len(points) + 1, F.col("stretch")).sortWithinPartitions("stretch", F.desc("guest"), F.col("doc_id").asc_nulls_last(), "h")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return sorted_rows.select("doc_id", "guest", "text").mapInArrow(_compared, RESULT)


def fingerprint_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of whole texts, without any shuffle."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        signs = signatures(shingle_sets(batch["text"].to_pylist()))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s.tobytes().hex() for s in signs])], ["doc_id", "fingerprint"])

    return map_arrow(_given(docs, id_column, text_column), work, "doc_id bigint, fingerprint string")


def bands_of(fingerprint: Column) -> Column:
    """An array of band keys of a fingerprint."""
    width = 2 * BAND_SLOTS
    return F.array(*[F.xxhash64(F.lit(i), F.substring(fingerprint, 1 + i * width, width)) for i in range(BANDS)])


def match_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, match_id, jaccard): the smallest id that a document was found to match, itself where there is none.

    Documents of equal text are one node. Nodes of a band are compared with the band's first one, the node with the smallest id, so
    a band costs as many comparisons as it has nodes and no pairs are listed. Each comparison is verified by the exact Jaccard
    similarity of the whole texts' shingle sets. Rows with a null id are left out; rows that repeat an id are read as the one with the smallest text hash;
    texts without words match equal texts only.
    """
    plain = _given(docs, id_column, text_column).filter("doc_id IS NOT NULL").withColumn("node", F.xxhash64("text"))
    ids = saved(plain.groupBy("doc_id").agg(F.min("node").alias("node")), "ids")
    nodes = saved(ids.groupBy("node").agg(F.min("doc_id").alias("low")), "nodes")
    one = saved(plain.join(nodes.withColumnRenamed("low", "doc_id"), ["doc_id", "node"]).dropDuplicates(["node"]).select("node", "doc_id", "text"), "texts")
    empty = signatures([np.zeros(0, np.uint64)])[0].tobytes().hex()
    banded = fingerprint_texts(one).filter(F.col("fingerprint") != empty).select(F.col("doc_id").alias("low"), F.explode(bands_of(F.col("fingerprint"))).alias("band"))
    firsts = banded.groupBy("band").agg(F.min("low").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    candidates = saved(banded.join(firsts, "band").filter("low > first").select("low", "first").distinct(), "candidates")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = shingle_sets(batch["text"].to_pylist()), shingle_sets(batch["first_text"].to_pylist())
        like = np.array([jaccard(x, y) for x, y in zip(a, b)])
        good = pa.array(like >= threshold)
        return pa.RecordBatch.from_arrays([batch["low"].filter(good), batch["first"].filter(good), pa.array(like).filter(good)], ["low", "first", "jaccard"])

    texts = candidates.join(one.select(F.col("doc_id").alias("low"), "text"), "low").join(one.select(F.col("doc_id").alias("first"), F.col("text").alias("first_text")), "first")
    found = map_arrow(texts.select("low", "first", "text", "first_text"), verify, "low bigint, first bigint, jaccard double")
    best = found.groupBy("low").agg(F.min(F.struct("first", "jaccard")).alias("best"))
    return ids.join(nodes, "node").join(best, "low", "left").select("doc_id", F.coalesce("best.first", "low").alias("match_id"), F.coalesce("best.jaccard", F.lit(1.0)).alias("jaccard"))
