"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablecraft.llm.common import components, map_arrow, saved
from tablecraft.llm.words import MASK, STEP, mix


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the row length is a power of two."""
    n, width, step = len(x), x.shape[1], 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def rotated(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A pseudo-random rotation: three times random signs and a Hadamard transform."""
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def polytope_codes(unit: np.ndarray, tables: int, functions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(own, probes): each row's bucket in each table, and the buckets of the vertices next in closeness.

    A function's value is the closest signed axis after a rotation. Probes exchange the value of one function for
    its second or third choice, or of two functions for their second.
    """
    n, width = unit.shape
    size = 1 << max(1, (width - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :width] = unit
    rng, own, probes = np.random.default_rng(seed), [], []
    for table in range(tables):
        choices = []
        for _ in range(functions):
            y = rotated(padded, rng)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
            choices.append(top * 2 + (np.take_along_axis(y, top, 1) < 0))
        base = [c[:, 0] for c in choices]
        variants = []
        for i in range(functions):
            for other in range(1, choices[i].shape[1]):
                variants.append([choices[i][:, other] if j == i else base[j] for j in range(functions)])
            for k in range(i):
                variants.append([choices[j][:, 1] if j in (i, k) and choices[j].shape[1] > 1 else base[j] for j in range(functions)])
        start = np.uint64((table + 1) * STEP & MASK)

        def bucket(codes: list[np.ndarray]) -> np.ndarray:
            value = np.full(n, start)
            for code in codes:
                value = mix(value * np.uint64(STEP) + code.astype(np.uint64) + np.uint64(1))
            return value.view(np.int64)

        own.append(bucket(base))
        probes.append(np.stack([bucket(v) for v in variants], 1))
    return np.stack(own, 1), np.concatenate(probes, 1)


def tables_for(width: int, functions: int, threshold: float, recall: float, seed: int, pairs: int = 600) -> int:
    """Tables with which a pair at exactly ``threshold`` meets with probability ``recall``; closer pairs meet more often.

    The chance to meet in one table is measured on random pairs of the given cosine; vectors are rotated at random, so it
    does not depend on where a pair lies.
    """
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(pairs, width)), rng.normal(size=(pairs, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if width > 1:
        b -= (a * b).sum(1, keepdims=True) * a
        b = threshold * a + math.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    else:
        b = a
    trial = 8
    (own_a, more_a), (own_b, more_b) = (polytope_codes(x, trial, functions, seed + 1) for x in (a, b))
    each = more_a.shape[1] // trial
    met = 0.0
    for t in range(trial):
        part = slice(t * each, (t + 1) * each)
        met += ((own_a[:, t] == own_b[:, t]) | (own_a[:, t, None] == more_b[:, part]).any(1) | (own_b[:, t, None] == more_a[:, part]).any(1)).mean() / trial
    met = min(max(met - 2 * math.sqrt(met * (1 - met) / (pairs * trial)), 1e-3), 1 - 1e-9)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None for null, empty, zero ones and those that hold a null or a non-finite number."""
    out: list[np.ndarray | None] = []
    for x in column:
        values = None if not x.is_valid or x.values.null_count else np.asarray(x.values, np.float64) + 0.0
        out.append(values if values is not None and len(values) and np.isfinite(values).all() and values.any() else None)
    return out


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.9, recall: float = 0.9999, seed: int = 5) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with a cosine of at least ``threshold``), component_id, kept.

    Equal vectors are one node, so thousands of copies cost as much as one. A node's code in a table joins so many
    cross-polytope functions that less than one node is in a bucket by chance, and there are so many tables that a pair at exactly
    ``threshold`` meets with probability ``recall`` whatever the number of functions (see ``tables_for``). Nodes meet where one's
    bucket is the other's bucket or probe; each pair that meets is verified once by its cosine in double precision.
    Vectors of different length never link.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Rows with a null
    id are left out; rows that repeat an id are one vector (of different ones that with the smallest hash). An
    empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_column}`").alias("v")).filter("vec_id IS NOT NULL")

    def name(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _vectors(batch["v"])
        nodes = [None if x is None else xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in found]
        return pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["vec_id", "node", "v"])

    named = saved(map_arrow(plain, name, "vec_id bigint, node bigint, v array<double>"), "vectors")
    ids = saved(named.groupBy("vec_id").agg(F.min("node").alias("node")), "ids")
    sizes = saved(ids.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")), "sizes")
    nodes = saved(named.select("vec_id", "node", "v").join(sizes.select("node", F.col("low").alias("vec_id")), ["vec_id", "node"]).select("node", "v").dropDuplicates(["node"]), "nodes")
    shape = nodes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).collect()[0]
    width = 1 << max(1, ((shape["width"] or 1) - 1).bit_length())
    functions = max(2, math.ceil(math.log(max(2, shape["n"])) / math.log(2 * width)))
    tables = tables_for(width, functions, threshold, recall, seed)

    def hashed(batch: pa.RecordBatch):
        found = [np.asarray(x.values) for x in batch["v"]]
        lengths = np.array([len(x) for x in found])
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            unit = np.stack([found[i] for i in rows])
            unit = unit / np.abs(unit).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            own, probes = polytope_codes(unit, tables, functions, seed)
            codes = np.concatenate([own, probes], 1)
            offsets = pa.array((np.arange(len(rows) + 1) * codes.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["node"].take(pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], ["node", "codes"])

    codes = saved(map_arrow(nodes, hashed, "node bigint, codes array<bigint>"), "codes")
    own = codes.select("node", F.explode(F.slice("codes", 1, tables)).alias("bucket"))
    asked = codes.select(F.col("node").alias("other"), F.explode("codes").alias("bucket"))
    met = own.join(asked, "bucket").filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = np.zeros(batch.num_rows, bool)
        sizes = np.stack([np.diff(batch[c].offsets.to_numpy()) for c in "xy"])
        for width in np.unique(sizes[0][sizes[0] == sizes[1]]):
            rows = np.flatnonzero((sizes == width).all(0))
            p, q = (batch[c].take(pa.array(rows)).flatten().to_numpy().reshape(-1, width) for c in "xy")
            p, q = p / np.abs(p).max(1, keepdims=True), q / np.abs(q).max(1, keepdims=True)
            good[rows] = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1)) >= threshold
        keep = pa.array(good)
        return pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    pairs = met.join(nodes.select(F.col("node").alias("a"), F.col("v").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("v").alias("y")), "b")
    edges = saved(map_arrow(pairs.select("a", "b", "x", "y"), verify, "a bigint, b bigint"), "edges")

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(sizes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("around"))
    parts = components(edges)
    known = saved(sizes.join(around, "node", "left").join(parts, "node", "left").select("node", "low", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part")), "known")
    lows = known.groupBy("part").agg(F.min("low").alias("component_id"))
    out = ids.join(saved(known.join(lows, "part").select("node", "n_links", "component_id"), "named"), "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
