"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablecraft.llm.common import Tables, map_arrow, saved
from tablecraft.llm.words import MASK, STEP, mix, shingles, word_hashes

#: Four words of 64 bits, cut into 16 blocks of 16 bits: fingerprints within 63 bits agree in some block but for three bits.
LANES, BLOCKS, BLOCK_BITS, RADIUS = 4, 16, 16, 63
#: Block values that differ in at most one and in at most two bits: items are entered under the first, windows look up the second.
ENTERED = np.array([0, *(1 << p for p in range(BLOCK_BITS))], np.int64)
LOOKED_UP = np.array([*ENTERED, *(1 << p | 1 << q for p, q in combinations(range(BLOCK_BITS), 2))], np.int64)
#: Bounds of the items that one pass over the documents carries along, and of the windows handled at once.
BLOCK_WORDS, BLOCK_ITEMS = 500_000, 10_000
WINDOWS = 256


def bit_votes(values: np.ndarray) -> np.ndarray:
    """+1 or -1 for each value and bit."""
    lanes = np.stack([mix(values + np.uint64(n * STEP & MASK)) for n in range(LANES)], axis=1)
    return np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def window_fingerprints(values: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every run of ``width`` shingles, a row of words each, by differences of running sums."""
    sums = np.concatenate([np.zeros((1, 64 * LANES)), np.cumsum(bit_votes(values) * weights[:, None], axis=0)])
    return np.packbits(sums[width:] - sums[:-width] > 1e-9, axis=1, bitorder="little").view(np.uint64)


def block_keys(prints: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """(prints, blocks, flips): number of the block and its value with some bits flipped."""
    parts = prints.view(np.uint16).astype(np.int64)
    return (parts[:, :, None] ^ flips) + (np.arange(BLOCKS, dtype=np.int64) << BLOCK_BITS)[:, None]


class HammingIndex:
    """Finds all given fingerprints within ``RADIUS`` bits of a looked-up one."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        keys = block_keys(prints, ENTERED).reshape(len(prints), -1)
        order = np.argsort(keys, axis=None, kind="stable")
        self.keys, self.owners = keys.ravel()[order].astype(np.int32), (order // keys.shape[1]).astype(np.int32)

    def near(self, marks: np.ndarray) -> list[tuple[int, int]]:
        """(place in marks, place in prints) of all pairs within the radius, in order."""
        probes = block_keys(marks, LOOKED_UP).reshape(len(marks), -1)
        whose = np.repeat(np.arange(len(marks)), probes.shape[1])
        probes = probes.ravel().astype(np.int32)
        low, high = np.searchsorted(self.keys, probes), np.searchsorted(self.keys, probes, "right")
        hit = np.flatnonzero(high > low)
        many = high[hit] - low[hit]
        places = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pairs = np.unique(np.repeat(whose[hit], many) * len(self.prints) + self.owners[places])
        one, other = pairs // len(self.prints), pairs % len(self.prints)
        close = np.bitwise_count(marks[one] ^ self.prints[other]).sum(axis=1) <= RADIUS
        return list(zip(one[close].tolist(), other[close].tolist()))


class Group:
    """Items whose shingles have the same number of words and are equally many."""

    def __init__(self, words: int, width: int) -> None:
        self.words, self.width, self.items, self.found = words, width, [], []

    def finish(self, index: "ItemIndex") -> None:
        self.counts = [Counter(f.tolist()) for f in self.found]
        self.known = np.unique(np.concatenate(self.found))
        self.lightest = min(float(index.weigh(f).sum()) for f in self.found)
        self.index = HammingIndex(np.concatenate([window_fingerprints(f, index.weigh(f), self.width) for f in self.found]))
        del self.found


class ItemIndex:
    """Items of one block, grouped by shape, and the groups of each shingle."""

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int, marks: np.ndarray, often: np.ndarray, total: int) -> None:
        order = np.argsort(marks)
        self.marks, self.weights, self.rare = marks[order], np.log1p(total / often[order]), math.log1p(total)
        groups: dict[tuple[int, int], Group] = {}
        for item, words in items:
            if len(words):
                found = shingles(words, size)
                shape = (min(size, len(words)), len(found))
                group = groups.setdefault(shape, Group(*shape))
                group.items.append(item)
                group.found.append(found)
        self.groups = [groups[shape] for shape in sorted(groups)]
        self.lengths = sorted({g.words for g in self.groups})
        for group in self.groups:
            group.finish(self)
        pairs = np.array(sorted((int(x), n) for n, g in enumerate(self.groups) for x in g.known.tolist()), object).reshape(-1, 2)
        self.shared, self.in_group = pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.int32)

    def weigh(self, values: np.ndarray) -> np.ndarray:
        """Rarity in the benchmark; a shingle that no item has weighs as the rarest."""
        at = np.minimum(np.searchsorted(self.marks, values), len(self.marks) - 1)
        return np.where(self.marks[at] == values, self.weights[at], self.rare)

    def similarity(self, one: Counter, other: Counter) -> float:
        """Weighted Jaccard of two multisets of shingles."""
        kinds = sorted(one.keys() | other.keys())
        weights = self.weigh(np.array(kinds, np.uint64)).tolist()
        both = math.fsum(min(one[x], other[x]) * w for x, w in zip(kinds, weights))
        return both / math.fsum(max(one[x], other[x]) * w for x, w in zip(kinds, weights))

    def search(self, words: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity): of each item the most similar window, if it reaches the threshold.

        What a window has in common with an item of a group lies in shingles of that group, so a window can only
        reach the threshold if these make up that share of its weight, and of the lightest item's (exact bounds).
        Only such windows get a fingerprint.
        """
        best: dict[int, tuple[float, int, int]] = {}
        for n in self.lengths:
            if len(words) < n:
                continue
            values = shingles(words, n)
            low, high = np.searchsorted(self.shared, values), np.searchsorted(self.shared, values, "right")
            hits = np.flatnonzero(high > low)
            if not len(hits):
                continue
            weights = self.weigh(values)
            many = high[hits] - low[hits]
            entries = np.repeat(low[hits], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            whose, where = self.in_group[entries], np.repeat(hits, many)
            order = np.argsort(whose, kind="stable")
            whose, where = whose[order], where[order]
            upto = np.concatenate([[0.0], np.cumsum(weights)])
            for number in np.unique(whose).tolist():
                group = self.groups[number]
                if group.words != n:
                    continue
                at = where[np.searchsorted(whose, number) : np.searchsorted(whose, number, "right")]
                wide = min(group.width, len(values))
                ours = np.concatenate([[0.0], np.cumsum(weights[at])])
                starts = _windows_of(at, wide, len(values))
                share = ours[np.searchsorted(at, starts + wide)] - ours[np.searchsorted(at, starts)]
                enough = share >= threshold * np.maximum(upto[starts + wide] - upto[starts], group.lightest) - 1e-6
                for part, marks in _marked(starts[enough], wide, values, weights):
                    for place, i in group.index.near(marks):
                        start, item = int(part[place]), group.items[i]
                        alike = self.similarity(Counter(values[start : start + wide].tolist()), group.counts[i])
                        if alike >= threshold and (item not in best or alike > best[item][0]):
                            best[item] = (alike, start, wide + n - 1)
        return [(item, start, length, alike) for item, (alike, start, length) in sorted(best.items())]


def _windows_of(hits: np.ndarray, width: int, end: int) -> np.ndarray:
    """First places of all windows of ``width`` places below ``end`` that hold a hit (in ascending order)."""
    first, last = np.maximum(hits - width + 1, 0), np.minimum(hits, end - width)
    fresh = np.maximum(first, np.concatenate([[0], last[:-1] + 1]))
    many = np.maximum(last - fresh + 1, 0)
    return np.repeat(fresh, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _marked(starts: np.ndarray, width: int, values: np.ndarray, weights: np.ndarray):
    """Runs of windows that follow one another, at most ``WINDOWS`` at once, and their fingerprints."""
    cuts = np.flatnonzero(np.diff(starts) != 1) + 1
    for run in np.split(starts, cuts) if len(starts) else ():
        for a in range(0, len(run), WINDOWS):
            part = run[a : a + WINDOWS]
            inside = slice(int(part[0]), int(part[-1]) + width)
            yield part, window_fingerprints(values[inside], weights[inside], width)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, words, similarity): documents with a window, as long as the item, whose weighted
    Jaccard with the item's word shingles is at least ``threshold``; of each pair the best window.

    A shingle weighs by its rarity among the items. Windows have as many shingles as the item (a document
    shorter than the item is one window); an item of fewer words than ``size`` is one shingle of that many words.
    Fingerprints within 63 of 256 bits are all found: 16 blocks, in one of which they agree but for three bits.

    The benchmark is the query set. Spark counts the items of each shingle; items go to the driver in blocks of
    bounded size, one at a time, and each block goes over all documents in one pass without a shuffle, whose
    findings are written before the next block is fetched. Null, empty and wordless texts match nothing; rows with
    a null item id are left out, null document ids are kept as they are; repeated documents are each reported.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc"), F.col(f"`{text_column}`").cast("string").alias("text"))
    items = benchmark.select(F.col(f"`{item_column}`").cast("bigint").alias("item"), F.col(f"`{item_text_column}`").cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    schema = "doc_id bigint, item_id bigint, start int, words int, similarity double"

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [word_hashes(text.as_py()) for text in batch["text"]]
        marks = [np.unique(shingles(w, size)) for w in words]
        lists = [pa.array([x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in (words, marks)]
        return pa.RecordBatch.from_arrays([batch["item"], *lists], ["item", "hashes", "marks"])

    tables = Tables(spark)
    made = tables.save(map_arrow(items, hashed, "item bigint, hashes array<bigint>, marks array<bigint>").filter("size(hashes) > 0").distinct(), "items")
    sizes = made.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("words")).first()
    blocks = max(-(-sizes["words"] // BLOCK_WORDS), -(-sizes["items"] // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item", "hashes"), F.lit(max(blocks, 1))).alias("block")
    marks = made.select(block, F.explode("marks").alias("mark"))
    known = tables.save(marks.distinct().join(marks.groupBy("mark").agg(F.count("*").alias("n")), "mark"), "marks")

    def one_pass(number: int) -> DataFrame:
        mine = made.filter(block == number).select("item", "hashes").orderBy("item", "hashes").toArrow()
        rarity = known.filter(F.col("block") == number).select("mark", "n").toArrow()
        hashes = [(i, np.array(h, np.int64).view(np.uint64)) for i, h in zip(mine["item"].to_pylist(), mine["hashes"].to_pylist())]
        index = ItemIndex(hashes, size, rarity["mark"].to_numpy().view(np.uint64), rarity["n"].to_numpy(), sizes["items"])
        shared = spark.sparkContext.broadcast(index)  # bounded by BLOCK_WORDS and BLOCK_ITEMS

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            index, rows = shared.value, []
            for doc, text in zip(batch["doc"].to_pylist(), batch["text"]):
                rows += [(doc, *found) for found in index.search(word_hashes(text.as_py()), threshold)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "start", "words", "similarity"]) if rows else None

        found = saved(map_arrow(plain, work, schema), "contaminated")
        shared.destroy()
        return found

    filled = [row["block"] for row in made.select(block).distinct().orderBy("block").collect()]  # a number for each pass
    passes = [one_pass(number) for number in filled]
    tables.drop("items", "marks")
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)
