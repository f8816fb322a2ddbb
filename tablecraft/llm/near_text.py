"""Near-duplicate texts by DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablecraft.llm.common import components, map_arrow, saved
from tablecraft.llm.words import MASK, STEP, mix, shingles_of, word_hashes

GOLD = np.uint64(STEP)
#: Texts whose darts are thrown together, and their shingles.
GROUP_TEXTS, GROUP_ITEMS = 256, 100_000
#: Leaders of a bucket: one in the first round, then so many times more a round, up to the most.
LEADERS, MOST_LEADERS = 8, 64


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """DartMinHash of weighted sets: an (n_sets, k) array whose rows agree in a coordinate as often as the
    weighted Jaccard similarity of the sets says. Sets without weight get zeros.

    Element e of weight x owns the region [0, x), cut into strips [0, 1), [1, 2), [2, 4) and so on. Into each
    strip darts fall as a Poisson process in rank whose rate is the strip's width; place, coordinate and rank of
    a dart depend on element, strip and number alone, so sets that share an element share its darts. A dart
    beyond the element's weight misses. Each coordinate keeps its earliest dart. About k ln k + 4k darts are
    thrown for a set whatever its size; sets with an empty coordinate are thrown again to twice the rank.
    """
    best, kept = np.full(n_sets * k, np.inf), np.zeros(n_sets * k, np.uint64)
    total = np.bincount(owners, weights, n_sets)
    reach = (k * math.log(k) + 4 * k) / np.maximum(total, 1e-300)
    while len(elements):
        low, strip, parts = 0.0, 0, []
        while (inside := weights > low).any():
            width = max(1.0, low)
            parts.append((mix(elements[inside] + np.uint64(strip * 0xD6E8FEB86659FD93 & MASK)), np.full(inside.sum(), low), np.full(inside.sum(), width), weights[inside], owners[inside]))
            low, strip = low + width, strip + 1
        seeds, lows, widths, limits, whose = (np.concatenate(x) for x in zip(*parts))
        ranks, number = np.zeros(len(seeds)), 0
        thrown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(seeds):
            number += 1
            hashed = mix(seeds + np.uint64(number * STEP & MASK))
            ranks = ranks - np.log1p(-(hashed >> np.uint64(11)).astype(np.float64) * 2.0**-53) / widths
            alive = ranks <= reach[whose]
            if not alive.all():
                seeds, lows, widths, limits, whose, ranks, hashed = (x[alive] for x in (seeds, lows, widths, limits, whose, ranks, hashed))
            name = mix(hashed ^ GOLD)
            hit = lows + widths * (name & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < limits
            slot = whose * k + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            thrown.append((slot, ranks, name) if hit.all() else (slot[hit], ranks[hit], name[hit]))
        slots, rank, names = (np.concatenate(x) for x in zip(*thrown))
        np.minimum.at(best, slots, rank)
        first = rank == best[slots]
        kept[slots[first]] = names[first]
        short = np.isinf(best.reshape(n_sets, k)).any(1) & (total > 0)
        again = short[owners]
        elements, weights, owners, reach = elements[again], weights[again], owners[again], reach * 2
    return kept.reshape(n_sets, k)


def _signed(values: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind)


def _signature_batch(batch: pa.RecordBatch, size: int, k: int, rows: int):
    ids, texts = batch.column(0), batch.column(1)
    start = 0
    while start < len(ids):
        hashes, stop, items = [], start, 0
        while stop < len(ids) and stop - start < GROUP_TEXTS and items < GROUP_ITEMS:
            hashes.append(word_hashes(texts[stop].as_py()))
            items += len(hashes[-1])
            stop += 1
        nodes = [xxhash.xxh3_64_intdigest(x) for x in hashes]
        sets, counts = zip(*(np.unique(x, return_counts=True) for x in shingles_of(hashes, size)))
        owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        weights = np.concatenate(counts).astype(np.float64)
        signs = dart_signatures(np.concatenate(sets), weights, owners, len(sets), k)
        bands = np.zeros((len(sets), k // rows), np.uint64)
        for place in range(rows):
            bands = mix(bands * GOLD + signs[:, place :: rows][:, : k // rows])
        bands = mix(bands + np.arange(1, k // rows + 1, dtype=np.uint64)[None, :] * GOLD)
        totals = np.bincount(owners, weights, len(sets)).astype(np.int64)
        offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (k // rows))
        yield pa.RecordBatch.from_arrays(
            [ids.slice(start, stop - start), _signed(np.array(nodes, np.uint64)), _signed(totals), pa.ListArray.from_arrays(offsets, _signed(bands.ravel()))],
            ["doc", "node", "weight", "bands"],
        )
        start = stop


def _item_batch(batch: pa.RecordBatch, size: int):
    """The multiset of shingles as a set: the n-th occurrence of a shingle is an item of its own."""
    hashes, parts = [word_hashes(text.as_py()) for text in batch.column(1)], []
    nodes = [xxhash.xxh3_64_intdigest(x) for x in hashes]
    for each in shingles_of(hashes, size):
        found, often = np.unique(each, return_counts=True)
        places = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
        parts.append(mix(np.repeat(found, often) + places.astype(np.uint64) * GOLD))
    offsets = pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([_signed(np.array(nodes, np.uint64)), pa.ListArray.from_arrays(offsets, _signed(np.concatenate(parts)))], ["node", "items"])


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, threshold: float = 0.8, k: int = 96, rows: int = 4) -> DataFrame:
    """One row per document: id, ``component_id`` (smallest id of its group), ``group_size`` (documents of the group), ``kept`` (it is that smallest).

    Similarity is the weighted Jaccard of the word shingles, each weighing as often as it occurs; pairs of at
    least ``threshold`` are linked, groups are connected components. Words are lower-case runs of letters and
    digits; a text of fewer words than ``size`` is one shingle.

    1. Signatures of ``k`` darts, hashed in bands of ``rows``; texts with the same words are one node from here.
    2. Nodes that share a band hash with another are candidates. A candidate is dropped where the items that no
       other candidate has prove that no partner can reach the threshold (an exact bound).
    3. In each bucket the node with the most company leads; every member is compared with the leader on the whole
       multisets. Those that fail, and by the bound of 2 may still match another of them, go on under the next
       leaders (one for each of 8 parts of the bucket, then of 64), until no bucket has two members left. Work is linear in bucket rows for each round; no pairs within a bucket are
       listed and nothing is capped.
    4. A node that matched its leader left the bucket; one that missed it may still be linked to that node. By the
       triangle inequality only narrow misses can be, and only with some of the matches; these pairs are compared
       too where the components are still apart, so no link between candidates is lost.

    Null, empty and wordless texts link with nothing. Rows that share an id are one document: any of its texts
    links it. Rows with a null id are left out. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc"), F.col(f"`{text_column}`").cast("string").alias("text")).filter("doc IS NOT NULL")
    signs = saved(map_arrow(plain, lambda batch: _signature_batch(batch, size, k, rows), "doc bigint, node bigint, weight bigint, bands array<bigint>"), "signatures")
    worded = signs.filter("weight > 0")
    classes = saved(worded.groupBy("node").agg(F.min("doc").alias("doc"), F.min("weight").alias("weight")), "classes")

    bands = worded.join(classes.select("node", "doc"), ["node", "doc"]).select("node", "weight", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("node").alias("one"), F.max("node").alias("other"), F.min("weight").alias("least")).filter("one <> other").select("bucket", "least")
    crowd = saved(bands.join(saved(shared, "buckets"), "bucket").select("bucket", "node", "least"), "crowd")
    wanted = crowd.groupBy("node").agg(F.min("least").alias("least")).join(classes, "node")
    texts = plain.join(wanted.select("doc", F.col("node").alias("wanted"), "least", "weight"), "doc")
    items = saved(_items(texts, size), "items")

    candidates, rounds = items, 0
    able = saved(_able(items, items.select("node", "least"), threshold), "able")
    rows_left = crowd.join(able.select("node", "weight"), "node").select("bucket", "node", "weight")
    size_of = rows_left.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    company = rows_left.join(size_of, "bucket").groupBy("node").agg(F.sum("n").alias("company"))
    live = saved(rows_left.join(company, "node").select("bucket", "node", "weight", (F.col("company") * 1024 + F.pmod("node", F.lit(1024))).alias("rank")), "live")
    found: list[DataFrame] = []
    while True:
        salt = F.pmod("node", F.lit(min(LEADERS**rounds, MOST_LEADERS)))
        chosen = live.groupBy("bucket", salt.alias("salt")).agg(F.max_by("node", "rank").alias("leader"))
        # at most MOST_LEADERS of a bucket, kept as one list: the joins below give a row for each node of a bucket, not for each leader
        leaders = chosen.groupBy("bucket").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
        met = saved(live.join(leaders, "bucket"), "met")
        pairs = _asked(met).select("node", F.explode("leaders").alias("leader")).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        tested = saved(_compared(pairs, items, threshold), "tested")
        if tested.isEmpty():
            break
        found.append(tested)
        alike = tested.filter("alike").select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("like")), F.struct(F.col("b").alias("node"), F.col("a").alias("like")))))
        likes = alike.groupBy("node").agg(F.collect_set("like").alias("likes"))
        settled = F.array_contains("leaders", F.col("node")) | F.coalesce(F.arrays_overlap("leaders", "likes"), F.lit(False))
        over = saved(met.join(likes, "node", "left").filter(~settled).select("bucket", "node", "weight", "rank").distinct(), "over")
        if over.isEmpty():
            break
        least = over.groupBy("bucket").agg(F.min("weight").alias("least"), F.count("*").alias("n")).filter("n > 1").select("bucket", "least")
        lows = over.join(least, "bucket").groupBy("node").agg(F.min("least").alias("least"))
        items = saved(items.drop("least").join(lows, "node"), "items")
        live = saved(over.join(_able(items, items.select("node", "least"), threshold).select("node"), "node"), "live")
        rounds += 1

    tests = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "a bigint, b bigint, weight_a bigint, weight_b bigint, alike boolean, sim double")
    edges = tests.filter("alike").select("a", "b")
    labels = components(edges)
    passed_over = saved(_passed_over(tests, labels, able, threshold), "passed-over")
    if not passed_over.isEmpty():
        labels = components(edges.unionByName(_compared(passed_over, candidates, threshold).filter("alike").select("a", "b")))
    named = signs.select("doc", F.when(F.col("weight") > 0, F.col("node")).alias("node")).join(labels, "node", "left")
    groups = saved(named.select("doc", F.coalesce("component", "node").alias("part")), "groups")
    lows = saved(groups.filter("part IS NOT NULL").groupBy("part").agg(F.min("doc").alias("low"), F.count("*").alias("n")), "lows")
    result = groups.join(lows, "part", "left").groupBy("doc").agg(F.least(F.min("doc"), F.min("low")).alias("component_id"), F.max(F.coalesce("n", F.lit(1))).alias("group_size"))
    return result.select(F.col("doc").alias("doc_id"), "component_id", "group_size", (F.col("doc") == F.col("component_id")).alias("kept"))


def _asked(met: DataFrame) -> DataFrame:
    """(node, leaders): the other leaders that a node meets in any bucket, each once; lists of its buckets name many of them again."""
    lists = met.groupBy("node").agg(F.collect_set("leaders").alias("lists"))
    return lists.select("node", F.array_remove(F.array_distinct(F.flatten("lists")), F.col("node")).alias("leaders"))


def _compared(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(a, b, weight_a, weight_b, alike, sim) of the pairs, on whole multisets; sim is 0 where the weights alone show a far miss."""
    mine, theirs = (items.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}"), F.col("weight").alias(f"weight_{x}")) for x in "ab")
    common = F.size(F.array_intersect("items_a", "items_b"))
    either = F.col("weight_a") + F.col("weight_b") - common
    close = F.least("weight_a", "weight_b") >= (2 * threshold - 1 - 1e-9) * F.greatest("weight_a", "weight_b")
    judged = F.when(close, F.struct((common >= threshold * either).alias("alike"), (common / either).alias("sim"))).otherwise(F.struct(F.lit(False).alias("alike"), F.lit(0.0).alias("sim")))
    return pairs.join(mine, "a").join(theirs, "b").select("a", "b", "weight_a", "weight_b", judged.alias("judged")).select("a", "b", "weight_a", "weight_b", "judged.*")


def _passed_over(tests: DataFrame, labels: DataFrame, able: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) not yet compared that may be linked and would join two components.

    One of them matched some leader and the other missed it. One minus the weighted Jaccard is a metric, so a link
    needs the leader's two similarities to differ by no more than 1 - threshold. Besides, what the two share lies
    within the leader, where each has no more than it shares with the leader, or outside it, where items that no
    other node has do not count. Both bounds are exact.
    """
    def each_way(df: DataFrame, node: str) -> DataFrame:
        inside = F.round(F.col("sim") * (F.col("weight_a") + F.col("weight_b")) / (1 + F.col("sim"))).cast("bigint").alias(f"{node}_inside")
        ways = (df.select(F.col(x).alias("leader"), F.col(y).alias(node), F.col(f"weight_{y}").alias(f"{node}_weight"), F.col("sim").alias(f"{node}_sim"), inside) for x, y in ("ab", "ba"))
        lefts = able.select(F.col("node").alias(node), F.col("left").alias(f"{node}_left"))
        return reduce(DataFrame.unionByName, ways).distinct().join(lefts, node).withColumn(f"{node}_outside", F.col(f"{node}_left") - F.col(f"{node}_inside"))

    part_a, part_b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")) for x in "ab")
    narrow = tests.filter(~F.col("alike") & (F.col("sim") >= 2 * threshold - 1 - 1e-9))
    apart = narrow.join(part_a, "a", "left").join(part_b, "b", "left").filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
    met = each_way(apart, "missed").join(each_way(tests.filter("alike"), "matched"), "leader")
    can = (F.col("matched_sim") - F.col("missed_sim") <= 1 - threshold + 1e-9) & (F.least("missed_weight", "matched_weight") >= threshold * F.greatest("missed_weight", "matched_weight"))
    common = F.least("missed_inside", "matched_inside") + F.least("missed_outside", "matched_outside")
    enough = common * (1 + threshold) >= threshold * (F.col("missed_weight") + F.col("matched_weight")) - 1e-9
    return met.filter(can & enough).select(F.least("missed", "matched").alias("a"), F.greatest("missed", "matched").alias("b")).distinct()


def _able(items: DataFrame, lows: DataFrame, threshold: float) -> DataFrame:
    """(node, weight, left) of the nodes that some other of these may still match. Items that no other node has cannot be
    shared, so the common part is at most the rest (``left``), and the partner weighs at least that and at least ``least``."""
    rare = items.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other").groupBy("node").agg(F.count("*").alias("own"))
    left = F.col("weight") - F.coalesce("own", F.lit(0))
    can = left >= threshold * (F.col("weight") - left + F.greatest(left, F.col("least")))
    return items.select("node", "weight").join(lows, "node").join(rare, "node", "left").filter(can).select("node", "weight", left.alias("left")).distinct()


def _items(texts: DataFrame, size: int) -> DataFrame:
    """(node, items, weight, least) of the wanted nodes; a document may hold other texts than the wanted one."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _item_batch(pa.RecordBatch.from_arrays([batch["wanted"], batch["text"]], ["node", "text"]), size)
        return pa.RecordBatch.from_arrays([batch["wanted"], made["node"], made["items"], batch["weight"], batch["least"]], ["wanted", "node", "items", "weight", "least"])

    made = map_arrow(texts, work, "wanted bigint, node bigint, items array<bigint>, weight bigint, least bigint")
    return made.filter("wanted = node").select("node", "items", "weight", "least")
