"""Decontamination against a brute force that shares no code with the operator."""

import collections
import math
import re

import numpy as np
import pytest

from tablecraft.llm import decontaminate
from tablecraft.llm.decontaminate import HammingIndex, contaminated


def prose(rng, n, words=400):
    return [f"w{x}" for x in rng.zipf(1.3, n) % words]


def edited(rng, text, share):
    out = list(text)
    for place in np.flatnonzero(rng.random(len(out)) < share):
        out[place] = f"new{rng.integers(1000)}"
    return out


def fixture(seed, docs=130, items=25):
    rng = np.random.default_rng(seed)
    bench = [(i, prose(rng, int(rng.choice([2, 4, 5, 6, 12, 40, 40, 90])))) for i in range(items)]
    bench += [(100, bench[5][1] + ["more"]), (101, bench[5][1]), (7, prose(rng, 30))]
    rows = []
    for d in range(docs):
        planted = bench[rng.integers(len(bench))][1]
        around = [prose(rng, int(rng.integers(0, 80))) for _ in range(2)]
        rows.append((d, around[0] + edited(rng, planted, rng.choice([0, 0.01, 0.02, 0.05])) + around[1]))
    rows += [(docs, bench[9][1] * 12), (docs + 1, bench[8][1][: int(len(bench[8][1]) * 0.9)])]
    return bench, rows


def grams(words, size):
    n = min(size, len(words))
    return [tuple(words[a : a + n]) for a in range(len(words) - n + 1)] if n else []


def brute_force(bench, docs, size=5, threshold=0.8):
    """Best similarity of all windows, for every document and item."""
    spread = collections.Counter(g for _, w in bench for g in set(grams(w, size)))
    weight = lambda g: math.log(1 + len(bench) / spread.get(g, 1))
    best = {}
    for doc, words in docs:
        for item, wanted in bench:
            n = min(size, len(wanted))
            if len(words) < n:
                continue
            mine, theirs = grams(words, n), collections.Counter(grams(wanted, size))
            width = min(sum(theirs.values()), len(mine))
            for a in range(len(mine) - width + 1):
                window = collections.Counter(mine[a : a + width])
                both, every = (math.fsum(f(window[g], theirs[g]) * weight(g) for g in window.keys() | theirs.keys()) for f in (min, max))
                if both / every >= threshold:
                    best[doc, item] = max(best.get((doc, item), 0), both / every)
    return best


def test_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**64, (300, 4), np.uint64)
    index = HammingIndex(prints)
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
    for distance in (0, 3, 40, 63, 64):
        marks = bits.copy()
        for row in marks:
            row[rng.choice(256, distance, replace=False)] ^= 1
        found = index.near(np.packbits(marks, axis=1, bitorder="little").view(np.uint64))
        assert set(found) == ({(i, i) for i in range(300)} if distance <= 63 else set())
    # flips spread as evenly as can be, the worst case for the blocks
    marks = bits.reshape(300, 16, 16).copy()
    marks[:, :, :3] ^= 1
    marks[:, :15, 3] ^= 1
    found = index.near(np.packbits(marks.reshape(300, 256), axis=1, bitorder="little").view(np.uint64))
    assert set(found) == {(i, i) for i in range(300)}


@pytest.mark.parametrize("block_items", [10_000, 6])
def test_equals_brute_force(spark, monkeypatch, block_items):
    """Edited passages on both sides of the threshold, whatever the number of passes."""
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block_items)
    bench, docs = fixture(1)
    table = spark.createDataFrame([(d, " ".join(w), "x") for d, w in docs], "doc_id bigint, text string, item string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in bench], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(table, items).collect()}
    want = brute_force(bench, docs)
    assert set(got) == set(want) and len(want) > 50 and sum(x < 0.95 for x in want.values()) > 10
    assert all(got[k].similarity == pytest.approx(want[k], abs=1e-9) for k in want)
    words = dict(docs)
    for (doc, item), row in got.items():
        assert 0 <= row.start and row.start + row.words <= len(re.findall(r"\w+", " ".join(words[doc])))


def test_long_text_of_one_item(spark):
    """Every window of a very long text is near the item; they are handled in bounded parts."""
    docs = spark.createDataFrame([(1, "a b c d e f g " * 3_000), (2, "a b c"), (None, "a b c d e f g"), (3, None), (1, "x")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "a b c d e f g a b c d"), (9, "a b c d e f g a b c d"), (None, "a b c"), (8, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.start, r.words, r.similarity) for r in contaminated(docs, items).collect()}
    assert got == {(1, 9, 0, 11, 1.0)}
