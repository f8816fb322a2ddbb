"""Line dedup: winnowed line hashes find repeated runs of lines, which are extended both ways and deleted but for the first.

Long passages that stand inside longer lines are found word by word: word runs are winnowed in the same way."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablecraft.llm.common import Tables, map_arrow, saved

WORD = re.compile(r"\w+")
#: Words of a run that is hashed for winnowing passages; a multiplier for running hashes and its inverse modulo 2**64.
RUN = 8
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Joins whose parts are small after the shuffle build a table of one side rather than sort both.
HASHED = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m"}
#: Letters whose lower case is two letters or depends on the letters beside.
ODD = "\u0130\u03a3"
#: Bits of a place that tell the line or word within a text; a string has less than 2**31 bytes.
PLACES = 30


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the high bits of each number."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(BASE)
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier, and of its inverse."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, BACK, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


POWERS = powers(1 << 14)


def stretch_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each stretch values[start:stop], by differences of a running sum; equal stretches have equal hashes."""
    up, down = POWERS if len(values) < len(POWERS[0]) else powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mixed((total[stops] - total[starts]) * down[starts])


@lru_cache(maxsize=2)
def word_letters(n: int) -> np.ndarray:
    """Which of the first n code points belong to words."""
    return np.array([chr(i).isalnum() or i == ord("_") for i in range(n)], np.int8)


ASCII = word_letters(1 << 7).tobytes().ljust(256, b"\0")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_edges(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop."""
    codes = code_points(text)
    if codes.itemsize > 1 and codes.max() >= 1 << 16:
        edges = np.array([word.span() for word in WORD.finditer(text)], np.int64).reshape(-1, 2)
        return edges[:, 0], edges[:, 1]
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = np.frombuffer(codes.tobytes().translate(ASCII), np.int8) if codes.itemsize == 1 else word_letters(1 << 16)[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def words_in(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word, how many words end before the end of each line). Case does not count.

    A text that holds letters whose lower case is longer or depends on the neighbours is lower-cased word by word.
    """
    starts, stops = word_edges(text)
    codes = code_points(text)
    breaks = np.searchsorted(starts, np.append(np.flatnonzero(codes == 10), len(codes)))
    if codes.itemsize == 1 or not any(x in text for x in ODD):
        lower = code_points(text.lower())
    else:
        words = [text[a:b].lower() for a, b in zip(starts.tolist(), stops.tolist())]
        stops = np.cumsum([len(word) for word in words], dtype=np.int64)
        starts, lower = np.concatenate([[0], stops])[: len(words)], code_points("".join(words))
    return stretch_hashes(lower.astype(np.uint64), starts, stops), breaks


def lines_of(text: str | None, breaks: np.ndarray | None = None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(numbers of the lines with words, their hashes, their words). Case and blanks at the ends do not count."""
    text = text or ""
    words = np.diff(words_in(text)[1] if breaks is None else breaks, prepend=0)
    numbers = np.flatnonzero(words)
    found = text.split("\n")
    hashes = [xxhash.xxh3_64_intdigest(found[i].strip().lower().encode("utf-8", "replace")) for i in numbers]
    return numbers.tolist(), np.array(hashes, np.uint64), words[numbers]


def windows(hashes: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, stop, pick) of the shortest run of at least ``least`` words from each line on; pick is its last smallest hash."""
    total = np.concatenate([[0], np.cumsum(words)])
    stops = np.searchsorted(total, total[:-1] + least)
    stops = stops[stops <= len(hashes)].tolist()
    return [(start, stop, start if stop == start + 1 else stop - 1 - int(hashes[start:stop][::-1].argmin())) for start, stop in enumerate(stops)]


def extended(own: np.ndarray, source: np.ndarray, start: int, stop: int, at: int, same: bool) -> tuple[int, int]:
    """The match own[start:stop] = source[at:...] as far as it goes both ways; within one document it does not reach its source."""
    end = at + stop - start
    while start > 0 and at > 0 and own[start - 1] == source[at - 1] and not (same and start - 1 < end):
        start, at = start - 1, at - 1
    while stop < len(own) and end < len(source) and own[stop] == source[end] and not (same and end + 1 > start):
        stop, end = stop + 1, end + 1
    return start, stop


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    starts = np.arange(max(0, len(hashes) - length + 1))
    return stretch_hashes(hashes, starts, starts + length)


def passage_picks(runs: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` runs the place of the last smallest hash: minima of twice as many runs from step to step."""
    if len(runs) < width:
        return np.zeros(0, np.int64)
    mask = (np.uint64(1) << np.uint64(len(runs).bit_length())) - np.uint64(1)  # the low bits tell the place, later ones first
    low, have = runs & ~mask | mask - np.arange(len(runs), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    return (mask - (low & mask)).astype(np.int64)


def listed(parts, kind: pa.DataType) -> pa.ListArray:
    """A column of lists from NumPy arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.asarray(x, kind.to_pandas_dtype()) for x in parts]), kind))


def read_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_passage: int = 50) -> DataFrame:
    """One row per text, an id with a text: key, doc, sig (hash of the text), again (another), numbers, hashes, words of its lines, n words, picks, places.

    Rows that repeat id and text are one, those with a null id or text none. Keys rise with (doc, sig) and leave room for
    all places of a text: key + i is its i-th line or word, and such places order the lines or words of all texts.
    """
    text = F.col(f"`{text_column}`").cast("string")
    chosen = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc"), F.xxhash64(text).alias("sig"), text.alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    run = min(RUN, least_passage)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch["text"]:
            text = x.as_py()
            hashes, breaks = words_in(text)
            runs = run_hashes(hashes, run)
            at = passage_picks(runs, least_passage - run + 1)
            at = at[np.append(at[:1] >= 0, at[1:] != at[:-1])]
            numbers, line_hashes, words = lines_of(text, breaks)
            rows.append((numbers, line_hashes.view(np.int64), words, len(hashes), runs[at].view(np.int64), at))
        numbers, line_hashes, words, n, picks, places = zip(*rows)
        columns = [listed(numbers, pa.int32()), listed(line_hashes, pa.int64()), listed(words, pa.int32()), pa.array(n, pa.int32()), listed(picks, pa.int64()), listed(places, pa.int32())]
        return pa.RecordBatch.from_arrays([batch["doc"], batch["sig"], batch["again"], *columns], ["doc", "sig", "again", *arrays])

    arrays = {"numbers": "array<int>", "hashes": "array<bigint>", "words": "array<int>", "n": "int", "picks": "array<bigint>", "places": "array<int>"}
    tables = Tables(docs.sparkSession, HASHED)
    found = map_arrow(chosen.withColumn("again", F.xxhash64(F.lit(1), "text")), read, "doc bigint, sig bigint, again bigint, " + ", ".join(map(" ".join, arrays.items()))).filter("size(hashes) > 0")
    ordered = tables.save(found, "read").repartitionByRange("doc", "sig").dropDuplicates(["doc", "sig"]).sortWithinPartitions("doc", "sig")
    texts = saved(ordered.withColumn("id", F.monotonically_increasing_id()), "texts")
    tables.drop("read")
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    parts, rows = texts.agg(F.max(part), F.max(row)).first()
    shift = (rows or 0).bit_length()
    if (parts or 0).bit_length() + shift + PLACES > 63:
        raise ValueError("too many texts to number their words")
    return texts.withColumn("key", F.shiftleft(F.shiftleft(part, shift) + row, PLACES)).drop("id")


def text_of(place: str):
    """The key of the text that holds a place."""
    return F.shiftleft(F.shiftright(place, PLACES), PLACES)


def place_in(place: str):
    return F.col(place).bitwiseAND((1 << PLACES) - 1).cast("int")


def repeated_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = 8, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, sig, gone): the numbers of the lines of each document that repeat an earlier run of at least ``least_words`` words.

    Winnowing: of each window, the shortest run of lines with so many words, the smallest line hash is picked. Two
    texts that share such a run pick the same line in it, so a pick that occurs nowhere else clears all its windows;
    only windows under a pick that occurs twice go on. Of these the whole content is compared: a window whose first
    occurrence (by id, text hash, line) lies elsewhere matches it, is extended line by line both ways, and its lines go.

    Lines without words and blanks at line ends do not count. Documents with nothing to delete give no row. Rows
    with a null id neither give nor lose lines. A document is an id with a text (sig is the text's hash): rows that repeat
    both are read once, different texts under one id are documents of their own. ``texts`` are those of ``read_texts``.
    """
    lines = read_texts(docs, id_column, text_column) if texts is None else texts

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, h, w in zip(batch["key"].to_pylist(), batch["hashes"], batch["words"]):
            hashes = np.asarray(h.values).view(np.uint64)
            start, stop, at = np.array(windows(hashes, np.asarray(w.values), least_words), np.int64).reshape(-1, 3).T
            rows.append((hashes[at].view(np.int64), key + at, key + start, stop - start, stretch_hashes(hashes, start, stop).view(np.int64)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*rows), kinds)], ["pick", "at", "start", "n", "content"])

    tables = Tables(docs.sparkSession, HASHED)
    spans = tables.save(map_arrow(lines.select("key", "hashes", "words"), pick, "pick bigint, at bigint, start bigint, n int, content bigint"), "windows")
    again = spans.groupBy("pick").agg(F.min("at").alias("a"), F.max("at").alias("b")).filter("a <> b").select("pick")
    suspects = tables.save(spans.join(tables.save(again, "picks"), "pick").select("start", "n", "content"), "suspects")
    tables.drop("windows", "picks")
    first = suspects.groupBy("content").agg(F.min("start").alias("first"), F.max("start").alias("last")).filter("first <> last").select("content", "first")
    matches = suspects.join(tables.save(first, "first"), "content").filter("start >= first + n")  # places of a later text are beyond
    runs = matches.groupBy(text_of("start").alias("text"), text_of("first").alias("source")).agg(
        F.collect_list(F.struct(place_in("start").alias("start"), "n", place_in("first").alias("source_at"))).alias("runs"))  # bounded by the lines of one document
    runs = tables.save(runs, "runs")
    tables.drop("suspects", "first")
    sources = lines.select(F.col("key").alias("source"), F.col("hashes").alias("source_hashes"))
    mine = runs.join(sources, "source").join(lines.select(F.col("key").alias("text"), "doc", "sig", "numbers", "hashes"), "text")

    def extend(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs_out, sigs, gone = [], [], []
        for row in batch.to_pylist():
            own, source, lost = np.array(row["hashes"]), np.array(row["source_hashes"]), set()
            for run in row["runs"]:
                a, b = extended(own, source, run["start"], run["start"] + run["n"], run["source_at"], row["same"])
                lost.update(range(a, b))
            docs_out.append(row["doc"])
            sigs.append(row["sig"])
            gone.append([row["numbers"][i] for i in sorted(lost)])
        return pa.RecordBatch.from_arrays([pa.array(docs_out, pa.int64()), pa.array(sigs, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc", "sig", "gone"])

    given = mine.select("doc", "sig", (F.col("text") == F.col("source")).alias("same"), "runs", "source_hashes", "numbers", "hashes")
    cut = map_arrow(given, extend, "doc bigint, sig bigint, gone array<int>")
    return cut.groupBy(F.col("doc").alias("doc_id"), "sig").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def marked(df: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the column likely: false only where ``wanted`` has no row of these keys.

    Keys are hashed to the bits of at most 2**18 numbers, which go to every task, so rows without a partner need no shuffle.
    """
    spot = F.xxhash64(*keys).bitwiseAND((1 << 24) - 1)
    bits = wanted.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(spot & 63))")).alias("bits"))
    placed = df.withColumn("spot", spot).withColumn("word", F.shiftright("spot", 6)).join(F.broadcast(bits), "word", "left")
    return placed.withColumn("likely", F.expr("coalesce(shiftright(bits, int(spot & 63)) & 1, 0) = 1")).drop("spot", "word", "bits")


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = 50, texts: DataFrame | None = None) -> DataFrame:
    """(doc, sig, starts): the first words of the windows of ``least_words`` words that occur earlier (by id, text hash and word).

    Every window that repeats is found, wherever it begins or ends in a line, so any repeated run of so many words is
    the union of its windows, whichever documents hold them. Of equal texts only the first is read: the others lose
    all their words. Within one document a window does not overlap its first occurrence. Case and what stands between
    words do not count. ``texts`` are those of ``read_texts`` for so many words.
    """
    text = F.col(f"`{text_column}`").cast("string")
    chosen = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc"), F.xxhash64(text).alias("sig"), text.alias("text"))
    read = (read_texts(docs, id_column, text_column, least_words) if texts is None else texts).filter(F.col("n") >= least_words)
    tables = Tables(docs.sparkSession, HASHED)
    first_of = tables.save(read.groupBy("sig", "again").agg(F.min("key").alias("key")).select("key"), "firsts")
    copies = saved(read.join(first_of, "key", "left_anti").select("doc", "sig", "n"), "copies").select("doc", "sig", F.sequence(F.lit(0), F.col("n") - least_words).alias("starts"))
    spread = read.join(first_of, "key", "left_semi").select("key", F.explode(F.arrays_zip("picks", "places")).alias("p")).select(F.col("p.picks").alias("pick"), (F.col("key") + F.col("p.places")).alias("at"))
    spread = tables.save(spread, "spread")
    again = tables.save(spread.groupBy("pick").agg(F.count("*").alias("n")).filter("n > 1").select("pick"), "again")
    wanted = spread.join(again, "pick").groupBy(text_of("at").alias("key")).agg(F.collect_list(place_in("at")).alias("places"))  # bounded by the words of one document
    wanted = tables.save(wanted.join(read.select("key", "doc", "sig"), "key"), "places")
    tables.drop("firsts", "spread", "again")
    likely = marked(chosen, wanted, "doc", "sig").filter("likely").select("doc", "sig", "text")
    found = likely.join(wanted, ["doc", "sig"]).dropDuplicates(["doc", "sig"]).select("key", "places", "text")
    run = min(RUN, least_words)

    def windows_of(batch: pa.RecordBatch):
        rows, ready = [], 0
        for key, places, x in zip(batch["key"].to_pylist(), batch["places"], batch["text"]):
            hashes = words_in(x.as_py())[0]
            wanted = np.zeros(len(hashes), bool)
            wanted[np.asarray(places.values)] = True
            starts = np.flatnonzero(wanted[passage_picks(run_hashes(hashes, run), least_words - run + 1)])
            rows.append((stretch_hashes(hashes, starts, starts + least_words).view(np.int64), starts + key))
            ready += len(starts)
            if ready >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["content", "start"])
                rows, ready = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["content", "start"])

    passages = tables.save(map_arrow(found, windows_of, "content bigint, start bigint"), "passages")
    tables.drop("places")
    first = passages.groupBy("content").agg(F.min("start").alias("first"), F.max("start").alias("last")).filter(F.col("last") >= F.col("first") + least_words).select("content", "first")
    later = passages.join(tables.save(first, "first_passages"), "content").filter(F.col("start") >= F.col("first") + least_words)  # places of a later text are beyond
    lost = saved(later.groupBy(text_of("start").alias("key")).agg(F.sort_array(F.collect_list(place_in("start"))).alias("starts")).join(read.select("key", "doc", "sig"), "key").select("doc", "sig", "starts"), "starts")
    tables.drop("passages", "first_passages")
    return lost.unionByName(copies)


def without(text: str, gone: set[int], starts: np.ndarray, least: int) -> tuple[str, int]:
    """The text without whole lines and without the words of the windows that begin at ``starts``; how many lines lost something."""
    lines, out, cut, dropped = text.split("\n"), [], 0, None
    if len(starts):
        begins = word_edges(text)[0]
        edges = np.zeros(len(begins) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + least, -1)
        lost = np.cumsum(edges[:-1]) > 0
        places = np.cumsum([0, *(len(line) + 1 for line in lines)])
        bounds = np.searchsorted(begins, places)
        dropped = np.diff(np.concatenate([[0], np.cumsum(lost)])[bounds]).tolist()
    for i, line in enumerate(lines):
        if i in gone or dropped and dropped[i] and dropped[i] == bounds[i + 1] - bounds[i]:
            cut += 1
        elif dropped and dropped[i]:
            own = slice(bounds[i], bounds[i + 1])
            inside = list(zip((begins[own] - places[i]).tolist(), lost[own].tolist()))
            pieces, at = [], 0
            for (a, gone_word), (b, _) in zip(inside, [*inside[1:], (len(line), False)]):
                if gone_word:
                    pieces.append(line[at:a])
                    at = b
            out.append("".join([*pieces, line[at:]]).rstrip())
            cut += 1
        else:
            out.append(line)
    return "\n".join(out), cut


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = 8, least_passage: int = 50) -> DataFrame:
    """One row per input row: doc_id, text without the repeated runs of lines and the repeated passages, n_lines, n_deleted.

    n_deleted counts the lines that are deleted whole or in part. Null and empty texts stay as they are.
    """
    texts = read_texts(docs, id_column, text_column, least_passage)
    gone = saved(repeated_runs(docs, id_column, text_column, least_words, texts), "gone")
    passages = repeated_passages(docs, id_column, text_column, least_passage, texts)
    both = saved(gone.withColumnRenamed("doc_id", "doc").join(passages, ["doc", "sig"], "full").withColumnsRenamed({"doc": "doc_id"}), "lost")
    text = F.col(f"`{text_column}`").cast("string")
    plain = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("sig"), text.alias("text"))
    plain = marked(plain, both, "doc_id", "sig")
    whole = plain.filter("NOT likely").selectExpr("doc_id", "text", "coalesce(length(text) - length(replace(text, '\n', '')) + 1, 0) AS n_lines", "0 AS n_deleted")
    out = plain.filter("likely").join(both, ["doc_id", "sig"], "left").select("doc_id", "text", "gone", "starts")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines, deleted = [], [], []
        for text, lose, at in zip(batch["text"], batch["gone"], batch["starts"]):
            text, n = text.as_py(), 0
            lines.append(0 if text is None else text.count("\n") + 1)
            if text is not None and (lose.is_valid or at.is_valid):
                text, n = without(text, set(lose.as_py() or []), np.asarray(at.values if at.is_valid else [], np.int64), least_passage)
            texts.append(text)
            deleted.append(n)
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), pa.array(lines, pa.int32()), pa.array(deleted, pa.int32())], ["doc_id", "text", "n_lines", "n_deleted"])

    return map_arrow(out, cut, "doc_id bigint, text string, n_lines int, n_deleted int").unionByName(whole)
