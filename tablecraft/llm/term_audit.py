"""Divergence audit of sources: a translate-table tokenizer, per-document counters, sparse sums, exact integer divergences."""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.llm.common import BATCH_ROWS, map_arrow, saved

#: Every ASCII byte that is no letter ends a term; bytes of other characters belong to terms.
BLANKS = bytes(b for b in range(128) if chr(b) not in string.ascii_letters)
TABLE = bytes.maketrans(string.ascii_uppercase.encode() + BLANKS, string.ascii_lowercase.encode() + b" " * len(BLANKS))
#: A tally is sent on when it holds so many (group, term) entries; a text is split in pieces of about so many bytes.
TALLY, PIECE = 150_000, 1 << 20
#: Cells of the dense block in which the terms of a batch are compared.
CELLS = 1 << 19
SCALE = 1_000_000_000

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("n", pa.int64())])
PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def document_terms(text: bytes) -> Counter:
    """Occurrences of each term of a whole UTF-8 text."""
    text, found, start = text.translate(TABLE), Counter(), 0
    while start < len(text):
        stop = text.find(b" ", start + PIECE)
        stop = len(text) if stop < 0 else stop
        found.update(text[start:stop].split())
        start = stop
    return found


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, occurrences, held = defaultdict(Counter), defaultdict(Counter), 0

    def drained() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in docs.items():
            count = occurrences[lang, source]
            size = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size), pa.array([source] * size), pa.array(list(terms), pa.binary()), pa.array(list(terms.values()), pa.int64()), pa.array([count[t] for t in terms], pa.int64())], schema=COUNTS)
        docs.clear(), occurrences.clear()

    for batch in batches:
        for text, lang, source in zip(batch["text"], batch["lang"].to_pylist(), batch["source"].to_pylist()):
            found, seen = document_terms(text.as_buffer().to_pybytes()), docs[lang, source]
            held -= len(seen)
            seen.update(found.keys())
            held += len(seen)
            total = occurrences[lang, source]
            for term, n in found.items():
                total[term] += n
            if held > TALLY:
                yield from drained()
                held = 0
    yield from drained()


def term_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(lang, source, term, docs, n) of all texts: in how many documents of the group a term stands, and how often."""
    def given(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    plain = docs.select(given(text_column).cast("binary").alias("text"), given(lang_column).alias("lang"), given(source_column).alias("source"))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    tallied = plain.mapInArrow(_tally, "lang string, source string, term binary, docs bigint, n bigint")
    return tallied.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (size + 2 terms)); the product may pass 64 bits."""
    above, below = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (size + 2 * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above, below) + 1).otherwise(F.lit(1).cast("bigint"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shared_terms(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For each two sources, over the terms of the batch that both have: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), summed."""
    langs = np.array(batch["lang"].to_pylist(), object)
    lists = batch["held"]
    offsets, cells = lists.offsets.to_numpy(), lists.values
    sources, p, p0 = np.array(cells.field("source").to_pylist(), object), cells.field("p").to_numpy(), cells.field("p0").to_numpy()
    term = np.repeat(np.arange(batch.num_rows), np.diff(offsets))

    def apart(a, b):
        return (a - b) * (a - b) // (a + b)

    for lang in sorted(set(langs)):
        mine = np.flatnonzero(langs[term] == lang)
        names, where = np.unique(sources[mine], return_inverse=True)
        absent = np.zeros(len(names), np.int64)
        absent[where] = p0[mine]
        rows = term[mine]
        step = max(1, CELLS // len(names))
        for low in range(0, batch.num_rows, step):
            inside = (rows >= low) & (rows < low + step)
            block = np.zeros((step, len(names)), np.int64)
            block[rows[inside] - low, where[inside]] = p[mine][inside]
            for s in range(len(names) - 1):
                have = block[block[:, s] > 0, s:]
                if not len(have):
                    continue
                a, others, q0 = have[:, :1], have[:, 1:], absent[s + 1 :]
                both = others > 0
                q = np.where(both, others, 1)
                gain = apart(a, q) - apart(a, q0) - apart(absent[s], q) + apart(absent[s], q0)
                value = np.where(both, gain, 0).sum(0)
                met = np.flatnonzero(both.any(0))
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(met), pa.string()), pa.array([names[s]] * len(met), pa.string()), pa.array(names[s + 1 + met], pa.string()), pa.array(value[met])], schema=PAIRS)


def audit_sources(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the term shares of each source are from those of other sources and of its language.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the V terms that stand in
    at least ``least_docs`` of its documents. A kept term's share in a group is p = 1 + floor(10^9 (n + 2) / (N + 2 V)), n its
    occurrences there and N those of all kept terms; f = floor((p - q)^2 / (p + q)). Part ``pair`` gives for each other source of
    the language the sum of f over all kept terms, part ``term`` the ``top_terms`` terms with p above the language's share.
    Ranks go by value descending, then item in byte order. All arithmetic is on integers.

    Only counts that occur are stored. A sum over all kept terms is split: V f(p0, q0) as if neither had any term; a
    correction for the terms of one source, which needs only how often each count occurs; and one for terms that
    both have, made from blocks of terms, of which a task emits one row per two sources.

    Null text, lang and source are read as ''. A group without terms, or a language without kept terms, still has its
    pairs (value 0 for V = 0). Repeated rows are documents each. Other columns are ignored; an empty table gives no rows.
    """
    by_source = term_counts(docs, text_column, lang_column, source_column)
    kept = saved(by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
                 .filter(F.col("docs") >= least_docs).select("lang", "term", "total", "held"), "terms")
    present = kept.select("lang", "term", "total", F.inline("held"))
    given = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_column, "lang"), (source_column, "source"))]).distinct()
    sizes = present.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    zero = F.lit(0).cast("bigint")
    known = given.join(sizes, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("size", "terms", "all")])
    groups = saved(known.withColumn("p0", _share(zero, F.col("size"), F.col("terms"))), "groups")

    stood = saved(present.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", _share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), _share(F.col("total"), F.col("all"), F.col("terms")).alias("q")), "shares")

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = groups.join(other, "lang").filter("source <> item").select("lang", "source", "item", (F.col("terms") * _apart(F.col("p0"), F.col("q0"))).alias("value"))
    alike = stood.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    single = alike.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(
        F.sum(F.col("times") * (_apart(F.col("p"), F.col("q0")) - _apart(F.col("p0"), F.col("q0")))).alias("value"))
    blocks = stood.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held")).filter(F.size("held") > 1).select("lang", "held")
    common = map_arrow(blocks, _shared_terms, "lang string, source string, item string, value bigint").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    corrections = single.unionByName(common)
    turned = corrections.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(corrections).unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = stood.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    marked = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return ranked.unionByName(marked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
