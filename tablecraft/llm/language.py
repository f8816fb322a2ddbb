"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablecraft.llm.common import BATCH_ROWS, map_arrow

BUCKETS = 1 << 15
ORDERS = (2, 3)
SEEDS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))
#: Characters looked at in one go; a longer text is worked through in such parts.
PART = 1 << 18


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def codes_of(text: str) -> np.ndarray:
    """Lower-case code points; everything but letters is a blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[codes], codes, np.uint32(32))


def subwords(codes: np.ndarray) -> np.ndarray:
    """Buckets of all runs of two and three characters that hold no blank but at an end, and some letter."""
    full, out = codes != 32, []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        hashed = np.full(m, n, np.uint32)
        for place in range(n):
            hashed = (hashed ^ codes[place : m + place]) * SEEDS[place]
            hashed ^= hashed >> np.uint32(15)
        good = full[:m] | full[n - 1 :]
        for place in range(1, n - 1):
            good &= full[place : m + place]
        out.append(hashed[good] % np.uint32(BUCKETS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def bucket_counts(text: str | None) -> np.ndarray:
    """How often each bucket occurs in the whole text, with a blank before and behind it; parts overlap, so none is lost or counted twice."""
    total = np.zeros(BUCKETS, np.int64)
    if text:
        codes = np.concatenate([[np.uint32(32)], codes_of(text), [np.uint32(32)]]).astype(np.uint32)
        for start in range(0, len(codes), PART):
            total += np.bincount(subwords(codes[start : start + PART]), minlength=BUCKETS)
            edge = start + PART
            for n in ORDERS:  # the runs that cross into the next part
                for at in range(max(start, edge - n + 1), min(edge, len(codes) - n + 1)):
                    run = codes[at : at + n]
                    total += np.bincount(_order(run, n), minlength=BUCKETS)
    return total


def _order(run: np.ndarray, n: int) -> np.ndarray:
    found = subwords(run)
    return found[-1:] if len(found) and _counts(run, n) else found[:0]


def _counts(run: np.ndarray, n: int) -> bool:
    full = run != 32
    return bool((full[0] or full[-1]) and full[1 : n - 1].all())


@dataclass
class LanguageModel:
    """``votes`` is embedding times weights, one row of logits for each bucket, so a text's logits are a mean of rows."""

    languages: list[str]
    votes: np.ndarray
    bias: np.ndarray
    heat: float
    least: float

    def score(self, text: str | None) -> tuple[str, float]:
        counts = bucket_counts(text)
        n = counts.sum()
        if not n or not self.languages:
            return "und", 0.0
        logits = (counts @ self.votes / n + self.bias) / self.heat
        chance = np.exp(logits - logits.max())
        chance /= chance.sum()
        best = int(chance.argmax())
        return self.languages[best], float(chance[best])


def _softmax(logits: np.ndarray) -> np.ndarray:
    out = np.exp(logits - logits.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], width: int = 16, passes: int = 12, rate: float = 30.0, group: int = 32, seed: int = 7) -> LanguageModel:
    """Fit embeddings and softmax by stochastic gradient descent on (language, buckets, counts).

    Every fifth sample is held back: on those the temperature is fitted, and the score below which a prediction
    is rejected is set so that at most one in a thousand of the rightly predicted ones falls under it (a half at most).
    """
    languages = sorted({x[0] for x in samples})
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    held, kept = order[::5], np.setdiff1d(order, order[::5])
    kept = kept if len(kept) else order
    table = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    weights, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    number = {x: i for i, x in enumerate(languages)}
    truth = np.array([number[x[0]] for x in samples])

    def dense(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for i, row in enumerate(rows):
            out[i, samples[row][1]] = samples[row][2] / samples[row][2].sum()
        return out

    steps, done = passes * -(-len(kept) // group), 0
    for _ in range(passes):
        shuffled = rng.permutation(kept)
        for at in range(0, len(shuffled), group):
            rows = shuffled[at : at + group]
            inputs, now = dense(rows), rate * (1 - done / steps)
            hidden = inputs @ table
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(rows)), truth[rows]] -= 1
            error /= len(rows)
            back = error @ weights.T
            weights -= now * 0.1 * hidden.T @ error
            bias -= now * 0.01 * error.sum(0)
            used = np.flatnonzero(inputs.any(0))
            table[used] -= now * (inputs[:, used].T @ back)
            done += 1
    held = held if len(held) else kept
    logits = np.concatenate([dense(held[i : i + 64]) @ table @ weights + bias for i in range(0, len(held), 64)])
    heats = np.geomspace(0.25, 4, 33)
    loss = [-np.log(_softmax(logits / h)[np.arange(len(held)), truth[held]] + 1e-12).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    chance = _softmax(logits / heat)
    right = np.sort(chance.max(1)[chance.argmax(1) == truth[held]])
    least = min(0.5, float(right[len(right) // 1000])) if len(right) else 0.0
    return LanguageModel(languages, (table @ weights).astype(np.float64), bias.astype(np.float64), heat, least)


def held_out(id_column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_language_model(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = 800) -> LanguageModel:
    """Fit on a bounded sample: ``per_language`` labelled rows of each language outside the held-out quarter, all where there are fewer.

    The rows with the smallest hashes of id and text are taken, ranked over the whole table, so no language is left out and
    none has more. Rows with a null id, language or text are not learned from. Whole texts are used. Repeated rows count as often as they occur.
    """
    ids, lang, text = (F.col(f"`{x}`") for x in (id_column, lang_column, text_column))
    usable = docs.filter(ids.isNotNull() & lang.isNotNull() & text.isNotNull() & ~held_out(id_column))
    keyed = usable.select(ids.cast("bigint").alias("doc"), lang.cast("string").alias("lang"), text.cast("string").alias("text"), F.xxhash64(ids, text, F.lit(17)).alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    ranked = keyed.select("lang", "h").withColumn("rank", rank).filter(F.col("rank") <= per_language)  # each task sends on so many rows of a language
    cuts = {row["lang"]: row["cut"] for row in ranked.groupBy("lang").agg(F.max("h").alias("cut")).collect()}  # a row per language
    if not cuts:
        return train([])
    cut = F.create_map(*[F.lit(x) for pair in sorted(cuts.items()) for x in pair])
    # copies of the row at the cut may be more than are wanted; they are alike, so any of them will do
    picked = keyed.filter(F.col("h") <= cut[F.col("lang")]).withColumn("rank", rank).filter(F.col("rank") <= per_language)

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [bucket_counts(x.as_py()) for x in batch["text"]]
        where = [np.flatnonzero(x).astype(np.int32) for x in counts]
        often = [x[w].astype(np.int32) for x, w in zip(counts, where)]
        return pa.RecordBatch.from_arrays([batch["doc"], batch["lang"], pa.array(where, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))], ["doc", "lang", "buckets", "counts"])

    rows = map_arrow(picked.select("doc", "lang", "text"), gather, "doc bigint, lang string, buckets array<int>, counts array<int>").toArrow()
    samples = [(doc, lang, np.array(b.values), np.array(c.values)) for doc, lang, b, c in zip(rows["doc"].to_pylist(), rows["lang"].to_pylist(), rows["buckets"], rows["counts"])]
    samples.sort(key=lambda x: (x[0], x[1], len(x[2])))
    return train([x[1:] for x in samples if len(x[2])])


def predict_languages(docs: DataFrame, model: LanguageModel, text_column: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and rejected behind its columns (names get ``prefix``).

    Only the text is looked at, all of it. A null text and one without letters are ``und`` with score 0 and are
    rejected; so is a prediction whose calibrated score is under the model's ``least``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the input's size
    names = [f"{prefix}{x}" for x in ("lang_pred", "score", "rejected")]

    def work(texts: pa.Array) -> pa.Array:
        found = [shared.value.score(x.as_py()) for x in texts]
        names, scores = [x[0] for x in found], [x[1] for x in found]
        rejected = [name == "und" or score < shared.value.least for name, score in found]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    scored = F.arrow_udf(work, "lang_pred string, score double, rejected boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    out = docs.withColumn(f"{prefix}_scored", scored(F.col(f"`{text_column}`").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{prefix}_scored`")[x.removeprefix(prefix)].alias(x) for x in names])


def identify_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected. A null id is not held out."""
    model = fit_language_model(docs, id_column, text_column, lang_column, **options)
    plain = docs.select(F.col(f"`{id_column}`").alias("doc_id"), held_out(id_column).alias("held_out"), F.col(f"`{text_column}`").alias("text"))
    return predict_languages(plain, model).drop("text")
