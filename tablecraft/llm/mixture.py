"""Mixing sources to target weights: budgets down a tree of domain, language and source, then token prefixes of seeded epochs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = ("domain", "lang", "source")
#: Leaves that the plan may have; it is a table of names, not of documents.
MOST_LEAVES = 1_000_000
#: Buckets of a leaf's seeded order: hexadecimal digits of the order key.
BUCKET_DIGITS = 4


@dataclass
class Targets:
    """Relative weights by name for each level (others get ``default``), the token budget (None: the tokens there
    are, times ``share``), how often a document may be used, and the seed of the order."""

    domain: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    source: dict[str, float] = field(default_factory=dict)
    default: float = 1.0
    budget: int | None = None
    share: float = 1.0
    epochs: int = 2
    seed: int = 1


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def pour(budget: float, cells: list[tuple[float, float]]) -> list[float]:
    """Divide a budget over (weight, capacity): in proportion to the weights, what a cell cannot take going to its siblings."""
    got, open_cells = [0.0] * len(cells), [i for i, (w, c) in enumerate(cells) if w > 0 and c > 0]
    while open_cells:
        level = budget / sum(cells[i][0] for i in open_cells)
        full = [i for i in open_cells if cells[i][1] <= cells[i][0] * level]
        if not full:
            for i in open_cells:
                got[i] = cells[i][0] * level
            break
        for i in full:
            got[i] = cells[i][1]
            budget -= cells[i][1]
        open_cells = [i for i in open_cells if i not in set(full)]
    return got


def plan_budgets(leaves: list[tuple[tuple[str, ...], int]], targets: Targets) -> dict[tuple[str, ...], int]:
    """Tokens that each leaf gives. A branch's capacity is what lies below it times the epochs, so a shortage is
    made up among siblings as long as they can, and only then by the siblings of an ancestor."""
    weights = (targets.domain, targets.lang, targets.source)
    tree: dict[tuple[str, ...], dict[tuple[str, ...], int]] = {}
    for path, tokens in leaves:
        for depth in range(len(path)):
            children = tree.setdefault(path[:depth], {})
            children[path[: depth + 1]] = children.get(path[: depth + 1], 0) + tokens * targets.epochs
    out: dict[tuple[str, ...], int] = {}

    def share(node: tuple[str, ...], budget: float) -> None:
        if node not in tree:
            out[node] = int(budget + 1e-6)
            return
        children = sorted(tree[node].items())
        cells = [(weights[len(node)].get(path[-1], targets.default), room) for path, room in children]
        for (path, _), part in zip(children, pour(budget, cells)):
            share(path, part)

    total = sum(n for _, n in leaves)
    share((), targets.budget if targets.budget is not None else int(total * targets.share))
    return out


def mix_sources(docs: DataFrame, targets: Targets, domain: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source", tokens: Column | None = None) -> DataFrame:
    """The rows chosen, with their columns and ``mix_domain, mix_lang, mix_source, mix_tokens, mix_epoch``; a row used in several epochs is there once for each.

    A leaf with budget b and t tokens gives b div t whole epochs, then of the next epoch the longest prefix, in
    an order seeded by the epoch, whose tokens fit into b mod t. The prefix is found by sums of buckets of the
    order; only rows of the one bucket at the cut are ordered, so a leaf with a third of all rows is no hot task.

    Null names are a name of their own, ``(none)``. Documents without tokens cost nothing: those before the cut
    are taken. A leaf whose budget is 0 gives no rows. Rows with a null id take their place by a hash of the text; ties in the
    order go by id, then by that hash; repeated rows are separate rows. An empty table gives an empty one. Columns of the input keep their names; names starting with ``mix_`` are refused.
    """
    if clash := [c for c in docs.columns if c.startswith("mix_")]:
        raise ValueError(f"columns named mix_: {clash}")
    spark, own = docs.sparkSession, [F.col(f"`{c}`") for c in docs.columns]
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    leaf = [name(domain).alias("mix_domain"), name(F.col(f"`{lang_column}`")).alias("mix_lang"), name(F.col(f"`{source_column}`")).alias("mix_source")]
    sized = docs.select(*own, *leaf, (word_count(F.col(f"`{text_column}`").cast("string")) if tokens is None else tokens.cast("bigint")).alias("mix_tokens"))
    keys = ["mix_domain", "mix_lang", "mix_source"]
    sums = sized.groupBy(*keys).agg(F.sum("mix_tokens").alias("t")).limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError("too many leaves; merge sources")
    held = {tuple(row[:3]): row["t"] for row in sums}
    budgets = plan_budgets(list(held.items()), targets)
    rows = [(*path, min(b // held[path], targets.epochs) if held[path] else 0, b % held[path] if held[path] and b < held[path] * targets.epochs else 0) for path, b in budgets.items() if b > 0 and held[path]]
    plan = spark.createDataFrame(rows, "mix_domain string, mix_lang string, mix_source string, mix_full bigint, mix_rest bigint")
    plan = F.broadcast(plan) if len(rows) <= 100_000 else plan
    told_apart = F.xxhash64(F.col(f"`{text_column}`").cast("string"))
    place = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.concat(F.lit("none:"), told_apart.cast("string")))
    order = F.md5(F.concat_ws(":", F.lit(targets.seed), F.col("mix_full"), place).cast("binary"))
    ordered = sized.join(plan, keys).withColumn("mix_order", order).withColumn("mix_bucket", F.substring("mix_order", 1, BUCKET_DIGITS))

    per = ordered.filter("mix_rest > 0").groupBy(*keys, "mix_rest", "mix_bucket").agg(F.sum("mix_tokens").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = per.withColumn("upto", F.sum("n").over(upto)).filter("upto > mix_rest").groupBy(*keys).agg(F.min(F.struct("mix_bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    cuts = cuts.select(*keys, F.col("cut.mix_bucket").alias("mix_cut"), F.col("cut.before").alias("mix_before"))
    marked = ordered.join(F.broadcast(cuts) if len(rows) <= 100_000 else cuts, keys, "left")

    extra = ["mix_domain", "mix_lang", "mix_source", "mix_tokens"]
    repeated = marked.filter("mix_full > 0").select(*own, *extra, F.explode(F.sequence(F.lit(0), F.col("mix_full").cast("int") - 1)).alias("mix_epoch"))
    last = F.col("mix_full").cast("int").alias("mix_epoch")
    whole = marked.filter("mix_rest > 0 AND (mix_cut IS NULL OR mix_bucket < mix_cut)").select(*own, *extra, last)
    so_far = F.sum("mix_tokens").over(Window.partitionBy(*keys).orderBy("mix_order", F.col(f"`{id_column}`"), told_apart).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = marked.filter("mix_rest > 0 AND mix_bucket = mix_cut").withColumn("mix_upto", so_far).filter("mix_before + mix_upto <= mix_rest").select(*own, *extra, last)
    return repeated.unionByName(whole).unionByName(edge)
