"""Mutual information of continuous features and a class, from distances to the k-th neighbour.

The estimator compares, around every point, how near its k-th neighbour of the same class is with how many points of
all classes are nearer than that. Both are questions about sorted columns: neighbours are a few rows away in the
order within the class, and a count inside an interval is a difference of two running counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.columns import col
from tablecraft.functions.ordering import ROWS_PER_BUCKET, over_sorted, running_sums
from tablecraft.session import freeze, small_frame

NEIGHBOURS = 3
#: Distances that differ by no more than this share of the values, some four units in the last place, are equal.
ROUNDING = 1e-15


def digamma(n: Column) -> Column:
    """Digamma of a whole number from 1 up; the series is taken at n + 6, where what is left out is below 2e-12."""
    z = (n + 6).cast("double")
    w = 1 / (z * z)
    series = F.log(z) - 0.5 / z - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return series - sum((1 / (n + i).cast("double") for i in range(6)), F.lit(0.0))


def _neighbourhoods(cells: DataFrame, k: int, rows_per_bucket: int) -> DataFrame:
    """(idx, x, n, of_class, k, lo, hi, tied) of each cell: the open interval that reaches to its k-th neighbour.

    ``cells`` has one row (idx, y, x, n, of_class) per distinct value of a class. The row ``k`` places behind a cell
    sees the cell and its ``k`` neighbours on either side by looking back only; ``k`` empty rows end each class.
    """
    pads = cells.select("idx", "y", "of_class").distinct().select(
        "idx", "y", F.lit(None).cast("double").alias("x"), F.lit(0).cast("bigint").alias("n"), "of_class",
        F.explode(F.sequence(F.lit(1), F.lit(k))).alias("pad"))
    frame = cells.withColumn("pad", F.lit(0)).unionByName(pads)

    def build(window) -> list[Column]:
        def at(name: str, back: int) -> Column:
            return F.lag(name, back).over(window) if back else F.col(name)

        columns = [at("x", k).alias("cx"), at("n", k).alias("cn")]
        for j in range(1, k + 1):
            columns += [at("x", k + j).alias(f"lx{j}"), at("n", k + j).alias(f"ln{j}"), at("x", k - j).alias(f"rx{j}"), at("n", k - j).alias(f"rn{j}")]
        return columns

    seen = over_sorted(frame, ["x", "pad"], build, 2 * k, ["idx", "y"], rows_per_bucket).filter("cx IS NOT NULL")
    x, n = F.col("cx"), F.col("cn")
    wanted = F.least(F.lit(k).cast("bigint"), F.col("of_class") - 1)
    around = [F.struct(F.abs(x - F.col(f"{side}x{j}")).alias("d"), F.col(f"{side}n{j}").alias("n")) for side in "lr" for j in range(1, k + 1)]
    near = F.sort_array(F.filter(F.array(*around), lambda e: e["d"].isNotNull()))
    start = F.struct((n - 1).alias("met"), F.lit(0.0).alias("r"))
    reached = F.aggregate("near", start, lambda got, e: F.when(got["met"] >= F.col("wanted"), got).otherwise(F.struct((got["met"] + e["n"]).alias("met"), e["d"].alias("r"))))

    measured = seen.select("idx", "cx", "cn", "of_class", wanted.alias("wanted"), near.alias("near")).withColumn("r", reached["r"])
    tied = F.col("r") == 0
    reach = F.col("r") - (F.abs(x) + F.col("r")) * ROUNDING
    return measured.select(
        "idx", "cx", "cn", "of_class", tied.alias("tied"), F.when(tied, n).otherwise(F.col("wanted")).alias("k"),
        F.when(tied, x).otherwise(x - reach).alias("lo"), F.when(tied, x).otherwise(x + reach).alias("hi"))


def neighbour_information(df: DataFrame, features: Sequence[str], target: str, k: int = NEIGHBOURS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(feature, mi) of each numeric feature and the classes of ``target``, in nats, 0 at least.

    For a point, k is the rank of the neighbour asked for within its class (at most the class's other rows) and m the number
    of points of any class, itself included, strictly nearer than that neighbour (up to rounding); mi is
    digamma(N) + mean digamma(k) - mean digamma(rows of the class) - mean digamma(m). Where k or more others of the class have the very same
    value the distance is 0; then k and m are the rows of the class and of all classes with this value, which is the counting
    estimate. So features with few values need no random noise and the result is repeatable.

    Equal values of a class are one cell, so copies cost nothing. All features go through the same few shuffles, whatever
    their number; a dominant class is cut into buckets along the order. Rows with a null or NaN target are left out, of a
    feature also nulls, NaN and infinite values; classes of one row are left out. A feature with nothing left has 0.
    """
    if not features:
        raise ValueError("no numeric features to choose from")
    numbers = F.array(*[F.struct(F.lit(i).alias("idx"), col(c).cast("double").alias("x")) for i, c in enumerate(features)])
    long = df.dropna(subset=[target]).select(col(target).cast("string").alias("y"), F.inline(numbers)).filter(F.abs("x") < float("inf"))
    counted = freeze(long.groupBy("idx", "y", "x").agg(F.count(F.lit(1)).alias("n")))
    sizes = counted.groupBy("idx", "y").agg(F.sum("n").alias("of_class")).filter("of_class > 1")
    cells = freeze(counted.join(sizes, ["idx", "y"]).select("idx", "y", "x", "n", "of_class"))

    spans = freeze(_neighbourhoods(cells, k, rows_per_bucket))
    none = F.lit(0).cast("bigint").alias("w")
    places = cells.select("idx", F.col("x").alias("p"), F.col("n").alias("w")).unionByName(
        spans.filter("NOT tied").select("idx", F.explode(F.array("lo", "hi")).alias("p"), none)).groupBy("idx", "p").agg(F.sum("w").alias("w"))
    ranked = running_sums(places, "p", ["w"], ("idx",), rows_per_bucket=rows_per_bucket)
    ranked = freeze(ranked.select("idx", "p", F.col("upto_w").alias("upto"), (F.col("upto_w") - F.col("w")).alias("below")))

    low = ranked.select("idx", F.col("p").alias("lo"), F.col("upto").alias("lo_upto"), F.col("below").alias("lo_below"))
    high = ranked.select("idx", F.col("p").alias("hi"), F.col("upto").alias("hi_upto"), F.col("below").alias("hi_below"))
    inside = F.when(F.col("tied"), F.col("hi_upto") - F.col("lo_below")).otherwise(F.col("hi_below") - F.col("lo_upto"))
    points = spans.join(low, ["idx", "lo"]).join(high, ["idx", "hi"]).select("idx", "cn", (digamma(F.col("k")) - digamma(F.col("of_class")) - digamma(inside)).alias("part"))
    sums = points.groupBy("idx").agg(F.sum("cn").alias("rows"), F.sum(F.col("cn") * F.col("part")).alias("s"))
    found = sums.select("idx", F.greatest(digamma(F.col("rows")) + F.col("s") / F.col("rows"), F.lit(0.0)).alias("mi"))
    names = small_frame(df.sparkSession, list(enumerate(features)), "idx int, feature string")
    return names.join(found, "idx", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"))
