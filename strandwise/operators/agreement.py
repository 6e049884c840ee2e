"""Agreement between two or more raters, and metrics of labels against predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def rater_pairs(answers: DataFrame) -> DataFrame:
    """`(field, item, a, b, left, right)`: both answers of each item for every pair of raters a < b.

    Pairs grow with the square of the raters of an item, not of the items; `answers` has one row per rater and item.
    """
    x = answers.select("field", "item", F.col("rater").alias("a"), F.col("label").alias("left"))
    y = answers.select("field", "item", F.col("rater").alias("b"), F.col("label").alias("right"))
    return x.join(y, ["field", "item"]).where("a < b")


def cross_tab(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of (left, right) by group; null is an answer of its own."""
    return pairs.groupBy(*by, "left", "right").agg(F.count("*").alias("n"))


def cohen_kappa(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """`(by..., n, agreement, kappa)`; kappa is null where chance agreement is complete."""
    by = list(by)
    cells = cross_tab(pairs, by)
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("left").eqNullSafe(F.col("right")), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(*by, F.col("left").alias("v")).agg(F.sum("n").alias("r"))
    cols = cells.groupBy(*by, F.col("right").alias("w")).agg(F.sum("n").alias("c"))
    left, right = rows.alias("x"), cols.alias("y")
    same = F.col("x.v").eqNullSafe(F.col("y.w"))
    for b in by:
        same = same & (F.col(f"x.{b}") == F.col(f"y.{b}"))
    chance = left.join(right, same).groupBy(*[F.col(f"x.{b}").alias(b) for b in by]).agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    joined = total.join(chance, by, "left").withColumn("rc", F.coalesce("rc", F.lit(0)))
    n, agree = F.col("n"), F.col("same")
    return joined.select(*by, "n", F.round(agree / n, 6).alias("agreement"), F.round(_ratio((n * agree - F.col("rc")).cast("double"), (n * n - F.col("rc")).cast("double")), 6).alias("kappa"))


def weighted_kappa(pairs: DataFrame, by: Sequence[str], scale: Sequence[str]) -> DataFrame:
    """Linearly weighted kappa on an ordinal scale; pairs off the scale are left out and counted."""
    by, span = list(by), max(len(scale) - 1, 1)
    position = F.create_map(*[x for i, v in enumerate(scale) for x in (F.lit(v), F.lit(i))])
    on = pairs.withColumn("i", F.try_element_at(position, F.col("left"))).withColumn("j", F.try_element_at(position, F.col("right")))
    off = on.groupBy(*by).agg(F.count_if(F.col("i").isNull() | F.col("j").isNull()).alias("n_off_scale"))
    on = on.where("i is not null and j is not null")
    seen = on.groupBy(*by).agg(F.count("*").alias("n"), F.sum(span - F.abs(F.col("i") - F.col("j"))).alias("close"))
    rows = on.groupBy(*by, "i").agg(F.count("*").alias("r"))
    cols = on.groupBy(*by, "j").agg(F.count("*").alias("c"))  # at most one row per scale value
    chance = rows.join(cols, by).groupBy(*by).agg(F.sum(F.col("r") * F.col("c") * (span - F.abs(F.col("i") - F.col("j")))).alias("rc"))
    n = F.col("n")
    kappa = _ratio((n * F.col("close") - F.col("rc")).cast("double"), (span * n * n - F.col("rc")).cast("double"))
    return off.join(seen.join(chance, by), by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), "n_off_scale", F.round(kappa, 6).alias("weighted_kappa"))


def fleiss_kappa(answers: DataFrame, raters: int) -> DataFrame:
    """Fleiss' kappa per field over the items with exactly `raters` answers."""
    cells = answers.groupBy("field", "item", "label").agg(F.count("*").alias("c"))
    items = cells.groupBy("field", "item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).where(F.col("m") == raters)
    per = items.groupBy("field").agg(F.count("*").alias("n_items"), F.sum("sq").alias("sq"))
    share = cells.join(items.select("field", "item"), ["field", "item"], "left_semi").groupBy("field", "label").agg(F.sum("c").alias("c")).groupBy("field").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    total = F.col("n_items") * raters
    observed = (F.col("sq") - total) / (total * (raters - 1))
    expected = F.col("cc") / (total * total)
    return per.join(share, "field").select("field", "n_items", F.round(_ratio(observed - expected, 1 - expected), 6).alias("fleiss_kappa"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; null without observations."""
    p = hits / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (centre - half) / (1 + z * z / n)), F.when(n > 0, (centre + half) / (1 + z * z / n))


def confusion(df: DataFrame, truth: Column, said: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, F1; an undefined metric is 0."""
    counts = df.groupBy(*by).agg(
        F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return counts.select(
        *by, "tp", "fp", "fn", "tn", F.round(F.coalesce(_ratio(tp, tp + fp), zero), 6).alias("precision"),
        F.round(F.coalesce(_ratio(tp, tp + fn), zero), 6).alias("recall"), F.round(F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), zero), 6).alias("f1"),
    )


def threshold_sweep(df: DataFrame, score: str, truth: Column, hundredths: Sequence[int]) -> DataFrame:
    """Confusion at each threshold. Rows are counted per distinct score first, so the sweep multiplies scores, not rows."""
    levels = df.groupBy(F.round(F.col(score) * 100).cast("int").alias("s")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    grid = levels.withColumn("t", F.explode(F.array(*[F.lit(int(h)) for h in hundredths])))
    said = F.coalesce(F.col("s") >= F.col("t"), F.lit(False))
    sums = grid.groupBy("t").agg(
        F.sum(F.when(said, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(said, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(said, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(said, 0).otherwise(F.col("neg"))).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("t", "tp", "fp", "fn", "tn", F.round(F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), 6).alias("f1"))
