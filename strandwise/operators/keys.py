"""Identity keys, exact duplicates, first-wins selection and snapshot merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.text import normalize_title


def identity_key(fields: Sequence[str], title: str = "title", normalized: str | None = None) -> Column:
    """First field that is present, as `field:value` in lower case, else the normalised title (a column of it, if there is one)."""
    key = F.col(normalized) if normalized else normalize_title(F.col(title))
    return F.coalesce(
        *[F.when(F.col(f).isNotNull() & (F.col(f) != ""), F.concat(F.lit(f"{f}:"), F.lower(F.col(f)))) for f in fields],
        F.concat(F.lit("title:"), F.coalesce(key, F.lit(""))),
    )


def title_year_key(title: str = "title", year: str = "year", normalized: str | None = None) -> Column:
    key = F.col(normalized) if normalized else normalize_title(F.col(title))
    return F.concat(F.coalesce(key, F.lit("")), F.lit("::"), F.coalesce(F.col(year).cast("string"), F.lit("None")))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by `order`; map-side combined, so a hot key needs no window task."""
    names = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_first"))
    return best.select(*keys, "_first.*")


def duplicate_groups(df: DataFrame, key: Column, member: str) -> DataFrame:
    """`(key, n, first_member)` for keys held by two or more distinct members."""
    return (
        df.select(key.alias("key"), F.col(member).alias("m")).distinct().groupBy("key")
        .agg(F.count("*").alias("n"), F.min("m").alias("first_member")).where("n > 1")
    )


def merge_snapshots(base: DataFrame, branch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of `base`, and the branch rows that share no value of any key column with it. Null keys match nothing."""
    added = branch
    for k in keys:
        added = added.join(base.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return base.withColumn("origin", F.lit("base")).unionByName(added.select(*base.columns).withColumn("origin", F.lit("branch")))


def unique_ids(df: DataFrame, base: str, order: Sequence[str]) -> DataFrame:
    """`unique_id`: the base id for its first row, then `-2`, `-3` ... in order, counting on past ids that rows carry literally.

    The taken numbers of a base come from a join, so only bases with several rows are looked at.
    """
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    numbered = df.withColumn("_n", n)
    literal = df.select(F.regexp_extract(base, r"^(.*)-([1-9]\d{0,8})$", 1).alias("_b"), F.regexp_extract(base, r"^(.*)-([1-9]\d{0,8})$", 2).try_cast("int").alias("_t")).where("_t >= 2").distinct()
    several = numbered.where("_n = 2").select(F.col(base).alias("_b"))
    taken = literal.join(several, "_b", "left_semi").groupBy("_b").agg(F.array_sort(F.collect_list("_t")).alias("_taken"))
    # of sorted taken numbers each one not above the present number moves it on
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_n"), lambda k, t: F.when(t <= k, k + 1).otherwise(k))
    out = numbered.join(taken, F.col(base) == F.col("_b"), "left")
    return out.withColumn("unique_id", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("-", base, free.cast("string")))).drop("_n", "_b", "_taken")
