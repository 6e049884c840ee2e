"""The import of harvested records as one plan: feeds converted to records, valid ones admitted, known ones left out, the rest appended."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import text as T
from strandwise.operators import gates as G
from strandwise.operators import keys as K
from strandwise.operators.fuzzy import keep_new
from strandwise.sources.collections import append_unique

#: What every converted feed has.
COLUMNS = ("id", "title", "authors", "year", "doi", "url", "publisher", "source_type", "abstract")
IDENTITIES = ("doi", "eric_id", "url")


def union_feeds(feeds: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """All feeds one under the other with `feed` and `feed_order`; a feed that can't be read is left out with a row in the log of the driver.

    A feed is a DataFrame or a function that makes one, so a broken source does not end the import of the others.
    """
    out = None
    for n, (name, feed) in enumerate(feeds.items()):
        try:
            df = feed() if callable(feed) else feed
        except Exception as e:  # noqa: BLE001 - whatever a source fails with, the others go on
            print(f"feed {name} left out: {type(e).__name__}")
            continue
        part = df.select(*COLUMNS, *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("eric_id",)], F.lit(name).alias("feed"), F.lit(n).alias("feed_order"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no feed could be read")
    return out


def keyed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The columns by which records are compared: `(id, ord, title, url, identity, title_key, key, year)`."""
    return df.select(
        "id", F.struct(*order).alias("ord"), "title", "url", K.identity_key(list(IDENTITIES)).alias("identity"), K.title_year_key().alias("title_key"), T.normalize_title(F.col("title")).alias("key"), "year",
    )


def new_records(known: DataFrame, harvested: DataFrame, vocabulary: G.Vocabulary | None = None, order: Sequence[str] = ("feed_order", "id"), least: float = 0.3) -> DataFrame:
    """The harvested records to add, in order: valid, admitted by the vocabulary if there is one, and the same as none that is known or kept.

    Records are the same by identity, by title and year, or by a close title within a year. A record that falls out neither
    blocks others nor lends them its keys. Ids must be unique within both tables together.
    """
    h = harvested.where(G.valid_candidate())
    if vocabulary is not None:
        h = G.admit(h, vocabulary, least=least)
    old = keyed(known.withColumns({c: F.lit(None).cast(h.schema[c].dataType) for c in order if c not in known.columns}), order)
    kept = keep_new(old, keyed(h, order)).where("kept").select("id")
    return h.join(kept, "id", "left_semi")


def import_feeds(spark: SparkSession, feeds: Mapping[str, DataFrame | Callable[[], DataFrame]], known: DataFrame, path: str, vocabulary: G.Vocabulary | None = None) -> int:
    """Add what is new in the feeds to the table at `path`; returns how many records. Nothing is written for none."""
    fresh = new_records(known, union_feeds(feeds), vocabulary)
    return append_unique(spark, fresh, path, F.col("id"), ("feed_order",))


def new_statements(known: DataFrame, harvested: DataFrame, order: Sequence[str], statement: str = "statement") -> DataFrame:
    """Claims whose normalised statement is neither known nor that of an earlier one; blank statements are never new."""
    k = T.normalize_title(F.col(statement))
    h = harvested.withColumn("_k", k).where("_k <> ''").join(known.select(k.alias("_k")).distinct(), "_k", "left_anti")
    names = [c for c in harvested.columns]
    return h.groupBy("_k").agg(F.min_by(F.struct(*names), F.struct(*order)).alias("x")).select("x.*")


def repointed(claims: DataFrame, skipped: DataFrame, stored: DataFrame) -> DataFrame:
    """`claims` whose `source_ids` name skipped records, with the ids under which the same works are stored, by title and year.

    `skipped` and `stored` are `(id, title, year)`; ids that have no stored twin stay.
    """
    k = K.title_year_key()
    twin = skipped.select("id", k.alias("_k")).join(stored.groupBy(k.alias("_k")).agg(F.min("id").alias("to")), "_k").select(F.col("id").alias("ref"), "to").distinct()
    refs = claims.select("id", F.posexplode("source_ids").alias("p", "ref")).join(twin, "ref", "left")
    new = refs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("to", "ref").alias("r")))).alias("x")).select("id", F.transform("x", lambda x: x["r"]).alias("_ids"))
    return claims.join(new, "id", "left").withColumn("source_ids", F.coalesce("_ids", "source_ids")).drop("_ids")
