"""References to records that do not exist.

References and the life events of their parents (loads, deletions) are co-partitioned and sorted by
(key, time), then merged in one linear pass. The range partitioning cuts inside a key, so a key that
holds a third of all rows is spread over as many tasks as its size asks for; a summary of two rows per
partition carries the state of a cut key into the next one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.session import cut, shuffle_partitions

_NEVER = np.iinfo(np.int64).min
_LOAD, _DELETE, _REFERENCE, _LAST_LOAD = 0, 1, 2, -1


def normal_key(col: Column) -> Column:
    """Ids compare without case and outer blanks; a blank id is no id (null)."""
    key = F.lower(F.trim(F.regexp_replace(col, r"^[\s 　]+|[\s 　]+$", "")))
    return F.when(key != "", key)


def list_references(df: DataFrame, owner: str, at: str, fields: Sequence[str]) -> DataFrame:
    """Distinct `(owner, ref_field, ref_key, at)`, one row per usable element of the array columns `fields`.

    Null lists, null elements and blank elements give no row; rows without a time stay and sort before all events.
    """
    pairs = F.array(*[
        F.struct(F.lit(f).alias("ref_field"), F.coalesce(F.col(f), F.array().cast("array<string>")).alias("refs"))
        for f in fields
    ])
    return (
        df.select(F.col(owner).cast("string").alias("owner"), F.col(at).cast("timestamp").alias("at"), F.explode(pairs).alias("p"))
        .select("owner", "at", "p.ref_field", F.explode("p.refs").alias("raw"))
        .select("owner", "ref_field", normal_key(F.col("raw")).alias("ref_key"), "at")
        .where(F.col("ref_key").isNotNull())
        .distinct()
    )


def _fill(keys: np.ndarray, values: np.ndarray, carry_key: str | None, carry: int) -> np.ndarray:
    """Last value that is not `_NEVER` so far within each key; the first key may go on from an earlier batch."""
    n = len(keys)
    start = np.ones(n, dtype=bool)
    start[1:] = keys[1:] != keys[:-1]
    known = values != _NEVER
    at = np.maximum.accumulate(np.where(known | start, np.arange(n), 0))
    filled = values[at]
    if n and carry_key is not None and keys[0] == carry_key and carry != _NEVER:
        end = int(np.argmax(start[1:])) + 1 if start[1:].any() else n
        head = filled[:end]
        head[head == _NEVER] = carry
    return filled


def _merge(carry: dict[int, tuple[str, int, int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: str | None = None
        state = [_NEVER, _NEVER, _NEVER]
        for pdf in batches:
            if pdf.empty:
                continue
            keys, at, what = pdf["k"].to_numpy(), pdf["t"].to_numpy(), pdf["what"].to_numpy()
            if key is None and (c := carry.get(int(pdf["pid"].iloc[0]))):
                key, state = c[0], list(c[1:])
            seen = []
            for i, kind in enumerate((_LAST_LOAD, _LOAD, _DELETE)):
                value = pdf["last"].to_numpy() if kind == _LAST_LOAD else at
                seen.append(_fill(keys, np.where(what == kind, value, _NEVER), key, state[i]))
            key, state = keys[-1], [int(s[-1]) for s in seen]
            final, load, deleted = seen
            absent = (what == _REFERENCE) & ~((load != _NEVER) & (load > deleted))
            if absent.any():
                out = pd.DataFrame({new: pdf[old].to_numpy()[absent] for old, new in (("owner", "owner"), ("ref_field", "ref_field"), ("k", "ref_key"), ("t", "t"))})
                out["kind"] = np.where(final[absent] > at[absent], "late", np.where(deleted[absent] != _NEVER, "deleted", "missing"))
                yield out

    return run


def orphan_references(references: DataFrame, loads: DataFrame, deletions: DataFrame, partitions: int | None = None) -> DataFrame:
    """References whose parent was not there at the time of the reference.

    `references(owner, ref_field, ref_key, at)`, `loads(key, at)` and `deletions(key, at)`, keys already
    normalised. A parent is there at T if its last load at or before T is later than its last deletion at or
    before T. Result `(owner, ref_field, ref_key, at, kind)`: `late` if a load follows T, else `deleted` if a
    deletion lies at or before T, else `missing`. Parent events without key or time, and references without
    key, are left out; a reference without time precedes all events. Repeated rows count once; empty tables give
    no parents or no result. Any other columns are ignored.
    """
    spark = references.sparkSession
    none = F.lit(None).cast("string")

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    held = loads.where("key is not null and at is not null").select("key", micros("at").alias("t"))
    gone = deletions.where("key is not null and at is not null").select("key", micros("at").alias("t"))
    events = (
        held.groupBy("key").agg(F.max("t").alias("last"))
        .select(F.col("key").alias("k"), F.lit(_NEVER).alias("t"), F.lit(_LAST_LOAD).alias("what"), "last", none.alias("owner"), none.alias("ref_field"))
        .unionByName(held.distinct().select(F.col("key").alias("k"), "t", F.lit(_LOAD).alias("what"), F.lit(_NEVER).alias("last"), none.alias("owner"), none.alias("ref_field")))
        .unionByName(gone.distinct().select(F.col("key").alias("k"), "t", F.lit(_DELETE).alias("what"), F.lit(_NEVER).alias("last"), none.alias("owner"), none.alias("ref_field")))
        .unionByName(references.where("ref_key is not null").select(
            F.col("ref_key").alias("k"), F.coalesce(micros("at"), F.lit(_NEVER + 1)).alias("t"), F.lit(_REFERENCE).alias("what"), F.lit(_NEVER).alias("last"), "owner", "ref_field"))
    )
    n = partitions or shuffle_partitions(spark)
    # Written once: the two passes below must see the same cuts.
    merged = cut(
        events.repartitionByRange(n, "k", "t", "what", F.xxhash64("owner", "ref_field"))
        .sortWithinPartitions("k", "t", "what")
        .withColumn("pid", F.spark_partition_id())
    )
    ends = (
        merged.groupBy("pid").agg(F.min("k").alias("first"), F.max("k").alias("final"))
    )
    ends = {r.pid: r for r in ends.collect()}  # one row per partition
    carry: dict[int, tuple[str, int, int, int]] = {}
    if len({r.final for r in ends.values()}) < len(ends) or any(
        ends[p].final == ends[q].first for p, q in zip(sorted(ends), sorted(ends)[1:], strict=False)
    ):
        final = F.create_map(*[x for p, r in ends.items() for x in (F.lit(p), F.lit(r.final))])
        tails = {
            r.pid: r
            for r in merged.where(F.col("k") == final[F.col("pid")]).groupBy("pid").agg(
                F.max(F.when(F.col("what") == _LAST_LOAD, F.col("last"))).alias("last"),
                F.max(F.when(F.col("what") == _LOAD, F.col("t"))).alias("load"),
                F.max(F.when(F.col("what") == _DELETE, F.col("t"))).alias("deleted"),
            ).collect()
        }
        key, state = None, (_NEVER,) * 3
        for p in sorted(ends):
            if key is not None and ends[p].first == key:
                carry[p] = (key, *state)
            own = tuple(_NEVER if v is None else v for v in (tails[p]["last"], tails[p].load, tails[p].deleted))
            state = tuple(max(a, b) for a, b in zip(state, own, strict=True)) if ends[p].final == key else own
            key = ends[p].final
    found = merged.mapInPandas(_merge(carry), "owner string, ref_field string, ref_key string, t long, kind string")
    return found.select("owner", "ref_field", "ref_key", F.when(F.col("t") > _NEVER + 1, F.timestamp_micros("t")).alias("at"), "kind")


def orphan_report(orphans: DataFrame, every: str = "yyyy-MM") -> DataFrame:
    """Counts of orphans by field, period and kind."""
    return orphans.groupBy("ref_field", F.date_format("at", every).alias("period"), "kind").agg(
        F.count("*").alias("n"), F.countDistinct("ref_key").alias("n_keys")
    )
