import datetime as dt
import random

import pytest

from strandwise.operators.references import list_references, orphan_references, orphan_report

DAY = dt.datetime(2026, 1, 1)


def at(n):
    return DAY + dt.timedelta(days=n)


def frames(spark, refs, loads, gone):
    return (
        spark.createDataFrame(refs, "owner string, ref_field string, ref_key string, at timestamp"),
        spark.createDataFrame(loads, "key string, at timestamp"),
        spark.createDataFrame(gone, "key string, at timestamp"),
    )


def brute(refs, loads, gone):
    out = set()
    for o, f, k, t in set(refs):
        if k is None:
            continue
        here = [x for key, x in loads if key == k and x is not None and t is not None and x <= t]
        dead = [x for key, x in gone if key == k and x is not None and t is not None and x <= t]
        if here and (not dead or max(here) > max(dead)):
            continue
        later = any(key == k and x is not None and (t is None or x > t) for key, x in loads)
        out.add((o, f, k, t, "late" if later else "deleted" if dead else "missing"))
    return out


def run(spark, refs, loads, gone, partitions=None):
    return {tuple(r) for r in orphan_references(*frames(spark, refs, loads, gone), partitions).collect()}


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_against_brute_force_with_a_hot_key(spark, partitions):
    rnd = random.Random(partitions)
    keys = ["hot"] * 12 + [f"k{i}" for i in range(12)]
    refs = [(f"o{i}", "f", rnd.choice(keys), at(rnd.randrange(30))) for i in range(600)]
    loads = [(rnd.choice(keys), at(rnd.randrange(30))) for _ in range(20)]
    gone = [(rnd.choice(keys), at(rnd.randrange(30))) for _ in range(20)]
    assert run(spark, refs, loads, gone, partitions) == brute(refs, loads, gone)


def test_same_moment_counts_as_deleted(spark):
    assert run(spark, [("o", "f", "a", at(5))], [("a", at(3))], [("a", at(3))]) == {("o", "f", "a", at(5), "deleted")}


def test_nulls_repeats_and_missing_times(spark):
    refs = [("o", "f", "a", None), ("o", "f", None, at(1)), ("o", "f", "b", at(1)), ("o", "f", "b", at(1))]
    loads = [("a", at(1)), (None, at(1)), ("b", None)]
    assert run(spark, refs, loads, []) == {("o", "f", "a", None, "late"), ("o", "f", "b", at(1), "missing")}


def test_empty_tables(spark):
    assert run(spark, [], [], []) == set()
    assert run(spark, [("o", "f", "a", at(1))], [], []) == {("o", "f", "a", at(1), "missing")}


def test_list_references_cleans_ids_and_ignores_clashing_columns(spark):
    df = spark.createDataFrame([("s", at(1), [" A ", None, "", "a"], None, "x")], "id string, loaded_at timestamp, up array<string>, down array<string>, ref_key string")
    refs = list_references(df, "id", "loaded_at", ["up", "down"])
    assert [tuple(r) for r in refs.collect()] == [("s", "up", "a", at(1))]


def test_report_counts_keys(spark):
    refs = [("o1", "f", "a", at(1)), ("o2", "f", "a", at(2)), ("o1", "f", "b", at(1))]
    r = orphan_report(orphan_references(*frames(spark, refs, [], []))).collect()
    assert [(x.ref_field, x.period, x.kind, x.n, x.n_keys) for x in r] == [("f", "2026-01", "missing", 3, 2)]
