"""What a query leaves with the driver and on disk while it runs."""

import os
import time

from pyspark.sql import functions as F

from strandwise.llm.fingerprints import in_map, map_of, rows_of
from strandwise.llm.history import FIELDS, repeated_records
from strandwise.session import shared_folder


def test_a_full_map_is_broadcast_in_few_rows(spark):
    keys = spark.range(400_000).select(F.xxhash64("id").alias("k"))
    rows = rows_of(map_of(keys, F.col("k")))
    assert rows.count() <= 2**12 and rows.where(F.size("_bits") != 64).count() == 0
    other = spark.range(300_000, 500_000).select(F.xxhash64("id").alias("k"), "id")
    want = {x >> 40 for x in (r.k % 2**64 for r in keys.collect())}
    got = {r.id for r in in_map(other, F.col("k"), map_of(keys, F.col("k"))).collect()}
    assert got == {r.id for r in other.collect() if r.k % 2**64 >> 40 in want}


def test_steps_of_a_call_are_released(spark):
    texts = [(f"s{i}", f"A study of reading number {i} in {w} schools of the north", None, 2000 + i % 9, None) for i in range(40) for w in ("rural", "urban")]
    old = spark.createDataFrame([(f"{a}{n}", *x) for n, (a, *x) in enumerate(texts)], "id string, title string, authors array<string>, year int, doi string").select("id", *FIELDS)
    new = old.limit(20).withColumn("id", F.concat(F.lit("b"), "id")).withColumn("at", F.timestamp_seconds(F.xxhash64("id") % 1000))
    folder = shared_folder(spark).removeprefix("file:")
    before = len(os.listdir(folder))
    out = repeated_records(old, new, "source")
    end = time.time() + 30
    while len(os.listdir(folder)) > before + 6 and time.time() < end:
        time.sleep(0.5)
    assert len(os.listdir(folder)) <= before + 6 and out.count() > 0
