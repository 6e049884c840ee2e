"""Vector operators: cosine, centroids, nearest centroid, hashed embeddings, components at a cosine cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.session import cut

#: Largest number of centroids (vectors x dimensions) sent to every task by `nearest_centroid`.
SENT_VALUES = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """`(group, dim, value)` of the unit mean vector of each group, by partial sums per dimension."""
    mean = df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, group).select(group, "dim", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(0.0).alias("value"))


def nearest_centroid(df: DataFrame, key: str, vector: str, centres: DataFrame, group: str) -> DataFrame:
    """`(key, nearest, similarity)`: the centroid of greatest cosine, the smallest group on ties.

    The centroids must fit `SENT_VALUES`; this is checked before they are sent to the tasks.
    """
    rows = centres.limit(SENT_VALUES + 1).toPandas()
    if len(rows) > SENT_VALUES:
        raise ValueError("too many centroids to send")
    wide = rows.pivot(index=group, columns="dim", values="value").sort_index().fillna(0.0)
    names, matrix = wide.index.to_numpy(), wide.to_numpy(dtype=float)
    kinds = dict(df.dtypes)[key], dict(centres.dtypes)[group]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = pdf[pdf["v"].notna()]
            if ok.empty or not len(names):
                continue
            x = np.array(ok["v"].tolist(), dtype=float)
            norm = np.linalg.norm(x, axis=1)
            sims = np.round(x @ matrix.T / np.where(norm > 0, norm, 1)[:, None], 9)
            best = sims.argmax(1)
            yield pd.DataFrame({"k": ok["k"], "nearest": names[best], "similarity": sims[np.arange(len(best)), best]})

    return df.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, f"k {kinds[0]}, nearest {kinds[1]}, similarity double").withColumnRenamed("k", key)


def hashed_counts(df: DataFrame, key: str, tokens: Column, size: int = 256) -> DataFrame:
    """`(key, bucket, value)` of the feature-hashed token vector before normalisation: SHA-1 gives bucket and sign."""
    h = F.sha1(F.col("t"))
    bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % size).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return df.select(key, F.explode(tokens).alias("t")).groupBy(key, "t").agg(F.count("*").alias("n")).select(key, bucket.alias("bucket"), (sign * F.col("n")).alias("v")).groupBy(key, "bucket").agg(F.sum("v").alias("value")).where("value <> 0")


def hashed_embedding(df: DataFrame, key: str, tokens: Column, size: int = 256) -> DataFrame:
    """`(key, bucket, value)`: the same vectors at unit length, zeros left out; a text without tokens has no row."""
    v = hashed_counts(df, key, tokens, size)
    norm = v.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    return v.join(norm, key).select(key, "bucket", (F.col("value") / F.col("_norm")).alias("value"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`(node, component)`: connected components, named by their smallest node.

    Alternates large-star and small-star steps, which take a logarithmic number of rounds on long chains too; edges stay in
    the cluster and every round is cut in the shared folder. `edges(a, b)` in any direction, `nodes(node)`.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = cut(small)
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if last == (state.n, state.h):
            break
        last = (state.n, state.h)
    top = e.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.select("node").distinct().join(top, F.col("node") == F.col("a"), "left").select("node", F.coalesce("component", "node").alias("component"))


def cosine_pairs(df: DataFrame, key: str, vector: str, least: float, block: int = 2_000) -> DataFrame:
    """`(id_a, id_b, similarity)`, id_a < id_b, of all vectors at a cosine of `least` or more, for unique keys; null vectors and norms of 0 pair with nothing.

    Exact: every pair of blocks of about `block` vectors is one group, so a task holds two blocks and the cost is that of all pairs.
    """
    kind = dict(df.dtypes)[key]
    rows = cut(df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")))
    blocks = -(-rows.count() // block) or 1
    own = rows.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def run(at, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), dtype=float)
        norm = np.linalg.norm(x, axis=1)
        x = x / np.where(norm > 0, norm, 1)[:, None]
        k, left, right = pdf["k"].to_numpy(), np.flatnonzero((pdf["own"] == at[0]).to_numpy()), np.flatnonzero((pdf["own"] == at[1]).to_numpy())
        sims = np.round(x[left] @ x[right].T, 9)
        a, b = np.nonzero((sims >= least) & (norm[left] > 0)[:, None] & (norm[right] > 0)[None, :])
        p, q = k[left[a]], k[right[b]]
        use = p < q if at[0] == at[1] else p != q
        p, q = p[use], q[use]
        return pd.DataFrame({"id_a": np.where(p < q, p, q), "id_b": np.where(p < q, q, p), "similarity": sims[a, b][use]})

    return sent.groupBy("i", "j").applyInPandas(run, f"id_a {kind}, id_b {kind}, similarity double")
