import numpy as np

from strandwise.operators.vectors import cosine_pairs
from strandwise.plans import registry


def test_cosine_pairs_equal_brute_force(spark):
    x = np.random.default_rng(2).normal(size=(60, 4))
    x[7] = 0
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    n = np.linalg.norm(x, axis=1)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if n[i] * n[j] > 0 and x[i] @ x[j] / (n[i] * n[j]) >= 0.8}
    got = [(r.id_a, r.id_b) for r in cosine_pairs(df, "id", "v", 0.8, 13).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_cosine_components_come_from_embeddings(spark, sf):
    q = registry.queries()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").distinct().count()
    assert q["q_cosine_pairs"](spark, sf).count() >= 0 and q["q_cosine_components"](spark, sf).count() == n
