import hashlib
import random

from pyspark.sql import functions as F

from strandwise.functions import text as T
from strandwise.operators import agreement as A
from strandwise.operators import keys as K
from strandwise.operators import vectors as V
from strandwise.operators.scoring import claim_scores, peer_context, skill_scores


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_normalize_title(spark):
    assert one(spark, "  Schülerinnen & Straße: ÉTUDE – ﬁn² ", T.normalize_title).startswith("schulerinnen strasse etude")
    assert one(spark, None, T.normalize_title) is None
    assert one(spark, "—", T.normalize_title) == ""


def test_slug_and_host(spark):
    assert one(spark, None, T.slug) == "record"
    assert one(spark, "a" * 100, T.slug) == "a" * 72
    assert one(spark, "https://u@WWW.Example.org:80/p?q", T.host) == "example.org"
    assert one(spark, None, T.host) == ""


def test_age_band(spark):
    assert tuple(one(spark, "6-12", T.age_band)) == (6, 12)
    assert one(spark, "12-6", T.age_band) is None and one(spark, "adult", T.age_band) is None


def test_claim_and_skill_scores(spark):
    sources = spark.createDataFrame([("s1", "systematic_review"), ("s2", "web_resource"), ("s3", "odd")], "source_id string, source_type string")
    claims = spark.createDataFrame(
        [("c1", ["s1", "s2", "s2"], None, "strong"), ("c2", ["s1", "gone", "s3"], None, "strong"), ("c3", [], None, "low"), ("c4", None, None, "low"), ("c5", ["s1"], "unverifiable", "strong"), ("c6", ["s1"], "very_low", "strong")],
        "claim_id string, source_ids array<string>, certainty string, strength string")
    scores = claim_scores(claims, sources)
    got = {r.claim_id: (r.score, r.problem) for r in scores.collect()}
    assert got["c1"] == (0.7, None) and got["c6"] == (0.66, None)
    assert got["c2"] == (None, "source missing") and got["c3"] == got["c4"] == (None, "no sources") and got["c5"][1] == "certainty without weight"
    ten = [0.895, 0.76, 0.82, 0.7, 0.7, 0.835, 0.76, 0.76, 0.76, 0.76]
    fixed = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(ten)], "claim_id string, score double")
    links = spark.createDataFrame([("k", "support", f"t{i}") for i in range(10)] + [("k", "support", "unknown")], "skill_id string, role string, claim_id string")
    skills = spark.createDataFrame([("k",), ("none",)], "skill_id string")
    s = {r.skill_id: r.score for r in skill_scores(links, fixed, skills).collect()}
    assert s == {"k": 0.78, "none": 0.0}


def test_peer_context_small_groups_have_no_rank(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 5, 3, 1, 2)] + [("b", 1.0)], "g string, s double")
    r = {(x.g, x.s): (x.peer_rank, x.peer_median) for x in peer_context(df, "g", "s").collect()}
    assert r["a", 5.0] == (1, 3.0) and r["a", 3.0] == (3, 3.0) and r["b", 1.0] == (None, None)


def test_first_wins_and_merge(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 1, "n")], "k string, o int, v string")
    assert {(r.k, r.v) for r in K.first_wins(df, ["k"], ["o", "v"]).collect()} == {("k", "a"), (None, "n")}
    base, branch = spark.createDataFrame([("x", None)], "k string, z string"), spark.createDataFrame([("x", "1"), (None, "2"), ("y", "3")], "k string, z string")
    assert {(r.k, r.z, r.origin) for r in K.merge_snapshots(base, branch, ["k"]).collect()} == {("x", None, "base"), (None, "2", "branch"), ("y", "3", "branch")}


def test_unique_ids_are_unique(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("x-2", 3), ("x", 4)], "b string, o int")
    ids = [r.unique_id for r in K.unique_ids(df, "b", ["o"]).collect()]
    assert len(set(ids)) == 4 and "x" in ids and "x-2" in ids


def test_kappa_where_chance_is_complete(spark):
    p = spark.createDataFrame([("f", 1, "a", "b", "x", "x")] * 3, "field string, item int, a string, b string, left string, right string")
    r = A.cohen_kappa(p, ["field"]).first()
    assert r.agreement == 1.0 and r.kappa is None


def test_components_on_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.component for r in V.components(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(i,) for i in (*range(61), *range(100, 130), 999)], "node int")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 130)) and got[999] == 999


def test_components_random(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in V.components(spark.createDataFrame(edges, "a int, b int"), spark.createDataFrame([(i,) for i in range(80)], "node int")).collect()}
    assert got == {i: find(i) for i in range(80)}


def test_hashed_counts(spark):
    df = spark.createDataFrame([("d", ["alpha", "beta", "alpha"])], "id string, t array<string>")
    want = {}
    for t in ["alpha", "beta", "alpha"]:
        h = hashlib.sha1(t.encode()).digest()
        k = int.from_bytes(h[:4], "big") % 256
        want[k] = want.get(k, 0) + (1 if h[4] % 2 == 0 else -1)
    assert {r.bucket: r.value for r in V.hashed_counts(df, "id", F.col("t")).collect()} == {k: v for k, v in want.items() if v}
