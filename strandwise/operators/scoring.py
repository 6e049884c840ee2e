"""Evidence scores: weights of sources and strengths into claims, claims into skills, skills against their peers.

Weights are parameters. Sums run over integers (weights x 1000), so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.text import half_up

#: Weights by type of source, by legacy strength and by appraised certainty, times 1000.
SOURCE_WEIGHTS = {
    "systematic_review": 1000, "framework": 850, "peer_reviewed_article": 800, "book": 750, "policy_report": 700,
    "conceptual_review": 650, "working_paper": 450, "dataset": 400, "web_resource": 250,
}
STRENGTH_WEIGHTS = {"strong": 1000, "moderate": 700, "low": 350}
CERTAINTY_WEIGHTS = {"strong": 1000, "moderate": 700, "low": 350, "very_low": 150}


def weight_of(col: Column, weights: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), col)


def claim_scores(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """`(claim_id, n_sources, score, problem)`: 0.6 x mean source weight + 0.4 x strength weight, or why there is none.

    `claims(claim_id, source_ids, certainty, strength)`, `sources(source_id, source_type)`, one row per id. A source cited
    twice counts twice. The first problem in order of citation is named; a claim without sources has none to weigh.
    """
    cited = claims.select("claim_id", F.posexplode("source_ids").alias("pos", "source_id"))
    weights = sources.select("source_id", F.lit(True).alias("there"), weight_of(F.col("source_type"), SOURCE_WEIGHTS).alias("w"))
    reason = F.when(F.col("there").isNull(), F.lit("source missing")).when(F.col("w").isNull(), F.lit("source type without weight"))
    per = cited.join(weights, "source_id", "left").groupBy("claim_id").agg(
        F.count("*").alias("n_sources"), F.sum("w").alias("total"),
        F.min(F.when(reason.isNotNull(), F.struct(F.col("pos"), reason.alias("reason")))).alias("bad"),
    )
    strength = F.when(F.col("certainty").isNotNull(), weight_of(F.col("certainty"), CERTAINTY_WEIGHTS)).otherwise(weight_of(F.col("strength"), STRENGTH_WEIGHTS))
    joined = claims.join(per, "claim_id", "left").withColumn("sw", strength)
    problem = (
        F.when(F.col("n_sources").isNull(), F.lit("no sources"))
        .when(F.col("bad").isNotNull(), F.col("bad.reason"))
        .when(F.col("sw").isNull() & F.col("certainty").isNotNull(), F.lit("certainty without weight"))
        .when(F.col("sw").isNull(), F.lit("strength without weight"))
    )
    score = half_up(3 * F.col("total") + 2 * F.col("sw") * F.col("n_sources"), 5 * F.col("n_sources") * F.lit(1000), 3)
    return joined.select("claim_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.when(problem.isNull(), score).alias("score"), problem.alias("problem"))


def skill_scores(links: DataFrame, scores: DataFrame, skills: DataFrame) -> DataFrame:
    """`(skill_id, n_support, n_contra, support_sum, contra_sum, score)` from `links(skill_id, role, claim_id)`.

    Mean support damped by breadth (0.85 + 0.15 x min(n, 6) / 6) less a tenth of the contradictions, within [0, 1], two
    decimals; 0 without support. Claims without score are left out; repeated citations count.
    """
    milli = scores.where("score is not null").select("claim_id", F.round(F.col("score") * 1000).cast("long").alias("s"))
    support, contra = F.col("role") == "support", F.col("role") == "contra"
    parts = links.join(milli, "claim_id").groupBy("skill_id").agg(
        F.count_if(support).alias("n_support"), F.count_if(contra).alias("n_contra"),
        F.sum(F.when(support, F.col("s")).otherwise(0)).alias("support_sum"), F.sum(F.when(contra, F.col("s")).otherwise(0)).alias("contra_sum"),
    )
    zero = F.lit(0).cast("long")
    full = skills.select("skill_id").join(parts, "skill_id", "left").select("skill_id", *[F.coalesce(c, zero).alias(c) for c in ("n_support", "n_contra", "support_sum", "contra_sum")])
    n = F.least("n_support", F.lit(6))
    # common denominator: 1000 (milli) x 40 (breadth) x n
    num = F.col("support_sum") * (34 + n) - 4 * F.col("contra_sum") * F.col("n_support")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), half_up(num, 40000 * F.col("n_support"), 2)))
    return full.withColumn("score", F.when(F.col("n_support") > 0, score).otherwise(0.0))


def peer_context(df: DataFrame, group: str, score: str, least: int = 5) -> DataFrame:
    """Rank (1 + number strictly higher) and median inside each peer group of at least `least`; null in smaller ones.

    Rank and median come from counts per distinct score, so no task holds a whole group. Null scores have no rank and do not
    count for the median.
    """
    levels = df.groupBy(group, score).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy(F.col(score).desc())
    ranks = levels.withColumn("_rank", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).drop("_n")
    up = Window.partitionBy(group).orderBy(score)
    known = levels.where(F.col(score).isNotNull()).withColumn("_upto", F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    known = known.withColumn("_all", F.sum("_n").over(Window.partitionBy(group)))
    # the lower and the upper middle place lie in the first levels that reach them
    middle = lambda place: F.min(F.when(F.col("_upto") >= place, F.col(score)))
    medians = known.groupBy(group).agg(((middle(F.floor((F.col("_all") + 1) / 2)) + middle(F.floor((F.col("_all") + 2) / 2))) / 2).alias("_median"))
    sizes = levels.groupBy(group).agg(F.sum("_n").alias("n_peers")).join(medians, group, "left")
    out = df.join(ranks, [group, score], "left").join(sizes, group, "left")
    big = F.col("n_peers") >= least
    return out.withColumn("peer_rank", F.when(big, F.col("_rank"))).withColumn("peer_median", F.when(big, F.round("_median", 3))).drop("_rank", "_median")
