"""Sentence ranking, term scores and host tiers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.text import normalize_title, phrase_pattern

#: Kind of evidence by kind of source.
EVIDENCE_OF = {
    "framework": "framework_synthesis", "policy_report": "policy_synthesis", "systematic_review": "systematic_review", "conceptual_review": "conceptual_review",
    "peer_reviewed_article": "empirical_study", "working_paper": "empirical_study", "dataset": "empirical_study",
}


def _mask(text: Column, abbreviations: Sequence[str], mark: str) -> Column:
    """Full stops of abbreviations as `mark`, in any case, where no letter stands before; those with one stop in one pass."""
    single = [a for a in abbreviations if a.count(".") == 1 and a.endswith(".")]
    for a in abbreviations:
        if a not in single:
            parts = a.split(".")
            pattern = r"\.".join(f"({re.escape(p)})" for p in parts)
            text = F.regexp_replace(text, f"(?i)(?<![a-zA-Z]){pattern}", mark.join(f"${i + 1}" for i in range(len(parts))))
    names = "|".join(re.escape(a[:-1]) for a in sorted(single, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)(?<![a-zA-Z])({names})\.", f"$1{mark}") if single else text


def masked_sentences(text: Column, abbreviations: Sequence[str]) -> Column:
    """Array of sentences: full stops of the listed abbreviations do not end one; split after `.!?` and white space."""
    masked = _mask(F.coalesce(text, F.lit("")), abbreviations, "\u0001")
    parts = F.transform(F.split(masked, r"(?<=[.!?])\s+"), lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def top_sentences(
    df: DataFrame, key: str, text: str, findings: list[str], methods: list[str], topics: Sequence[Sequence[str]], audience: list[str], abbreviations: Sequence[str], k: int = 3, shortest: int = 40
) -> DataFrame:
    """`(key, rank, pos, sentence, tier, score)`: the best `k` sentences of each text, findings before the rest, methods left out.

    Tier 1 has a finding phrase only, -1 a method phrase only, else 0. Within a tier the score decides (0.3 for each topic named,
    0.7 at most, 0.3 for the audience), then the place. Sentences without a topic or of fewer characters are left out. Sentences
    of one text are ranked inside its row, so no shuffle is needed.
    """
    has = lambda s, phrases: s.rlike(phrase_pattern(list(phrases)))
    squeezed = F.transform(masked_sentences(F.col(text), abbreviations), lambda s, i: F.struct(i.alias("pos"), F.trim(F.regexp_replace(s, r"\s+", " ")).alias("s")))
    padded = F.transform(F.filter(squeezed, lambda x: F.length(x["s"]) >= shortest), lambda x: F.struct(x["pos"].alias("pos"), x["s"].alias("s"), F.concat(F.lit(" "), normalize_title(x["s"]), F.lit(" ")).alias("n")))

    def judged(x: Column) -> Column:
        found, method = has(x["n"], findings), has(x["n"], methods)
        tier = F.when(found & ~method, 1).when(method & ~found, -1).otherwise(0)
        named = sum((has(x["n"], t).cast("int") for t in topics), F.lit(0))
        points = F.least(F.lit(70), named * 30) + F.when(has(x["n"], audience), 30).otherwise(0) if audience else F.least(F.lit(70), named * 30)
        return F.struct((-tier).alias("t"), (-points).alias("p"), x["pos"].alias("pos"), x["s"].alias("sentence"), named.alias("named"))

    best = F.slice(F.array_sort(F.filter(F.transform(padded, judged), lambda x: (x["named"] > 0) & (x["t"] <= 0))), 1, k)
    return df.select(key, F.posexplode(best).alias("rank", "s")).select(
        key, (F.col("rank") + 1).alias("rank"), "s.pos", "s.sentence", (-F.col("s.t")).alias("tier"), (-F.col("s.p") / 100.0).alias("score")
    )


def sentence_claims(top: DataFrame, key: str, kinds: DataFrame) -> DataFrame:
    """Candidate claims of the best sentences: id from the source and the place, anchor, kind of evidence by the kind of source.

    `kinds(key, source_type)`; source types without a kind of their own are taken for empirical studies.
    """
    evidence = F.element_at(F.create_map(*[F.lit(x) for pair in EVIDENCE_OF.items() for x in pair]), F.coalesce("source_type", F.lit("")))
    c = top.join(kinds, key, "left")
    return c.select(
        F.concat(F.lit("claim-"), F.regexp_replace(key, "^src-", ""), F.lit("-"), (F.col("pos") + 1).cast("string")).alias("id"), F.col("sentence").alias("statement"), F.array(key).alias("source_ids"),
        F.format_string("abstract, sentence %d", F.col("pos") + 1).alias("text_anchor"), F.coalesce(evidence, F.lit("empirical_study")).alias("evidence_type"), F.lit("low").alias("evidence_strength"), F.lit("candidate").alias("status"),
    )


def host_tiers(df: DataFrame, host: str, tiers: DataFrame) -> DataFrame:
    """`df` with `tier`: the first tier in order whose domain is the host or a parent of it, else `open`.

    `tiers(tier, tier_order, domain)`. Hosts are joined by their suffixes, an equi-join; distinct hosts are looked up once.
    """
    hosts = df.select(F.col(host).alias("_h")).where(F.col(host) != "").distinct()
    parts = F.split("_h", r"\.")
    suffixes = hosts.select("_h", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("domain"))
    found = suffixes.join(tiers, "domain").groupBy("_h").agg(F.min_by("tier", "tier_order").alias("tier"))
    return df.join(found, F.col(host) == F.col("_h"), "left").drop("_h").withColumn("tier", F.coalesce("tier", F.lit("open")))


def term_statistics(tokens: DataFrame) -> DataFrame:
    """`(term, df, idf)` over `tokens(doc, term)`: smooth idf ln((1 + n) / (1 + df)) + 1."""
    n = tokens.select("doc").distinct().agg(F.count("*").alias("n_docs"))
    df = tokens.distinct().groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def linear_scores(tokens: DataFrame, model: DataFrame, intercept: float) -> DataFrame:
    """`(doc, score)`: logistic score of L2-normalised TF-IDF vectors under `model(term, idf, weight)`; unknown terms drop out."""
    tf = tokens.groupBy("doc", "term").agg(F.count("*").alias("tf")).join(model, "term").withColumn("x", F.col("tf") * F.col("idf"))
    sums = tf.groupBy("doc").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    docs = tokens.select("doc").distinct()
    z = F.coalesce(F.col("dot") / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0)) + intercept
    return docs.join(sums, "doc", "left").select("doc", (1 / (1 + F.exp(-z))).alias("score"))


def stratified_folds(df: DataFrame, key: str, label: str, folds: int, seed: str = "") -> DataFrame:
    """`df` with `fold`: keys of each class dealt out in order of a salted hash.

    The hash order is cut into ranges first, so no task holds a class: ranks are counts of earlier ranges plus the place inside.
    """
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    marked = df.withColumn("_h", h).withColumn("_bin", F.substring(h, 1, 3))
    bins = marked.groupBy(label, "_bin").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label).orderBy("_bin")
    before = bins.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_h", key)) - 1
    return marked.withColumn("_in", inside).join(before, [label, "_bin"]).withColumn("fold", ((F.col("_before") + F.col("_in")) % folds).cast("int")).drop("_h", "_bin", "_in", "_before")
