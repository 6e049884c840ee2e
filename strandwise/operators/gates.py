"""Admission of records by phrase vocabularies: scores, lanes, ordered rules and the first rule that drops a record.

The vocabulary is a parameter. Title and abstract are normalised once; every rule is a column over them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions import text as T


@dataclass(frozen=True)
class Vocabulary:
    """Phrases by their part in the rules; all are compared as whole words of normalised text."""

    topics: Mapping[str, Sequence[str]]
    audience: Sequence[str] = ()
    off_scope: Sequence[str] = ()
    higher_education: Sequence[str] = ()
    higher_teaching: Sequence[str] = ()
    school_age: Sequence[str] = ()
    educator_strong: Sequence[str] = ()
    educator_subject: Sequence[str] = ()
    educator_context: Sequence[str] = ()
    educator_off: Sequence[str] = ()
    #: Points of a hundred: a topic in the title and in the abstract, the most that topics give, and the same for the audience.
    points: tuple[int, int, int, int, int] = field(default=(30, 15, 70, 30, 15))


def has(padded: Column, phrases: Sequence[str]) -> Column:
    return padded.rlike(T.phrase_pattern(list(phrases))) if phrases else F.lit(False)


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with further columns that are computed once a row: behind a generator the optimiser does not copy them to where they are used."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select("*", made).select("*", "_made.*").drop("_made")


def _padded(text: str) -> Column:
    return F.concat(F.lit(" "), F.coalesce(T.normalize_title(F.col(text)), F.lit("")), F.lit(" "))


def annotate(df: DataFrame, v: Vocabulary, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """`df` with `score`, `topics`, `lane` and the outcome of each single rule; null texts count as empty.

    `off_scope`: a phrase of other domains in the title, or in the abstract of a record whose title names no topic.
    `adult`: only grown-up learners are named. `educator`: the competence of teachers is the subject. `tool_use`: teachers
    save work with a tool.
    """
    df = _once(df, {"_t": _padded(title), "_a": _padded(abstract)})
    t, a = F.col("_t"), F.col("_a")
    in_title, in_abstract, most, who_title, who_abstract = v.points
    # what stands in the title and what anywhere, each found once
    hits = {f"_k{i}": F.when(has(t, p), 2).when(has(a, p), 1).otherwise(0) for i, p in enumerate(v.topics.values())}
    lists = ("audience", "off_scope", "higher_education", "higher_teaching", "school_age", "educator_strong", "educator_subject", "educator_context", "educator_off")
    hits |= {f"_{n}": F.when(has(t, getattr(v, n)), 2).when(has(a, getattr(v, n)), 1).otherwise(0) for n in lists}
    df = _once(df, hits)
    level = {n: F.col(f"_{n}") for n in lists}
    named = {n: c > 0 for n, c in level.items()}
    keys = [F.col(f"_k{i}") for i in range(len(v.topics))]
    points = sum((F.when(k == 2, in_title).when(k == 1, in_abstract).otherwise(0) for k in keys), F.lit(0))
    who = F.when(level["audience"] == 2, who_title).when(level["audience"] == 1, who_abstract).otherwise(0)
    anchored = F.greatest(*keys, F.lit(0), F.lit(0)) == 2
    strong = named["educator_strong"]
    educator = (
        F.when(named["educator_off"], False).when(strong, True)
        .when(named["higher_teaching"] & ~named["school_age"], False)
        .otherwise(named["educator_subject"] & named["educator_context"])
    )
    df = _once(df, {
        "score": F.least(F.lit(100), F.least(F.lit(most), points) + who) / 100.0,
        "topics": F.filter(F.array(*[F.when(k > 0, F.lit(n)) for n, k in zip(v.topics, keys, strict=True)]), lambda x: x.isNotNull()),
        "off_scope": (level["off_scope"] == 2) | ((level["off_scope"] == 1) & ~anchored),
        "adult": named["higher_education"] & ~named["school_age"],
        "educator": educator,
        "tool_use": ~strong & named["educator_subject"] & named["educator_off"],
    })
    return df.drop("_t", "_a", *hits).withColumn("lane", F.when(F.col("educator"), "educator").otherwise("learner"))


def drop_rules(least: float, rescue: bool = True) -> list[tuple[str, Column]]:
    """Rules in order; without `rescue` neither tool use nor the educators' lane are known, as in a probe of what a search would miss."""
    adult = F.col("adult") & ~F.col("educator") if rescue else F.col("adult")
    rules = [("no_topic", F.size("topics") == 0), ("below_threshold", F.col("score") < least), ("off_scope", F.col("off_scope"))]
    return rules + ([("teacher_tooluse", F.col("tool_use"))] if rescue else []) + [("adult_audience", adult)]


def drop_reason(least: float = 0.3, rescue: bool = True) -> Column:
    """The first rule that drops an annotated record; null if it is kept."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in drop_rules(least, rescue)])


def decide(df: DataFrame, decider: str = "heuristic", least: float = 0.3, score: str | None = None) -> DataFrame:
    """Annotated records with `keep`: by the rules, or by the column `score` of a model or of anchors where it is known and the rules elsewhere."""
    rules = drop_reason(least).isNull()
    if decider == "heuristic" or score is None or score not in df.columns:
        return df.withColumn("keep", rules)
    return df.withColumn("keep", F.coalesce(F.col(score) >= least, rules))


def admit(df: DataFrame, v: Vocabulary, decider: str = "heuristic", least: float = 0.3, score: str | None = None) -> DataFrame:
    """The kept records with score, topics and lane."""
    kept = decide(annotate(df, v), decider, least, score).where("keep")
    return kept.drop("keep", "off_scope", "adult", "educator", "tool_use")


def valid_candidate(title: str = "title", url: str = "url", year: str = "year") -> Column:
    """Title and address are there and the year, if any, is one of 1900 to 2100."""
    filled = [F.coalesce(F.col(c) != "", F.lit(False)) for c in (title, url)]
    return filled[0] & filled[1] & F.coalesce(F.col(year).between(1900, 2100), F.lit(True))
