"""Constraints as violation rows: rules of one record, identifiers, relations, derived values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """`(key, rule)`: one row for each record and rule it breaks; a rule is a condition that must hold, null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def filled(column: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(column))) > 0, F.lit(False))


def one_of(column: str, values: Sequence[str], optional: bool = False) -> Column:
    c = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return c | F.col(column).isNull() if optional else c


def missing_parents(relations: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """`(relation, key, n)`: keys of children without a parent and how often they occur. Each relation is (`child(key)`, `parent(key)`).

    References are counted before the join, so a key that is cited by a third of all rows is one row in it.
    """
    out = None
    for name, (child, parent) in relations.items():
        refs = child.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
        lost = refs.join(parent.select("key").distinct(), "key", "left_anti").select(F.lit(name).alias("relation"), "key", "n")
        out = lost if out is None else out.unionByName(lost)
    return out


def known_only(value: Column, values: Sequence[str], what: str) -> Column:
    """The value itself; a value outside the list ends the query with an error that names it."""
    return F.when(value.isNull() | value.isin(*values), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)))


def coverage_label(score: Column) -> Column:
    """Label of a coverage score of 0 to 3."""
    return F.when(score >= 2.4, "strong").when(score >= 1.5, "partial").when(score.isNotNull(), "gap")


def worksheet_problems(given: DataFrame, original: DataFrame, key: str, kept: Sequence[str], values: Mapping[str, Sequence[str]]) -> DataFrame:
    """`(key, problem)` of a sheet filled in by hand: keys unknown, missing or repeated, columns changed, values outside their lists."""
    g = given.groupBy(key).agg(F.count("*").alias("_n"), *[F.max(c).alias(c) for c in (*kept, *values)])
    o = original.select(key, F.lit(1).alias("_known"), *[F.col(c).alias(f"_{c}") for c in kept])
    both = g.join(o, key, "full")
    rules = {"repeated key": F.coalesce(F.col("_n") == 1, F.lit(True)), "unknown key": F.col("_known").isNotNull(), "missing key": F.col("_n").isNotNull()}
    there = F.col("_n").isNotNull() & F.col("_known").isNotNull()
    rules |= {f"{c} changed": ~there | F.col(c).eqNullSafe(F.col(f"_{c}")) for c in kept}
    rules |= {f"{c} not allowed": one_of(c, v, optional=True) for c, v in values.items()}
    return rule_violations(both, key, rules).withColumnRenamed("rule", "problem")
