"""Certainty of a finding from its appraisal: levels by rule with their reasons, contradictions, and values outside their lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scale, lowest first.
LEVELS = ("very_low", "low", "moderate", "strong")
#: Level of a study design, for claims of an effect.
DESIGN_LEVEL = {
    "systematic_review": "moderate", "meta_analysis": "moderate", "narrative_review": "very_low", "psychometric_validation": "very_low", "rct": "moderate", "cluster_rct": "moderate",
    "quasi_experimental": "low", "matched_comparison": "low", "controlled_pre_post": "low", "cohort": "low", "uncontrolled_pre_post": "very_low", "cross_sectional": "very_low",
    "single_case": "very_low", "qualitative": "very_low", "descriptive": "very_low", "policy_report": "very_low", "working_paper": "very_low", "consensus_framework": "low",
}
#: Level by directness, for claims of no effect.
DIRECT_LEVEL = {"direct": "moderate", "partially_direct": "low", "indirect": "very_low"}
#: What replication may raise a level.
REPLICATED = ("multiple_studies", "multiple_contexts", "systematic_synthesis")
#: Designs that can't carry the highest level.
NEVER_STRONG = ("uncontrolled_pre_post", "single_case", "cross_sectional", "descriptive", "qualitative", "policy_report", "working_paper")
#: The values of each field.
VALUES = {
    "source_provenance": ("verified_real_source", "unverified_source", "synthetic_eval_case"),
    "claim_type": ("causal_effect", "association", "descriptive", "normative", "definitional", "unknown"),
    "source_verified": ("true", "false", "unknown"),
    "study_design": (*DESIGN_LEVEL, "other", "unknown"),
    "comparator": ("active_control", "passive_control", "waitlist", "business_as_usual", "historical_control", "matched_comparison", "none", "unclear"),
    "outcome_type": ("standardized_objective", "objective_nonstandardized", "behavioural", "teacher_rating", "self_report", "administrative", "mixed", "unclear"),
    "effect_direction": ("positive", "negative", "null", "mixed", "unclear", "not_applicable"),
    "effect_magnitude": ("large", "moderate", "small", "trivial", "null", "mixed", "unknown"),
    "risk_of_bias": ("low", "some_concerns", "high", "unknown"),
    "directness": ("direct", "partially_direct", "indirect", "unknown"),
    "replication": ("single_study", *REPLICATED, "unknown"),
    "consistency": ("consistent", "mixed", "inconsistent", "unknown"),
    "heterogeneity": ("low", "moderate", "high", "unknown"),
    "precision": ("adequate", "imprecise", "unknown"),
    "follow_up": ("none", "immediate_post", "delayed_post", "longitudinal", "unknown"),
    "claim_supported_by_source": ("supported", "partially_supported", "not_supported", "cannot_determine"),
    "evidence_certainty": (*LEVELS, "unverifiable"),
}


def _is(field: Column, *values: str) -> Column:
    return F.coalesce(field.isin(*values), F.lit(False))


def _level(field: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("int")
    for n, level in enumerate(LEVELS):
        out = F.when(_is(field, *[k for k, x in table.items() if x == level]), n).otherwise(out)
    return out


def _marks(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull())


def certainty(a: Column) -> Column:
    """Struct (level, reasons) derived from an appraisal struct; the level is null where too little is recorded.

    A level starts with the design, or with directness if no effect is claimed, falls a step for each concern (two for
    indirect evidence of an effect), rises one if nothing speaks against it and it is replicated, and is the lowest where the
    source does not support the claim. Reasons are codes in that order.
    """
    unnamed = _is(a["source_provenance"], "unverified_source") & _is(a["source_verified"], "false")
    support = a["claim_supported_by_source"]
    causal = a["claim_type"].isNull() | _is(a["claim_type"], "causal_effect")
    base = F.when(causal, _level(a["study_design"], DESIGN_LEVEL)).otherwise(_level(a["directness"], DIRECT_LEVEL))
    concerns = (
        (_is(a["risk_of_bias"], "high"), "bias", 1),
        (_is(a["consistency"], "inconsistent"), "inconsistent", 1),
        (_is(a["heterogeneity"], "high") & ~_is(a["consistency"], "inconsistent"), "heterogeneous", 1),
        (_is(a["precision"], "imprecise"), "imprecise", 1),
        (causal & _is(a["comparator"], "historical_control"), "historical_control", 1),
        (causal & _is(a["directness"], "indirect"), "indirect", 2),
        (causal & _is(a["directness"], "partially_direct"), "partially_direct", 1),
        (_is(support, "partially_supported"), "partial_support", 1),
    )
    down = sum((F.when(c, n).otherwise(0) for c, _, n in concerns), F.lit(0))
    up = (down == 0) & _is(a["replication"], *REPLICATED) & _is(a["consistency"], "consistent") & (~causal | _is(a["risk_of_bias"], "low"))
    capped = _is(support, "not_supported")
    step = F.when(capped, 0).otherwise(F.least(F.lit(len(LEVELS) - 1), F.greatest(F.lit(0), base - down) + up.cast("int")))
    name = F.element_at(F.array(*map(F.lit, LEVELS)), step + 1)
    reasons = F.concat(
        F.array(F.when(causal, F.lit("design")).otherwise(F.lit("directness"))), _marks(*[(c, n) for c, n, _ in concerns]), _marks((up, "replicated"), (capped, "unsupported"))
    )
    return (
        F.when(unnamed, F.struct(F.lit("unverifiable").alias("level"), F.array(F.lit("source_unknown")).alias("reasons")))
        .when(_is(support, "cannot_determine"), F.struct(F.lit(None).cast("string").alias("level"), F.array(F.lit("support_unknown")).alias("reasons")))
        .when(base.isNull(), F.struct(F.lit(None).cast("string").alias("level"), F.array(F.when(causal, F.lit("no_design")).otherwise(F.lit("no_directness"))).alias("reasons")))
        .otherwise(F.struct(name.alias("level"), reasons.alias("reasons")))
    )


def conflicts(a: Column) -> Column:
    """Codes of the rules that a recorded level breaks; empty without a recorded level."""
    level = a["evidence_certainty"]
    strong, design = _is(level, "strong"), a["study_design"]
    clean = _is(a["consistency"], "consistent") & _is(a["risk_of_bias"], "low")
    return _marks(
        (strong & _is(design, "systematic_review", "meta_analysis") & ~clean, "review_not_clean"),
        (strong & _is(design, *NEVER_STRONG), "design_not_strong"),
        (_is(level, "strong", "moderate") & _is(a["claim_supported_by_source"], "not_supported"), "not_supported"),
        (level.isNotNull() & (level != "unverifiable") & _is(a["source_provenance"], "unverified_source") & _is(a["source_verified"], "false"), "source_unknown"),
    )


def problems(a: Column) -> Column:
    """Names of the fields whose value is outside their list, and of what is missing or malformed; empty for a sound appraisal."""
    wrong = [(a[f].isNotNull() & ~_is(a[f], *v), f) for f, v in VALUES.items()]
    age = a["age_range_explicit"]
    band = age.rlike(r"^\d{1,2}-\d{1,2}$")
    backwards = band & (F.split_part(age, F.lit("-"), F.lit(1)).try_cast("int") > F.split_part(age, F.lit("-"), F.lit(2)).try_cast("int"))
    return _marks(
        *wrong, (age.isNotNull() & F.coalesce(~band | backwards, F.lit(True)), "age_range_explicit"),
        (a["evidence_certainty"].isNotNull() & F.coalesce(a["appraisal_method"] == "", F.lit(True)), "appraisal_method"),
        (_is(a["source_provenance"], "synthetic_eval_case"), "synthetic"),
    )


def appraised(df: DataFrame, appraisal: str = "appraisal") -> DataFrame:
    """`df` with `level`, `reasons`, `conflicts` and `problems` of its appraisal; a null appraisal has a null level and no problem."""
    a = F.col(appraisal)
    c = certainty(a)
    none = F.array().cast("array<string>")
    there = a.isNotNull()
    return df.withColumns({
        "level": F.when(there, c["level"]), "reasons": F.when(there, c["reasons"]).otherwise(none),
        "conflicts": F.when(there, conflicts(a)).otherwise(none), "problems": F.when(there, problems(a)).otherwise(none),
    })
