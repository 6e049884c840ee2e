"""Queries of admission, appraisal and text parsing over the catalogue, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators import appraise as P
from strandwise.operators import gates as G
from strandwise.plans.core import _NORM
from strandwise.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Phrases of the test corpus, one list for each part; the operators take any.
VOCABULARY = G.Vocabulary(
    topics={"critical thinking": ["critical thinking", "kritisches denken"], "media literacy": ["media literacy", "medienkompetenz"], "resilience": ["resilience", "resilienz"], "systems thinking": ["systems thinking"], "collaboration": ["collaboration"], "ai literacy": ["ai literacy"]},
    audience=["pupils", "primary schools", "lower secondary", "schools"], off_scope=["games", "network"], higher_education=["vocational education", "two year study"], higher_teaching=["vocational"],
    school_age=["pupils", "primary", "children"], educator_strong=["teacher education", "lehrerbildung"], educator_subject=["teachers", "mentor"], educator_context=["coaching", "guidance"], educator_off=["privacy settings", "equipment"],
)


def _any(column: str, phrases) -> str:
    return "(" + (" or ".join(f"contains({column}, ' {p} ')" for p in phrases) or "false") + ")"


def _level(phrases) -> str:
    return f"case when {_any('t', phrases)} then 2 when {_any('a', phrases)} then 1 else 0 end"


_V = VOCABULARY
_GATES_SQL = f"""
s0 as (select distinct id, title, abstract, audience, status from sources),
p as (select *, ' ' || coalesce({_NORM.format(c='title')}, '') || ' ' as t, ' ' || coalesce({_NORM.format(c='abstract')}, '') || ' ' as a from s0),
l as (select *, {", ".join(f"{_level(p)} as k{i}" for i, p in enumerate(_V.topics.values()))},
  {", ".join(f"{_level(getattr(_V, n))} as {n}" for n in ("off_scope", "higher_education", "higher_teaching", "school_age", "educator_strong", "educator_subject", "educator_context", "educator_off"))}, {_level(_V.audience)} as who from p),
f as (select id, title, abstract, audience, status,
  least(100, least(70, {" + ".join(f"case k{i} when 2 then 30 when 1 then 15 else 0 end" for i in range(len(_V.topics)))}) + case who when 2 then 30 when 1 then 15 else 0 end) / 100.0 as score,
  list_filter([{", ".join(f"case when k{i} > 0 then '{n}' end" for i, n in enumerate(_V.topics))}], lambda x: x is not null) as topics,
  off_scope = 2 or (off_scope = 1 and greatest({", ".join(f"k{i}" for i in range(len(_V.topics)))}) < 2) as off,
  higher_education > 0 and school_age = 0 as adult,
  case when educator_off > 0 then false when educator_strong > 0 then true when higher_teaching > 0 and school_age = 0 then false else educator_subject > 0 and educator_context > 0 end as educator,
  educator_strong = 0 and educator_subject > 0 and educator_off > 0 as tool from l),
g as (select *, case when len(topics) = 0 then 'no_topic' when score < 0.3 then 'below_threshold' when off then 'off_scope' when tool then 'teacher_tooluse' when adult and not educator then 'adult_audience' end as reason,
  case when len(topics) = 0 then 'no_topic' when score < 0.3 then 'below_threshold' when off then 'off_scope' when adult then 'adult_audience' end as probe,
  case when educator then 'educator' else 'learner' end as lane from f)
"""


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sources").select("id", "title", "abstract", "audience", "status").distinct()
    return G.annotate(s, VOCABULARY)


@query(f"with {_GATES_SQL} select id, score, count(*) as n from g where score > 0 group by all")
def q_relevance_score(spark: SparkSession, sf: str) -> DataFrame:
    """Phrase scores: 0.30 for a topic in the title, 0.15 in the abstract, 0.70 at most, and the same for the audience."""
    return _annotated(spark, sf).where("score > 0").groupBy("id", "score").agg(F.count("*").alias("n"))


@query(f"with {_GATES_SQL} select id, score, array_to_string(topics, '|') as topics, lane, count(*) as n from g where reason is null group by all")
def q_keep_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Admitted records with score, topics and lane."""
    s = table(spark, sf, "sources").select("id", "title", "abstract", "audience", "status").distinct()
    return G.admit(s, VOCABULARY).groupBy("id", "score", F.array_join("topics", "|").alias("topics"), "lane").agg(F.count("*").alias("n"))


@query(f"with {_GATES_SQL} select id, reason, probe, count(*) as n from g where reason is not null or probe is not null group by all")
def q_drop_reason(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that drops a record, by the rules of the importer and by those of the probe."""
    r = _annotated(spark, sf).select("id", G.drop_reason().alias("reason"), G.drop_reason(rescue=False).alias("probe"))
    return r.where("reason is not null or probe is not null").groupBy("id", "reason", "probe").agg(F.count("*").alias("n"))


@query(f"with {_GATES_SQL} select coalesce(reason, 'kept') as reason, coalesce(probe, 'kept') as probe, count(*) as n from g group by all")
def q_drop_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _annotated(spark, sf).groupBy(F.coalesce(G.drop_reason(), F.lit("kept")).alias("reason"), F.coalesce(G.drop_reason(rescue=False), F.lit("kept")).alias("probe")).agg(F.count("*").alias("n"))


@query(f"with {_GATES_SQL}, x as (select unnest(topics) as topic, reason is null as kept from g) select topic, count(*) as n, count(*) filter (kept) as n_kept from x group by topic")
def q_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Records and kept records by topic."""
    x = _annotated(spark, sf).select(F.explode("topics").alias("topic"), G.drop_reason().isNull().alias("kept"))
    return x.groupBy("topic").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))


@query(
    f"""with {_GATES_SQL}, c as (select count(*) filter (lane = 'educator' and audience = 'educator') as tp, count(*) filter (lane = 'educator' and audience <> 'educator') as fp,
  count(*) filter (lane <> 'educator' and audience = 'educator') as fn, count(*) filter (lane = 'educator' and adult and reason is null) as rescued, min(id) filter (lane = 'educator' and audience <> 'educator') as first_leaked from g where audience is not null)
select tp, fp, fn, rescued, first_leaked, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall from c"""
)
def q_lane_report(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall of the educators' lane against the stored audience, with what leaked into it and what it rescued."""
    g = _annotated(spark, sf).where("audience is not null").withColumn("kept", G.drop_reason().isNull())
    mine, gold = F.col("lane") == "educator", F.col("audience") == "educator"
    c = g.agg(F.count_if(mine & gold).alias("tp"), F.count_if(mine & ~gold).alias("fp"), F.count_if(~mine & gold).alias("fn"), F.count_if(mine & F.col("adult") & F.col("kept")).alias("rescued"), F.min(F.when(mine & ~gold, F.col("id"))).alias("first_leaked"))
    share = lambda a, b: F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0), 6)
    return c.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


# --- appraisal -----------------------------------------------------------------------------------------------------


def _levels_sql(field: str, levels: dict[str, str]) -> str:
    return "case " + " ".join(f"when {field} = '{k}' then {P.LEVELS.index(v)}" for k, v in levels.items()) + " end"


_APPRAISED_SQL = f"""
c0 as (select id, arg_max(appraisal, (loaded_at, appraisal::varchar)) filter (appraisal is not null) as x from claims group by id),
c1 as (select id, x.* from c0 where x is not null),
c2 as (select *, claim_type is null or claim_type = 'causal_effect' as causal, coalesce(source_provenance = 'unverified_source' and source_verified = 'false', false) as unnamed from c1),
c3 as (select *, case when causal then {_levels_sql('study_design', P.DESIGN_LEVEL)} else {_levels_sql('directness', P.DIRECT_LEVEL)} end as base,
  list_filter([case when risk_of_bias = 'high' then 'bias' end, case when consistency = 'inconsistent' then 'inconsistent' end,
    case when heterogeneity = 'high' and coalesce(consistency, '') <> 'inconsistent' then 'heterogeneous' end, case when precision = 'imprecise' then 'imprecise' end,
    case when causal and comparator = 'historical_control' then 'historical_control' end, case when causal and directness = 'indirect' then 'indirect' end,
    case when causal and directness = 'partially_direct' then 'partially_direct' end, case when claim_supported_by_source = 'partially_supported' then 'partial_support' end], lambda r: r is not null) as down from c2),
c4 as (select *, len(down) + case when list_contains(down, 'indirect') then 1 else 0 end as steps,
  len(down) = 0 and coalesce(replication in {P.REPLICATED}, false) and coalesce(consistency = 'consistent', false) and (not causal or coalesce(risk_of_bias = 'low', false)) as up,
  coalesce(claim_supported_by_source = 'not_supported', false) as capped from c3),
c5 as (select id, evidence_certainty,
  case when unnamed then 'unverifiable' when claim_supported_by_source = 'cannot_determine' then null when base is null then null
    else ['very_low', 'low', 'moderate', 'strong'][case when capped then 1 else least(3, greatest(0, base - steps) + up::int) + 1 end] end as level,
  case when unnamed then ['source_unknown'] when claim_supported_by_source = 'cannot_determine' then ['support_unknown'] when base is null then [case when causal then 'no_design' else 'no_directness' end]
    else list_concat(list_concat([case when causal then 'design' else 'directness' end], down), list_filter([case when up then 'replicated' end, case when capped then 'unsupported' end], lambda r: r is not null)) end as reasons,
  list_filter([case when evidence_certainty = 'strong' and study_design in ('systematic_review', 'meta_analysis') and not (coalesce(consistency = 'consistent', false) and coalesce(risk_of_bias = 'low', false)) then 'review_not_clean' end,
    case when evidence_certainty = 'strong' and study_design in {P.NEVER_STRONG} then 'design_not_strong' end,
    case when evidence_certainty in ('strong', 'moderate') and claim_supported_by_source = 'not_supported' then 'not_supported' end,
    case when evidence_certainty <> 'unverifiable' and unnamed then 'source_unknown' end], lambda r: r is not null) as conflicts,
  list_filter([{", ".join(f"case when {f} is not null and {f} not in {v} then '{f}' end" for f, v in P.VALUES.items())},
    case when age_range_explicit is not null and not (regexp_matches(age_range_explicit, '^\\d{{1,2}}-\\d{{1,2}}$') and try_cast(split_part(age_range_explicit, '-', 1) as int) <= try_cast(split_part(age_range_explicit, '-', 2) as int)) then 'age_range_explicit' end,
    case when evidence_certainty is not null and coalesce(appraisal_method, '') = '' then 'appraisal_method' end, case when source_provenance = 'synthetic_eval_case' then 'synthetic' end], lambda r: r is not null) as problems from c4)
"""


def _appraised(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims").where("appraisal is not null").groupBy("id").agg(F.max_by("appraisal", F.struct("loaded_at", F.to_json("appraisal"))).alias("appraisal"))
    return P.appraised(c)


@query(f"with {_APPRAISED_SQL} select id, level, array_to_string(reasons, '|') as reasons, level is not distinct from evidence_certainty as as_recorded from c5")
def q_certainty(spark: SparkSession, sf: str) -> DataFrame:
    """Derived certainty of each claim with its reasons, and whether it is the recorded one."""
    return _appraised(spark, sf).select("id", "level", F.array_join("reasons", "|").alias("reasons"), F.col("level").eqNullSafe(F.col("appraisal.evidence_certainty")).alias("as_recorded"))


@query(f"with {_APPRAISED_SQL}, x as (select id, 'conflict' as kind, unnest(conflicts) as code from c5 union all select id, 'problem', unnest(problems) from c5) select kind, code, count(*) as n, min(id) as first_id from x group by all")
def q_certainty_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Rules broken by recorded levels and values outside their lists."""
    a = _appraised(spark, sf)
    x = a.select("id", F.lit("conflict").alias("kind"), F.explode("conflicts").alias("code")).unionByName(a.select("id", F.lit("problem").alias("kind"), F.explode("problems").alias("code")))
    return x.groupBy("kind", "code").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"with {_APPRAISED_SQL} select coalesce(evidence_certainty, 'none') as recorded, coalesce(level, 'none') as derived, count(*) as n from c5 group by all")
def q_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded against derived levels: the drift of a new rule from an old one, as a cross table."""
    a = _appraised(spark, sf).select(F.coalesce("appraisal.evidence_certainty", F.lit("none")).alias("recorded"), F.coalesce("level", F.lit("none")).alias("derived"))
    return a.groupBy("recorded", "derived").agg(F.count("*").alias("n"))
