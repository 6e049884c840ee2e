"""Queries of the core that stand on the catalogue tables (general problems)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators.references import list_references, normal_key, orphan_references, orphan_report
from strandwise.sources.tables import table

CITING = ("supporting_claim_ids", "contradicting_claim_ids")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = list_references(table(spark, sf_dir, "skills"), "id", "loaded_at", CITING)
    loads = table(spark, sf_dir, "claims").select(normal_key(F.col("id")).alias("key"), F.col("loaded_at").alias("at"))
    gone = table(spark, sf_dir, "claim_tombstones").select(normal_key(F.col("claim_id")).alias("key"), F.col("deleted_at").alias("at"))
    return orphan_references(refs, loads, gone)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation of a claim that was not there when the skill was loaded."""
    return _orphans(spark, sf_dir).select(
        F.col("owner").alias("skill_id"), "ref_field", F.col("ref_key").alias("claim_id"), F.date_format("at", "yyyy-MM").alias("period"), "kind"
    ).distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan citations by field, month and kind."""
    return orphan_report(_orphans(spark, sf_dir))


_ORPHANS_SQL = """
refs as (
  select distinct id as skill_id, ref_field, lower(trim(raw, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))) as claim_id, loaded_at as t
  from (
    select id, loaded_at, 'supporting_claim_ids' as ref_field, unnest(supporting_claim_ids) as raw from skills
    union all
    select id, loaded_at, 'contradicting_claim_ids', unnest(contradicting_claim_ids) from skills)
  where raw is not null and trim(raw, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) <> ''),
loads as (select distinct lower(trim(id)) as k, loaded_at as t from claims),
gone as (select distinct lower(trim(claim_id)) as k, deleted_at as t from claim_tombstones),
state as (
  select r.skill_id, r.ref_field, r.claim_id, r.t,
    (select max(l.t) from loads l where l.k = r.claim_id and l.t <= r.t) as load,
    (select max(g.t) from gone g where g.k = r.claim_id and g.t <= r.t) as deleted,
    (select max(l.t) from loads l where l.k = r.claim_id and l.t > r.t) as later
  from refs r),
orphans as (
  select skill_id, ref_field, claim_id, t, strftime(t, '%Y-%m') as period,
    case when later is not null then 'late' when deleted is not null then 'deleted' else 'missing' end as kind
  from state where not coalesce(load is not null and (deleted is null or load > deleted), false))
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLES = {
    "p2_found": f"with {_ORPHANS_SQL} select distinct skill_id, ref_field, claim_id, period, kind from orphans",
    "p2_report": f"with {_ORPHANS_SQL} select ref_field, period, kind, count(*) as n, count(distinct claim_id) as n_keys from orphans group by all",
}
