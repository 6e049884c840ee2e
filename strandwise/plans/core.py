"""Queries of the core operators over the catalogue tables, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import text as T
from strandwise.operators import agreement as A
from strandwise.operators import keys as K
from strandwise.operators import scoring as S
from strandwise.operators import vectors as V
from strandwise.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_NORM = "trim(regexp_replace(strip_accents(replace(lower({c}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"
_IDENTITY = (
    "coalesce('doi:' || lower(nullif(doi, '')), 'eric_id:' || lower(nullif(eric_id, '')), 'url:' || lower(nullif(url, '')), 'title:' || coalesce("
    + _NORM.format(c="title") + ", ''))"
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _latest(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per id: the last load; of rows loaded at once the greatest by the kept columns."""
    return df.groupBy("id").agg(F.max(F.struct("loaded_at", *keep)).alias("x")).select("id", *[f"x.{c}" for c in keep])


# --- keys and duplicates -------------------------------------------------------------------------------------------


@query(f"select distinct id, {_NORM.format(c='title')} as title_key from sources where title is not null")
def q_normalize_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").where("title is not null").select("id", T.normalize_title(F.col("title")).alias("title_key")).distinct()


@query(
    f"select distinct id, coalesce(nullif(regexp_replace(substr(replace({_NORM.format(c='title')}, ' ', '-'), 1, 72), '^-+|-+$', '', 'g'), ''), 'record') as slug from sources"
)
def q_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").select("id", T.slug(F.col("title")).alias("slug")).distinct()


@query(f"select distinct id, {_IDENTITY} as identity, coalesce({_NORM.format(c='title')}, '') || '::' || coalesce(year::varchar, 'None') as title_key from sources")
def q_identity_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").select("id", K.identity_key(["doi", "eric_id", "url"]).alias("identity"), K.title_year_key().alias("title_key")).distinct()


@query(
    f"""with k as (select distinct key, id from (
  select {_IDENTITY} as key, id from sources
  union all select coalesce({_NORM.format(c='title')}, '') || '::' || coalesce(year::varchar, 'None'), id from sources))
select key, count(*) as n, min(id) as first_member from k group by key having count(*) > 1"""
)
def q_dup_groups_exact(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sources")
    keyed = s.select("id", F.explode(F.array(K.identity_key(["doi", "eric_id", "url"]), K.title_year_key())).alias("key"))
    return K.duplicate_groups(keyed, F.col("key"), "id")


@query(
    f"""select key, doc_id, source from (
  select md5(text) as key, doc_id, source, row_number() over (partition by md5(text) order by collected_at, doc_id) as r from documents) where r = 1"""
)
def q_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.md5("text").alias("key"), "doc_id", "source", "collected_at")
    return K.first_wins(d, ["key"], ["collected_at", "doc_id"]).select("key", "doc_id", "source")


@query(
    f"""with k as (select id, {_IDENTITY} as identity, loaded_at from sources),
base as (select distinct identity from k where loaded_at < timestamp '2026-03-01')
select 'base' as origin, count(*) as n from k where loaded_at < timestamp '2026-03-01'
union all select 'branch', count(*) from k where loaded_at >= timestamp '2026-03-01' and identity not in (select identity from base)"""
)
def q_snapshot_merge(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "sources").select("id", K.identity_key(["doi", "eric_id", "url"]).alias("identity"), F.col("loaded_at").cast("timestamp").alias("at"))
    split = F.lit("2026-03-01").cast("timestamp")
    return K.merge_snapshots(k.where(F.col("at") < split), k.where(F.col("at") >= split), ["identity"]).groupBy("origin").agg(F.count("*").alias("n"))


@query(
    f"""with b as (select id, harvested_at, coalesce(nullif(regexp_replace(substr(replace({_NORM.format(c='title')}, ' ', '-'), 1, 40), '^-+|-+$', '', 'g'), ''), 'record') as slug from source_batch),
n as (select *, row_number() over (partition by slug order by harvested_at) as r, count(*) over (partition by slug) as k from b),
lit as (select distinct regexp_extract(slug, '^(.*)-([1-9][0-9]{{0,8}})$', 1) as base, try_cast(regexp_extract(slug, '^(.*)-([1-9][0-9]{{0,8}})$', 2) as int) as t from b),
g as (select n.slug, max(k) as k, count(distinct t) as m from n left join lit on base = n.slug where k > 1 group by n.slug), c as (select slug, unnest(range(2, k + m + 2)) as s from g),
f as (select slug, s, row_number() over (partition by slug order by s) + 1 as r from c where not exists (select 1 from lit where base = c.slug and t = c.s))
select id, n.slug as slug, case when n.r = 1 then n.slug else n.slug || '-' || s end as unique_id from n left join f on f.slug = n.slug and f.r = n.r"""
)
def q_unique_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs made unique by numbered suffixes that skip those carried literally."""
    b = table(spark, sf, "source_batch").select("id", "harvested_at", T.slug(F.col("title"), 40).alias("slug"))
    return K.unique_ids(b, "slug", ["harvested_at"]).select("id", "slug", "unique_id")


@query("select id, count(*) as n from skills group by id having count(*) > 1")
def q_id_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "skills").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


# --- projections of nested feeds -----------------------------------------------------------------------------------


@query(
    """select distinct id, array_to_string(list_transform(list_sort(flatten(list_transform(map_entries(abstract_inverted_index),
  lambda e: list_transform(e.value, lambda p: {'p': p, 'w': e.key})))), lambda x: x.w), ' ') as abstract
from openalex_works where abstract_inverted_index is not null"""
)
def q_inverted_abstract(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "openalex_works").where("abstract_inverted_index is not null")
    return w.select("id", T.inverted_text(F.col("abstract_inverted_index")).alias("abstract")).distinct()


@query(
    """select distinct id, coalesce(nullif(trim(display_name), ''), 'Untitled') as title,
  list_filter(list_transform(coalesce(authorships, []), lambda a: a.author.display_name), lambda n: n is not null) as authors,
  primary_location.source.display_name as publisher, nullif(publication_year, 0) as year,
  case when type in ('review') then 'systematic_review' when type in ('article', 'preprint') then 'peer_reviewed_article'
       when type = 'report' then 'policy_report' when type = 'book' then 'book' when type = 'dataset' then 'dataset' else 'web_resource' end as source_type
from openalex_works"""
)
def q_work_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Nested works to flat source rows, null-safe at every level."""
    kind = F.col("type")
    w = table(spark, sf, "openalex_works")
    return w.select(
        "id", F.coalesce(F.nullif(F.trim("display_name"), F.lit("")), F.lit("Untitled")).alias("title"),
        F.filter(F.coalesce(F.col("authorships.author.display_name"), F.array().cast("array<string>")), lambda n: n.isNotNull()).alias("authors"),
        F.col("primary_location.source.display_name").alias("publisher"), F.nullif(F.col("publication_year"), F.lit(0)).alias("year"),
        F.when(kind == "review", "systematic_review").when(kind.isin("article", "preprint"), "peer_reviewed_article").when(kind == "report", "policy_report")
        .when(kind == "book", "book").when(kind == "dataset", "dataset").otherwise("web_resource").alias("source_type"),
    ).distinct()


@query(
    r"""select distinct id, list_max(list_transform(regexp_extract_all(coalesce(title, ''), '\b(?:19[5-9][0-9]|20[0-4][0-9])\b'), lambda y: y::int)) as title_year from sources"""
)
def q_title_year(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").select("id", T.latest_year(F.col("title")).alias("title_year")).distinct()


# --- scores --------------------------------------------------------------------------------------------------------


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims").select("id", "loaded_at", "source_ids", F.col("appraisal.evidence_certainty").alias("certainty"), F.col("evidence_strength").alias("strength"), "status")
    return _latest(c, ["source_ids", "certainty", "strength", "status"]).withColumnRenamed("id", "claim_id")


def _source_types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").groupBy(F.col("id").alias("source_id")).agg(F.max("source_type").alias("source_type"))


def _claim_scores(spark: SparkSession, sf: str) -> DataFrame:
    return S.claim_scores(_claims(spark, sf), _source_types(spark, sf))


def _case(col: str, weights: dict[str, int]) -> str:
    return "case " + col + " " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " end"


_CLAIMS_SQL = f"""
c as (select id as claim_id, x.source_ids as source_ids, x.certainty as certainty, x.strength as strength, x.status as status from (
  select id, max({{'loaded_at': loaded_at, 'source_ids': source_ids, 'certainty': appraisal.evidence_certainty, 'strength': evidence_strength, 'status': status}}) as x from claims group by id)),
st as (select id as source_id, max(source_type) as source_type from sources group by id),
cited as (select claim_id, unnest(source_ids) as source_id, unnest(range(len(source_ids))) as pos from c),
per as (select claim_id, count(*) as n_sources, sum({_case('source_type', S.SOURCE_WEIGHTS)}) as total,
  min(case when st.source_id is null then {{'pos': pos, 'reason': 'source missing'}} when {_case('source_type', S.SOURCE_WEIGHTS)} is null then {{'pos': pos, 'reason': 'source type without weight'}} end) as bad
  from cited left join st using (source_id) group by claim_id),
j as (select c.*, n_sources, total, bad, case when certainty is not null then {_case('certainty', S.CERTAINTY_WEIGHTS)} else {_case('strength', S.STRENGTH_WEIGHTS)} end as sw from c left join per using (claim_id)),
p as (select *, case when n_sources is null then 'no sources' when bad is not null then bad.reason when sw is null and certainty is not null then 'certainty without weight'
  when sw is null then 'strength without weight' end as problem from j),
cs as (select claim_id, coalesce(n_sources, 0) as n_sources, case when problem is null then
  ((2 * (3 * total + 2 * sw * n_sources) * 1000 + 5 * n_sources * 1000)::hugeint // (10 * n_sources * 1000)::hugeint) / 1000.0 end as score, problem from p)
"""


@query(f"with {_CLAIMS_SQL} select claim_id, n_sources, score, problem from cs")
def q_claim_score(spark: SparkSession, sf: str) -> DataFrame:
    return _claim_scores(spark, sf)


@query(f"with {_CLAIMS_SQL} select problem, count(*) as n from cs where problem is not null group by problem")
def q_unscoreable_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _claim_scores(spark, sf).where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


def _skills(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "skills")
    return _latest(s, ["name", "audience", "age_range", "status", "trend", "evidence_score", "topics", "supporting_claim_ids", "contradicting_claim_ids"]).withColumnRenamed("id", "skill_id")


def _skill_scores(spark: SparkSession, sf: str) -> DataFrame:
    skills = _skills(spark, sf)
    links = skills.select("skill_id", F.explode(F.array(*[
        F.struct(F.lit(role).alias("role"), F.coalesce(F.col(col), F.array().cast("array<string>")).alias("ids"))
        for role, col in (("support", "supporting_claim_ids"), ("contra", "contradicting_claim_ids"))])).alias("l"))
    links = links.select("skill_id", "l.role", F.explode("l.ids").alias("claim_id"))
    return S.skill_scores(links, _claim_scores(spark, sf), skills)


_SKILLS_SQL = """
sk as (select id as skill_id, x.name as name, x.audience as audience, x.age_range as age_range, x.status as status, x.trend as trend, x.evidence_score as evidence_score, x.topics as topics, x.s as s, x.k as k from (
  select id, max({'loaded_at': loaded_at, 'name': name, 'audience': audience, 'age_range': age_range, 'status': status, 'trend': trend, 'evidence_score': evidence_score, 'topics': topics,
    's': supporting_claim_ids, 'k': contradicting_claim_ids}) as x from skills group by id))
"""
_SCORES_SQL = f"""{_CLAIMS_SQL}, {_SKILLS_SQL},
li as (select skill_id, 'support' as role, unnest(s) as claim_id from sk union all select skill_id, 'contra', unnest(k) from sk),
pa as (select skill_id, count(*) filter (role = 'support') as n_support, count(*) filter (role = 'contra') as n_contra,
  sum(case when role = 'support' then round(score * 1000)::bigint else 0 end) as support_sum, sum(case when role = 'contra' then round(score * 1000)::bigint else 0 end) as contra_sum
  from li join cs using (claim_id) where score is not null group by skill_id),
ss as (select sk.skill_id, coalesce(n_support, 0) as n_support, coalesce(n_contra, 0) as n_contra, coalesce(support_sum, 0)::bigint as support_sum, coalesce(contra_sum, 0)::bigint as contra_sum
  from sk left join pa using (skill_id)),
sc as (select *, case when n_support > 0 then least(1.0, greatest(0.0,
  floor((2 * (support_sum * (34 + least(n_support, 6)) - 4 * contra_sum * n_support) * 100 + 40000 * n_support)::double / (80000 * n_support)) / 100.0)) else 0.0 end as score from ss)
"""


@query(f"with {_SCORES_SQL} select skill_id, n_support, n_contra, support_sum, contra_sum, score::double as score from sc")
def q_skill_score_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _skill_scores(spark, sf)


@query(
    f"""with {_SKILLS_SQL}, a as (select * from sk where status = 'active')
select skill_id, count(*) over (partition by audience) as n_peers, case when count(*) over (partition by audience) >= 5 then rank() over (partition by audience order by evidence_score desc) end as peer_rank,
  case when count(*) over (partition by audience) >= 5 then round(median(evidence_score) over (partition by audience), 3) end as peer_median
from a where audience is not null and evidence_score is not null"""
)
def q_peer_rank_median(spark: SparkSession, sf: str) -> DataFrame:
    active = _skills(spark, sf).where("status = 'active' and audience is not null and evidence_score is not null")
    return S.peer_context(active.select("skill_id", "audience", "evidence_score"), "audience", "evidence_score").select("skill_id", "n_peers", "peer_rank", "peer_median")


@query(f"with {_SCORES_SQL} select count(*) as n, count(*) filter (sc.score is distinct from sk.evidence_score) as n_drifted from sc join sk using (skill_id)")
def q_score_drift(spark: SparkSession, sf: str) -> DataFrame:
    both = _skill_scores(spark, sf).join(_skills(spark, sf).select("skill_id", "evidence_score"), "skill_id")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("score").eqNullSafe(F.col("evidence_score"))).alias("n_drifted"))


# --- counts and coverage -------------------------------------------------------------------------------------------


@query(
    """with a as (select 'source' as kind, status from sources union all select 'claim', status from claims union all select 'skill', status from skills)
select kind, status, count(*) as n from a group by rollup (kind, status)"""
)
def q_status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).select(F.lit(k).alias("kind"), "status") for t, k in (("sources", "source"), ("claims", "claim"), ("skills", "skill"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).rollup("kind", "status").agg(F.count("*").alias("n"))


@query(
    f"""with {_CLAIMS_SQL}, {_SKILLS_SQL}, used as (select distinct unnest(s) as claim_id from sk where status = 'active'),
src as (select id as source_id, max(status) as status from sources group by id),
reach as (select distinct source_id from (select unnest(source_ids) as source_id from c where status = 'reviewed' and claim_id in (select claim_id from used)))
select 'claim' as kind, count(*) as captured, count(*) filter (status = 'candidate') as open, count(*) filter (status = 'reviewed') as accepted,
  count(*) filter (claim_id in (select claim_id from used)) as in_catalogue from c
union all select 'source', count(*), count(*) filter (status = 'candidate'), count(*) filter (status = 'reviewed'), count(*) filter (source_id in (select source_id from reach)) from src"""
)
def q_review_funnel(spark: SparkSession, sf: str) -> DataFrame:
    claims, skills = _claims(spark, sf), _skills(spark, sf)
    used = skills.where("status = 'active'").select(F.explode("supporting_claim_ids").alias("claim_id")).distinct().withColumn("used", F.lit(True))
    sources = table(spark, sf, "sources").groupBy(F.col("id").alias("source_id")).agg(F.max("status").alias("status"))
    marked = claims.join(used, "claim_id", "left")
    reach = marked.where("used and status = 'reviewed'").select(F.explode("source_ids").alias("source_id")).distinct().withColumn("used", F.lit(True))

    def counts(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.count("*").alias("captured"), F.count_if(F.col("status") == "candidate").alias("open"), F.count_if(F.col("status") == "reviewed").alias("accepted"), F.count_if("used").alias("in_catalogue")).select(F.lit(kind).alias("kind"), "*")

    return counts(marked, "claim").unionByName(counts(sources.join(reach, "source_id", "left"), "source"))


@query(
    f"""with {_SKILLS_SQL} select topic, count(*) as n_skills, count(*) filter (status = 'active') as n_active, min(skill_id) as first_skill
from (select skill_id, status, unnest(list_distinct(topics)) as topic from sk) group by topic having count(*) >= 2"""
)
def q_topic_groups(spark: SparkSession, sf: str) -> DataFrame:
    t = _skills(spark, sf).select("skill_id", "status", F.explode(F.array_distinct("topics")).alias("topic"))
    return t.groupBy("topic").agg(F.count("*").alias("n_skills"), F.count_if(F.col("status") == "active").alias("n_active"), F.min("skill_id").alias("first_skill")).where("n_skills >= 2")


@query(
    """select cycle, count(*) as n, count(distinct skill_id) as n_skills, round(avg(round(coverage_score * 100)::bigint) / 100, 4) as mean_coverage
from (select skill_id, coverage_score, unnest(list_distinct(cycles)) as cycle from frameworks) group by cycle"""
)
def q_cycle_footer(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "frameworks").select("skill_id", "coverage_score", F.explode(F.array_distinct("cycles")).alias("cycle"))
    return c.groupBy("cycle").agg(F.count("*").alias("n"), F.countDistinct("skill_id").alias("n_skills"), F.round(F.avg(F.round(F.col("coverage_score") * 100).cast("long")) / 100, 4).alias("mean_coverage"))


@query(
    """select skill_id, max(coverage_score) filter (cycle = 'Zyklus 1') as z1, max(coverage_score) filter (cycle = 'Zyklus 2') as z2, max(coverage_score) filter (cycle = 'Zyklus 3') as z3
from (select skill_id, coverage_score, unnest(cycles) as cycle from frameworks) group by skill_id"""
)
def q_cycle_matrix(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "frameworks").select("skill_id", "coverage_score", F.explode("cycles").alias("cycle"))
    return c.groupBy("skill_id").pivot("cycle", ["Zyklus 1", "Zyklus 2", "Zyklus 3"]).agg(F.max("coverage_score")).toDF("skill_id", "z1", "z2", "z3")


@query(
    """select skill_id, round(coverage_score, 2) as lowest, case when coverage_score >= 2.4 then 'strong' when coverage_score >= 1.5 then 'partial' else 'gap' end as label
from (select *, row_number() over (partition by skill_id order by coverage_score, id) as r from frameworks where coverage_score is not null) where r = 1"""
)
def q_worst_label(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "frameworks").where("coverage_score is not null").select("skill_id", "coverage_score", "id")
    worst = K.first_wins(f, ["skill_id"], ["coverage_score", "id"])
    c = F.col("coverage_score")
    return worst.select("skill_id", F.round(c, 2).alias("lowest"), F.when(c >= 2.4, "strong").when(c >= 1.5, "partial").otherwise("gap").alias("label"))


# --- search --------------------------------------------------------------------------------------------------------


@query(
    f"""with {_SKILLS_SQL} select skill_id, evidence_score from sk where status = 'active' and evidence_score >= 0.3 and audience = 'learner'
  and contains(' ' || {_NORM.format(c='name')} || ' ', ' literacy ') order by evidence_score desc, skill_id limit 50"""
)
def q_faceted_search(spark: SparkSession, sf: str) -> DataFrame:
    """Top 50 skills by score under facets and a search word (the limit is the feature)."""
    hit = F.col("status").eqNullSafe("active") & (F.col("evidence_score") >= 0.3) & (F.col("audience") == "learner") & T.contains_phrase(F.col("name"), ["literacy"])
    return _skills(spark, sf).where(hit).orderBy(F.desc("evidence_score"), "skill_id").select("skill_id", "evidence_score").limit(50)


@query(
    f"""with {_SKILLS_SQL}, t as (select coalesce(status = 'deprecated', false) as a, coalesce(evidence_score >= 0.5, false) as b, coalesce(trend = 'declining', false) as c from sk)
select count(*) filter (a and b and c) as n_all, count(*) filter (b and c) as n_without_status, count(*) filter (a and c) as n_without_score, count(*) filter (a and b) as n_without_trend from t"""
)
def q_filter_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    """Rows under all filters, and with each one left out, in a single pass."""
    a, b, c = F.col("status") == "deprecated", F.col("evidence_score") >= 0.5, F.col("trend") == "declining"
    return _skills(spark, sf).agg(F.count_if(a & b & c).alias("n_all"), F.count_if(b & c).alias("n_without_status"), F.count_if(a & c).alias("n_without_score"), F.count_if(a & b).alias("n_without_trend"))


@query(
    f"""with {_SKILLS_SQL}, {_CLAIMS_SQL}, l as (select skill_id, unnest(s) as claim_id from sk where status = 'active')
select skill_id, count(*) as n_claims, count(distinct src) as n_sources from (select l.skill_id, l.claim_id, unnest(c.source_ids) as src from l join c using (claim_id)) group by skill_id"""
)
def q_skill_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Skill to claims to sources: the evidence path of each active skill."""
    links = _skills(spark, sf).where("status = 'active'").select("skill_id", F.explode("supporting_claim_ids").alias("claim_id"))
    path = links.join(_claims(spark, sf), "claim_id").select("skill_id", "claim_id", F.explode("source_ids").alias("src"))
    return path.groupBy("skill_id").agg(F.count("*").alias("n_claims"), F.countDistinct("src").alias("n_sources"))


@query(
    f"""with s as (select distinct id, list_distinct(list_filter(string_split({_NORM.format(c='title')}, ' '), lambda w: w <> '')) as a, list_distinct(list_filter(string_split({_NORM.format(c='abstract')}, ' '), lambda w: w <> '')) as b
  from sources where title is not null and abstract is not null)
select id, round(case when len(a) > 0 and len(b) > 0 then 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) else 0 end, 6) as dice,
  round(case when len(list_distinct(list_concat(a, b))) > 0 then len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) else 0 end, 6) as jaccard from s"""
)
def q_jaccard_dice(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sources").where("title is not null and abstract is not null")
    t, a = F.col("title"), F.col("abstract")
    return s.select("id", F.round(T.dice(t, a), 6).alias("dice"), F.round(T.jaccard(t, a), 6).alias("jaccard")).distinct()


@query(
    r"""with b as (select age_range, count(*) as n, try_cast(regexp_extract(age_range, '^(\d{1,2})-(\d{1,2})$', 1) as int) as lo, try_cast(regexp_extract(age_range, '^(\d{1,2})-(\d{1,2})$', 2) as int) as hi
  from claims where age_range is not null group by age_range)
select age_range, n, coalesce(lo <= hi and lo <= 8 and hi >= 4, false) as in_first_cycle from b"""
)
def q_age_overlap(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "claims").where("age_range is not null").groupBy("age_range").agg(F.count("*").alias("n"))
    band = T.age_band(F.col("age_range"))
    return c.select("age_range", "n", F.coalesce((band["low"] <= 8) & (band["high"] >= 4), F.lit(False)).alias("in_first_cycle"))


# --- agreement and metrics -----------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "ratings").where("touched and value is not null")
    label = F.regexp_replace(F.lower(F.trim("value")), r"[\s-]+", "_")
    last = r.groupBy("field", F.col("item_key").alias("item"), "rater").agg(F.max(F.struct("rated_at", label.alias("label"))).alias("x"))
    return last.select("field", "item", "rater", "x.label")


_ANSWERS_SQL = r"""an as (select field, item_key as item, rater, arg_max(label, (rated_at, label)) as label
  from (select *, regexp_replace(lower(trim(value)), '[\s-]+', '_', 'g') as label from ratings where touched and value is not null) group by all),
pr as (select x.field, x.item, x.rater as a, y.rater as b, x.label as l, y.label as r from an x join an y on x.field = y.field and x.item = y.item and x.rater < y.rater)"""


@query(
    f"""with {_ANSWERS_SQL}, g as (select field, count(*) as n, sum((l = r)::int) as same from pr group by field),
rw as (select field, l as v, count(*) as c from pr group by all), cl as (select field, r as v, count(*) as c from pr group by all),
ch as (select rw.field, sum(rw.c * cl.c) as rc from rw join cl on rw.field = cl.field and rw.v = cl.v group by rw.field)
select field, n, round(same / n, 6) as agreement, round((n * same - rc)::double / nullif(n * n - rc, 0)::double, 6) as kappa from g join ch using (field)"""
)
def q_cohen(spark: SparkSession, sf: str) -> DataFrame:
    return A.cohen_kappa(A.rater_pairs(_answers(spark, sf)), ["field"])


_SCALE = ("very_low", "low", "moderate", "strong")
_POS = "case {c} " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(_SCALE)) + " end"


@query(
    f"""with {_ANSWERS_SQL}, o as (select field, {_POS.format(c='l')} as i, {_POS.format(c='r')} as j from pr where field = 'evidence_certainty'),
s as (select field, count(*) as n, sum(3 - abs(i - j)) as close from o where i is not null and j is not null group by field),
rw as (select field, i, count(*) as c from o where i is not null and j is not null group by all), cl as (select field, j, count(*) as c from o where i is not null and j is not null group by all),
ch as (select rw.field, sum(rw.c * cl.c * (3 - abs(i - j))) as rc from rw join cl on rw.field = cl.field group by rw.field)
select field, n, (select count(*) from o where i is null or j is null) as n_off_scale, round((n * close - rc)::double / (3 * n * n - rc)::double, 6) as weighted_kappa from s join ch using (field)"""
)
def q_weighted_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return A.weighted_kappa(A.rater_pairs(_answers(spark, sf).where("field = 'evidence_certainty'")), ["field"], _SCALE)


@query(
    f"""with {_ANSWERS_SQL}, c as (select field, item, label, count(*) as c from an group by all), i as (select field, item, sum(c * c) as sq from c group by all having sum(c) = 4),
p as (select field, count(*) as n_items, sum(sq) as sq from i group by field),
s as (select field, sum(t * t) as cc from (select field, label, sum(c) as t from c join i using (field, item) group by all) group by field)
select field, n_items, round(((sq - n_items * 4) / (n_items * 12) - cc / (n_items * 4 * n_items * 4)) / nullif(1 - cc / (n_items * 4 * n_items * 4), 0), 6) as fleiss_kappa from p join s using (field)"""
)
def q_fleiss(spark: SparkSession, sf: str) -> DataFrame:
    return A.fleiss_kappa(_answers(spark, sf), 4)


@query(f"with {_ANSWERS_SQL} select field, l as \"left\", r as \"right\", count(*) as n from pr group by all")
def q_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return A.cross_tab(A.rater_pairs(_answers(spark, sf)), ["field"])


@query(
    f"""with {_ANSWERS_SQL}, s as (select a, b, count(*) as n, sum((l = r)::int) as same from pr group by all)
select a, b, n, round(same / n, 6) as agreement,
  round((same / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(same / n * (1 - same / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as low,
  round((same / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(same / n * (1 - same / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as high from s"""
)
def q_wilson(spark: SparkSession, sf: str) -> DataFrame:
    s = A.rater_pairs(_answers(spark, sf)).groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("left").eqNullSafe(F.col("right"))).alias("same"))
    low, high = A.wilson(F.col("same"), F.col("n"))
    return s.select("a", "b", "n", F.round(F.col("same") / F.col("n"), 6).alias("agreement"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"with {_ANSWERS_SQL}, i as (select field, item, count(*) as m, count(distinct label) as d from an group by all) select field, case when m = 1 then 'single' when d = 1 then 'unanimous' else 'split' end as outcome, count(*) as n from i group by all")
def q_split_items(spark: SparkSession, sf: str) -> DataFrame:
    i = _answers(spark, sf).groupBy("field", "item", "label").agg(F.count("*").alias("c")).groupBy("field", "item").agg(F.sum("c").alias("m"), F.count("*").alias("d"))
    return i.groupBy("field", F.when(F.col("m") == 1, "single").when(F.col("d") == 1, "unanimous").otherwise("split").alias("outcome")).agg(F.count("*").alias("n"))


@query(
    """with t as (select source_type, coalesce(status = 'reviewed', false) as y, coalesce(relevance_score >= 0.3, false) as s from sources),
c as (select source_type, count(*) filter (y and s) as tp, count(*) filter (not y and s) as fp, count(*) filter (y and not s) as fn, count(*) filter (not y and not s) as tn from t group by source_type)
select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c"""
)
def q_confusion(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sources")
    return A.confusion(s, F.coalesce(F.col("status") == "reviewed", F.lit(False)), F.coalesce(F.col("relevance_score") >= 0.3, F.lit(False)), ["source_type"])


@query(
    """with t as (select coalesce(status = 'reviewed', false) as y, round(relevance_score * 100)::int as s from sources), g as (select unnest(range(10, 71, 5))::int as t_),
c as (select t_ as t, count(*) filter (y and coalesce(s >= t_, false)) as tp, count(*) filter (not y and coalesce(s >= t_, false)) as fp,
  count(*) filter (y and not coalesce(s >= t_, false)) as fn, count(*) filter (not y and not coalesce(s >= t_, false)) as tn from t, g group by t_)
select *, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c"""
)
def q_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return A.threshold_sweep(table(spark, sf, "sources"), "relevance_score", F.coalesce(F.col("status") == "reviewed", F.lit(False)), range(10, 71, 5))


@query(
    """with t as (select coalesce(supports_skill_ids, []) as a, coalesce(contradicts_skill_ids, []) as b from claims)
select count(*) as n, sum(len(list_intersect(list_distinct(a), list_distinct(b))))::bigint as tp, sum(len(list_filter(list_distinct(a), lambda x: not list_contains(b, x))))::bigint as fp,
  sum(len(list_filter(list_distinct(b), lambda x: not list_contains(a, x))))::bigint as fn, count(*) filter (len(a) = 0 and len(b) = 0) as both_empty from t"""
)
def q_link_sets(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    a, b = F.coalesce("supports_skill_ids", none), F.coalesce("contradicts_skill_ids", none)
    return table(spark, sf, "claims").agg(
        F.count("*").alias("n"), F.sum(F.size(F.array_intersect(a, b))).alias("tp"), F.sum(F.size(F.array_except(a, b))).alias("fp"),
        F.sum(F.size(F.array_except(b, a))).alias("fn"), F.count_if((F.size(a) == 0) & (F.size(b) == 0)).alias("both_empty"))


# --- vectors -------------------------------------------------------------------------------------------------------


_CENTRE_SQL = """e as (select label, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as dim from embeddings),
m as (select label, dim, avg(x) as m from e group by all), nn as (select label, sqrt(sum(m * m)) as norm from m group by label),
ce as (select label, dim, case when norm > 0 then m / norm else 0 end as value from m join nn using (label))"""


@query(f"with {_CENTRE_SQL} select label, dim, round(value, 5) as value from ce")
def q_vector_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return V.centroids(table(spark, sf, "embeddings"), "label", "embedding").select("label", "dim", F.round("value", 5).alias("value"))


@query(
    f"""with {_CENTRE_SQL}, v as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as dim from embeddings),
d as (select vec_id, ce.label as nearest, sum(x * value) / sqrt(sum(x * x)) as s from v join ce using (dim) group by all)
select vec_id, arg_max(nearest, (round(s, 9), -nearest)) as nearest from d group by vec_id"""
)
def q_nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return V.nearest_centroid(e, "vec_id", "embedding", V.centroids(e, "label", "embedding"), "label").select("vec_id", "nearest")


@query(
    """with recursive e as (select distinct s.id as a, x.id as b from (select 'skill:' || id as id, unnest(topics) as t from skills) s join (select 'topic:' || t as id, t from (select distinct unnest(topics) as t from skills)) x on s.t = x.t),
bo as (select a, b from e union select b, a from e), n as (select distinct a as node from bo),
r(node, c) as (select node, node from n union select b.b, r.c from r join bo b on r.node = b.a)
select node, min(c) as component from r group by node"""
)
def q_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the graph of skills and their topics."""
    e = table(spark, sf, "skills").select(F.concat(F.lit("skill:"), "id").alias("a"), F.explode("topics").alias("t")).where("t is not null")
    e = e.select("a", F.concat(F.lit("topic:"), "t").alias("b")).distinct()
    return V.components(e, e.select(F.explode(F.array("a", "b")).alias("node")))


@query(
    f"""with s as (select distinct id, title from sources where title is not null), k as (select id, unnest(list_filter(string_split({_NORM.format(c='title')}, ' '), lambda w: w <> '')) as t from s),
h as (select id, sha1(t) as h from k), v as (select id, (('0x' || substr(h, 1, 8))::bigint % 256)::int as bucket, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 0 then 1 else -1 end) as value from h group by all),
w as (select * from v where value <> 0) select id, bucket, round(value / sqrt(sum(value * value) over (partition by id)), 6) as value from w"""
)
def q_hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors of hashed title words."""
    s = table(spark, sf, "sources").where("title is not null").select("id", "title").distinct()
    return V.hashed_embedding(s, "id", T.words(F.col("title"))).withColumn("value", F.round("value", 6))


# --- streams as batches --------------------------------------------------------------------------------------------


@query("select user_id, event_type, min(ts) as first_ts, max(ts) as last_ts, arg_max(value, (ts, event_id)) as last_value, count(*) as n from events group by all")
def q_events_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count("*").alias("n"))


@query("select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def q_events_daily(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
