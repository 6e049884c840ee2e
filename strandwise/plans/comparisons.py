"""Queries that compare, order and fall back: topic groups, gates, label sets, thresholds, chains of backends, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions import text as T
from strandwise.operators import reviews as R
from strandwise.operators import texts as X
from strandwise.operators import validation as V
from strandwise.operators import vectors as E
from strandwise.plans.core import _ANSWERS_SQL, _NORM, _SKILLS_SQL, _answers, _skills
from strandwise.plans.ledger import _HOST, _LEDGER_SQL, _ledger
from strandwise.plans.textual import TIERS
from strandwise.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_KEY = "trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    """with c as (select distinct id, outcome as topic from claims where status = 'candidate' and outcome is not null)
select topic, count(*) as n, min(id) as first_id, max(id) as last_id, bit_xor(hash_) as members from (select *, ('0x' || substr(md5(id), 1, 15))::bigint as hash_ from c) group by topic having count(*) >= 3"""
)
def q_topic_members(spark: SparkSession, sf: str) -> DataFrame:
    """Topics with three open claims or more; the members come as an exclusive or of their hashes, which gathers no group."""
    c = table(spark, sf, "claims").where("status = 'candidate' and outcome is not null").select("id", F.col("outcome").alias("topic")).distinct()
    h = F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("long")
    return c.groupBy("topic").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.bit_xor(h).alias("members")).where("n >= 3")


@query(
    """with p as (select a.label = b.label as same, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as s from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select case when same then 'matching' else 'control' end as kind, count(*) as n, round(max(s), 5) as highest, round(avg((s >= 0.6)::int), 6) as share_above from p group by 1"""
)
def q_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Cosines of pairs of one label against pairs of two: what a threshold of 0.60 lets through."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("label2"), F.col("embedding").alias("embedding2"))
    s = F.round(E.cosine(F.col("embedding"), F.col("embedding2")), 6)
    p = e.join(other, "vec_id").select(F.when(F.col("label") == F.col("label2"), "matching").otherwise("control").alias("kind"), s.alias("s"))
    return p.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.max("s"), 5).alias("highest"), F.round(F.avg((F.col("s") >= 0.6).cast("int")), 6).alias("share_above"))


@query(
    f"""with {_SKILLS_SQL}, m as (select f.id, f.framework, s.skill_id, coalesce(s.name, '') as name, f.coverage_score from frameworks f join sk s on s.skill_id = f.skill_id where f.coverage_score is not null)
select id, skill_id, name, coverage_score, rank() over (partition by framework order by coverage_score) as gap_rank from m"""
)
def q_coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Mappings of known skills with their rank inside a framework, gaps first; the rank comes from counts per score."""
    f = table(spark, sf, "frameworks").where("coverage_score is not null").select("id", "framework", "skill_id", "coverage_score")
    m = f.join(_skills(spark, sf).select("skill_id", F.coalesce("name", F.lit("")).alias("name")), "skill_id")
    levels = m.groupBy("framework", "coverage_score").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("framework").orderBy("coverage_score").rowsBetween(Window.unboundedPreceding, -1))
    ranks = levels.select(F.col("framework").alias("f"), F.col("coverage_score").alias("c"), (F.coalesce(below, F.lit(0)) + 1).alias("gap_rank"))
    return m.join(ranks, F.col("framework").eqNullSafe(F.col("f")) & (F.col("coverage_score") == F.col("c"))).select("id", "skill_id", "name", "coverage_score", "gap_rank")


@query(
    f"""with a as (select {_KEY.format(c='title')} as k, max(status) as l from sources where title is not null group by 1), b as (select {_KEY.format(c='title')} as k, min(status) as r from source_batch where title is not null group by 1)
select l, r, count(*) as n from a join b using (k) where k <> '' group by all"""
)
def q_label_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Two sets of labels where both know a title (spelling alike but for case and marks): their cross table."""
    k = T.plain_key(F.col("title")).alias("k")
    a = table(spark, sf, "sources").where("title is not null").groupBy(k).agg(F.max("status").alias("l"))
    b = table(spark, sf, "source_batch").where("title is not null").groupBy(k).agg(F.min("status").alias("r"))
    return a.join(b, "k").where("k <> ''").groupBy("l", "r").agg(F.count("*").alias("n"))


@query(
    f"""with {_SKILLS_SQL}, cl as (select id, arg_max(status, (loaded_at, status)) as status from claims group by id), l as (select distinct skill_id, status, unnest(s) as cid from sk where status = 'active'),
v as (select skill_id, count(*) filter (cl.status = 'reviewed') as n_reviewed, count(*) filter (cl.status <> 'reviewed') as n_open, count(*) filter (cl.id is null) as n_unknown from l left join cl on cl.id = cid group by skill_id)
select skill_id, n_reviewed, n_open, n_unknown from v where n_reviewed = 0 or n_open > 0 or n_unknown > 0"""
)
def q_activation_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Active skills that rest on claims which are not reviewed or not known."""
    cl = table(spark, sf, "claims").groupBy(F.col("id").alias("cid")).agg(F.max_by("status", F.struct("loaded_at", "status")).alias("st"))
    links = _skills(spark, sf).where("status = 'active'").select("skill_id", F.explode("supporting_claim_ids").alias("cid")).distinct()
    v = links.join(cl.withColumn("known", F.lit(True)), "cid", "left").groupBy("skill_id").agg(
        F.count_if(F.col("st") == "reviewed").alias("n_reviewed"), F.count_if(F.col("st") != "reviewed").alias("n_open"), F.count_if(F.col("known").isNull()).alias("n_unknown"))
    return v.where("n_reviewed = 0 or n_open > 0 or n_unknown > 0")


@query(
    f"""with {_LEDGER_SQL} select host, accepted, rejected, round(rate, 6) as rate, r::int as place from (select *, row_number() over (order by accepted desc, rate desc, host) as r from lr) where r <= 20"""
)
def q_ledger_top(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty hosts with most accepted records (the limit is the feature)."""
    top = _ledger(spark, sf).orderBy(F.desc("accepted"), F.desc("rate"), "host").limit(20)
    place = F.row_number().over(Window.orderBy(F.desc("accepted"), F.desc("rate"), "host"))
    return top.select("host", "accepted", "rejected", F.round("rate", 6).alias("rate"), place.alias("place"))


@query(
    f"""with {_SKILLS_SQL}, q0 as (select 0 as o, 0 as p, trim(q) as q from (values ('media literacy pupils'), (' critical thinking '), ('critical thinking'), ('')) t(q)
  union all select 1, 0, trim(lower(name) || case when audience = 'educator' then ' teacher competence' else ' pupils' end) from sk where status = 'active' and name is not null)
select q as query, min(o)::int as origin from q0 where q <> '' group by q"""
)
def q_query_union(spark: SparkSession, sf: str) -> DataFrame:
    """Base queries and those derived from active skills, each once, with where it came from first."""
    base = spark.createDataFrame([(0, q) for q in ("media literacy pupils", " critical thinking ", "critical thinking", "")], "origin int, query string")
    own = F.concat(F.lower("name"), F.when(F.col("audience") == "educator", F.lit(" teacher competence")).otherwise(F.lit(" pupils")))
    derived = _skills(spark, sf).where("status = 'active' and name is not null").select(F.lit(1).alias("origin"), own.alias("query"))
    both = base.unionByName(derived).select("origin", F.trim("query").alias("query")).where("query <> ''")
    return both.groupBy("query").agg(F.min("origin").alias("origin"))


@query(
    f"""with w as (select distinct id, outcome, context, evidence_strength, appraisal.evidence_certainty as certainty from claims where outcome is not null),
t as (select *, list_distinct(list_filter(string_split({_NORM.format(c='outcome')}, ' '), lambda x: x <> '')) as a, list_distinct(list_filter(string_split({_NORM.format(c="coalesce(context, '')")}, ' '), lambda x: x <> '')) as b from w)
select 'outcome' as field, count(*) filter (case when len(list_distinct(list_concat(a, b))) > 0 then len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) else 0 end >= 0.5) as hits, count(*) as n from t
union all select 'strength', count(*) filter (lower(trim(evidence_strength)) = lower(trim(certainty))), count(*) from t"""
)
def q_text_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement by field: free text by half of the words in common, closed lists exactly but for case and blanks."""
    w = table(spark, sf, "claims").where("outcome is not null").select("id", "outcome", "context", "evidence_strength", F.col("appraisal.evidence_certainty").alias("certainty")).distinct()
    free = T.jaccard(F.col("outcome"), F.coalesce("context", F.lit(""))) >= 0.5
    closed = F.lower(F.trim("evidence_strength")) == F.lower(F.trim("certainty"))
    counts = w.agg(F.count_if(free).alias("a"), F.count_if(closed).alias("b"), F.count("*").alias("n"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("hits"), F.col("n")) for f, c in (("outcome", "a"), ("strength", "b"))])).alias("x")).select("x.*")


@query(
    f"""with {_ANSWERS_SQL}, c as (select field, l as "left", r as "right", count(*) as n from pr where l <> r group by all)
select field, "left", "right", n, place::int as place from (select *, row_number() over (partition by field order by n desc, "left" desc, "right" desc) as place from c) where place <= 10"""
)
def q_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent disagreements of each field; the window runs over pairs of labels, not over answers."""
    from strandwise.operators.agreement import cross_tab, rater_pairs

    c = cross_tab(rater_pairs(_answers(spark, sf)).where(F.col("left") != F.col("right")), ["field"])
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), F.desc("left"), F.desc("right")))
    return c.withColumn("place", place).where("place <= 10")


@query(
    """with s as (select id, max({'loaded_at': loaded_at, 'n': name, 'd': name_de, 't': trend}) as x from skills group by id)
select id, coalesce(nullif(trim(x.d), ''), nullif(trim(x.n), ''), id) as name, case x.t when 'growing' then 'up' when 'emerging' then 'up' when 'declining' then 'down' when 'stable' then 'level' else coalesce(x.t, 'none') end as trend from s"""
)
def q_display_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with their fallbacks, and labels of an enumeration with unknown ones shown as they are."""
    s = table(spark, sf, "skills").groupBy("id").agg(F.max(F.struct("loaded_at", F.col("name").alias("n"), F.col("name_de").alias("d"), F.col("trend").alias("t"))).alias("x"))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    label = F.create_map(*[F.lit(v) for pair in (("growing", "up"), ("emerging", "up"), ("declining", "down"), ("stable", "level")) for v in pair])
    return s.select("id", F.coalesce(filled("x.d"), filled("x.n"), "id").alias("name"), F.coalesce(F.try_element_at(label, "x.t"), "x.t", F.lit("none")).alias("trend"))


@query(
    f"""with s as (select id as source_id, max(url) as url from sources group by id), st as (select source_id, case when {" or ".join(f"host = '{d}' or host like '%.{d}'" for _, o, d in TIERS if o == 1)} then 2 when {" or ".join(f"host = '{d}' or host like '%.{d}'" for _, o, d in TIERS if o == 2)} then 1 else 0 end as boost
  from (select source_id, {_HOST} as host from s)),
c as (select distinct id, unnest(source_ids) as source_id from claims where status = 'candidate')
select id, count(*) as n_sources, count(*) filter (st.source_id is null) as n_missing, sum(coalesce(boost, 0))::bigint as boost from c left join st using (source_id) group by id"""
)
def q_triage(spark: SparkSession, sf: str) -> DataFrame:
    """Open claims with their sources, how many of them are missing, and the boost of the hosts' tiers."""
    s = table(spark, sf, "sources").groupBy(F.col("id").alias("source_id")).agg(F.max("url").alias("url")).withColumn("host", T.host(F.col("url")))
    tiered = X.host_tiers(s, "host", spark.createDataFrame(TIERS, "tier string, tier_order int, domain string"))
    boost = F.when(F.col("tier") == "trusted", 2).when(F.col("tier") == "watch", 1).otherwise(0)
    c = table(spark, sf, "claims").where("status = 'candidate'").select("id", F.explode("source_ids").alias("source_id")).distinct()
    j = c.join(tiered.select("source_id", boost.alias("boost"), F.lit(True).alias("known")), "source_id", "left")
    return j.groupBy("id").agg(F.count("*").alias("n_sources"), F.count_if(F.col("known").isNull()).alias("n_missing"), F.sum(F.coalesce("boost", F.lit(0))).alias("boost"))


@query(
    f"""with h as (select {_NORM.format(c='title')} as query, 1 as o, id from sources where title is not null union all select {_NORM.format(c='display_name')}, 2, id from openalex_works where display_name is not null
  union all select {_NORM.format(c='title')}, 3, id from source_batch where title is not null),
f as (select query, min(o) as o from h group by query) select f.o::int as backend_order, count(distinct f.query) as n_queries, count(distinct id) as n_hits from h join f on f.query = h.query and f.o = h.o where f.query <> '' group by f.o"""
)
def q_first_backend(spark: SparkSession, sf: str) -> DataFrame:
    """Titles answered by the first of three catalogues that has them."""
    parts = [table(spark, sf, t).where(f"{c} is not null").select(T.normalize_title(F.col(c)).alias("query"), F.lit(o).alias("backend_order"), "id") for t, c, o in (("sources", "title", 1), ("openalex_works", "display_name", 2), ("source_batch", "title", 3))]
    hits = R.first_backend(parts[0].unionByName(parts[1]).unionByName(parts[2])).where("query <> ''")
    return hits.groupBy("backend_order").agg(F.countDistinct("query").alias("n_queries"), F.countDistinct("id").alias("n_hits"))


@query(
    """with k as (select 'source' as kind, id, status from sources union all select 'claim', id, status from claims union all select 'skill', id, status from skills)
select kind, status, count(distinct id) as n from k where status in ('candidate', 'reviewed', 'rejected', 'active', 'deprecated') group by all"""
)
def q_known_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Records by kind and status; a status that no list names ends the query with an error."""
    parts = [table(spark, sf, t).select(F.lit(k).alias("kind"), "id", V.known_only(F.col("status"), ("candidate", "reviewed", "rejected", "active", "deprecated"), "status").alias("status")) for k, t in (("source", "sources"), ("claim", "claims"), ("skill", "skills"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("status is not null").groupBy("kind", "status").agg(F.countDistinct("id").alias("n"))
