"""Queries of decisions, ledgers, label layers, constraints and comparisons, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.functions import text as T
from strandwise.operators import agreement as A
from strandwise.operators import converters as C
from strandwise.operators import reviews as R
from strandwise.operators import texts as X
from strandwise.operators import validation as V
from strandwise.plans.core import _ANSWERS_SQL, _NORM, _SKILLS_SQL, _answers, _skills
from strandwise.plans.textual import TIERS
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


_HOST = r"regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '^www\.', '')"
_LEDGER_SQL = f"""h as (select distinct id, status, {_HOST} as host from sources),
ld as (select host, count(*) filter (status = 'reviewed') as accepted, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'candidate') as open,
  list_slice(list_sort(list(distinct id)), 1, 3) as examples from h where host <> '' group by host),
lr as (select *, coalesce(accepted / nullif(accepted + rejected, 0), 0) as rate, case when {" or ".join(f"host = '{d}' or host like '%.{d}'" for _, o, d in TIERS if o == 1)} then 'trusted'
  when {" or ".join(f"host = '{d}' or host like '%.{d}'" for _, o, d in TIERS if o == 2)} then 'watch' else 'open' end as tier from ld)"""


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return R.domain_ledger(table(spark, sf, "sources").select("id", "status", "url"))


# --- domains -------------------------------------------------------------------------------------------------------


@query(f"with {_LEDGER_SQL} select host, accepted, rejected, open, round(rate, 6) as rate, array_to_string(examples, '|') as examples from lr")
def q_domain_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions by host with the share accepted and the first three examples."""
    return _ledger(spark, sf).select("host", "accepted", "rejected", "open", F.round("rate", 6).alias("rate"), F.array_join("examples", "|").alias("examples"))


@query(
    f"""with {_LEDGER_SQL} select host, tier, accepted, rejected, case when tier = 'open' and accepted >= 2 and rate >= 0.6 then 'promote' else 'review' end as action from lr
where not (host = 'birch-review.example' or host like '%.birch-review.example') and ((tier = 'open' and accepted >= 2 and rate >= 0.6) or (tier <> 'open' and accepted = 0 and rejected >= 2))"""
)
def q_domain_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts to promote or to review by their decisions; hosts of infrastructure are left out."""
    tiered = X.host_tiers(_ledger(spark, sf), "host", spark.createDataFrame(TIERS, "tier string, tier_order int, domain string"))
    return R.domain_proposals(tiered, ("birch-review.example",)).select("host", "tier", "accepted", "rejected", "action")


@query(
    f"""with h as (select publisher, {_HOST} as host, url, id from sources where publisher is not null and url is not null),
c as (select publisher, host, count(*) as n, min(url) as first_url from h where host <> '' group by all)
select publisher, host, n, first_url from (select *, row_number() over (partition by publisher order by n desc, host) as r from c) where r = 1"""
)
def q_host_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent host of each publisher and its first address."""
    h = table(spark, sf, "sources").where("publisher is not null and url is not null").select("publisher", T.host(F.col("url")).alias("host"), "url").where("host <> ''")
    c = h.groupBy("publisher", "host").agg(F.count("*").alias("n"), F.min("url").alias("first_url"))
    best = c.groupBy("publisher").agg(F.min(F.struct((-F.col("n")).alias("m"), "host", "n", "first_url")).alias("x"))
    return best.select("publisher", "x.host", "x.n", "x.first_url")


# --- constraints ---------------------------------------------------------------------------------------------------

_RELATIONS = (
    ("framework.skill", "select skill_id as key from frameworks", "skills"),
    ("claim.source", "select unnest(source_ids) from claims", "sources"),
    ("claim.supports", "select unnest(supports_skill_ids) from claims", "skills"),
    ("claim.contradicts", "select unnest(contradicts_skill_ids) from claims", "skills"),
    ("skill.supporting", "select unnest(supporting_claim_ids) from skills", "claims"),
    ("skill.contradicting", "select unnest(contradicting_claim_ids) from skills", "claims"),
    ("document.source", "select source_id from documents", "sources"),
    ("rating.item", "select item_key from ratings", "claims"),
)


@query(
    "with "
    + ", ".join(f"r{i} as (select '{n}' as relation, key, count(*) as n from ({q}) t(key) where key is not null and key not in (select id from {p} where id is not null) group by key)" for i, (n, q, p) in enumerate(_RELATIONS))
    + " "
    + " union all ".join(f"select * from r{i}" for i in range(len(_RELATIONS)))
)
def q_fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Keys without a parent in all relations of the catalogue, as they are spelled."""
    t = {n: table(spark, sf, n) for n in ("frameworks", "claims", "skills", "sources", "documents", "ratings")}
    keys = {
        "framework.skill": t["frameworks"].select(F.col("skill_id").alias("key")), "claim.source": t["claims"].select(F.explode("source_ids").alias("key")),
        "claim.supports": t["claims"].select(F.explode("supports_skill_ids").alias("key")), "claim.contradicts": t["claims"].select(F.explode("contradicts_skill_ids").alias("key")),
        "skill.supporting": t["skills"].select(F.explode("supporting_claim_ids").alias("key")), "skill.contradicting": t["skills"].select(F.explode("contradicting_claim_ids").alias("key")),
        "document.source": t["documents"].select(F.col("source_id").alias("key")), "rating.item": t["ratings"].select(F.col("item_key").alias("key")),
    }
    return V.missing_parents({n: (keys[n], t[p].select(F.col("id").alias("key"))) for n, _, p in _RELATIONS})


_TYPES = ("framework", "policy_report", "peer_reviewed_article", "systematic_review", "conceptual_review", "working_paper", "book", "dataset", "web_resource")


@query(
    f"""with s as (select distinct id, title, publisher, url, year, status, source_type, audience, relevance_score, doi from sources),
v as (select id, unnest(list_filter([case when not coalesce(starts_with(id, 'src-'), false) then 'id' end, case when coalesce(trim(title), '') = '' then 'title' end, case when coalesce(trim(publisher), '') = '' then 'publisher' end,
  case when coalesce(trim(url), '') = '' then 'url' end, case when year is not null and year not between 1900 and 2100 then 'year' end, case when coalesce(status, '') not in ('candidate', 'reviewed', 'rejected') then 'status' end,
  case when coalesce(source_type, '') not in {_TYPES} then 'source_type' end, case when audience is not null and audience not in ('learner', 'educator') then 'audience' end,
  case when relevance_score is not null and not relevance_score between 0 and 1 then 'relevance_score' end, case when doi is not null and not regexp_matches(doi, '^10\\.[0-9]{{4,9}}/[^ ]+$') then 'doi' end], lambda r: r is not null)) as rule from s)
select id, rule, count(*) as n from v group by all"""
)
def q_schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of source records that are missing, outside their lists or malformed."""
    s = table(spark, sf, "sources").select("id", "title", "publisher", "url", "year", "status", "source_type", "audience", "relevance_score", "doi").distinct()
    rules = {
        "id": F.col("id").startswith("src-"), **{c: V.filled(c) for c in ("title", "publisher", "url")}, "year": F.col("year").isNull() | F.col("year").between(1900, 2100),
        "status": V.one_of("status", ("candidate", "reviewed", "rejected")), "source_type": V.one_of("source_type", _TYPES), "audience": V.one_of("audience", ("learner", "educator"), optional=True),
        "relevance_score": F.col("relevance_score").isNull() | F.col("relevance_score").between(0, 1), "doi": F.col("doi").isNull() | F.col("doi").rlike(r"^10\.[0-9]{4,9}/[^ ]+$"),
    }
    return V.rule_violations(s, "id", rules).groupBy("id", "rule").agg(F.count("*").alias("n"))


@query(
    """with l as (select *, case when coverage_score >= 2.4 then 'strong' when coverage_score >= 1.5 then 'partial' when coverage_score is not null then 'gap' end as label from frameworks)
select coalesce(framework_group, 'none') as framework_group, coalesce(label, 'none') as label, coalesce(mapping_strength, 'none') as recorded, count(*) as n, round(avg(coverage_score), 6) as mean_coverage from l group by all"""
)
def q_coverage_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Derived coverage labels against the recorded strength."""
    f = table(spark, sf, "frameworks").withColumn("label", V.coverage_label(F.col("coverage_score")))
    names = [F.coalesce(a, F.lit("none")).alias(b) for a, b in (("framework_group", "framework_group"), ("label", "label"), ("mapping_strength", "recorded"))]
    return f.groupBy(*names).agg(F.count("*").alias("n"), F.round(F.avg("coverage_score"), 6).alias("mean_coverage"))


# --- decisions -----------------------------------------------------------------------------------------------------


@query(
    """with d as (select distinct claim_id as id, deleted_at as tm, reason from claim_tombstones), c as (select id, arg_max(status, (loaded_at, status)) as status from claims group by id),
l as (select id, count(*) as n_decisions, max(tm) as last_at, string_agg(coalesce(reason, ''), '|' order by tm, reason nulls first) as reasons from d group by id)
select id, 'rejected' as status, n_decisions, strftime(last_at, '%Y-%m-%d') as last_day, reasons from c join l using (id)"""
)
def q_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with the deletions that came in for them, applied in order; those without any keep their status and are left out here."""
    c = table(spark, sf, "claims").groupBy("id").agg(F.max_by("status", F.struct("loaded_at", "status")).alias("status"))
    d = table(spark, sf, "claim_tombstones").select(F.col("claim_id").alias("id"), F.col("deleted_at").cast("timestamp").alias("at"), F.lit("rejected").alias("status"), "reason")
    done = R.apply_decisions(c, d).where("n_decisions > 0")
    reasons = F.array_join(F.transform("log", lambda x: F.coalesce(x["reason"], F.lit(""))), "|")
    return done.select("id", "status", "n_decisions", F.date_format(F.element_at("log", -1)["at"], "yyyy-MM-dd").alias("last_day"), reasons.alias("reasons"))


@query(
    f"""with {_SKILLS_SQL}, m as (select skill_id, list_sort(list(distinct claim_id)) as more from (select id as claim_id, unnest(supports_skill_ids) as skill_id from claims) group by skill_id)
select sk.skill_id, len(coalesce(s, [])) as n_before, len(coalesce(s, [])) + len(list_filter(coalesce(more, []), lambda x: not list_contains(coalesce(s, []), x))) as n_after,
  md5(array_to_string(list_concat(coalesce(s, []), list_filter(coalesce(more, []), lambda x: not list_contains(coalesce(s, []), x))), ',')) as digest from sk left join m using (skill_id)"""
)
def q_attach_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Skills with the claims that say they support them appended to their lists, those that are not there yet."""
    s = _skills(spark, sf).select(F.col("skill_id").alias("id"), "supporting_claim_ids", F.size(F.coalesce("supporting_claim_ids", F.array().cast("array<string>"))).cast("long").alias("n_before"))
    links = table(spark, sf, "claims").select(F.explode("supports_skill_ids").alias("id"), F.col("id").alias("ref")).distinct()
    out = R.attach(s, links, "supporting_claim_ids")
    return out.select(F.col("id").alias("skill_id"), "n_before", F.size("supporting_claim_ids").cast("long").alias("n_after"), F.md5(F.array_join("supporting_claim_ids", ",")).alias("digest"))


@query(
    f"""with {_SKILLS_SQL} select skill_id, case when evidence_score >= 0.75 and len(coalesce(s, [])) between 1 and 3 then 'strong but thin' when evidence_score <= 0.7 and len(coalesce(s, [])) >= 6 then 'broad but weak' end as note
from sk where (evidence_score >= 0.75 and len(coalesce(s, [])) between 1 and 3) or (evidence_score <= 0.7 and len(coalesce(s, [])) >= 6)"""
)
def q_quality_breadth_note(spark: SparkSession, sf: str) -> DataFrame:
    """Skills whose quality and breadth pull apart."""
    n = F.coalesce(F.size("supporting_claim_ids"), F.lit(0))
    note = F.when((F.col("evidence_score") >= 0.75) & n.between(1, 3), "strong but thin").when((F.col("evidence_score") <= 0.7) & (n >= 6), "broad but weak")
    return _skills(spark, sf).select("skill_id", note.alias("note")).where("note is not null")


# --- labels and comparisons ----------------------------------------------------------------------------------------


@query(
    f"""with cu as (select id, title from sources where status = 'reviewed' and title is not null group by all), ha as (select id, title, harvested_at as tm from source_batch where title is not null),
ck as (select {_NORM.format(c='title')} as k, count(*) as n from cu group by 1), hk as (select {_NORM.format(c='title')} as k, min(tm) as tm from ha where {_NORM.format(c='title')} not in (select k from ck) group by 1)
select 'curated' as origin, sum(n)::bigint as n, count(*) as n_titles from ck union all select 'harvested', count(*), count(*) from hk"""
)
def q_label_union(spark: SparkSession, sf: str) -> DataFrame:
    """Curated records and the first harvested one of each other title."""
    cu = table(spark, sf, "sources").where("status = 'reviewed' and title is not null").select("id", "title").distinct().withColumn("at", F.lit(None).cast("timestamp"))
    ha = table(spark, sf, "source_batch").where("title is not null").select("id", "title", F.col("harvested_at").cast("timestamp").alias("at"))
    u = R.curated_first(cu, ha, ["at", "id"])
    return u.groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct(T.normalize_title(F.col("title"))).alias("n_titles"))


@query(
    f"""with {_ANSWERS_SQL}, p0 as (select field, item, arg_min(label, rater) as old from an group by all), p1 as (select field, item, arg_max(label, rater) as new from an group by all)
select field, old as stored, new as label, count(*) as n from p0 join p1 using (field, item) group by all"""
)
def q_label_layers(spark: SparkSession, sf: str) -> DataFrame:
    """The first rater's labels under those of the last one: cross table of the two layers."""
    a = _answers(spark, sf)
    old = a.groupBy("field", "item").agg(F.min_by("label", "rater").alias("stored"))
    new = a.groupBy("field", "item").agg(F.max_by("label", "rater").alias("label"))
    return old.join(new, ["field", "item"]).groupBy("field", "stored", "label").agg(F.count("*").alias("n"))


@query(
    f"""with {_ANSWERS_SQL}, e as (select pr.*, t.claim_id is not null as exposed from pr left join (select distinct claim_id from claim_tombstones) t on t.claim_id = item),
c as (select field, count(*) as n, count(*) filter (exposed) as n_exposed, count(*) filter (exposed and l = r) as same_exposed, count(*) filter (not exposed and l = r) as same_clean from e group by field)
select field, n, n_exposed, same_exposed, same_clean, round(same_exposed / nullif(n_exposed, 0), 6) as exposed_agreement, round(same_clean / nullif(n - n_exposed, 0), 6) as clean_agreement, n >= 40 as ready from c"""
)
def q_exposed_split(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of raters on items that were deleted since and on all others, and whether there are enough for a floor."""
    named = table(spark, sf, "claim_tombstones").select(F.col("claim_id").alias("item")).distinct().withColumn("exposed", F.lit(True))
    p = A.rater_pairs(_answers(spark, sf)).join(named, "item", "left").withColumn("exposed", F.coalesce("exposed", F.lit(False)))
    return R.split_agreement(p, "exposed", ["field"]).withColumn("ready", R.gate_ready(F.col("n"), F.lit(True), F.lit(False)))


_FIELDS_SQL = f"""{_ANSWERS_SQL}, vt as (select field, item, label, count(*) as n from an group by all), gold as (select field, item, mode_label from (select field, item, label as mode_label, row_number() over (partition by field, item order by n desc, label) as r from vt) where r = 1),
mt as (select rater as provider, field, count(*) filter (label = mode_label) as hits, count(*) as predicted from an join gold using (field, item) group by all)"""


def _rater_metrics(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf)
    votes = a.groupBy("field", "item", "label").agg(F.count("*").alias("n"))
    gold = votes.groupBy("field", "item").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("x")).select("field", "item", F.col("x.label").alias("gold"))
    m = a.join(gold, ["field", "item"])
    return m.groupBy(F.col("rater").alias("provider"), "field").agg(F.count_if(F.col("label") == F.col("gold")).alias("hits"), F.count("*").alias("predicted"))


@query(f"with {_FIELDS_SQL} select provider, sum(hits)::bigint as hits, sum(predicted)::bigint as predicted, round(sum(hits) / sum(predicted), 6) as precision from mt where field in ('study_design', 'effect_direction') group by provider")
def q_micro_average(spark: SparkSession, sf: str) -> DataFrame:
    """Precision of each rater against the plurality, pooled over two fields."""
    m = _rater_metrics(spark, sf).where(F.col("field").isin("study_design", "effect_direction"))
    return m.groupBy("provider").agg(F.sum("hits").alias("hits"), F.sum("predicted").alias("predicted")).withColumn("precision", F.round(F.col("hits") / F.col("predicted"), 6))


@query(
    f"""with {_FIELDS_SQL}, g as (select * from mt where field in ('study_design', 'effect_direction')), inc as (select min(provider) as p from g), pool as (select provider, sum(hits) / sum(predicted) as v from g group by provider),
w as (select g.provider, min(g.hits / g.predicted - b.hits / b.predicted) as worst from g join g b on b.field = g.field and b.provider = (select p from inc) group by g.provider),
d as (select pool.provider, pool.v - (select v from pool where provider = (select p from inc)) as delta, worst from pool join w using (provider) where pool.provider <> (select p from inc))
select provider, round(delta, 6) as delta, round(worst, 6) as worst, case when delta <= 0.02 then case when delta >= -0.02 then 'ties' else 'loses' end when worst < -0.05 then 'regresses' else 'activate' end as verdict from d"""
)
def q_provider_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a rater may take the place of the first one: better on the whole, and on no field much worse."""
    m = _rater_metrics(spark, sf)
    first = m.agg(F.min("provider")).first()[0]  # one name
    return R.verdict(m, first, ("study_design", "effect_direction"))


@query(
    r"""with c as (select age_range as gold, coalesce(appraisal.age_range_explicit, 'none') as said, count(*) as n from claims where age_range is not null group by all),
x as (select *, list_transform(regexp_extract_all(gold, '\d+'), lambda v: v::int) as g, list_transform(regexp_extract_all(said, '\d+'), lambda v: v::int) as p from c)
select gold, said, n, case when len(g) = 0 or len(p) = 0 then lower(trim(gold)) = lower(trim(said)) else list_min(g) <= list_max(p) and list_min(p) <= list_max(g) and abs(list_min(g) - list_min(p)) <= 1 and abs(list_max(g) - list_max(p)) <= 2 end as match from x"""
)
def q_age_match(spark: SparkSession, sf: str) -> DataFrame:
    """Whether recorded and read age bands agree within a tolerance."""
    said = F.coalesce("appraisal.age_range_explicit", F.lit("none")).alias("said")
    c = table(spark, sf, "claims").where("age_range is not null").groupBy(F.col("age_range").alias("gold"), said).agg(F.count("*").alias("n"))
    return c.withColumn("match", T.ages_match(F.col("gold"), F.col("said")))


@query(
    f"""with q as (select id as qid, title, year from source_batch where title is not null and doi is not null), c as (select distinct doi, id as cid, title, year from sources where title is not null and doi is not null),
j as (select q.qid, c.cid, q.year as y1, c.year as y2, list_distinct(list_filter(string_split({_NORM.format(c='q.title')}, ' '), lambda w: w <> '')) as a, list_distinct(list_filter(string_split({_NORM.format(c='c.title')}, ' '), lambda w: w <> '')) as b
  from q join source_batch sb on sb.id = q.qid join c on lower(sb.doi) = lower(c.doi)),
s as (select *, case when len(a) > 0 and len(b) > 0 then 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) else 0 end as sim from j)
select qid, cid, round(sim, 6) as similarity from (select *, row_number() over (partition by qid order by sim + case when y1 = y2 then 0.1 else 0 end desc, cid) as r from s where sim >= 0.7 and coalesce(abs(y1 - y2) <= 1, true)) where r = 1"""
)
def q_best_title(spark: SparkSession, sf: str) -> DataFrame:
    """For each harvested record the record of the same DOI with the closest title, if it is close enough."""
    q = table(spark, sf, "source_batch").where("title is not null and doi is not null").select(F.col("id").alias("qid"), "title", "year", F.lower("doi").alias("k"))
    c = table(spark, sf, "sources").where("title is not null and doi is not null").select(F.lower("doi").alias("k"), F.col("id").alias("cid"), "title", "year").distinct()
    order = F.dense_rank().over(Window.partitionBy("qid").orderBy("cid"))
    hits = q.select("qid", "k").join(c, "k").select("qid", "cid", "title", "year", order.alias("ord"))
    return R.best_by_title(q, hits).withColumn("similarity", F.round("similarity", 6))


@query(
    """with h as (select id, batch_id, sha256(coalesce(statement, '')) as k from claim_batch), c as (select distinct sha256(coalesce(statement, '')) as k from claims)
select batch_id, count(*) as n, count(c.k) as n_cached from h left join c using (k) group by batch_id"""
)
def q_cached_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of a batch that a content-addressed store already answers."""
    key = F.sha2(F.coalesce("statement", F.lit("")), 256).alias("k")
    stored = table(spark, sf, "claims").select(key).distinct().withColumn("hit", F.lit(1))
    return table(spark, sf, "claim_batch").select("batch_id", key).join(stored, "k", "left").groupBy("batch_id").agg(F.count("*").alias("n"), F.count("hit").alias("n_cached"))


@query(
    """with d as (select ts::date as day, user_id, min(ts::date) over (partition by user_id) as first_day from events), r as (select day, count(distinct user_id) as n_users, count(distinct case when day = first_day then user_id end) as n_new from d group by day),
g as (select *, sum((n_new > 0)::int) over (order by day) as run from r)
select day, n_users, n_new, (sum((n_new = 0)::int) over (partition by run order by day))::int as barren from g"""
)
def q_barren_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Days in a row on which no new user came; the window runs over days, not rows."""
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "user_id").distinct()
    first = e.groupBy("user_id").agg(F.min("day").alias("first_day"))
    r = e.join(first, "user_id").groupBy("day").agg(F.count("*").alias("n_users"), F.count_if(F.col("day") == F.col("first_day")).alias("n_new"))
    return R.barren_rounds(r.withColumn("all", F.lit(1)), "all", "day", "n_new").drop("all")


@query(
    r"""with m as (select doc_id, trim(coalesce(text, '')) as t, regexp_replace(regexp_extract(trim(coalesce(text, '')), '(?i)(https?://\S+)', 1), '[.,;:!?»''"]+$', '') as url from documents),
k as (select *, case when url <> '' then trim(replace(t, url, '')) else t end as prose from m),
l as (select case when starts_with(t, '/') then 'command' when length(prose) >= 200 or lower(split_part(split_part(url, '?', 1), '#', 1)) like '%.pdf' then 'submission' when t <> '' then 'guidance' else 'ignore' end as kind, url <> '' as has_url from k)
select kind, has_url, count(*) as n from l group by all"""
)
def q_message_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as messages: what an intake would do with them."""
    d = table(spark, sf, "documents")
    return d.groupBy(R.message_kind(F.col("text")).alias("kind"), F.coalesce(F.col("text").rlike(r"(?i)https?://\S"), F.lit(False)).alias("has_url")).agg(F.count("*").alias("n"))


@query(
    r"""with l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:25] as ls from documents),
f as (select doc_id, list_filter(ls, lambda x: length(x) between 15 and 200 and not regexp_matches(x, '\.{4,}|^\d+(\s|\.|$)') and length(regexp_replace(x, '[^A-Za-zÄÖÜäöüß]', '', 'g')) * 2 >= length(x)) as fit from l),
b as (select doc_id, fit, list_max(list_transform(fit, lambda x: length(x))) as n from f)
select doc_id, md5(coalesce(list_filter(fit, lambda x: length(x) = n)[1], '')) as title_digest from b"""
)
def q_guess_title(spark: SparkSession, sf: str) -> DataFrame:
    """The line of each text that is most likely its title (as a digest)."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.guess_title(F.col("text"))).alias("title_digest"))


@query(
    """with s as (select id, max(status) as status from sources group by id), r as (select id, status, row_number() over (partition by status order by sha256('7:' || id), id) as r from s where status is not null)
select id, status, r::int as place from r where r <= 20"""
)
def q_seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty records of each status in a seeded order (the sample is the feature)."""
    s = table(spark, sf, "sources").groupBy("id").agg(F.max("status").alias("status")).where("status is not null")
    # a sample keeps the smallest hashes, so ranges that can't reach it are cut before the ranking
    h = s.withColumn("h", F.sha2(F.concat(F.lit("7:"), "id"), 256))
    return h.withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy("h", "id"))).where("place <= 20").select("id", "status", "place")


@query(
    """with a as (select unnest(topics) as topic, id, relevance_score as s, loaded_at as t from sources where topics is not null), b as (select topic, id, max(s) as s, max(t) as t from a where topic is not null group by all),
r as (select *, row_number() over (partition by topic order by s desc nulls last, id) as by_score, row_number() over (partition by topic order by t desc, id) as by_time from b)
select topic, count(*) filter (by_score <= 25 and by_time <= 25) as n_both, count(*) filter (by_score <= 25) as n_top from r group by topic"""
)
def q_rank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How much the 25 best records of a topic by score and by time have in common."""
    b = table(spark, sf, "sources").select(F.explode("topics").alias("topic"), "id", "relevance_score", "loaded_at").where("topic is not null").groupBy("topic", "id").agg(F.max("relevance_score").alias("s"), F.max("loaded_at").alias("t"))
    w = Window.partitionBy("topic")
    r = b.select("topic", F.row_number().over(w.orderBy(F.desc_nulls_last("s"), "id")).alias("a"), F.row_number().over(w.orderBy(F.desc("t"), "id")).alias("b"))
    return r.groupBy("topic").agg(F.count_if((F.col("a") <= 25) & (F.col("b") <= 25)).alias("n_both"), F.count_if(F.col("a") <= 25).alias("n_top"))


@query(
    """with c as (select id, context, list_sort(list_distinct(supports_skill_ids)) as k from claims where status = 'candidate' group by all), b as (select id, unnest(k) as skill_id from c)
select skill_id, count(*) as n_open, count(distinct id) as n_claims from b where skill_id is not null group by skill_id"""
)
def q_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Open claims by the skill they would support."""
    c = table(spark, sf, "claims").where("status = 'candidate'").select("id", "context", F.array_sort(F.array_distinct("supports_skill_ids")).alias("k")).distinct()
    b = c.select("id", F.explode("k").alias("skill_id")).where("skill_id is not null")
    return b.groupBy("skill_id").agg(F.count("*").alias("n_open"), F.countDistinct("id").alias("n_claims"))


@query(
    """with w as (select distinct id, regexp_replace(doi, '(?i)^https?://(dx\\.)?doi\\.org/', '') as doi, coalesce(nullif(primary_location.source.display_name, ''), primary_location.source.display_name, 'OpenAlex') as publisher, primary_location.license as license,
  md5(array_to_string(list_transform(list_sort(flatten(list_transform(map_entries(abstract_inverted_index), lambda e: list_transform(e.value, lambda p: {'p': p, 'w': e.key})))), lambda x: x.w), ' ')) as abstract_digest,
  coalesce(nullif(doi, ''), case when regexp_replace(doi, '(?i)^https?://(dx\\.)?doi\\.org/', '') is not null and doi = '' then 'https://doi.org/' end, id) as url from openalex_works)
select id, doi, publisher, license, abstract_digest, count(*) as n from w group by all"""
)
def q_openalex_records(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue works as flat records: DOI without resolver, abstract from its index."""
    w = C.from_openalex(table(spark, sf, "openalex_works")).select(F.col("openalex_id").alias("id"), "doi", "publisher", "license", F.md5("abstract").alias("abstract_digest"), "url").distinct()
    return w.groupBy("id", "doi", "publisher", "license", "abstract_digest").agg(F.count("*").alias("n"))
